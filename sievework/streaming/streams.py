"""Structured Streaming forms of the pipeline. Each takes a streaming or a batch frame: the same plan serves both, so a stream
that has seen all rows equals its batch twin. Results of streams are put into a `sources.keyed.KeyedTable`, whose sink takes each batch
once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions import columns as C
from ..operators import skills as S
from ..operators import text as X
from . import state


def _millis(interval: str) -> int:
    """Of an interval like `1 hour`."""
    n, unit = interval.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def ingest_dedup(uploads: DataFrame, keys: list[str], ts: str, order: list[str] | None = None, late: str = "1 hour", forget: str = "7 days") -> DataFrame:
    """The first upload of each key, by time and then by the `order` columns.

    A stream holds the first row that it has seen and gives it out when the watermark passes it, as then no earlier one can come; it
    drops further uploads of the key until the watermark is `forget` past the first. A batch needs neither. Rows without time are left out.
    """
    order = order or []
    rows = uploads.where(F.col(ts).isNotNull())
    if not uploads.isStreaming:
        return rows.groupBy(*keys).agg(F.min_by(F.struct(*uploads.columns), F.struct(ts, *order)).alias("r")).select("r.*")
    rows, held = _timed(rows, ts, late)
    first = state.First(held, "__at", order, _millis(forget))
    return _untimed(rows.groupBy(*keys).transformWithState(first, held, "Append", "EventTime"), uploads, ts)


def _timed(rows: DataFrame, ts: str, late: str) -> tuple[DataFrame, StructType]:
    """rows with watermark and a column of microseconds, and the schema of what state holds of them."""
    rows = rows.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp"))).withWatermark(ts, late)
    return rows, StructType([f for f in rows.schema.fields if f.name != ts])


def _untimed(out: DataFrame, like: DataFrame, ts: str, *more: str) -> DataFrame:
    back = F.timestamp_micros("__at").cast(like.schema[ts].dataType).alias(ts)
    return out.select(*[back if c == ts else c for c in like.columns], *more)


def enrich(docs: DataFrame, text: str, skills: list[str], synonyms: list[tuple[str, str]], categories: dict[str, str]) -> DataFrame:
    """Stateless features of a document: words, content_hash, years, skills, categories (a map to skills) and sections."""
    t = F.col(text)
    of = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv))
    out = docs.withColumns({"words": C.word_count(t), "content_hash": C.content_hash(t), "years": C.years_of_experience(t), "skills": S.found(t, skills, synonyms), "sections": X.sections(t)})
    named = F.transform("skills", lambda k: F.struct(F.coalesce(F.element_at(of, k), F.lit("Other Skills")).alias("category"), k.alias("skill")))
    groups = F.array_sort(F.array_distinct(F.transform(named, lambda x: x["category"])))
    return out.withColumn("categories", F.map_from_entries(F.transform(groups, lambda g: F.struct(g, F.transform(F.filter(named, lambda x: x["category"] == g), lambda x: x["skill"])))))


def stage_windows(events: DataFrame, ts: str, stage: str, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts of each stage in tumbling or sliding windows: start, stage, n."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(w.alias("w"), stage).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), stage, "n")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, end and events of each session."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def rate_limit(events: DataFrame, ts: str, user: str, limit: int, size: str = "1 minute", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Sliding windows in which a user passes the limit."""
    return stage_windows(events, ts, user, size, slide, late).where(F.col("n") > limit)


def latest_stage(events: DataFrame, key: str, ts: str, stage: str, late: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """key, ts and stage: the newest stage of each key, the larger on ties. Rows without time are left out.

    A stream (for update mode) gives a row, `closed` false, whenever a key's stage is a newer one, whatever order rows come in within
    the watermark, and one with `closed` true when the watermark is `idle` past the newest; then it forgets the key. In a batch
    `closed` is false.
    """
    rows = events.where(F.col(ts).isNotNull()).select(key, ts, stage)
    if not events.isStreaming:
        return rows.groupBy(key).agg(F.max_by(F.struct(ts, stage), F.struct(ts, stage)).alias("r")).select(key, "r.*", F.lit(False).alias("closed"))
    timed, held = _timed(rows, ts, late)
    newest = state.Latest(held, "__at", [stage], _millis(idle))
    schema = StructType([*held.fields, StructField("closed", BooleanType())])
    return _untimed(timed.groupBy(key).transformWithState(newest, schema, "Update", "EventTime"), rows, ts, "closed")
