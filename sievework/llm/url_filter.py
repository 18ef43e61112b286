"""URL rules by a sort-merge range join.

Method: hosts are written backwards by labels, each closed by a mark that sorts below all letters of labels, so the hosts that a
rule fits are one interval of keys. URLs and rules are dealt into ranges of keys with boundaries from quantiles of the URL keys;
a rule goes to every range that its interval meets, a URL key that fills several ranges is spread over them. In each range one
sorted sweep keeps the stack of active nested intervals; the rules of the stack whose path fits compete and the longest wins.

Results: null urls and urls without `://` have empty host and path and fit no rule. Verdict without a rule: `default`. Of two
equal rules block wins. Repeated rows get equal results; empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Closes a label; below every character that a label has.
MARK = "\x01"
#: A range has about so many URLs; the number of ranges is bounded, and so are the keys drawn for each boundary.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, SAMPLED = 100_000, 64, 16_384, 16
#: Characters of a boundary.
CUT = 48


def _host_path(df: DataFrame, url_col: str) -> DataFrame:
    df = df.withColumn("_url", F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    df = df.withColumn("_rest", F.expr("CASE WHEN instr(_url, '://') > 0 THEN substring(_url, instr(_url, '://') + 3) ELSE '' END"))
    host = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    tail = F.expr("substring(_rest, length(_h0) + 1)")
    df = df.withColumn("_h0", host)
    return df.withColumn("host", common.ascii_lower(F.col("_h0"))).withColumn("path", F.regexp_extract(tail, r"(?s)^([^?#]*)", 1))


def host_key(host: Column) -> Column:
    """`www.example.org` as org, example, www, each closed by the mark."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), MARK), F.lit(MARK))


def _boundaries(keys: DataFrame) -> list[str]:
    """Keys that cut the sorted keys into about even parts, drawn by hash. They only place work; results don't depend on them."""
    ranges = min(MOST_RANGES, max(LEAST_RANGES, keys.count() // RANGE_ROWS))
    # the beginnings of keys do, so what is collected has a bound
    drawn = keys.select(F.substring("key", 1, CUT).alias("key"), F.xxhash64("_id", "key").alias("o")).orderBy("o", "key").limit(ranges * SAMPLED)
    found = sorted(r.key for r in drawn.select("key").collect())
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (host and path; null without one), verdict. rules: verdict, host, path."""
    spark = pages.sparkSession
    urls = _host_path(pages.select(F.col(id_col).alias("_id"), F.col(url_col)), url_col).select("_id", "host", "path")
    urls = urls.withColumn("key", F.concat(host_key(F.col("host")), F.lit("/"), F.col("path")))
    cuts = spark.sparkContext.broadcast(_boundaries(urls))
    ordered = rules.select(common.ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), "verdict").distinct()
    # the interval of a rule: all keys that start with its host's key
    ordered = ordered.withColumn("low", host_key(F.col("r_host"))).withColumn("high", F.concat(F.expr("substring(low, 1, length(low) - 1)"), F.lit("\x02")))
    id_type = urls.schema["_id"].dataType.simpleString()

    def place(batches):
        from bisect import bisect_left, bisect_right

        bounds = cuts.value
        for b in batches:
            keys, ids = b.column("key").to_pylist(), b.column("spread").to_pylist()
            part = []
            for k, i in zip(keys, ids, strict=True):
                low, high = bisect_left(bounds, k), bisect_right(bounds, k)
                part.append(low + i % (high - low + 1))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("host"), b.column("path"), b.column("key"), pa.array(part, pa.int32())], ["_id", "host", "path", "key", "part"])

    def meet(batches):
        from bisect import bisect_left, bisect_right

        bounds = cuts.value
        for b in batches:
            rows = [(r, p) for r in b.to_pylist() for p in range(bisect_left(bounds, r["low"]), bisect_right(bounds, r["high"]) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r, _ in rows], pa.string()) for c in ("r_host", "r_path", "verdict", "low", "high")] + [pa.array([p for _, p in rows], pa.int32())], ["r_host", "r_path", "verdict", "low", "high", "part"])

    left = urls.withColumn("spread", F.pmod(F.xxhash64("_id", "key"), F.lit(1 << 20)).cast("int")).mapInArrow(place, f"_id {id_type}, host string, path string, key string, part int")
    right = ordered.mapInArrow(meet, "r_host string, r_path string, verdict string, low string, high string, part int")
    events = left.withColumn("what", F.lit(1)).unionByName(right.withColumn("key", F.col("low")).withColumn("what", F.lit(0)), allowMissingColumns=True)
    events = events.repartition("part").sortWithinPartitions("part", "key", "what", "high")

    def fit(stack: list, host: str, path: str) -> tuple | None:
        """The longest of the active rules whose path fits, of equal ones that of the longer host, then block."""
        fits = [x for *_, rules in stack for x in rules if path.startswith(x[1]) and f".{host}".endswith(f".{x[0]}")]
        return max(fits, key=lambda x: (len(x[0]) + len(x[1]), len(x[0]), x[2] == "block"), default=None)

    def sweep(batches):
        part, stack = None, []  # the stack holds (low, high, rules) of nested intervals
        for b in batches:
            ids, out = [], []
            columns = (b.column(c).to_pylist() for c in ("part", "what", "key", "host", "path", "r_host", "r_path", "verdict", "high"))
            for i, (p, what, key, host, path, r_host, r_path, verdict, high) in enumerate(zip(*columns, strict=True)):
                if p != part:
                    part, stack = p, []
                while stack and stack[-1][1] <= key:
                    stack.pop()
                if what == 0:
                    if stack and stack[-1][0] == key:
                        stack[-1][2].append((r_host, r_path, verdict))
                    else:
                        stack.append((key, high, [(r_host, r_path, verdict)]))
                else:
                    best = fit(stack, host, path)
                    ids.append(i)
                    out.append((host, path, best and best[0] + best[1], best[2] if best else default))
            rest = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(ids, pa.int64())), *(pa.array(c, pa.string()) for c in rest)], ["id", "host", "path", "rule", "verdict"])

    return events.mapInArrow(sweep, f"id {id_type}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
