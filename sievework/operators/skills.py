"""Skill extraction with dictionaries as tables."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ..functions import columns as C
from ..functions import tables as T

TOKEN = r"[a-zA-Z0-9.+#]+"


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct lower-case tokens of each row."""
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), 0))).alias("token"))


def by_synonym(toks: DataFrame, key: str, synonyms: DataFrame) -> DataFrame:
    """synonyms: synonym, skill; up to `SMALL` of them are broadcast after they were counted."""
    synonyms = F.broadcast(synonyms) if synonyms.limit(SMALL + 1).count() <= SMALL else synonyms
    return toks.join(synonyms, F.col("token") == F.lower("synonym")).select(key, "skill").distinct()


def _runs(text: Column, longest: int) -> Column:
    """Distinct runs of 1 to `longest` tokens of a text."""
    t = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\s,;:()\[\]!?\"']+"), 0)
    clean = F.transform(t, lambda x: F.regexp_replace(x, r"[.]+$", ""))

    def runs(t: Column, n: int) -> Column:
        if n == 1:
            return t
        every = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))
        return F.when(F.size(t) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(clean), lambda t: F.flatten(F.array(*(runs(t, n) for n in range(1, longest + 1))))), 1)


def found(text: Column, skills: list[str], synonyms: list[tuple[str, str]], longest: int = 3) -> Column:
    """The sorted skills of a text by both dictionaries, in one projection without a shuffle; for dictionaries that fit a plan."""
    names = F.create_map(*(F.lit(x) for s in skills for x in (s.lower(), s)))
    exact_ones = F.transform(F.array_intersect(_runs(text, longest), F.array(*(F.lit(s.lower()) for s in skills))), lambda g: F.element_at(names, g))
    own = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    meant = F.create_map(*(F.lit(x) for a, b in synonyms for x in (a.lower(), b)))
    other = F.transform(F.array_intersect(own, F.array(*(F.lit(a.lower()) for a, _ in synonyms))), lambda t: F.element_at(meant, t))
    return F.sort_array(F.array_union(exact_ones, other))


#: A dictionary of up to so many rows is looked up inside the scan, and one of up to FEW rows in the whole text at once.
SMALL, FEW = 4096, 64


def _runs_of(text: Column, longest: int, names: list[str]) -> Column:
    """Those of the names that are among `_runs`: between single blanks, where a name with a blank less than a run has words is one."""

    def among(t: Column) -> Column:
        return F.array_compact(F.array(*(F.when(F.contains(t, F.lit(f" {g} ")), F.lit(g)) for g in names if g.count(" ") < longest)).cast("array<string>"))

    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s,;:()\[\]!?\"']+", " "))
    # as `[.]+$` in each token, where $ stands before a last line end too
    clean = F.regexp_replace(F.concat(F.lit(" "), spaced, F.lit(" ")), r"(?<![.])[.]++(?=[\u0085\u2028\u2029]? )", "")
    return C.let(F.when(spaced != "", clean).otherwise(F.lit("")), among)


def exact(df: DataFrame, key: str, text: str, skills: DataFrame, longest: int = 3) -> DataFrame:
    """Skills of up to `longest` words, found as runs of tokens. A dictionary that is counted small goes into the projection, so only hits
    leave a row; a larger one is joined."""
    known = skills.select("skill", F.lower("skill").alias("g"))
    few = known.limit(SMALL + 1).collect()  # bounded by SMALL
    runs = _runs(F.col(text), longest)
    if len(few) <= SMALL:
        if not few:
            return df.select(key, F.lit(None).cast("string").alias("skill")).where("false")
        runs = F.array_intersect(runs, F.array(*(F.lit(r.g) for r in few))) if len(few) > FEW else _runs_of(F.col(text), longest, sorted({r.g for r in few if r.g is not None}))
        known = F.broadcast(known)
    hits = df.select(key, F.explode(F.array_distinct(runs)).alias("g"))
    return hits.join(known, "g").select(key, "skill").distinct()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 LCS / (len + len): insertions and deletions only."""

    def one(x: str, y: str) -> float:
        if not x and not y:
            return 100.0
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, e in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if c == e else max(row[j + 1], row[j])
        return 200.0 * row[-1] / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def _budget(n: int, m: int, least: float) -> int:
    """Insertions and deletions that a ratio of at least `least` allows between strings of n and m characters."""
    return int((1 - least / 100) * (n + m) + 1e-9)


def _segments(m: int, least: float) -> list[tuple[int, int]]:
    """(start, length) of the even parts of a string of m characters, one more than any string within its ratio differs in places."""
    share = least / 100 / (2 - least / 100)
    parts = min(m, _budget(int(m / share + 1e-9), m, least) + 1)
    return [(i * m // parts, (i + 1) * m // parts - i * m // parts) for i in range(parts)]


def _signatures(text: Column, least: float, known: bool) -> Column:
    """Keys of strings, of which two within the ratio share one. A known string has its segments, by its length and their number; any
    other has, for each length that the ratio allows, what it has near the place of each segment: of one more segment than there are
    differences, one is untouched, and stands no further off than there are differences."""

    def run(texts: pa.Array) -> pa.Array:
        share, parts, out = least / 100 / (2 - least / 100), {}, []
        for t in texts.to_pylist():
            n, keys = len(t or ""), set()
            for m in [n] if known else range(max(1, -int(-n * share // 1)), int(n / share + 1e-9) + 1):
                k = _budget(n, m, least)
                for i, (start, size) in enumerate(parts.setdefault(m, _segments(m, least))):
                    for at in [start] if known else range(max(0, start - k), min(n - size, start + k) + 1):
                        keys.add(f"{m}:{i}:{t[at : at + size]}")
            out.append(sorted(keys))
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, ArrayType(StringType()))(text)


def _sharing(text: Column, known: list[tuple[str, str]], least: float) -> Column:
    """The skills that share a key of `_signatures` with a string; known: skill and key. Only keys of the dictionary's lengths are looked at."""
    lengths = {}
    for skill, key in known:
        m, i, segment = key.split(":", 2)
        lengths.setdefault(int(m), {}).setdefault(int(i), {}).setdefault(segment, []).append(skill)

    def run(texts: pa.Array) -> pa.Array:
        share, out = least / 100 / (2 - least / 100), []
        parts = {m: [(*_segments(m, least)[i], held) for i, held in of.items()] for m, of in lengths.items()}
        for t in texts.to_pylist():
            n, skills = len(t or ""), set()
            for m in range(max(1, -int(-n * share // 1)), int(n / share + 1e-9) + 1):
                if m in parts:
                    k = _budget(n, m, least)
                    for start, size, held in parts[m]:
                        for at in range(max(0, start - k), min(n - size, start + k) + 1):
                            skills.update(held.get(t[at : at + size], ()))
            out.append(sorted(skills))
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, ArrayType(StringType()))(text)


def fuzzy(toks: DataFrame, key: str, skills: DataFrame, least: float = 92.0, min_chars: int = 4, found: DataFrame | None = None, enough: int = 3) -> DataFrame:
    """The most similar skill of each distinct token, for rows of which the other layers found fewer than `enough` skills (found: key,
    skill). Case counts, as tokens are lower-case and skills are taken as they are written. Candidates share a segment (see
    `_signatures`); distinct tokens are compared once for all documents. Rows with enough skills are taken out of the hits, so tokens
    are never dealt by row."""
    names = toks.where(F.length("token") >= min_chars).select("token").distinct()
    known = T.stored(skills.select("skill").distinct().where("skill <> ''").select("skill", F.explode(_signatures(F.col("skill"), least, True)).alias("s")), "segments")
    some = known.limit(SEGMENTS + 1).collect()  # bounded by SEGMENTS
    if len(some) <= SEGMENTS:
        near = names.select("token", F.explode(_sharing(F.col("token"), [(r.skill, r.s) for r in some], least)).alias("skill"))
    else:
        near = names.select("token", F.explode(_signatures(F.col("token"), least, False)).alias("s")).join(known, "s").select("token", "skill").distinct()
    # an indel distance is at least the Levenshtein distance, which the JVM knows
    most = (1 - least / 100) * (F.length("token") + F.length("skill"))
    scored = near.where(F.levenshtein("token", "skill") <= most + 1e-9).withColumn("r", indel_ratio("token", "skill")).where(F.col("r") >= least)
    best = T.stored(scored.groupBy("token").agg(F.min_by("skill", F.struct(-F.col("r"), "skill")).alias("skill")), "best")
    hits = toks.join(F.broadcast(best) if best.limit(SEGMENTS + 1).count() <= SEGMENTS else best, "token").select(key, "skill").distinct()
    if found is None:
        return hits
    return hits.join(found.groupBy(key).agg(F.count_distinct("skill").alias("n")).where(F.col("n") >= enough).select(key), key, "left_anti")


#: Segments of a dictionary that travel with a function, and tokens that are broadcast, after they were counted.
SEGMENTS = 1 << 18


def extract(*layers: DataFrame, key: str) -> DataFrame:
    """Sorted distinct union of the layers."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out.groupBy(key).agg(F.sort_array(F.collect_set("skill")).alias("skills"))


def categorize(found: DataFrame, key: str, categories: DataFrame) -> DataFrame:
    """(key, category, skills); unknown ones are `Other Skills`. categories: skill, category."""
    out = found.join(categories, "skill", "left").withColumn("category", F.coalesce("category", F.lit("Other Skills")))
    return out.groupBy(key, "category").agg(F.array_join(F.sort_array(F.collect_set("skill")), ",").alias("skills"))


def demand(found: DataFrame) -> DataFrame:
    return found.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
