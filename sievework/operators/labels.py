"""Label normalisation, taxonomies, and leak-safe splits. Dictionaries are tables; they are small, and broadcast by the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable


def normalize(df: DataFrame, label: str, mapping: DataFrame, lower: bool = False, strict: bool = False, unknown: str = "Unknown") -> DataFrame:
    """Adds `_role_normalized` and `_role_changed` (against the untrimmed label). mapping: source, target."""
    key = F.trim(F.col(label))
    key = F.lower(key) if lower else key
    m = mapping.select(F.lower("source").alias("_k") if lower else F.col("source").alias("_k"), F.col("target").alias("_t"))
    out = df.withColumn("_key", key).join(m, F.col("_key") == F.col("_k"), "left")
    new = F.coalesce("_t", F.lit(unknown) if strict else F.trim(F.col(label)))
    return out.withColumn("_role_normalized", new).withColumn("_role_changed", F.coalesce(new != F.col(label), F.lit(True))).drop("_key", "_k", "_t")


def mapping_report(df: DataFrame, label: str, mapping: DataFrame) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("source")).agg(F.count(F.lit(1)).alias("count"))
    return normalize(counts, "source", mapping).select("source", F.col("_role_normalized").alias("canonical"), "count", F.col("_role_changed").alias("changed"))


def merge_suggestions(df: DataFrame, label: str) -> DataFrame:
    """longer -> shorter for labels where one holds the other, case aside; the last shorter one in order wins.

    A theta join over the distinct labels, a dictionary-sized table whatever the corpus.
    """
    names = df.select(F.col(label).alias("l")).where("l is not null").distinct()
    a, b = names.select(F.col("l").alias("longer")), names.select(F.col("l").alias("shorter"))
    pairs = a.join(b, F.contains(F.lower("longer"), F.lower("shorter")) & (F.col("longer") != F.col("shorter")) & (F.length("longer") > F.length("shorter")))
    return pairs.groupBy("longer").agg(F.max("shorter").alias("shorter"))


def find_canonical(df: DataFrame, label: str, taxonomy: DataFrame) -> DataFrame:
    """Adds `canonical` by name or alias; the first entry of the taxonomy wins. taxonomy: ord, name, aliases."""
    names = taxonomy.select("ord", F.col("name").alias("_c"), F.explode(F.array_union(F.array("name"), "aliases")).alias("_a")).select(F.lower("_a").alias("_a"), "ord", "_c")
    first = names.groupBy("_a").agg(F.min_by("_c", "ord").alias("canonical"))
    return df.join(first, F.lower(F.trim(F.col(label))) == F.col("_a"), "left").drop("_a")


def aliases(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("name", F.explode("aliases").alias("alias"))


def catalog_filter(catalog: DataFrame, cls: str | None = None, search: str | None = None) -> DataFrame:
    """catalog: name, occupational_class, description, aliases, skills."""
    out = catalog
    if cls:
        out = out.where(F.upper(F.trim("occupational_class")) == cls.strip().upper())
    if search:
        s = search.lower()
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(s))
        out = out.where(has(F.col("name")) | has(F.col("description")) | F.exists("aliases", has) | F.exists("skills", has))
    return out


def catalog_sync(old: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """Upsert by key: new values win, missing ones keep the old, and entries of the new catalogue become active."""
    fields = [c for c in old.columns if c not in (key, "is_active")]
    o, n = old.select(F.col(key).alias(key), *(F.col(c).alias(f"o_{c}") for c in [*fields, "is_active"])), new.select(key, *(F.col(c).alias(f"n_{c}") for c in fields), F.lit(True).alias("fresh"))
    joined = o.join(n, key, "full")
    return joined.select(key, *(F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in fields), F.coalesce("fresh", "o_is_active").alias("is_active"))


def sync_catalog(catalog: KeyedTable, new: DataFrame, number: int | None = None) -> bool:
    """catalog_sync() into a stored catalogue, of which only the buckets of the new entries are rewritten; once for each number."""
    newer = {c: lambda old, new: F.coalesce(new, old) for c in catalog.rest if c != "is_active"}
    return catalog.merge(new.withColumn("is_active", F.lit(True)), writer="sync", number=number, resolve=newer)


def exclude_classes(df: DataFrame, label: str, names: list[str]) -> DataFrame:
    """Rows of other classes, with ids by sorted class. Ids come from the distinct labels, not from a sort of the rows."""
    kept = df.where(~F.col(label).isin(names))
    ids = kept.select(label).distinct().select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("class_id"))
    return kept.join(ids, label)


def dominant_label(df: DataFrame, group: str, label: str) -> DataFrame:
    """The most frequent label of a group, the least on ties."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("dominant"))


def split(df: DataFrame, group: str, label: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Adds `_split`: whole groups go to train, val or test, stratified by their dominant label and ordered by md5 of seed and
    group. Ranking runs over groups within a label."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"ratios sum to {sum(ratios)}, not 1")
    groups = dominant_label(df, group, label)
    w = Window.partitionBy("dominant")
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(group).cast("string"))), group))
    test = F.greatest(F.lit(1), F.bround(n * ratios[2], 0).cast("int"))
    val = F.when(n > 2, F.greatest(F.lit(1), F.bround(n * ratios[1], 0).cast("int"))).otherwise(0)
    named = groups.select(group, F.when(r <= test, "test").when(r <= test + val, "val").otherwise("train").alias("_split"))
    return df.join(named, group)


def kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key)
    return df.withColumn("fold", (F.row_number().over(w) - 1) % k)


def split_summary(df: DataFrame) -> DataFrame:
    counts = df.groupBy("_split").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("_split", "rows", F.round(100.0 * F.col("rows") / F.sum("rows").over(Window.partitionBy()), 1).alias("pct"))


def leakage(df: DataFrame, key: str) -> DataFrame:
    """Keys that two splits share, by pair of splits: one pass over keys and splits."""
    where = df.groupBy(key).agg(F.collect_set("_split").alias("s"))
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    counts = where.agg(*(F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}") for a, b in pairs))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("overlap")) for a, b in pairs))))


def complement(whole: DataFrame, *parts: DataFrame, key: str) -> DataFrame:
    for p in parts:
        whole = whole.join(p.select(key), key, "left_anti")
    return whole


def review_queue(*frames: DataFrame, columns: list[str]) -> DataFrame:
    """One queue with fixed string columns; missing ones are empty."""
    out = None
    for f in frames:
        part = f.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in f.columns else F.lit("").alias(c) for c in columns))
        out = part if out is None else out.unionByName(part)
    return out
