"""Profiling of a corpus table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C


def _size(f: T.StructField):
    """What range and mean are taken of: the length of texts, the value of numbers."""
    c = F.col(f.name)
    return F.length(c).cast("double") if isinstance(f.dataType, T.StringType) else c.cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")


def _mark(*columns: str):
    """128 bits that stand for values, nulls included."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def schema_summary(df: DataFrame, order: str | None = None, n: int = 5, cut: int = 120) -> DataFrame:
    """One row per column: type, nulls, null share, distinct values, range and mean of values or text lengths; and with `order` the first n
    values, cut. Distinct values are counted as 128-bit hashes, so no value is copied or shuffled."""
    aggs, cells = [], []
    for i, f in enumerate(df.schema.fields):
        c, size = F.col(f.name), _size(f)
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"), F.min(size).alias(f"lo{i}"), F.max(size).alias(f"hi{i}"), F.avg(size).alias(f"m{i}")]
        cells.append(F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("null_count"), F.round(F.when(F.col("rows") == 0, 0.0).otherwise(100.0 * F.col(f"n{i}") / F.col("rows")), 2).alias("null_pct"), F.col(f"lo{i}").alias("least"), F.col(f"hi{i}").alias("most"), F.round(F.col(f"m{i}"), 1 if isinstance(f.dataType, T.StringType) else 4).alias("mean")))
    out = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).select(F.inline(F.array(*cells)))
    marks = df.select(F.explode(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), _mark(c).alias("m"))) for i, c in enumerate(df.columns)))).alias("x")).where("x is not null")
    unique = marks.groupBy("x.i", "x.m").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count("one").alias("unique_count"))
    out = out.join(unique, "i", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    if order is not None:
        first = [df.where(F.col(c).isNotNull()).orderBy(order).limit(n).select(F.lit(i).alias("i"), F.struct(F.col(order).alias("o"), F.substring(F.col(c).cast("string"), 1, cut).alias("v")).alias("x")) for i, c in enumerate(df.columns)]
        taken = reduce(DataFrame.unionByName, first).groupBy("i").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("samples"))  # n rows for each column
        out = out.join(taken, "i", "left")
    return out.select("column", "dtype", "null_count", "null_pct", "unique_count", "least", "most", "mean", *(["samples"] if order is not None else []))


def sketches(df: DataFrame) -> DataFrame:
    """One row per column for storing and merging: rows, nulls, least, most, total, and sketches of distinct values (HyperLogLog) and of
    quantiles (KLL), each of fixed size."""
    aggs, cells = [], []
    for i, f in enumerate(df.schema.fields):
        c, size = F.col(f.name), _size(f)
        aggs += [F.count(c).alias(f"n{i}"), F.min(size).alias(f"lo{i}"), F.max(size).alias(f"hi{i}"), F.sum(size).alias(f"t{i}"), F.hll_sketch_agg(F.xxhash64(c) if not isinstance(f.dataType, T.StringType) else c).alias(f"h{i}"), F.kll_sketch_agg_double(size).alias(f"q{i}")]
        cells.append(F.struct(F.lit(f.name).alias("column"), F.col("rows"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"lo{i}").alias("least"), F.col(f"hi{i}").alias("most"), F.col(f"t{i}").alias("total"), F.col(f"h{i}").alias("distinct_sketch"), F.col(f"q{i}").alias("quantile_sketch")))
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs).select(F.inline(F.array(*cells)))


def merged_sketches(parts: DataFrame) -> DataFrame:
    """The sketches of a whole from those of its parts, as of the files that were added since."""
    return parts.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def from_sketches(stored: DataFrame) -> DataFrame:
    """column, rows, nulls, least, most, mean, unique_count and median; the last two are estimates, within about 2 percent."""
    filled = F.col("rows") - F.col("nulls")
    median = F.when(F.col("least").isNotNull(), F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(0.5)))
    return stored.select("column", "rows", "nulls", "least", "most", F.when(filled > 0, F.col("total") / filled).alias("mean"), F.hll_sketch_estimate("distinct_sketch").alias("unique_count"), median.alias("median"))


def samples(df: DataFrame, column: str, order: str, n: int = 5, cut: int = 120) -> DataFrame:
    """The first n non-null values by an explicit order, cut."""
    return df.where(F.col(column).isNotNull()).orderBy(order).limit(n).select(order, F.substring(F.col(column).cast("string"), 1, cut).alias("sample"))


def text_stats(df: DataFrame, text: str) -> DataFrame:
    """Characters and words: least, most, mean, median and sample deviation, to two digits."""
    sizes = df.select(F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length(text).cast("double").alias("n")), F.struct(F.lit("words").alias("unit"), C.word_count(F.col(text)).cast("double").alias("n")))).alias("s")).select("s.*")
    return sizes.groupBy("unit").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 2).alias("mean"), F.round(F.median("n"), 2).alias("median"), F.round(F.stddev_samp("n"), 2).alias("std"))


def null_profile(df: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)]
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns))).select(F.inline(F.array(*cells)))


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """Repeats after the first, of whole rows and of ids; null counts as a value."""
    # rows are told apart by 128 bits, so no value is shuffled
    rows = df.select(_mark(*df.columns).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))
    return rows.crossJoin(keys)  # one row each


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count, share in percent and rank of each label; ties by label."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy()
    return counts.select("label", "count", F.round(100.0 * F.col("count") / F.sum("count").over(whole), 2).alias("pct"), F.row_number().over(whole.orderBy(F.desc("count"), "label")).alias("rank"))


def category_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def category_summary(df: DataFrame, label: str, weak: int = 10, small: int = 50) -> DataFrame:
    n = F.col("count")
    return category_distribution(df.where(F.col(label).isNotNull()), label).agg(F.count(F.lit(1)).alias("categories"), F.max(n).alias("largest"), F.min(n).alias("smallest"), F.count_if(n < weak).alias("weak"), F.count_if(n < small).alias("small"))


def weak_classes(df: DataFrame, label: str, threshold: int = 10) -> DataFrame:
    return category_distribution(df, label).where(F.col("count") < threshold)


def quality_report(checks: DataFrame, schema: DataFrame, warn_pct: float = 5.0) -> DataFrame:
    """check, value, status, detail: `warn` for counts above 0 and null shares above a limit. checks: check, value."""
    counts = checks.select("check", F.col("value").cast("double").alias("value"), F.when(F.col("value") > 0, "warn").otherwise("ok").alias("status"), F.lit("").alias("detail"))
    nulls = schema.select(F.concat(F.lit("null_pct_"), F.col("column")).alias("check"), F.col("null_pct").alias("value"), F.when(F.col("null_pct") > warn_pct, "warn").otherwise("ok").alias("status"), F.col("dtype").alias("detail"))
    return counts.unionByName(nulls)


def manifest(df: DataFrame, key: str, label: str, text: str, **fixed: str) -> DataFrame:
    """One record of counts, a fingerprint that no row order changes, and given values such as seed and version."""
    parts = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (key, label, text)))
    mark = F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(label).alias("labels"), F.count_distinct(key).alias("ids"), F.bit_xor(mark).alias("fingerprint")).select("*", *(F.lit(v).alias(k) for k, v in fixed.items()))


def inspection_report(df: DataFrame, key: str, label: str, text: str) -> DataFrame:
    """The profile as Markdown lines in order; the median is the median."""
    stats = text_stats(df, text).select(F.concat(F.lit("## Text "), F.col("unit")).alias("section"), F.format_string("- least %s, most %s, mean %s, median %s", "least", "most", "mean", "median").alias("line"))
    classes = class_distribution(df, label).select(F.lit("## Classes").alias("section"), F.format_string("- %s: %d (%s %%)", F.coalesce("label", F.lit("null")), "count", "pct").alias("line"))
    nulls = null_profile(df).select(F.lit("## Nulls").alias("section"), F.format_string("- %s: %d", "column", "nulls").alias("line"))
    return stats.unionByName(classes).unionByName(nulls)
