"""Validation of a corpus table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


class MissingColumns(ValueError):
    """Required columns aren't there; later checks make no sense."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise MissingColumns(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df


def nulls(df: DataFrame, columns: list[str], max_pct: float = 10.0) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.when(F.col("rows") == 0, 0.0).otherwise(100.0 * F.col(f"n{i}") / F.col("rows")).alias("pct")) for i, c in enumerate(columns)]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns))).select(F.inline(F.array(*cells)))
    level = F.when(F.col("pct") > max_pct, "error").when(F.col("pct") > 0, "warning").otherwise("ok")
    return found.select("column", "nulls", F.round("pct", 2).alias("null_pct"), level.alias("level"))


def _text_aggregates(text: str, min_chars: int, min_words: int) -> list[Column]:
    t = F.coalesce(F.trim(F.col(text)), F.lit(""))
    full, n = F.length(t) > 0, F.length(t)
    return [F.count_if(~full).alias("empty"), F.count_if(full & (n < min_chars)).alias("short_chars"), F.count_if(full & (C.word_count(t) < min_words)).alias("short_words"), F.min(F.when(full, n)).alias("min_chars"), F.max(F.when(full, n)).alias("max_chars"), F.round(F.avg(F.when(full, n)), 1).alias("mean_chars"), F.median(F.when(full, n)).alias("median_chars")]


def text_quality(df: DataFrame, text: str, min_chars: int = 100, min_words: int = 20) -> DataFrame:
    return df.agg(*_text_aggregates(text, min_chars, min_words))


def label_distribution(df: DataFrame, label: str, min_count: int = 5, named: int = 10) -> DataFrame:
    """How many labels are rare, and the first of them by name; null if none is."""
    rare = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_count)
    first = rare.orderBy(label).limit(named).agg(F.when(F.count(F.lit(1)) > 0, F.array_join(F.sort_array(F.collect_list(label)), ",")).alias("named"))  # `named` rows at most
    return rare.agg(F.count(F.lit(1)).alias("rare")).crossJoin(first)  # one row each


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))


def suspicious(df: DataFrame, text: str, most_tags: int = 10) -> DataFrame:
    """Tag-heavy rows, and rows of symbols and digits only; a row can count twice."""
    t = F.coalesce(F.col(text), F.lit(""))
    heavy = F.regexp_count(t, F.lit("<[^>]+>")) > most_tags
    # what is neither a letter nor a number other than a digit
    symbols = C.strip(t).rlike(r"\A[^\p{L}\p{Nl}\p{No}]+\z")
    return df.agg(F.count_if(heavy).alias("html_heavy"), F.count_if(symbols).alias("symbol_only"))


def report(df: DataFrame, key: str, label: str, text: str, max_null_pct: float = 10.0, min_count: int = 5) -> DataFrame:
    """Pass flag, errors, warnings and statistics in one row; the table is read once for all row-wise checks."""
    require_columns(df, key, label, text)
    t = F.col(text)
    stats = df.agg(F.count(F.lit(1)).alias("rows"), *(F.round(100.0 * F.count_if(F.col(c).isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias(f"null_{k}") for k, c in (("label", label), ("text", text))), *_text_aggregates(text, 100, 20), F.count_if(F.regexp_count(F.coalesce(t, F.lit("")), F.lit("<[^>]+>")) > 10).alias("html_heavy"))
    stats = stats.crossJoin(duplicate_ids(df, key)).crossJoin(label_distribution(df, label, min_count).select("rare"))  # one row each
    errors = F.array_compact(F.array(*(F.when(F.col(f"null_{k}") > max_null_pct, F.lit(f"{k}: too many nulls")) for k in ("label", "text"))))
    warnings = F.array_compact(F.array(*(F.when((F.col(f"null_{k}") > 0) & (F.col(f"null_{k}") <= max_null_pct), F.lit(f"{k}: nulls")) for k in ("label", "text")), F.when(F.col("empty") > 0, F.lit("empty texts")), F.when(F.col("short_chars") > 0, F.lit("short texts")), F.when(F.col("rare") > 0, F.lit("rare labels")), F.when(F.col("duplicate_ids") > 0, F.lit("duplicate ids")), F.when(F.col("html_heavy") > 0, F.lit("html"))))
    return stats.select((F.size(errors) == 0).alias("passed"), F.array_join(errors, "; ").alias("errors"), F.array_join(warnings, "; ").alias("warnings"), "rows", "empty", "short_chars", "short_words", "duplicate_ids", "rare", "html_heavy")
