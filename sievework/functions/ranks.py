"""Ranks without a window over a whole group: rows are dealt by ranges of their order, and ranks come from the counts of earlier ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables


def _dealt(df: DataFrame, by: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """df with the number of the range that each row is in, and of each group and range how many rows of the group come before."""
    rows = tables.stored(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    n = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))  # a group has as many rows as it has ranges
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return rows, n.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))


def _numbered(rows: DataFrame, before: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    names = [*by, "__range"]
    b = before.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(names)), "__before")
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    here = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    out = rows.withColumn("__here", here).join(F.broadcast(b) if not by else b, same)  # without groups a row for each range
    return out.select(*[c for c in rows.columns if c != "__range"], (F.col("__here") + F.col("__before")).cast("int").alias(name))


def ranked(df: DataFrame, by: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, in the order within its group (all rows without `by`). A group of any size is numbered in
    several tasks. The order should tell rows apart."""
    rows, before = _dealt(df, by, order)
    return _numbered(rows, before, by, order, name)


def page(df: DataFrame, order: list[str | Column], number: int, size: int) -> DataFrame:
    """The rows of a page of all rows in order: only the ranges that the page touches are sorted."""
    rows, before = _dealt(df, [], order)
    low, high = (number - 1) * size, number * size
    touched = before.where((F.col("__before") < high) & (F.col("__before") + F.col("__n") > low))
    rows = rows.join(F.broadcast(touched.select("__range")), "__range", "left_semi")
    out = _numbered(rows, touched, [], order, "__place")
    return out.where(F.col("__place").between(low + 1, high)).orderBy("__place").drop("__place")  # a page
