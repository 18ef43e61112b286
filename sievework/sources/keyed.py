"""A table of unique keys in Parquet that is changed by merges: hash buckets, of which a merge rewrites only those it touches.

A folder holds `data/<name>/bucket=<n>/` (what one merge wrote) and `commits/<version>.json`: for each bucket the name of the merge that
wrote it last, and for each writer the number of its last batch. A merge becomes visible when its commit file is renamed into place,
which fails if the version is there already. So readers see whole versions, a merge that breaks off leaves nothing but unread files, a
batch that comes twice changes nothing, and two writers can't lose each other's rows. As a bucket is always written whole, reading
never merges, and old data is compacted by forgetting it: vacuum() deletes what no kept version names.

The driver handles the commit files only, whose size is that of the list of buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import tables


class Conflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 32) -> None:
        """schema: of the rows. keys: the columns that name a row; rows with a null key are names like any other."""
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        if "bucket" in self.schema.names:
            raise ValueError("a column of the table can't be named bucket")
        self.rest = [c for c in self.schema.names if c not in keys]

    # --- commit files, through Hadoop's file systems ---

    def _at(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._at("commits")
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def commit(self, version: int | None = None) -> dict:
        """version, buckets (number: name of the merge) and batches (writer: number) of a version, the newest by default."""
        there = self.versions()
        if not there and version is None:
            return {"version": 0, "buckets": {}, "batches": {}}
        at, _ = self._at("commits", f"{there[-1] if version is None else version}.json")
        return json.loads("".join(r.value for r in self.spark.read.text(at.toString(), wholetext=True).collect()))  # one small file

    def _publish(self, state: dict) -> None:
        at, fs = self._at("commits", f"{state['version']}.json")
        before, _ = self._at("commits", f"_{uuid.uuid4().hex}")
        out = fs.create(before, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(before, at):
            fs.delete(before, False)
            raise Conflict(f"version {state['version']} of {self.path} is there already")

    # --- reading ---

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of some buckets, if given."""
        held = self.commit(version)["buckets"]
        paths = [f"{self.path}/data/{name}/bucket={n}" for n, name in sorted(held.items(), key=lambda x: int(x[0])) if only is None or int(n) in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    # --- writing ---

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, order: Column | None = None, writer: str = "", number: int | None = None, resolve: dict[str, Callable[[Column, Column], Column]] | None = None, matched_only: bool = False) -> bool:
        """Puts the rows of a batch in; False if this writer's batch of that number, or a later one, is in already.

        Of rows of one key in the batch that with the largest `order` counts. New values replace old ones, unless `resolve` has a function
        of the old and the new value for a column; columns that the batch doesn't have keep the old value. With matched_only, keys that
        the table doesn't have are left out.
        """
        state = self.commit()
        if number is not None and number <= state["batches"].get(writer, -1):
            return False
        given = [c for c in self.rest if c in batch.columns]
        rows = batch.select(*self.keys, *given, (order if order is not None else F.lit(0)).alias("__order"))
        value = F.struct(*given, F.lit(True).alias("__new"))
        new = rows.groupBy(*self.keys).agg(F.max_by(value, F.struct("__order", *given)).alias("new")).withColumn("bucket", self._bucket())
        new = tables.stored(new, "batch")
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # as many as there are buckets, at most
        if touched:
            old = self.read(state["version"] or None, touched).withColumn("old", F.struct(*self.rest, F.lit(True).alias("__old")) if self.rest else F.struct(F.lit(True).alias("__old"))).select(*[F.col(k).alias(f"__{k}") for k in self.keys], "old")
            same = F.lit(True)
            for k in self.keys:
                same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
            both = new.drop("bucket").join(old, same, "right" if matched_only else "full")
            is_new, is_old = F.coalesce(F.col("new.__new"), F.lit(False)), F.coalesce(F.col("old.__old"), F.lit(False))
            out = [F.when(is_new, F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in self.keys]
            for c in self.rest:
                if c not in given:
                    out.append(F.col(f"old.{c}").alias(c))
                else:
                    how = (resolve or {}).get(c)
                    put = how(F.col(f"old.{c}"), F.col(f"new.{c}")) if how else F.col(f"new.{c}")
                    out.append(F.when(is_new & is_old, put).when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
            name = f"{state['version'] + 1}-{uuid.uuid4().hex}"
            whole = both.select(*out).withColumn("bucket", self._bucket())
            whole.repartition(len(touched), "bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
            state["buckets"] |= dict.fromkeys(map(str, touched), name)
            if matched_only:  # a touched bucket may have stayed empty
                at, fs = self._at("data", name)
                there = {x.getPath().getName().removeprefix("bucket=") for x in fs.listStatus(at)}
                state["buckets"] = {n: x for n, x in state["buckets"].items() if x != name or n in there}
        state["version"] += 1
        if number is not None:
            state["batches"][writer] = number
        self._publish(state)
        return True

    def sink(self, order: Column | None = None, writer: str = "stream", **options) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that is delivered again after a failure changes nothing."""

        def write(batch: DataFrame, number: int) -> None:
            self.merge(batch, order, writer, number, **options)

        return write

    def vacuum(self, keep: int = 1) -> int:
        """Forgets all but the newest `keep` versions, and deletes data that none of them names; returns how many merges went.

        Not while a merge is under way: its data isn't named yet."""
        there = self.versions()
        kept = there[-keep:]
        named = {x for v in kept for x in self.commit(v)["buckets"].values()}
        for v in there[:-keep]:
            at, fs = self._at("commits", f"{v}.json")
            fs.delete(at, False)
        at, fs = self._at("data")
        gone = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName() not in named] if fs.exists(at) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)
