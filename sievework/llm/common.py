"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables

#: The separators of the word form `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: ASCII but for digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Those at both ends; a run in the middle is looked at once, as only its first separator is tried and nothing is given back.
OUTER = rf"\A{SEPARATORS}|(?<!{SEPARATORS[:-1]}){SEPARATORS}+\z"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows in an Arrow batch while a table is written: long texts and sets count, as a batch is held whole.
RECORDS = 1000


def settled(df: DataFrame, name: str = "part", records: int = RECORDS) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps don't depend on lost executors or recompute it."""
    spark = df.sparkSession
    path = tables.new_path(spark, name)
    # the shuffles behind a written table are of no more use
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(records)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable) -> Callable:
    """For mapInArrow: the worker gives the memory of a finished task back, as it stays for later tasks of other operators."""

    def outer(batches):
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
                ctypes.CDLL(None).malloc_trim(0)

    return outer


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """The lower-cased words of a text in order; null and blank texts have none."""
    inner = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), OUTER, "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATORS, -1))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`_id`, `_text` and `_h`, a hash of both; repeated rows have the same key and so the same result."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(F.col(id_col), text).alias("_h"))


#: A key with more rows than this, and than a 2^20th of all rows, is matched by broadcast instead of in one task.
FREQUENT = 1000


def _hot_and_cold(counts: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """counts split by its number of rows `n`; the first part has at most 2^20 keys for any number of rows, and is None if empty."""
    most = max(FREQUENT, (counts.agg(F.sum("n")).first()[0] or 0) >> 20)
    hot = counts.where(F.col("n") > most)
    return (hot if hot.limit(1).count() else None), counts.where(F.col("n") <= most)


def having(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in counts, which has the number of rows `n` of each and is written. Very frequent keys are broadcast, so
    none of them is a hot task; the others are shuffled."""
    hot, cold = _hot_and_cold(counts)
    cold = cold.select(*keys)
    if hot is None:
        return rows.join(cold, keys, "left_semi")
    hot = F.broadcast(hot.select(*keys))
    return rows.join(hot, keys, "left_semi").unionByName(rows.join(hot, keys, "left_anti").join(cold, keys, "left_semi"))


def attached(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows with the other columns of values (written; one row for each key, with its number of rows `n`, which is dropped), as an inner
    join, dealt like having()."""
    hot, cold = _hot_and_cold(values)
    if hot is None:
        return rows.join(cold.drop("n"), key)
    names = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot.drop("n")), key).unionByName(rows.join(names, key, "left_anti").join(cold.drop("n"), key))


def spread_join(rows: DataFrame, values: DataFrame, key: str, by: str) -> DataFrame:
    """rows (written) joined with values, which has one row, of any size, for each key: a frequent key is dealt over several tasks by
    `by`, and its value sent to each of them."""
    counts = settled(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "counts")
    hot, _ = _hot_and_cold(counts)
    if hot is None:
        return rows.join(values, key)
    parts = F.broadcast(hot.select(key, F.ceil(F.col("n") / FREQUENT).cast("int").alias("__parts")))
    n = F.coalesce("__parts", F.lit(1))
    left = rows.join(parts, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), n).cast("int")).drop("__parts")
    right = values.join(parts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__parts")
    return left.join(right, [key, "__salt"]).drop("__salt")


# --- a fixed-size bitmap of keys, to keep rows without partner out of a shuffle ---

BITMAP_LEAST, BITMAP_MOST = 20, 27


def bitmap(df: DataFrame, hash_col: str) -> np.ndarray:
    """Marks the 64-bit hashes in a column, about 16 bits for each, 16 MB at most for any number; false hits only cost work."""
    bits = min(BITMAP_MOST, max(BITMAP_LEAST, int(np.ceil(np.log2(16 * (df.count() + 1))))))
    slot = F.shiftrightunsigned(F.col(hash_col), 64 - bits)
    words = df.select(F.shiftrightunsigned(slot, 5).cast("int").alias("w"), F.expr("1L").alias("one"), slot.bitwiseAND(F.lit(31)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("v"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for batch in _arrow_batches(words):
        out[batch.column("w").to_numpy()] = batch.column("v").to_numpy().astype(np.uint32)
    return out


def _arrow_batches(df: DataFrame) -> list[pa.RecordBatch]:
    """A result of proven bound, as Arrow."""
    return df.toArrow().to_batches()


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.astype(np.int64).view(np.uint64) >> np.uint64(64 - int(len(bits)).bit_length() + 1 - 5)
    return (bits[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 == 1


def keep_marked(df: DataFrame, hash_col: str, bits: np.ndarray, inverse: bool = False) -> DataFrame:
    """The rows whose hash the bitmap marks (or doesn't), before any shuffle."""
    held = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            hit = in_bitmap(held.value, b.column(hash_col).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(~hit if inverse else hit))

    return df.mapInArrow(run, df.schema)


# --- texts as one run of bytes ---


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row starts (one more entry than rows)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int) -> list[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of text; a longer row stands alone."""
    _, at = text_buffer(batch.column(column))
    out, start = [], 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        out.append(batch.slice(start, stop - start))
        start = stop
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a public bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any byte range of a buffer from prefix sums of a polynomial modulo 2^64 over random byte values."""

    def __init__(self, seed: int) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (int(rng.integers(1, 2**62)) * 8 + 5) % 2**64
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.down[start])


# --- connected components ---


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have an edge.

    Each round every node points to its smallest neighbour, pointers are followed to their roots,
    and edges are redrawn between roots; a round at least halves the nodes that still have edges,
    so the number of rounds is logarithmic. Nothing but a row count reaches the driver.
    """
    left = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    left = settled(left, "edges")
    found = None
    while left.count():
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = settled(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "pointers")
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            # the target of a pointer always has an entry of its own, as it has an edge too
            point = settled(point.join(up, "root").select("node", "next", (F.col("next") != F.col("root")).alias("moved")).withColumnRenamed("next", "root"), "pointers")
            if not point.where("moved").limit(1).count():
                break
            point = point.drop("moved")
        point = point.select("node", "root")
        if found is None:
            found = point
        else:
            step = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = settled(found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        pu, pv = point.select(F.col("node").alias("u"), F.col("root").alias("ru")), point.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        left = left.join(pu, "u").join(pv, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        left = settled(left, "edges")
    return found if found is not None else left.select(F.col("u").alias("node"), F.col("v").alias("root"))

