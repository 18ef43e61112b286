"""Prefix trie of conversations with totals of every subtree.

Method: time-forward processing. Nodes are sorted by reverse level order (Spark's external sort); each passes the totals of its subtree
to its parent through a priority queue that spills to the shared folder. That happens within shards of bounded size first, then
across the roots of shards:

- a node's weight is the number of turns at or below it; nodes of a weight up to a limit are light, and a shard is a whole light subtree
  below a heavy node (or the root). Their totals are final after one pass over all shards in parallel.
- heavy nodes get what light subtrees pass on. They form a tree of few branches, cut along each branch into pieces of bounded depth.
  Pieces are summed in parallel, their roots, a few thousand at any size, are processed in one task, and then each piece again with what
  other pieces pass on.

A node is a prefix: its key has the exclusive or of 128-bit hashes of (place, role, text) over its turns, so keys of one conversation
are running aggregates in blocks, and the turns of one very long conversation are dealt over many tasks. Texts are hashed where they
are read and never shuffled. Conversations that end in a node are hashed in order of id, from runs joined to strings before.

Results: rows without conv_id belong to no conversation and are left out; null role and text count as empty; turns with equal number (null
first) stand in order of a digest of role and text; repeated rows are repeated turns. An empty table gives no nodes. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from . import common

#: Shards have a weight of at most a SHARDS-th of all turns, or LEAST_WEIGHT.
SHARDS, LEAST_WEIGHT = 4096, 1000
#: Messages that a queue holds in memory.
QUEUE = 1 << 17
#: Turns of a conversation that are aggregated together.
BLOCK = 1024
#: Characters of ids joined to a string before they meet in one task.
CHUNK = 1 << 14


# --- turns of the rebuilt conversations ---


def _halves(hexadecimal: Column) -> list[Column]:
    return [F.conv(F.substring(hexadecimal, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(2)]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), a and b (a digest of role and text), bytes of the text. A conversation's turns may lie in several tasks."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    a, b = _halves(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", a.alias("a"), b.alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), "a", "b"]
    rows = common.settled(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "ranged")
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return rows.withColumn("place", place).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("before")).alias("pos"), "a", "b", "bytes")


def rebuilt(own: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """own: written turns(). (conv_id, depth, a, b, bytes) of the rebuilt conversations, and (conv_id, length) of all of them.

    Conversation c begins with the first crc32(c) % heads turns of conversation c - c % family.
    """
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    donor = F.col("conv_id") - F.col("conv_id") % family
    sizes = common.settled(sizes.select("conv_id", "n", donor.alias("donor"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")), "sizes")
    given = sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("there"))
    # a conversation that is its own donor stays as it is
    plan = sizes.withColumn("h", F.when(F.col("donor") == F.col("conv_id"), 0).otherwise(F.col("h"))).join(given, "donor", "left")
    plan = plan.select("conv_id", "donor", "n", "h", F.least(F.col("h"), F.coalesce("there", F.lit(0))).alias("taken"))
    plan = common.settled(plan, "plan")
    first = own.where(F.col("pos") < heads).select(F.col("conv_id").alias("donor"), "pos", "a", "b", "bytes")
    borrowed = first.join(plan.where("taken > 0").select("conv_id", "donor", "taken"), "donor").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "a", "b", "bytes")
    kept = common.spread_join(own, plan.select("conv_id", "h", "taken"), "conv_id", "pos").where("pos > h")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "bytes")
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return borrowed.unionByName(kept), lengths


def _paths(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each conversation and depth, 0 included: the key (ka, kb) of the node there and that of its parent (pa, pb)."""
    mixed = rows.select("conv_id", "depth", "bytes", *[F.xxhash64(F.lit(k), "depth", "a", "b").alias(f"g{'ab'[k]}") for k in range(2)], F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = common.settled(mixed, "mixed")
    whole = mixed.groupBy("conv_id", "block").agg(*[F.bit_xor(f"g{x}").alias(f"g{x}") for x in "ab"])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = whole.select("conv_id", "block", *[F.bit_xor(f"g{x}").over(earlier).alias(f"s{x}") for x in "ab"]).where("block > 0")
    run = mixed.select("conv_id", "block", "depth", "bytes", "ga", "gb", *[F.bit_xor(f"g{x}").over(within).alias(f"w{x}") for x in "ab"])
    run = run.join(start, ["conv_id", "block"], "left")
    key = {x: F.col(f"w{x}").bitwiseXOR(F.coalesce(f"s{x}", F.lit(0).cast("long"))) for x in "ab"}
    run = run.select("conv_id", "depth", "bytes", *[key[x].alias(f"k{x}") for x in "ab"], *[key[x].bitwiseXOR(F.col(f"g{x}")).alias(f"p{x}") for x in "ab"])
    run = common.spread_join(common.settled(run, "run"), lengths, "conv_id", "depth")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    top = lengths.select("conv_id", zero.alias("depth"), zero.alias("bytes"), zero.alias("ka"), zero.alias("kb"), none.alias("pa"), none.alias("pb"), "length")
    return run.withColumn("depth", F.col("depth").cast("long")).unionByName(top)


# --- conversations that end in a node ---


def _ends(paths: DataFrame) -> DataFrame:
    """ka, kb, ends_sha256 of the nodes in which conversations end."""
    rows = paths.where("depth = length").select("ka", "kb", "conv_id").repartitionByRange("ka", "kb", "conv_id").sortWithinPartitions("ka", "kb", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        for b in batches:
            out = []
            for ka, kb, c in zip(*(b.column(x).to_pylist() for x in ("ka", "kb", "conv_id")), strict=True):
                if (ka, kb) != key or size > CHUNK:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, first, ids, size = (ka, kb), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _batch(out, ("ka", "kb", "first", "ids"))
        if ids:
            yield _batch([(*key, first, ",".join(ids))], ("ka", "kb", "first", "ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out = []
            for ka, kb, ids in zip(*(b.column(x).to_pylist() for x in ("ka", "kb", "ids")), strict=True):
                if (ka, kb) == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (ka, kb), hashlib.sha256(ids.encode())
            yield _batch(out, ("ka", "kb", "ends_sha256"))
        if key:
            yield _batch([(*key, sha.hexdigest())], ("ka", "kb", "ends_sha256"))

    runs = rows.mapInArrow(common.tidy(joined), "ka long, kb long, first long, ids string")
    return runs.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "first").mapInArrow(common.tidy(hashed), "ka long, kb long, ends_sha256 string")


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("ids", "ends_sha256") else pa.int64()) for c, n in zip(columns, names, strict=True)], list(names))


# --- time-forward processing ---


class Queue:
    """A priority queue of equally long tuples of integers. Beyond `most` entries all are written, sorted, to a file in a shared folder."""

    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most, self.heap, self.runs, self.files = folder, most, [], [], []

    def push(self, entry: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        fs, at = pa.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(at, recursive=True)
        path = f"{at}/{uuid.uuid4().hex}"
        with fs.open_output_stream(path, compression=None) as out:
            out.write(np.array(sorted(self.heap), np.int64).tobytes())
        self.files.append((fs, path))
        run = self._entries(fs, path, len(self.heap[0]))
        self.heap = []
        heapq.heappush(self.runs, (next(run), len(self.files), run))

    @staticmethod
    def _entries(fs, path: str, width: int) -> Iterator[tuple[int, ...]]:
        with fs.open_input_stream(path, compression=None) as file:
            while part := file.read(8 * width * 4096):
                yield from map(tuple, np.frombuffer(part, np.int64).reshape(-1, width).tolist())

    def head(self) -> tuple[int, ...] | None:
        heads = [x[0] for x in (self.heap[:1] and [(self.heap[0],)]) + self.runs[:1]]
        return min(heads, default=None)

    def pop(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            entry, k, run = self.runs[0]
            if (following := next(run, None)) is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, k, run))
            return entry
        return heapq.heappop(self.heap)

    def close(self) -> None:
        for _, _, run in self.runs:
            run.close()
        for fs, path in self.files:
            fs.delete_file(path)


def _time_forward(nodes: DataFrame, shard: str, most: int) -> DataFrame:
    """nodes with `leaves` and `saved`, which are a node's own, replaced by totals of its subtree within its shard.

    nodes: also conv_id and depth (together the node's name), up_conv and up_depth (its parent's), and is_root (passes nothing on).
    """
    folder = tables.new_path(nodes.sparkSession, "queue")
    names = ["shard", "depth", "conv_id", "up_conv", "up_depth", "is_root", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = Queue(folder, most)
        try:
            for b in batches:
                leaves, saved = [], []
                for s, d, c, uc, ud, root, own_leaves, own_saved in zip(*(b.column(x).to_pylist() for x in names), strict=True):
                    place = (s, -d, c)
                    while (head := queue.head()) is not None and head[:3] <= place:
                        if head[:3] < place:
                            raise ValueError("a message to a node that isn't there")
                        entry = queue.pop()
                        own_leaves += entry[3]
                        own_saved += entry[4]
                    if not root:
                        queue.push((s, -ud, uc, own_leaves, own_saved))
                    leaves.append(own_leaves)
                    saved.append(own_saved)
                done = dict(zip(b.schema.names, b.columns, strict=True)) | {"leaves": pa.array(leaves, pa.int64()), "saved": pa.array(saved, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(done.values()), list(done))
        finally:
            queue.close()

    rows = nodes.withColumn("shard", F.expr(shard)).repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id")
    return rows.mapInArrow(common.tidy(run), rows.schema).drop("shard")


def _passed_on(done: DataFrame) -> DataFrame:
    """What the roots of shards pass to their parents: conv_id and depth of the parent, more_leaves, more_saved."""
    out = done.where("is_root AND up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("conv_id"), (F.col("attach")).alias("depth"))
    return out.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def _received(nodes: DataFrame, passed: DataFrame) -> DataFrame:
    more = [(F.col(x) + F.coalesce(f"more_{x}", F.lit(0).cast("long"))).alias(x) for x in ("leaves", "saved")]
    return nodes.join(passed, ["conv_id", "depth"], "left").select(*[c for c in nodes.columns if c not in ("leaves", "saved")], *more)


def _totals(tree: DataFrame, assigned: DataFrame, limit: int, most: int) -> DataFrame:
    """tree with is_root, leaves and saved; assigned: the shard of each conversation that has light nodes."""
    own = tree.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes"), "up_conv": F.col("parent_conv_id"), "up_depth": F.col("depth") - 1, "attach": F.col("depth") - 1})
    light = own.where(F.col("weight") <= limit).join(assigned, "conv_id").withColumn("is_root", F.col("up_conv").isNull() | (F.col("parent_weight") > limit))
    light = common.settled(_time_forward(light, "home", most).drop("home"), "light")
    heavy = own.where(F.col("weight") > limit).withColumn("piece", F.floor(F.col("depth") / limit))
    heavy = heavy.withColumn("is_root", F.col("up_conv").isNull() | (F.col("up_conv") != F.col("conv_id")) | (F.col("depth") % limit == 0))
    heavy = common.settled(_received(heavy, _passed_on(light)), "heavy")
    # the roots of pieces: a piece's sum, its first depth, and the piece and first depth of the parent
    pieces = heavy.groupBy("conv_id", "piece").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("depth").alias("depth"), F.min_by("up_conv", "depth").alias("up_conv"))
    pieces = common.settled(pieces.withColumn("attach", F.col("depth") - 1), "pieces")
    above = pieces.select(F.col("conv_id").alias("up_conv"), F.col("piece").alias("up_piece"), F.col("depth").alias("up_depth"))
    roots = pieces.withColumn("up_piece", F.floor(F.col("attach") / limit)).join(above, ["up_conv", "up_piece"], "left").withColumn("is_root", F.col("up_conv").isNull())
    roots = common.settled(_time_forward(roots, "0L", most), "roots")
    passed = _passed_on(roots.withColumn("is_root", F.lit(True)))
    done = _time_forward(_received(heavy, passed), "xxhash64(conv_id, piece)", most).drop("piece")
    return light.unionByName(done)


def trie(conversations: DataFrame, family: int = 5, heads: int = 9, queue: int = QUEUE) -> DataFrame:
    """One row per node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = common.settled(turns(conversations), "turns")
    rows, lengths = rebuilt(own, family, heads)
    lengths = common.settled(lengths, "lengths")
    paths = common.settled(_paths(rows, lengths), "paths")
    limit = max(LEAST_WEIGHT, paths.count() // SHARDS)
    nodes = paths.groupBy("ka", "kb", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    nodes = common.settled(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = common.settled(nodes.join(children, ["ka", "kb"], "left").fillna(0, ["n_children"]), "counted")
    parents = nodes.where("n_children > 0").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("weight").alias("parent_weight"), F.col("n_children").alias("n"))
    none = F.lit(None).cast("long")
    tree = common.attached(nodes.where("depth > 0"), parents, ["pa", "pb"]).unionByName(nodes.where("depth = 0").withColumns({"parent_conv_id": none, "parent_weight": none})).drop("pa", "pb")
    tree = common.settled(tree, "tree")
    tops = tree.where((F.col("weight") <= limit) & (F.col("parent_weight").isNull() | (F.col("parent_weight") > limit)))
    assigned = paths.select("ka", "kb", "conv_id").join(tops.select("ka", "kb"), ["ka", "kb"], "left_semi").select("conv_id", F.xxhash64("ka", "kb").alias("home"))
    totals = _totals(tree, assigned, limit, queue)
    nothing = hashlib.sha256(b"").hexdigest()
    out = totals.select("ka", "kb", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return out.join(_ends(paths), ["ka", "kb"], "left").select(*out.columns[2:], F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
