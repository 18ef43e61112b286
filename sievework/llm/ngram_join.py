"""Self-join of documents on Jaccard similarity of word shingles, and its connected components.

Method: adaptive multi-match prefixes. Shingles have a global order, rarest first, from counts over all documents. With
size n and threshold t, two documents that link share at least l of their first n - ceil(t n) + l shingles, for any l. Each
document takes the l that costs least by the estimated number of candidates, and a pair becomes a candidate when it shares
min(l, l') shingles of both prefixes.

Large groups never become pairs:
- documents with equal sets are joined as one;
- shingles are looked up within a range of set sizes, which is all that the threshold lets link;
- a prefix shingle with up to `SMALL` documents gives pairs, which are counted;
- a more frequent one compares each of its documents with one leader, the one whose prefix is most common. Documents that
  don't link with their leader are compared with all that have the same leader, in blocks of bounded size by
  matrix products over the shingles that a block shares. So no link between two components is lost.

Results: documents without words, with null or empty text link with nothing. Ids may be null (they never name a component)
or repeated (rows with one id are one place for their texts' links). An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 19
#: Counters of the frequency sketch (32 MB), whatever the size of the corpus; more of them tell rare shingles from frequent ones better.
SKETCH_BITS = 22
SKETCH = 1 << SKETCH_BITS
SKETCH_PARTS = 64
#: Partial sketches that are summed at a time.
FAN = 32
SMALL = 16
MOST_MATCHES = 6
#: Size classes are this power of 1/threshold wide.
WIDTH = 3
#: A block of the comparison within a leader's group holds about so many shingles, and about so many documents at most.
BLOCK, BLOCK_ROWS = 400_000, 1000
#: Rows of two whole sets in an Arrow batch.
PAIR_RECORDS = 100


class _Shingles:
    """Hashed distinct shingles of every row of a buffer; made once in each task."""

    def __init__(self, words: int) -> None:
        self.words, self.hash = words, common.Rolling(21)
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True

    def rows(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        data = self.fold[data]
        word = ~self.space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        first = np.flatnonzero(word & (edge[:-1] | np.r_[True, ~word[:-1]])) if len(data) else np.zeros(0, np.int64)
        last = np.flatnonzero(word & (edge[1:] | np.r_[~word[1:], True])) + 1 if len(data) else first
        token = self.hash.ranges(self.hash.prefix(data), first, last)
        bound = np.searchsorted(first, at)
        n = self.words
        shingle = np.zeros(max(0, len(token) - n + 1), np.uint64)
        for i in range(n):
            shingle = common.mix(shingle * np.uint64(0x9E3779B97F4A7C15) + token[i : len(token) - n + 1 + i]) if len(shingle) else shingle
        out = []
        for s, e in zip(bound[:-1], bound[1:], strict=True):
            if e - s >= n:
                out.append(np.unique(shingle[s : e - n + 1]))
            else:
                short = np.full(min(1, e - s), e - s, np.uint64)
                for x in token[s:e]:
                    short = common.mix(short * np.uint64(0x9E3779B97F4A7C15) + x)
                out.append(short)
        return out


def _digest(s: np.ndarray) -> bytes:
    """128 bits that tell sets of hashes apart."""
    return np.array([common.mix(s).sum(dtype=np.uint64), common.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(s))], ">u8").tobytes()


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """One row per document with its digest and set size, and the partial sketch of each task in SKETCH_PARTS rows: all
    counts, or, where that is shorter, slots and then their counts."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def run(batches):
        kernel, counts, waiting = _Shingles(words), np.zeros(SKETCH, np.int32), []
        for whole in batches:
            for b in common.slices(whole, "_text", CHUNK):
                sets = kernel.rows(*common.text_buffer(b.column("_text")))
                waiting += [(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32) for s in sets]
                if sum(map(len, waiting)) > SKETCH // 4:
                    counts += np.bincount(np.concatenate(waiting), minlength=SKETCH).astype(np.int32)
                    waiting = []
                none = pa.nulls(len(sets), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), none, none, pa.nulls(len(sets), pa.list_(pa.int32()))], ["id", "h", "n", "digest", "part", "task", "counts"])
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=SKETCH).astype(np.int32)
        if counts.any():
            # only what a task has counted, so small tasks write little
            slots = [np.flatnonzero(x) for x in counts.reshape(SKETCH_PARTS, -1)]
            parts = [(np.r_[k, x[k]] if 2 * len(k) < len(x) else x).astype(np.int32) for k, x in zip(slots, counts.reshape(SKETCH_PARTS, -1), strict=True)]
            id_arrow = pa.nulls(SKETCH_PARTS, whole.schema.field("_id").type)
            yield pa.RecordBatch.from_arrays([id_arrow, pa.nulls(SKETCH_PARTS, pa.int64()), pa.nulls(SKETCH_PARTS, pa.int64()), pa.nulls(SKETCH_PARTS, pa.binary()), pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), pa.array(np.full(SKETCH_PARTS, TaskContext.get().partitionId(), np.int32)), pa.array(parts, pa.list_(pa.int32()))], ["id", "h", "n", "digest", "part", "task", "counts"])

    return docs.mapInArrow(common.tidy(run), f"id {id_type}, h long, n long, digest binary, part int, task int, counts array<int>")


def _sketch(scan: DataFrame) -> np.ndarray:
    """The summed counters: SKETCH numbers, so bounded for any corpus. Tasks are summed on the executors, `FAN` at a time, so no
    group reads more than FAN partial sketches of SKETCH / SKETCH_PARTS counters, however many tasks there were."""
    per = SKETCH // SKETCH_PARTS

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(per, np.int64)
        for t in batches:
            for row in t.column("counts"):
                x = row.values.to_numpy()
                if len(x) == per:
                    total += x
                else:
                    slots, more = x.reshape(2, -1)
                    total[slots] += more
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total], pa.list_(pa.int32()))], ["part", "task", "counts"])

    parts = scan.where("part is not null").select("part", "task", "counts")
    last = parts.agg(F.max("task")).first()[0]
    out = np.zeros((SKETCH_PARTS, per), np.int32)
    while last is not None:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("part", "task").applyInArrow(add, "part int, task int, counts array<int>")
        last //= FAN
        if not last:
            break
        parts = common.settled(parts, "sketch")
    if last is not None:
        for b in common._arrow_batches(parts):
            for p, c in zip(b.column("part"), b.column("counts"), strict=True):
                out[p.as_py()] = c.values.to_numpy()
    return out.ravel()


def _matches(others: np.ndarray, base: int) -> int:
    """The l of least estimated cost. A prefix shingle costs an entry; a candidate costs a whole set. Any two documents share a
    rare shingle now and then, but rarely several, so each further match asked for divides the candidates by a factor."""
    most = min(MOST_MATCHES, len(others) - base)
    if most <= 1:
        return 1
    l = np.arange(1, most + 1)
    candidates = (0.1 + np.cumsum(others)[base : base + most] / (base + l)) * (base + l) / 20.0 ** (l - 1)
    return int(np.argmin(3 * (base + l) + len(others) * candidates)) + 1


def _prefixes(docs: DataFrame, words: int, threshold: tuple[int, int], sketch: np.ndarray) -> DataFrame:
    """digest, n, matches, central and the shingles of the prefix with the size classes mixed in, once per distinct set."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)
    num, den = threshold

    def run(batches):
        kernel, counts = _Shingles(words), held.value
        noise = int(np.median(counts))
        wide = np.log(den / num) * WIDTH
        for whole in batches:
            for b in common.slices(whole, "_text", CHUNK):
                out = []
                for s in kernel.rows(*common.text_buffer(b.column("_text"))):
                    if not len(s):
                        continue
                    n = len(s)
                    freq = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.lexsort((s, freq))
                    need = -(-num * n // den)
                    other = np.maximum(0, freq[order] - noise)
                    k = _matches(other, n - need)
                    prefix = s[order[: n - need + k]]
                    low, high = int(np.log(n) / wide), int(np.log(n * den / num + 1e-9) / wide)
                    keys = [common.mix(prefix + np.uint64(c * 2654435761 + 1)) for c in range(low, high + 1)]
                    central = int(np.log1p(other[: n - need + k]).sum() * 1000) * 1000 // (n - need + k)
                    out.append((_digest(s), n, k, central, np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.list_(pa.int64()))], ["digest", "n", "matches", "central", "keys"])

    rows = docs.mapInArrow(common.tidy(run), "digest binary, n long, matches int, central long, keys array<long>")
    return rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n", "matches", "central", "keys")))


def _often(entries: DataFrame, bits: np.ndarray) -> DataFrame:
    """The entries with those keys only that the bitmap marks."""
    held = entries.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            keys = b.column("keys")
            hit = common.in_bitmap(held.value, keys.values.to_numpy()[keys.offsets[0].as_py() : keys.offsets[-1].as_py()]) if b.num_rows else np.zeros(0, bool)
            flat = keys.flatten().filter(pa.array(hit))
            ends = np.r_[0, np.cumsum(hit)][keys.offsets.to_numpy() - keys.offsets[0].as_py()]
            kept = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("digest", "n", "matches", "central")), kept], ["digest", "n", "matches", "central", "keys"])

    return entries.select("digest", "n", "matches", "central", "keys").mapInArrow(common.tidy(run), "digest binary, n long, matches int, central long, keys array<long>")


def _sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """digest, n and the whole set of the wanted digests, one row each."""
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap(wanted.select(_head("digest").alias("h")), "h"))

    def run(batches):
        kernel = _Shingles(words)
        for whole in batches:
            for b in common.slices(whole, "_text", CHUNK):
                sets = [s for s in kernel.rows(*common.text_buffer(b.column("_text"))) if len(s)]
                digests = [_digest(s) for s in sets]
                hit = common.in_bitmap(bits.value, np.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], np.int64)) if sets else []
                take = [(d, s) for d, s, h in zip(digests, sets, hit, strict=True) if h]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in take], pa.binary()), pa.array([s.tobytes() for _, s in take], pa.binary())], ["digest", "members"])

    rows = docs.mapInArrow(common.tidy(run), "digest binary, members binary")
    return rows.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("members").alias("members"))


def _head(c: str):
    """The first 8 bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(c, 1, 8)), 16, -10).cast("long")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """pairs (a, b) with `linked`, by their whole sets."""
    num, den = threshold
    # a leader may stand in very many pairs
    joined = common.spread_join(pairs, sets.select(F.col("digest").alias("b"), F.col("members").alias("mb")), "b", "a").join(sets.select(F.col("digest").alias("a"), F.col("members").alias("ma")), "a")

    def run(batches):
        for b in batches:
            yes = []
            for x, y in zip(b.column("ma"), b.column("mb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) * den >= num * len(y) and len(y) * den >= num * len(x) else 0
                yes.append(both * den >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(yes, pa.bool_())], ["a", "b", "linked"])

    return joined.select("a", "b", "ma", "mb").mapInArrow(common.tidy(run), "a binary, b binary, linked boolean")


def _block_edges(left: list, right: list, threshold: tuple[int, int]) -> list[tuple[bytes, bytes]]:
    """Links between two lists of (digest, set): a spanning forest of them. Shingles that one row alone has can't match."""
    num, den = threshold
    rows = left + right
    sizes = np.array([len(s) for _, s in rows])
    every = np.concatenate([s for _, s in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, col = owner[keep], column[inverse[keep]]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), 4096):  # a bounded part of the columns at a time
        here = (col >= start) & (col < start + 4096)
        m = np.zeros((len(rows), 4096), np.float32)
        m[owner[here], col[here] - start] = 1
        both += m[: len(left)] @ m[len(left) :].T
    union = sizes[: len(left), None] + sizes[None, len(left) :] - both
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in np.argwhere(den * both >= num * union):
        a, b = find(int(i)), find(len(left) + int(j))
        if a != b and rows[i][0] != rows[len(left) + j][0]:
            parent[a] = b
            out.append((rows[i][0], rows[len(left) + j][0]))
    return out


def _within_leaders(stars: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Edges between documents of one leader of which at least one isn't linked with it. stars: a, b (the leader), linked, n."""
    total = stars.groupBy("b").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"), F.count_if(~F.col("linked")).alias("open"), F.count(F.lit(1)).alias("n")).where("open > 0")
    total = common.settled(total.select("b", "blocks", "n", F.col("n").alias("size")), "groups")
    rows = common.attached(stars.select("a", "b", "linked"), total, "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    rows = common.settled(rows, "blocks")
    free = rows.where("not linked")
    probe = free.select("a", "b", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("against"), F.lit(True).alias("probe"))
    # a block is needed against those blocks only that have an open document
    opened = common.settled(free.groupBy("b").agg(F.collect_set("block").alias("opened"), F.max("size").alias("n")), "opened")
    target = common.attached(rows.select("a", "b", F.col("block").alias("against")), opened, "b").select("a", "b", F.explode("opened").alias("block"), "against", F.lit(False).alias("probe"))
    tasks = probe.select("a", "b", "block", "against", "probe").unionByName(target)
    tasks = tasks.join(sets.select(F.col("digest").alias("a"), "members"), "a")
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for t in batches:
            for a, probe, members in zip(t.column("a").to_pylist(), t.column("probe").to_pylist(), t.column("members").to_pylist(), strict=True):
                (left if probe else right).append((a, np.frombuffer(members, np.uint64)))
        edges = _block_edges(left, right, threshold) if left and right else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.binary()), pa.array([y for _, y in edges], pa.binary())], ["a", "b"])

    return tasks.groupBy("b", "block", "against").applyInArrow(run, "a binary, b binary")


def _joined(docs: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """id, h, n, digest, root and component_id of every row; docs as from common.keyed."""
    num, den = threshold
    scan = common.settled(_scan(docs, words), "scan")
    base = scan.where("part is null").select("id", "h", "n", "digest")
    entries = common.settled(_prefixes(docs, words, threshold, _sketch(scan)), "prefixes")
    counts = entries.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    counts = common.settled(counts, "keys")
    flat = _often(entries, common.bitmap(counts, "key")).select("digest", "n", "matches", "central", F.explode("keys").alias("key"))
    shared = common.settled(common.attached(flat, counts.select("key", "docs", F.col("docs").alias("n")), "key"), "shared")
    few = shared.where(F.col("docs") <= SMALL)
    x, y = (few.select("key", *(F.col(c).alias(f"{p}_{c}") for c in ("digest", "n", "matches"))) for p in "xy")
    pairs = x.join(y, "key").where(F.expr(f"x_digest < y_digest and x_n * {den} >= y_n * {num} and y_n * {den} >= x_n * {num}"))
    pairs = pairs.groupBy(F.col("x_digest").alias("a"), F.col("y_digest").alias("b")).agg(F.count(F.lit(1)).alias("m"), F.min(F.least("x_matches", "y_matches")).alias("l")).where("m >= l").select("a", "b")
    pairs = common.settled(pairs, "pairs")
    many = shared.where(F.col("docs") > SMALL)
    leaders = common.settled(many.groupBy("key").agg(F.max_by("digest", F.struct("central", "digest")).alias("leader"), F.count(F.lit(1)).alias("n")), "leaders")
    stars = common.attached(many.select("key", "digest", F.col("n").alias("size")), leaders, "key").select(F.col("digest").alias("a"), F.col("leader").alias("b"), F.col("size").alias("n")).distinct()
    stars = common.settled(stars, "stars")
    wanted = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).unionByName(stars.select(F.col("a").alias("digest"))).distinct()
    sets = common.settled(_sets(docs, words, wanted), "sets")
    checked = common.settled(_linked(common.settled(pairs.unionByName(stars.where("a <> b").select("a", "b")).distinct(), "compared"), sets, threshold), "checked", PAIR_RECORDS)
    edges = checked.where("linked").select("a", "b")
    around = stars.join(checked, ["a", "b"], "left").select("a", "b", "n", F.coalesce("linked", F.lit(True)).alias("linked"))
    edges = edges.unionByName(common.settled(_within_leaders(around, sets, threshold), "inner", PAIR_RECORDS))
    roots = common.components(edges, "a", "b").withColumnRenamed("node", "digest")
    least = base.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"))
    named = least.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = common.settled(named, "named")
    smallest = common.settled(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "smallest")
    of = common.attached(named.select("digest", "root"), smallest, "root")
    return base.join(of, "digest", "left").select("id", "h", "n", "digest", "root", F.coalesce("component_id", "id").alias("component_id"))


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: tuple[int, int] = (9, 10)) -> DataFrame:
    """id, n_shingles, digest of the set, component (a digest; null without words) and component_id (its smallest id)."""
    rows = _joined(common.keyed(docs, id_col, text_col), words, threshold)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "digest", F.col("root").alias("component"), "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """The rows of docs, one of each component: that of the smallest id (nulls last), then of the smallest hash of id and text. Of
    repeated rows one stays; rows without words all stay. Texts of rows that no other row resembles aren't shuffled."""
    rows = common.settled(_joined(common.keyed(docs, id_col, text_col), words, threshold).where("root is not null").select("id", "h", "root"), "groups")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    grouped = rows.join(first, "root")
    mine = (F.col("h") == F.col("first.h")) & F.col("id").eqNullSafe(F.col("first.id"))
    # what each key of a group of several rows is: the one that stays, or not
    keys = common.settled(grouped.select("id", "h", mine.alias("stays")).distinct(), "decided")
    bits = common.bitmap(keys.select("h").distinct(), "h")
    marked = docs.withColumn("__sw_h", F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    alone = common.keep_marked(marked, "__sw_h", bits, inverse=True)
    k = keys.select(F.col("id").alias("__sw_k"), F.col("h").alias("__sw_kh"), F.col("stays").alias("__sw_stays"))
    several = common.keep_marked(marked, "__sw_h", bits).join(k, (F.col("__sw_h") == F.col("__sw_kh")) & F.col(id_col).eqNullSafe(F.col("__sw_k")), "left")
    other = several.where("__sw_stays is null")
    stay = several.where("__sw_stays").dropDuplicates(["__sw_h", id_col])
    return alone.select(*docs.columns).unionByName(other.select(*docs.columns)).unionByName(stay.select(*docs.columns))
