"""Removal of byte strings that occur more than once in a corpus.

Method: a depth-limited most-significant-digit radix sort of suffixes, each by its first `threshold` bytes (its window). A radix
sort may take the digits of a key in any fixed order; here the first digit of a window is the half of it with the least hash
(leftmost on ties), its anchor. Equal windows have equal anchors at equal places, and neighbouring suffixes mostly have one
anchor in common, so they go through the first passes together, as one row with a range of starts (a context).

pass 1 groups contexts by the anchor's digit; a digit that occurs once leaves.
pass 2 groups by the whole context. Equal contexts, as in copies, make every window in them a repeated one; all but one leave.
pass 3 groups by the quarter before or after the anchor, whichever a window has whole; groups of one leave.
pass 4 sorts the suffixes of a group of pass 3 one by one, by their bytes: the anchor's place first, then digits of a quarter
       window from left to right. Groups of one leave after each digit; the groups after the last digit are exactly the repeated
       windows, equal byte for byte.
Groups of pass 3 with more than `GROUP` contexts don't meet in a task: their suffixes are dealt by digests of whole windows and
only counted. Digests of passes 1 to 3 have 64 bits for each digit, 128 for a context.

Results: rows with null or empty text have 0 bytes and nothing removed; repeated rows count as separate places; rows of one
id and text get the same result; ids may be null or repeated; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 19
#: Contexts of a group that are sorted together.
GROUP = 1000


class _Kernel:
    """Anchors and digests of windows; made once in each task."""

    def __init__(self, threshold: int) -> None:
        self.n, self.k = threshold, threshold // 2
        self.span, self.side = threshold - self.k + 1, (threshold - self.k) // 2
        self.one, self.two = common.Rolling(11), common.Rolling(12)

    def _least(self, key: np.ndarray) -> np.ndarray:
        """Minimum of each `span` neighbours: prefix minima of blocks against suffix minima of blocks."""
        w, m = self.span, len(key)
        padded = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:m] = key
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(behind[: m - w + 1], ahead[w - 1 : m])

    def anchors(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """row, digit, context digest, first and last window start, anchor (all three within the row), digests of both sides (0: none)."""
        if len(data) < self.n:
            return tuple(np.zeros(0, np.int64 if i in (0, 3, 4, 5) else np.uint64) for i in range(8))
        s1, s2 = self.one.prefix(data), self.two.prefix(data)
        place = np.arange(len(data) - self.k + 1)
        digit = self.one.ranges(s1, place, place + self.k)
        least = self._least((digit & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64))
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.searchsorted(at, np.arange(len(anchor)), "right") - 1
        inside = np.flatnonzero(np.arange(len(anchor)) + self.n <= at[row + 1])
        if not len(inside):
            return self.anchors(data[:0], at)
        a, r = anchor[inside], row[inside]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
        last = np.r_[new[1:], len(a)] - 1
        lo, hi, a, r = inside[new], inside[last], a[new], r[new]
        shape = (a - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)
        context = common.mix(self.one.ranges(s1, lo, hi + self.n) + shape) ^ (self.two.ranges(s2, lo, hi + self.n) + shape * np.uint64(0x9E3779B97F4A7C15))
        left, right, side = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64), self.side
        has = lo <= a - side
        left[has] = self.two.ranges(s2, a[has] - side, a[has]) | np.uint64(1)
        has, far = hi >= a - side, self.n - self.k - side
        right[has] = self.two.ranges(s2, a[has] + self.k, a[has] + self.k + far) | np.uint64(1)
        # the least of many hashes isn't even over all values, so it is mixed again
        return r, common.mix(digit[a]), context, lo - at[r], hi - at[r], a - at[r], left, right

    def windows(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ranges of starts in one row: the range, the start and the digest of each window."""
        which = np.repeat(np.arange(len(lo)), hi - lo + 1)
        start = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[which]
        s1, s2 = self.one.prefix(data), self.two.prefix(data)
        return which, start, self.one.ranges(s1, start, start + self.n) ^ common.mix(self.two.ranges(s2, start, start + self.n))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(docs: DataFrame, threshold: int) -> DataFrame:
    def run(batches):
        kernel = _Kernel(threshold)
        for whole in batches:
            for b in common.slices(whole, "_text", CHUNK):
                data, at = common.text_buffer(b.column("_text"))
                row, digit, context, lo, hi, anchor, left, right = kernel.anchors(data, at)
                columns = [b.column("_id").take(pa.array(row)), b.column("_h").take(pa.array(row)), _signed(digit), _signed(context), *(pa.array(x.astype(np.int32)) for x in (lo, hi, anchor)), _signed(left), _signed(right)]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_h", "digit", "context", "lo", "hi", "anchor", "before", "after"])

    id_type = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(common.tidy(run), f"_id {id_type}, _h long, digit long, context long, lo int, hi int, anchor int, before long, after long")


def _ranged(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """The distinct rows that have contexts in parts, with these as an array."""
    of = parts.groupBy("_id", "_h").agg(F.collect_list(F.struct("lo", "hi", "anchor", "digit", "name")).alias("ranges")).select(F.col("_id").alias("p_id"), F.col("_h").alias("p_h"), "ranges")
    wanted = common.keep_marked(docs, "_h", common.bitmap(parts.select("_h").distinct(), "_h")).dropDuplicates(["_id", "_h"])
    return wanted.join(of, (F.col("_h") == F.col("p_h")) & F.col("_id").eqNullSafe(F.col("p_id"))).select("_id", "_h", "_text", "ranges")


def _window_rows(docs: DataFrame, parts: DataFrame, threshold: int) -> DataFrame:
    """The windows of the given contexts, each with a digest."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def run(batches):
        kernel = _Kernel(threshold)
        for whole in batches:
            for b in common.slices(whole, "_text", CHUNK):
                ranges = b.column("ranges").to_pylist()
                for i in range(b.num_rows):
                    data, _ = common.text_buffer(b.column("_text").slice(i, 1))
                    lo, hi, digit = (np.array([r[k] for r in ranges[i]], np.int64) for k in ("lo", "hi", "digit"))
                    which, start, whole = kernel.windows(data, lo, hi)
                    same = pa.array(np.zeros(len(start), np.int64))
                    yield pa.RecordBatch.from_arrays([b.column("_id").slice(i, 1).take(same), b.column("_h").slice(i, 1).take(same), pa.array(start.astype(np.int32)), pa.array(digit[which]), _signed(whole)], ["_id", "_h", "start", "digit", "whole"])

    return _ranged(docs, parts).mapInArrow(common.tidy(run), f"_id {id_type}, _h long, start int, digit long, whole long")


def _context_bytes(docs: DataFrame, parts: DataFrame, threshold: int) -> DataFrame:
    """The given contexts with their bytes; `at` is the anchor's place in the first window, `count` the number of windows."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, "_text", CHUNK):
                owner, texts, rows = [], [], []
                for i, ranges in enumerate(b.column("ranges").to_pylist()):
                    data = b.column("_text")[i].as_py().encode()
                    rows += ranges
                    owner += [i] * len(ranges)
                    texts += [data[r["lo"] : r["hi"] + threshold] for r in ranges]
                column = lambda f, kind: pa.array([f(r) for r in rows], kind)
                keys = [b.column(c).take(pa.array(owner, pa.int64())) for c in ("_id", "_h")]
                yield pa.RecordBatch.from_arrays([*keys, column(lambda r: r["digit"], pa.int64()), column(lambda r: r["name"], pa.int64()), column(lambda r: r["lo"], pa.int32()), column(lambda r: r["anchor"] - r["lo"], pa.int32()), column(lambda r: r["hi"] - r["lo"] + 1, pa.int32()), pa.array(texts, pa.binary())], ["_id", "_h", "digit", "name", "lo", "at", "count", "bytes"])

    return _ranged(docs, parts).mapInArrow(common.tidy(run), f"_id {id_type}, _h long, digit long, name long, lo int, at int, count int, bytes binary")


def equal_windows(contexts: list[tuple[bytes, int, int]], threshold: int) -> list[list[int]]:
    """By context, the sorted numbers of its windows that another window of the group equals. contexts: bytes, place of the anchor in
    the first window, number of windows."""
    digit = max(1, threshold // 4)
    first: dict[int, list[tuple[int, int]]] = {}
    for i, (_, at, count) in enumerate(contexts):
        for j in range(count):
            first.setdefault(at - j, []).append((i, j))
    todo, found = [(g, 0) for g in first.values() if len(g) > 1], [[] for _ in contexts]
    while todo:
        group, depth = todo.pop()
        if depth >= threshold:
            for i, j in group:
                found[i].append(j)
            continue
        stop = min(depth + digit, threshold)
        dealt: dict[bytes, list[tuple[int, int]]] = {}
        for i, j in group:
            dealt.setdefault(contexts[i][0][j + depth : j + stop], []).append((i, j))
        todo += [(g, stop) for g in dealt.values() if len(g) > 1]
    return [sorted(x) for x in found]


def _sorted_groups(contexts: DataFrame, threshold: int, size: int) -> DataFrame:
    """(_id, _h, lo, hi): ranges of repeated starts within the groups (digit, name). Tasks have about 1 MB each, or 64 MB where that
    would be more than a thousand tasks; a bin of groups is taken at a time, 8 MB at most."""
    parts = max(1, min(size >> 20, 1000), size >> 26)
    bins = max(parts, size >> 23)
    id_type = contexts.schema["_id"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[int, int], list] = {}
        for b in batches:
            id_arrow = b.schema.field("_id").type
            for digit, name, *row in zip(*(b.column(c).to_pylist() for c in ("digit", "name", "_id", "_h", "lo", "at", "count", "bytes")), strict=True):
                groups.setdefault((digit, name), []).append(row)
        out = []
        for rows in groups.values():
            for (i, h, lo, *_), starts in zip(rows, equal_windows([(r[5], r[3], r[4]) for r in rows], threshold), strict=True):
                for k, j in enumerate(starts):
                    if k and starts[k - 1] == j - 1:
                        out[-1][3] = lo + j
                    else:
                        out.append([i, h, lo + j, lo + j])
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_arrow), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])], ["_id", "_h", "lo", "hi"])

    dealt = contexts.withColumn("bin", F.pmod(F.xxhash64("digit", "name"), F.lit(bins)).cast("long"))
    return dealt.repartition(parts, "bin").groupBy("bin").applyInArrow(run, f"_id {id_type}, _h long, lo int, hi int")


def repeated_windows(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """(_id, _h, lo, hi): ranges of starts of windows that also start elsewhere; docs as from common.keyed."""
    anchors = _anchor_rows(docs, threshold)
    # pass 1
    often = anchors.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit")
    anchors = common.settled(common.keep_marked(anchors, "digit", common.bitmap(common.settled(often, "digits"), "digit")), "anchors")
    # pass 2: contexts that occur twice or more
    pairs = anchors.groupBy("digit", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_h", "_id", "lo", "hi", "anchor", "before", "after")).alias("one"))
    pairs = common.settled(pairs.select("digit", "context", "n", "one.*"), "contexts")
    whole = common.having(anchors.select("digit", "context", "_id", "_h", "lo", "hi"), pairs.where("n > 1").select("digit", "context", "n"), ["digit", "context"]).select("_id", "_h", "lo", "hi")
    # pass 3, with one copy of each context
    middle = F.col("anchor") - (threshold - threshold // 2) // 2
    left = F.struct(F.xxhash64(F.lit("before"), "before").alias("name"), F.col("lo").alias("lo"), F.least("hi", middle).alias("hi"))
    right = F.struct(F.xxhash64(F.lit("after"), "after").alias("name"), F.greatest("lo", middle + 1).alias("lo"), F.col("hi").alias("hi"))
    sides = pairs.select("_id", "_h", "digit", "anchor", F.explode(F.array(left, right)).alias("s")).select("_id", "_h", "digit", "anchor", "s.*").where("lo <= hi")
    counts = common.settled(sides.groupBy("digit", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "quarters")
    few = common.settled(sides.join(counts.where(F.col("n") <= GROUP).select("digit", "name"), ["digit", "name"], "left_semi"), "groups")
    size = few.agg(F.sum(F.col("hi") - F.col("lo") + threshold)).first()[0] or 0
    # pass 4
    contexts = common.settled(_context_bytes(docs, few, threshold), "bytes")
    single = _sorted_groups(contexts, threshold, size).unionByName(_large_groups(docs, sides, counts.where(F.col("n") > GROUP), threshold))
    return common.settled(whole.unionByName(single), "repeated")


def _large_groups(docs: DataFrame, sides: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """As _sorted_groups, for groups of more than GROUP contexts."""
    large = common.settled(common.having(sides, counts, ["digit", "name"]), "large")
    windows = common.settled(_window_rows(docs, large, threshold), "windows")
    again = common.settled(windows.groupBy("digit", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    return common.having(windows, again, ["digit", "whole"]).select("_id", "_h", F.col("start").alias("lo"), F.col("start").alias("hi"))


def _cut(text: bytes, ranges: list[tuple[int, int]], threshold: int) -> tuple[int, int, str]:
    """Bytes and runs removed, and the digest of what is left."""
    kept, removed, spans, at, stop = hashlib.sha256(), 0, 0, 0, -1
    for lo, hi in sorted(ranges):
        if lo > stop:
            kept.update(text[at:lo])
            spans += 1
            at = lo
        stop = max(stop, hi + threshold)
        removed += max(0, stop - at)
        at = max(at, stop)
    kept.update(text[at:])
    return removed, spans, kept.hexdigest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 400) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) of every row."""
    docs = common.keyed(docs, id_col, text_col)
    id_type = docs.schema["_id"].dataType.simpleString()
    found = repeated_windows(docs, threshold)
    bits = common.bitmap(found.select("_h").distinct(), "_h")
    ranges = found.groupBy("_id", "_h").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")).select(F.col("_id").alias("p_id"), F.col("_h").alias("p_h"), "ranges")
    touched = common.keep_marked(docs, "_h", bits).join(ranges, (F.col("_h") == F.col("p_h")) & F.col("_id").eqNullSafe(F.col("p_id")), "left").select("_id", "_text", "ranges")

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, "_text", CHUNK):
                texts = [x.encode() for x in b.column("_text").to_pylist()]
                cuts = [_cut(t, [(r["lo"], r["hi"]) for r in rs or []], threshold) for t, rs in zip(texts, b.column("ranges").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([c[0] for c in cuts], pa.int64()), pa.array([c[1] for c in cuts], pa.int64()), pa.array([c[2] for c in cuts], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    cut = touched.mapInArrow(common.tidy(run), f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    clean = common.keep_marked(docs, "_h", bits, inverse=True).select(F.col("_id").alias("id"), F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("_text").cast("binary"), 256).alias("kept_sha256"))
    return cut.unionByName(clean).withColumnRenamed("id", id_col)
