"""Near-duplicate vectors by spherical-cap filters.

Method: the space is cut into `BLOCKS` parts, each with a small code of random unit directions; a filter is one direction of
each part. A vector is decoded to all filters whose cap holds it (their summed products exceed a height), by merging the
sorted sums of two halves, so the cost follows the number of answers; at least `LEAST` filters are taken by lowering the cap
for a vector. Vectors that share label and filter are compared exactly, in double precision. The number of filters
grows with the number of vectors, so buckets don't.

Equal vectors are one node with a weight. A bucket of more than `BUCKET` vectors is compared in pairs of parts, and a task
gives counts and a spanning forest, never all pairs: a pair is counted in the first filter that both have. Recall is that of
the filters (0.987 and more, measured on pairs at cosine 0.981 in 16 to 384 dimensions); precision is exact.

Results: rows whose vector is null, zero or has null or non-finite components, or whose label is null, link with nothing and
are kept; ids may repeat (rows of one id and vector count one by one); rows with a null id name no component and are not kept. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCKS, EXPECTED, LEAST, BUCKET = 4, 12, 8, 512
#: Filters for each vector; with more, fewer vectors share one by chance.
FILTERS = 8
#: Buckets are small, so a task takes those of about so many rows together.
TASK_ROWS = 4000
#: Large buckets whose numbers of parts are broadcast; more are joined.
LARGE = 1 << 18


class Caps:
    """The filters for vectors of one dimension."""

    def __init__(self, dims: int, code: int) -> None:
        rng = np.random.Generator(np.random.PCG64([dims, code, 5]))
        self.parts = np.array_split(np.arange(dims), BLOCKS)
        self.codes = []
        for p in self.parts:
            c = rng.standard_normal((code, len(p)))
            norm = np.linalg.norm(c, axis=1, keepdims=True)
            self.codes.append(c / np.where(norm == 0, 1, norm))
        self.code = code
        # the sum of products of a random unit vector is about normal with variance BLOCKS / dims
        self.height = NormalDist().inv_cdf(max(0.5, 1 - EXPECTED / code**BLOCKS)) * (BLOCKS / max(dims, 1)) ** 0.5

    def decode(self, x: np.ndarray) -> np.ndarray:
        """All filters whose cap holds the unit vector x, sorted."""
        s = [c @ x[p] for c, p in zip(self.codes, self.parts, strict=True)]
        left, right = np.add.outer(s[0], s[1]).ravel(), np.add.outer(s[2], s[3]).ravel()
        order = np.argsort(-right)
        falling, height = right[order], self.height
        while True:
            count = np.searchsorted(-falling, left - height, "right")
            if count.sum() >= min(LEAST, self.code**BLOCKS):
                break
            height -= 0.05 * max(abs(height), 0.1)
        i = np.repeat(np.arange(len(left)), count)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)]
        return np.sort(i * self.code**2 + j)


def _nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, node (a digest of label and vector; null if it can't link), group (label and dimension), vector."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # which says all of them in half the room
    item, kind = ("float", pa.float32()) if single else ("double", pa.float64())
    source = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.col(label_col).cast("string").alias("_l"))
    id_type = source.schema["_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            nodes, groups, values = [], [], []
            for v, label in zip(b.column("_v"), b.column("_l").to_pylist(), strict=True):
                x = None if label is None or not v.is_valid or v.values.null_count or not len(v.values) else v.values.to_numpy()
                if x is None or not np.isfinite(x).all() or not np.any(x) or not 0 < np.linalg.norm(x) < np.inf:
                    x = None
                group = None if x is None else f"{len(x)}:{label}"
                nodes.append(None if x is None else hashlib.blake2b(x.tobytes() + group.encode(), digest_size=16).digest())
                groups.append(group)
                values.append(x)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(nodes, pa.binary()), pa.array(groups, pa.string()), pa.array(values, pa.list_(pa.float64())).cast(pa.list_(kind))], ["id", "node", "group", "vector"])

    return source.mapInArrow(common.tidy(run), f"id {id_type}, node binary, group string, vector array<{item}>")


def _bucketed(nodes: DataFrame, code: int) -> DataFrame:
    def run(batches):
        caps: dict[int, Caps] = {}
        for b in batches:
            found = []
            for v in b.column("vector"):
                x = v.values.to_numpy().astype(float)
                caps.setdefault(len(x), Caps(len(x), code)) if len(x) not in caps else None
                found.append(caps[len(x)].decode(x / np.linalg.norm(x)))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("group"), b.column("weight"), b.column("vector"), pa.array(found, pa.list_(pa.int64()))], ["node", "group", "weight", "vector", "filters"])

    return nodes.select("node", "group", "weight", "vector").mapInArrow(common.tidy(run), f"node binary, group string, weight long, vector {nodes.schema['vector'].dataType.simpleString()}, filters array<long>")


def _compare(rows: list[dict], other: list[dict] | None, this: int, threshold: float) -> tuple[list, list]:
    """Links in a bucket (or between two parts of one): (node, linked weight) and spanning edges."""
    every = rows + (other or [])
    n, m = len(every), len(rows)
    x = np.stack([r["vector"] for r in every]).astype(float)
    norm = np.linalg.norm(x, axis=1)
    left, right = (slice(0, n), slice(0, n)) if other is None else (slice(0, m), slice(m, n))
    near = (x[left] @ x[right].T) / np.outer(norm[left], norm[right]) >= threshold
    if other is None:
        np.fill_diagonal(near, False)
    if not near.any():
        return [], []
    # pairs that share an earlier filter have been counted there
    earlier = [[f for f in r["filters"] if f < this] for r in every]
    names = {f: i for i, f in enumerate({f for fs in earlier for f in fs})}
    first = near
    if names:
        has = np.zeros((n, len(names)), np.float32)
        for i, fs in enumerate(earlier):
            has[i, [names[f] for f in fs]] = 1
        first = near & ((has[left] @ has[right].T) == 0)
    weight = np.array([r["weight"] for r in every], np.int64)
    linked = np.zeros(n, np.int64)
    linked[left] += first @ weight[right]
    if other is not None:
        linked[right] += first.T @ weight[left]
    label = np.arange(n)
    while True:  # the smallest number that is reachable
        new = label.copy()
        new[left] = np.minimum(new[left], np.where(near, label[right][None, :], n).min(1))
        new[right] = np.minimum(new[right], np.where(near, label[left][:, None], n).min(0))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(every[i]["node"], int(linked[i])) for i in np.flatnonzero(linked)], [(every[i]["node"], every[label[i]]["node"]) for i in np.flatnonzero(label != np.arange(n))]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """id, n_links, component_id, kept: one row per vector."""
    rows = common.settled(_nodes(vectors, id_col, vector_col, label_col), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("group").alias("group"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    nodes = common.settled(nodes, "nodes")
    code = max(8, round((FILTERS * (nodes.count() + 1)) ** (1 / BLOCKS)))
    spread = common.settled(_bucketed(nodes, code), "filters")
    bucket = F.xxhash64("group", "filter")
    sizes = spread.select("group", F.explode("filters").alias("filter")).groupBy("group", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = common.settled(sizes.withColumn("bucket", bucket), "buckets")
    # vectors of buckets of one aren't shuffled
    flat = common.keep_marked(spread.select("node", "group", "weight", "vector", "filters", F.explode("filters").alias("filter")).withColumn("bucket", bucket), "bucket", common.bitmap(sizes, "bucket"))
    large = sizes.where(F.col("n") > BUCKET).select("group", "filter", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
    few = large.limit(LARGE + 1).count()
    there = flat.join(F.broadcast(large) if few <= LARGE else large, ["group", "filter"], "left") if few else flat.withColumn("parts", F.lit(1))
    there = there.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node", "filter"), F.col("parts")).cast("int"))
    against = there.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = against.select("node", "weight", "vector", "filters", "group", "filter", "part", F.least("part", "o").alias("a"), F.greatest("part", "o").alias("b"))

    bins = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS)
    tasks = tasks.withColumn("bin", F.pmod(F.xxhash64("group", "filter", "a", "b"), F.lit(bins)).cast("long"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[tuple, tuple[list, list]] = {}
        for t in batches:
            for node, weight, vector, filters, *where, part in zip(*(t.column(c).to_pylist() for c in ("node", "weight")), t.column("vector"), *(t.column(c).to_pylist() for c in ("filters", "group", "filter", "a", "b", "part")), strict=True):
                sides = buckets.setdefault(tuple(where), ([], []))
                sides[part != where[2]].append({"node": node, "weight": weight, "vector": vector.values.to_numpy(), "filters": filters})
        links, edges = [], []
        for (_, this, a, b), (left, right) in buckets.items():
            if a == b and len(left) > 1 or a != b and left and right:
                one, two = _compare(left, right if a != b else None, this, threshold)
                links += one
                edges += two
        names = [x for x, _ in links] + [x for x, _ in edges]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([None] * len(links) + [y for _, y in edges], pa.binary()), pa.array([n for _, n in links] + [0] * len(edges), pa.int64())], ["x", "y", "n"])

    found = common.settled(tasks.groupBy("bin").applyInArrow(run, "x binary, y binary, n long"), "found")
    links = found.where("y is null").groupBy("x").agg(F.sum("n").alias("others"))
    roots = common.components(found.where("y is not null").select("x", "y"), "x", "y").withColumnRenamed("node", "x")
    named = nodes.select(F.col("node").alias("x"), "weight", "least").join(roots, "x", "left").join(links, "x", "left").withColumn("root", F.coalesce("root", "x"))
    named = common.settled(named, "named")
    smallest = common.settled(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "smallest")
    of = common.attached(named, smallest, "root").select(F.col("x").alias("node"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(of, "node", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
