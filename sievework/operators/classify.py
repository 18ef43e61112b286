"""Text classification with MLlib: features, a weighted multinomial model, a calibrated linear SVC (of arrays, all classes and folds in each pass), and decisions for whole tables."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import NGram, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import tables as T


#: Rows whose words are held at once, and words that may travel with a function.
ROWS, WORDS = 1024, 1 << 18


def _counts(keys: np.ndarray, owner: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys (from 0, below `many`), their places, and the rows (owners) that hold them."""
    held, places = np.unique(owner * many + keys, return_counts=True)
    names, at = np.unique(held % many, return_inverse=True)
    return names, np.bincount(at, places, len(names)).astype(np.int64), np.bincount(at, minlength=len(names)).astype(np.int64)


def _words(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """For `ROWS` lower-case texts at a time: all words in one array, the text of each, and how many texts these are."""
    every = re.compile(r"\w{2,}").findall
    for start in range(0, len(texts), ROWS):
        found = [every(t) if t else [] for t in texts.slice(start, ROWS).to_pylist()]
        yield pa.array(list(itertools.chain.from_iterable(found)), pa.string()), np.repeat(np.arange(len(found)), list(map(len, found))), len(found)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for flat, owner, _ in itertools.chain.from_iterable(_words(x.column(0)) for x in batches):
        coded = flat.dictionary_encode()
        names, n, rows = _counts(coded.indices.to_numpy(), owner, max(1, len(coded.dictionary)))
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(names)), pa.array(n), pa.array(rows)], ["term", "n", "rows"])


def _pair_counts(known: list[str]):
    """Of pairs of neighbours that are both known: the first's number times the known ones, plus the second's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, many = pa.array(known, pa.string()), len(known)
        for flat, owner, _ in itertools.chain.from_iterable(_words(x.column(0)) for x in batches):
            code = pc.index_in(flat, value_set=names).fill_null(-1).to_numpy().astype(np.int64)
            at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (owner[:-1] == owner[1:]))
            pairs, own = np.unique(code[at] * many + code[at + 1], return_inverse=True)
            keys, n, rows = _counts(own, owner[at], max(1, len(pairs)))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[keys]), pa.array(n), pa.array(rows)], ["pair", "n", "rows"])

    return run


def _named(known: list[str]):
    def run(pairs: pa.Array) -> pa.Array:
        first, second = np.divmod(pairs.to_numpy(zero_copy_only=False).astype(np.int64), len(known))
        names = pa.array(known, pa.string())
        return pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), " ")

    return F.arrow_udf(run, "string")


class FrequentTerms(Estimator):
    """The vocabulary of `text`, words and pairs of neighbours: of the terms that stand in `least` rows or more, the `terms` most frequent, ties by
    the term itself. Only the vocabulary, of a bounded size, and the words that its pairs can have reach the driver.

    A pair stands in no more places and rows than each of its words. So words are counted first, and of the pairs only those whose
    words are both as frequent as the last of the `terms` most frequent words. Where more than `WORDS` words are (by ties), all are
    counted where they stand in `_terms`.
    """

    def __init__(self, terms: int, least: int) -> None:
        super().__init__()
        self.terms, self.least = terms, least

    def _fit(self, dataset: DataFrame) -> TermWeights:
        summed = lambda df, key: df.groupBy(key).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).where(F.col("rows") >= self.least)
        best = lambda df: df.orderBy(F.desc("n"), "term").limit(self.terms).collect()
        words = T.stored(summed(dataset.select(F.lower("text")).mapInArrow(_word_counts, "term string, n long, rows long"), "term"), "words")
        most = best(words)
        floor = most[-1].n if len(most) == self.terms else 0
        known = sorted(r.term for r in words.where(F.col("n") >= floor).select("term").limit(WORDS + 1).collect())
        if len(known) > WORDS:
            # each place of a term, and each term once for its row
            marked = lambda terms, rows: F.transform(terms, lambda x: F.struct(x.alias("term"), F.lit(1 - rows).alias("n"), F.lit(rows).alias("rows")))
            most = best(summed(dataset.select(F.inline(F.concat(marked("_terms", 0), marked(F.array_distinct("_terms"), 1)))), "term"))
        elif known:
            pairs = summed(dataset.select(F.lower("text")).mapInArrow(_pair_counts(known), "pair long, n long, rows long"), "pair").where(F.col("n") >= floor)
            most = sorted(most + best(pairs.select(_named(known)("pair").alias("term"), "n", "rows")), key=lambda r: (-r.n, r.term))[: self.terms]
        every = dataset.count()
        return TermWeights([r.term for r in most], [float(np.log((every + 1.0) / (r.rows + 1.0))) for r in most])


class TermWeights(Transformer):
    """From `text`, sparse vectors over the vocabulary: 1 + ln of the counts of terms in `_tf`, and in `_unit` these times idf, of length 1. Words
    are looked up and counted for `ROWS` rows of an Arrow batch at once."""

    def __init__(self, vocabulary: list[str], idf: list[float]) -> None:
        super().__init__()
        self.vocabulary, self.idf = vocabulary, idf

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("_tf", F.arrow_udf(_log_counts(self.vocabulary), VectorUDT())(F.lower("text"))).withColumn("_unit", F.arrow_udf(_weighed(self.idf), VectorUDT())("_tf"))


def _vectors(size: int, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray) -> pa.Array:
    """Sparse vectors as Arrow stores them: kind, size, indices and values."""
    at, n = pa.array(offsets.astype(np.int32)), len(offsets) - 1
    lists = [pa.ListArray.from_arrays(at, pa.array(indices.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values.astype(float)))]
    return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], ["type", "size", "indices", "values"])


def _log_counts(vocabulary: list[str]):
    def run(texts: pa.Array) -> pa.Array:
        parts = [v.split(" ") for v in vocabulary]
        known = sorted({w for p in parts for w in p})
        number = {w: i for i, w in enumerate(known)}
        names, single = pa.array(known, pa.string()), np.full(len(known) + 1, -1)
        for i, p in enumerate(parts):
            if len(p) == 1:
                single[number[p[0]]] = i
        double = sorted((number[p[0]] * len(known) + number[p[1]], i) for i, p in enumerate(parts) if len(p) == 2)
        pairs, place = np.array([x for x, _ in double], np.int64), np.array([i for _, i in double], np.int64)
        size, lengths, indices, counts = len(vocabulary), [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for flat, owner, rows in _words(texts):
            code = pc.index_in(flat, value_set=names).fill_null(-1).to_numpy().astype(np.int64)
            one = single[code]
            cells = [owner[one >= 0] * size + one[one >= 0]]
            if len(pairs):
                at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (owner[:-1] == owner[1:]))
                key = code[at] * len(known) + code[at + 1]
                found = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                hit = pairs[found] == key
                cells.append(owner[at[hit]] * size + place[found[hit]])
            held, n = np.unique(np.concatenate(cells), return_counts=True)
            lengths.append(np.bincount(held // max(1, size), minlength=rows))
            indices.append(held % max(1, size))
            counts.append(1 + np.log(n))
        return _vectors(size, np.cumsum(np.concatenate(lengths)), np.concatenate(indices), np.concatenate(counts))

    return run


def _weighed(idf: list[float]):
    def run(tf: pa.Array) -> pa.Array:
        lists = tf.field("indices")
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        index = lists.flatten().to_numpy()
        x = tf.field("values").flatten().to_numpy() * np.array(idf)[index]
        owner = np.repeat(np.arange(len(tf)), length)
        norm = np.sqrt(np.bincount(owner, x * x, len(tf)))
        return _vectors(len(idf), np.r_[0, np.cumsum(length)], index, x / np.where(norm > 0, norm, 1)[owner])

    return run


def values(vector: str) -> Column:
    """The values other than 0 of a sparse vector, in order."""

    def run(vectors: pa.Array) -> pa.Array:
        lists = vectors.field("values")
        x = lists.flatten().to_numpy()
        ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        kept = np.r_[0, np.cumsum(x != 0)]
        return pa.ListArray.from_arrays(pa.array(kept[ends].astype(np.int32)), pa.array(x[x != 0]))

    return F.arrow_udf(run, "array<double>")(vector)


class Embedding(Transformer):
    """The hash embedding of `text`, scaled, in `_embedding`."""

    def __init__(self, scale: float) -> None:
        super().__init__()
        self.scale = scale

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("_embedding", F.arrow_udf(_scaled(self.scale), VectorUDT())(F.lower("text")))


def _scaled(scale: float):
    """The embeddings as dense vectors."""

    def run(texts: pa.Array) -> pa.Array:
        x, n = C._embedder(768)(texts), len(texts)
        lists = pa.ListArray.from_arrays(x.offsets, pa.array(x.values.to_numpy() * scale))
        return pa.StructArray.from_arrays([pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), lists], ["type", "size", "indices", "values"])

    return run


def features(terms: int = 5000, least: int = 2, embedding: float = 0.3) -> Pipeline:
    """In `features`: words and pairs of words of `text` with sublinear counts, weighted by idf, of length 1, and beside them the embedding
    times `embedding` (none if that is 0)."""
    # only terms of a table whose words tie in great number are made of these
    tokens = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    both = SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__")
    parts = [Embedding(embedding), VectorAssembler(inputCols=["_unit", "_embedding"], outputCol="features")] if embedding else [VectorAssembler(inputCols=["_unit"], outputCol="features")]
    return Pipeline(stages=[tokens, pairs, both, FrequentTerms(terms, least), *parts])


def _index(label: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")


def train(df: DataFrame, label: str, weight: str | None = None, terms: int = 5000, iterations: int = 1000, embedding: float = 0.3) -> PipelineModel:
    """df: text, the label, and a sample weight. A fit ends when it has converged, or after so many iterations."""
    model = LogisticRegression(featuresCol="features", labelCol="_label", maxIter=iterations, regParam=0.01, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[_index(label), *features(terms, embedding=embedding).getStages(), model]).fit(df)


def predict(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """(id, class, p) for all rows and classes; the label isn't read."""
    names = model.stages[0].labels
    scored = df.select(key, F.coalesce("text", F.lit("")).alias("text"))
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    p = F.transform(vector_to_array("probability"), lambda x, i: F.struct(F.element_at(F.array(*map(F.lit, names)), i + 1).alias("class"), x.alias("p")))
    return scored.select(F.col(key).alias("id"), F.inline(p))


def _matrix(vectors: pa.StructArray, size: int) -> np.ndarray:
    """Vectors, sparse or dense, as rows of a matrix with a last column of ones for the intercept."""
    held, n = vectors.field("values"), len(vectors)
    length = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
    x, owner = held.flatten().to_numpy(), np.repeat(np.arange(n), length)
    place = np.arange(len(x)) - np.repeat(np.cumsum(length) - length, length)
    sparse = np.repeat(vectors.field("type").to_numpy(zero_copy_only=False) == 0, length)
    place[sparse] = vectors.field("indices").flatten().to_numpy()
    out = np.zeros((n, size + 1))
    out[owner, place] = x
    out[:, size] = 1
    return out


def _descent(size: int, most: int, least: float = 1e-4, memory: int = 10) -> Iterator[np.ndarray]:
    """Minimises a smooth convex function by L-BFGS: yields points, is sent value and gradient, returns the best. It ends when the gradient has
    shrunk to `least` of the first one, or after `most` steps."""
    x = np.zeros(size)
    f, g = yield x
    goal, steps = least * np.linalg.norm(g), []
    for _ in range(most):
        if np.linalg.norm(g) <= goal:
            break
        d, used = -g, []
        for s, y in reversed(steps):
            used.append(s @ d / (s @ y))
            d = d - used[-1] * y
        if steps:
            d = d * (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y), by in zip(steps, reversed(used), strict=True):
            d = d + s * (by - y @ d / (s @ y))
        length = 1.0 if steps else min(1.0, 1 / np.linalg.norm(g))
        while True:
            there = x + length * d
            value, slope = yield there
            if value <= f + 1e-4 * length * (g @ d) or length < 1e-12:
                break
            length /= 2
        if value > f:
            break
        s, y = there - x, slope - g
        steps = [*steps, (s, y)][-memory:] if s @ y > 0 else steps
        x, f, g = there, value, slope
    return x


class CalibratedSVC:
    """One linear SVC with squared hinge loss for each class against the rest, rows weighted so that classes count alike; a logistic curve for each
    class, fitted on the margins of rows that were held out in one of `folds` folds by hash, turns margins into probabilities.

    The models of all classes and folds are fitted together: a pass over the rows gives loss and gradient of each, and each takes its own
    steps until it has converged, or for `iterations`.
    """

    #: Rows that are a matrix at once.
    BLOCK = 256

    def __init__(self, label: str, terms: int = 5000, folds: int = 5, iterations: int = 5000, embedding: float = 0.3, penalty: float = 0.01) -> None:
        self.label, self.terms, self.folds, self.iterations, self.embedding, self.penalty = label, terms, folds, iterations, embedding, penalty

    def _fitted(self, rows: DataFrame, size: int, classes: np.ndarray, fold_weights: dict[int, float]) -> np.ndarray:
        """Coefficients by fold, class and feature; the last fold is that of all rows. classes: the weight of a row of each."""
        k, spread = len(classes), rows.sparkSession.sparkContext.defaultParallelism
        held_by = [sum(w for f, w in fold_weights.items() if f != g) or 1.0 for g in range(self.folds + 1)]
        models = [_descent(size + 1, self.iterations) for _ in range((self.folds + 1) * k)]
        at, done = {m: next(x) for m, x in enumerate(models)}, np.zeros((len(models), size + 1))
        self.passes = 0
        while at:
            names = np.array(sorted(at))
            slopes = _slopes(np.column_stack([at[m] for m in names]), names // k, names % k, classes, self.BLOCK)
            # one part of a gradient for each core and model, summed by model
            parts = rows.coalesce(spread).mapInArrow(slopes, "model int, loss double, gradient binary").groupBy("model").applyInArrow(_summed, "model int, loss double, gradient binary").collect()
            self.passes += 1
            for r in parts:
                m = int(names[r.model])
                share = held_by[m // k]
                # the intercept isn't penalised
                w = at[m] * np.r_[np.ones(size), 0.0]
                try:
                    at[m] = models[m].send((r.loss / share + self.penalty / 2 * (w @ w), np.frombuffer(r.gradient) / share + self.penalty * w))
                except StopIteration as end:
                    done[m] = end.value
                    del at[m]
        return done.reshape(self.folds + 1, k, size + 1)

    def fit(self, df: DataFrame) -> CalibratedSVC:
        """df: text and the label."""
        self.prepare = Pipeline(stages=[_index(self.label), *features(self.terms, embedding=self.embedding).getStages()]).fit(df)
        self.names = self.prepare.stages[0].labels
        # written, as each pass reads them
        fold = F.pmod(F.xxhash64("text"), F.lit(self.folds)).cast("int")
        rows = T.stored(self.prepare.transform(df).select(F.col("_label").cast("int").alias("_label"), "features", fold.alias("_fold")), "features")
        sizes = {(r["_label"], r["_fold"]): r["n"] for r in rows.groupBy("_label", "_fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each class and fold
        total, k = sum(sizes.values()), len(self.names)
        classes = np.array([total / (k * sum(n for (c, _), n in sizes.items() if c == i)) for i in range(k)])
        by_fold = {f: sum(n * classes[c] for (c, g), n in sizes.items() if g == f) for f in range(self.folds)}
        first = rows.select(F.col("features").alias("f")).head()
        self.size = first.f.size if first else 0
        fitted = self._fitted(rows, self.size, classes, by_fold)
        self.coefficients = fitted[-1]
        weight = F.element_at(F.array(*map(F.lit, classes.tolist())), F.col("_label") + 1)
        held = T.stored(rows.select("_label", weight.alias("_weight"), F.arrow_udf(_margins(fitted[:-1], self.BLOCK), "array<double>")("features", "_fold").alias("margins")), "margins")
        self.curves = []
        for i in range(k):
            points = held.select((F.col("_label") == i).cast("double").alias("y"), "_weight", array_to_vector(F.array(F.col("margins")[i])).alias("x"))
            curve = LogisticRegression(featuresCol="x", labelCol="y").fit(points)
            self.curves.append((float(curve.coefficients[0]), float(curve.intercept)))
        return self

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """(id, class, p) for all rows and classes."""
        scored = df.select(key, F.coalesce("text", F.lit("")).alias("text"))
        for stage in self.prepare.stages[1:]:
            scored = stage.transform(scored)
        margins = F.col("margins")
        raw = [1 / (1 + F.exp(-(a * margins[i] + b))) for i, (a, b) in enumerate(self.curves)]
        held = scored.select(F.col(key).alias("id"), F.arrow_udf(_margins(self.coefficients[None], self.BLOCK), "array<double>")("features", F.lit(0)).alias("margins"))
        out = held.select("id", F.array(*raw).alias("p"))
        total = F.aggregate("p", F.lit(1e-12), lambda s, x: s + x)
        return out.select("id", F.inline(F.transform("p", lambda x, i: F.struct(F.element_at(F.array(*map(F.lit, self.names)), i + 1).alias("class"), (x / total).alias("p")))))


def _slopes(points: np.ndarray, fold: np.ndarray, kind: np.ndarray, classes: np.ndarray, many: int):
    """Over the rows of a task, the loss and its gradient at a point (a column) of each model, whose rows are those of other folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope = np.zeros(points.shape[1]), np.zeros(points.shape)
        for batch in batches:
            for begin in range(0, batch.num_rows, many):
                part = batch.slice(begin, many)
                x, label = _matrix(part.column("features"), len(points) - 1), part.column("_label").to_numpy()
                y = np.where(label[:, None] == kind, 1.0, -1.0)
                short = np.maximum(0, 1 - y * (x @ points))
                weight = classes[label][:, None] * (part.column("_fold").to_numpy()[:, None] != fold)
                loss += (weight * short**2).sum(0)
                slope += x.T @ (-2 * weight * y * short)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loss)), pa.int32()), pa.array(loss), pa.array([v.tobytes() for v in slope.T], pa.binary())], ["model", "loss", "gradient"])

    return run


def _summed(parts: pa.Table) -> pa.Table:
    slope = sum(np.frombuffer(v.as_py()) for v in parts.column("gradient"))
    return pa.table({"model": parts.column("model").slice(0, 1), "loss": [pc.sum(parts.column("loss")).as_py()], "gradient": pa.array([slope.tobytes()], pa.binary())})


def _margins(models: np.ndarray, many: int):
    """The margins of each class by the models of a row's fold; models: by fold, class and feature."""

    def run(vectors: pa.Array, fold: pa.Array) -> pa.Array:
        out = [np.zeros((0, models.shape[1]))]
        for begin in range(0, len(vectors), many):
            x, at = _matrix(vectors.slice(begin, many), models.shape[2] - 1), fold.slice(begin, many).to_numpy(zero_copy_only=False)
            every = (x @ models.reshape(-1, models.shape[2]).T).reshape(len(x), *models.shape[:2])
            out.append(every[np.arange(len(x)), at])
        flat = np.concatenate(out)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))

    return run
