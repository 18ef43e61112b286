"""Toxicity scores from the nearest labelled examples.

Method: exact TF-IDF cosine search with a block-max inverted index. Terms are the words of a text and, for words of more than
`STEM` bytes, their first `STEM` bytes, so inflected forms share terms; all terms that an example holds are in the index, and
document frequencies are counted over all documents. A term's weight also has a smooth factor of its chi-squared between the
classes, which no term lacks and which has no cut. Examples lie in blocks of `BLOCK`. Terms that many examples hold are dense
rows and summed by one matrix product; for all others the index keeps postings and the largest weight in each block, and the
postings are read in blocks only whose bound reaches the K-th best sum: the result is that of a full search. Neighbours vote by
their cosine, and a logistic curve fitted to left-one-out votes of the examples (without their own share in chi-squared)
calibrates the score.

Bounded, and on documented parameters: the labelled examples (`EXAMPLES` of each class, the least by hash of the id). Only rows
with crc32(id as text) mod `folds` <> 0 are examples. Everything else covers all documents and all terms of the examples.

Results: null and empty texts have no terms and the calibrated score of texts without terms; without labelled rows every score is
the share of toxic rows, 0 if there are none. Repeated rows get equal scores; of an id with several texts the least text is the
example. Empty tables give empty results; ties between neighbours go to the smaller id. Extra columns are ignored; null labels and
null ids teach nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EXAMPLES, BLOCK, NEIGHBOURS = 1000, 64, 25
#: At most so many terms are dense rows, if a `SHARE`-th of the examples holds them; only speed depends on both.
DENSE, SHARE = 2048, 16
#: Chi-squared at which a term weighs about half, and what a term without association has of it.
HALF, LITTLE = 30.0, 0.1
#: Weight of the prior among the votes.
PRIOR = 0.5
CHUNK = 1 << 19
STEM = 6


class _Terms:
    """Words and stems of each row as 64-bit hashes; made once in each task."""

    def __init__(self) -> None:
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.inner = np.zeros(256, bool)
        for lo, hi in ((48, 57), (97, 122), (128, 255)):
            self.inner[lo : hi + 1] = True
        self.word, self.stem = common.Rolling(31), common.Rolling(32)

    def rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms and the row of each."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = self.fold[data]
        inner = self.inner[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        first = np.flatnonzero(inner & (edge[:-1] | np.r_[True, ~inner[:-1]]))
        last = np.flatnonzero(inner & (edge[1:] | np.r_[~inner[1:], True])) + 1
        row = np.searchsorted(at, first, "right") - 1
        long = last - first > STEM
        words = self.word.ranges(self.word.prefix(data), first, last)
        stems = self.stem.ranges(self.stem.prefix(data), first[long], first[long] + STEM)
        return np.concatenate([words, stems]).view(np.int64), np.concatenate([row, row[long]])


def _chunks(batches, column: str = "_text"):
    for whole in batches:
        for b in common.slices(whole, column, CHUNK):
            yield b, common.text_buffer(b.column(column))


def _term_counts(texts: DataFrame) -> DataFrame:
    """By gram: examples that hold it, of each class. texts: _text, toxic."""

    def run(batches):
        grams = _Terms()
        for b, (data, at) in _chunks(batches):
            gram, row = grams.rows(data, at)
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            order = np.lexsort((gram, row))
            gram, row = gram[order], row[order]
            new = np.r_[True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])] if len(gram) else np.zeros(0, bool)
            names, place = np.unique(gram[new], return_inverse=True)
            yes = np.bincount(place, weights=toxic[row[new]], minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(yes), pa.array(np.bincount(place, minlength=len(names)) - yes)], ["gram", "yes", "no"])

    return texts.mapInArrow(common.tidy(run), "gram long, yes long, no long").groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


class _Lookup:
    """Term numbers of grams: a small table rejects nearly all others at once."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = np.sort(terms)
        self.shift = np.uint64(64 - min(24, max(16, int(4 * len(terms) + 1).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self._slot(self.terms)] = True

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rows(self, gram: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) in order of row."""
        if not len(self.terms):
            return row[:0], row[:0], row[:0]
        some = np.flatnonzero(self.table[self._slot(gram)])
        found = gram[some]
        term = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        hit = self.terms[term] == found
        both, count = np.unique(row[some][hit] * len(self.terms) + term[hit], return_counts=True)
        return both // len(self.terms), both % len(self.terms), count


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, and the range of each."""
    size = stop - start
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which], which


class Index:
    """Block-max inverted index over the examples; `idf` has the whole weight of a term."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: list, toxic: np.ndarray, worth: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        order = np.lexsort((row, term))
        least = lambda x: x[order].astype(np.min_scalar_type(int(x.max(initial=0))))
        self._build(terms, idf, ids, toxic, worth, np.searchsorted(term[order], np.arange(len(terms) + 1)), least(row), least(count))

    def _build(self, terms: np.ndarray, idf: np.ndarray, ids: list, toxic: np.ndarray, worth: np.ndarray, at: np.ndarray, doc: np.ndarray, count: np.ndarray) -> None:
        self.given = (terms, idf, ids, toxic, worth, at, doc, count)
        self.lookup, self.idf, self.ids, self.toxic, self.worth = _Lookup(terms), idf, ids, toxic, worth
        self.n, self.blocks = len(ids), max(1, -(-len(ids) // BLOCK))
        self.doc, term = doc.astype(np.int32), np.repeat(np.arange(len(terms), dtype=np.int32), np.diff(at))
        weight = self.weights(term, count.astype(np.float32)).astype(np.float32)
        norm = np.sqrt(np.bincount(self.doc, weights=weight.astype(float) ** 2, minlength=self.n))
        self.weight, self.at = weight / norm[self.doc].astype(np.float32), at
        # the groups of a term's postings by block
        key = term.astype(np.int64) * self.blocks + self.doc // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.group = np.r_[first, len(key)]
        self.block, self.most = (key[first] % self.blocks).astype(np.int32), np.maximum.reduceat(self.weight, first)
        self.group_at = np.searchsorted(term[first], np.arange(len(terms) + 1))
        held = np.diff(self.at)
        many = np.argsort(-held, kind="stable")[:DENSE]
        self.dense = many[held[many] * SHARE >= self.n]
        self.slot = np.full(len(terms), -1, np.int32)
        self.slot[self.dense] = np.arange(len(self.dense))
        self.matrix = None

    @classmethod
    def of(cls, given: tuple) -> Index:
        """From plain arrays, as they are broadcast: executors need no class of this package, and keep postings only."""
        out = cls.__new__(cls)
        out._build(*given)
        return out

    def weights(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (1 + np.log(count)) * self.idf[term]

    def nearest(self, term: np.ndarray, count: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the NEIGHBOURS best with a cosine above 0, best first, without example `but`."""
        return self.search([(term, count, but, None)])[0]

    def search(self, queries: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of many: terms, counts, an example to leave out, and factors of the terms' products or None."""
        if self.matrix is None:
            self.matrix = np.zeros((len(self.dense), self.n), np.float32)
            place, which = _ranges(self.at[self.dense], self.at[self.dense + 1])
            self.matrix[which, self.doc[place]] = self.weight[place]
        weights = []
        for term, count, _, factor in queries:
            w = self.weights(term, count)
            q = w if factor is None else w * factor
            weights.append((q / np.sqrt(max((q * w).sum(), 1e-300))).astype(np.float32))
        q = np.zeros((len(queries), len(self.dense)), np.float32)
        for i, (term, *_) in enumerate(queries):
            slot = self.slot[term]
            q[i, slot[slot >= 0]] = weights[i][slot >= 0]
        sums = q @ self.matrix
        return [self._best(sums[i], term[self.slot[term] < 0], weights[i][self.slot[term] < 0], but) for i, (term, _, but, _) in enumerate(queries)]

    def _best(self, score: np.ndarray, term: np.ndarray, q: np.ndarray, but: int) -> tuple[np.ndarray, np.ndarray]:
        if but >= 0:
            score[but] = -1
        kth = max(np.partition(score, -NEIGHBOURS)[-NEIGHBOURS], 0.0) if self.n >= NEIGHBOURS else 0.0
        group, which = _ranges(self.group_at[term], self.group_at[term + 1])
        bound = np.maximum.reduceat(score, np.arange(0, self.n, BLOCK)) + np.bincount(self.block[group], weights=self.most[group] * q[which], minlength=self.blocks)
        some = np.flatnonzero(bound[self.block[group]] >= kth - 1e-5)
        place, owner = _ranges(self.group[group[some]], self.group[group[some] + 1])
        score = score + np.bincount(self.doc[place], weights=self.weight[place] * q[which[some]][owner], minlength=self.n)
        if but >= 0:
            score[but] = -1
        floor = np.partition(score, -NEIGHBOURS)[-NEIGHBOURS] - 1e-5 if self.n >= NEIGHBOURS else 0.0
        some = np.flatnonzero(score >= max(floor, 1e-6))
        best = some[np.lexsort((some, -np.round(score[some], 6)))][:NEIGHBOURS]
        return best, score[best].astype(float)

    def vote(self, ids: np.ndarray, cosine: np.ndarray, prior: float) -> float:
        w = cosine * self.worth[ids]
        # examples stand for as many rows as were drawn from; the prior weighs as PRIOR such a row of mean worth
        extra = PRIOR * float(self.worth.mean())
        return float(((w * self.toxic[ids]).sum() + extra * prior) / (w.sum() + extra))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def calibrate(vote: np.ndarray, toxic: np.ndarray, worth: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes' logits, by Newton steps with a little shrinkage."""
    x = np.c_[_logit(vote), np.ones(len(vote))]
    beta, w = np.array([1.0, 0.0]), worth / worth.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (toxic - p)) - 1e-2 * (beta - [1, 0])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 0.05), float(beta[1])


class Model:
    """What tasks need to score texts; fitted on the driver from bounded samples and counts."""

    def __init__(self, index: Index | None, prior: float, empty: float, slope: float, offset: float) -> None:
        self.index, self.prior, self.empty, self.slope, self.offset = index, prior, empty, slope, offset

    def final(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit(np.array(vote)) + self.offset, -30, 30)))) if self.index else vote

    def plain(self) -> tuple:
        """What is broadcast: arrays and numbers."""
        return self.index and self.index.given, self.prior, self.empty, self.slope, self.offset

    @classmethod
    def of(cls, plain: tuple) -> Model:
        return cls(plain[0] and Index.of(plain[0]), *plain[1:])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "toxic", folds: int = 5) -> Model:
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    if not totals.get(1) or not totals.get(0):
        return Model(None, prior, prior, 1.0, 0.0)
    drawn = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(EXAMPLES) for c in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1])
    texts = common.settled(source.join(F.broadcast(drawn), "_id").groupBy("_id", "toxic").agg(F.min("_text").alias("_text")), "examples")
    counted = _term_counts(texts)
    n1, n0 = (texts.where(F.col("toxic") == c).count() for c in (1, 0))
    if not n1 or not n0:
        return Model(None, prior, prior, 1.0, 0.0)
    held = counted.orderBy("gram").toArrow()  # bounded: the terms of the examples
    terms, yes, no = (held.column(c).to_numpy() for c in ("gram", "yes", "no"))
    lookup = source.sparkSession.sparkContext.broadcast(terms)

    def frequencies(batches):
        grams, find = _Terms(), _Lookup(lookup.value)
        df, rows = np.zeros(len(find.terms), np.int64), 0
        for b, (data, at) in _chunks(batches):
            _, term, _ = find.rows(*grams.rows(data, at))
            df += np.bincount(term, minlength=len(df))
            rows += b.num_rows
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[held, -1]), pa.array(np.r_[df[held], rows])], ["term", "df"])

    counts = common.settled(source.select("_text").mapInArrow(common.tidy(frequencies), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), "frequencies").toArrow()
    df = np.zeros(len(terms) + 1)
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()  # the last, -1, has the rows
    factor = association(yes, no, n1, n0)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * factor
    # without an example of a class, as share of the factor, for both sides of a product
    without = {c: (association(np.maximum(yes - c, 0), np.maximum(no - 1 + c, 0), n1 - c, n0 - 1 + c) / factor).astype(np.float32) ** 2 for c in (0, 1)}

    def vectors(batches):
        grams, find = _Terms(), _Lookup(lookup.value)
        for b, (data, at) in _chunks(batches):
            row, term, count = find.rows(*grams.rows(data, at))
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.string()), b.column("toxic"), *lists], ["id", "toxic", "term", "count"])

    rows = common.settled(texts.mapInArrow(common.tidy(vectors), "id string, toxic int, term array<int>, count array<int>"), "vectors")
    bare = {r.toxic: r.n for r in rows.where(F.size("term") == 0).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = rows.where(F.size("term") > 0).toArrow().combine_chunks()  # bounded: the examples
    full = full.take(pa.array(sorted(range(full.num_rows), key=[(len(i), i) for i in full.column("id").to_pylist()].__getitem__), pa.int64()))
    share = {1: totals[1] / n1, 0: totals[0] / n0}
    bare_worth = sum(share[c] * k for c, k in bare.items())
    empty = (share[1] * bare.get(1, 0) + prior) / (bare_worth + 1) if bare else prior
    if not full.num_rows:
        return Model(None, prior, empty, 1.0, 0.0)
    ids, toxic = full.column("id").to_pylist(), full.column("toxic").to_numpy().astype(float)
    term, count = (full.column(c).combine_chunks() for c in ("term", "count"))
    row = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(term.offsets.to_numpy()))
    term, count = term.flatten().to_numpy(), count.flatten().to_numpy()
    worth = np.where(toxic > 0, share[1], share[0])
    index = Index(terms, idf, ids, toxic, worth, row, term, count)
    del full, row, term, count
    shared = source.sparkSession.sparkContext.broadcast((index.given, without, {x: i for i, x in enumerate(ids)}))

    def left_out(batches):
        given, without, number = shared.value
        index = Index.of(given)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                who = [number[x] for x in b.column("id").to_pylist()]
                vectors = [(b.column("term")[i].values.to_numpy(), b.column("count")[i].values.to_numpy()) for i in range(b.num_rows)]
                found = index.search([(t, c, i, without[int(index.toxic[i])][t]) for (t, c), i in zip(vectors, who, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array([index.vote(*f, prior) for f in found], pa.float64())], ["row", "vote"])

    votes = np.zeros(len(ids))
    for r in common.settled(rows.where(F.size("term") > 0).select("id", "term", "count").repartition(12).mapInArrow(common.tidy(left_out), "row long, vote double"), "votes").collect():
        votes[r.row] = r.vote
    shared.destroy()
    alone = [(c, share[c]) for c, k in bare.items() for _ in range(k)]
    return Model(index, prior, empty, *calibrate(np.r_[votes, [empty] * len(alone)], np.r_[toxic, [float(c) for c, _ in alone]], np.r_[worth, [w for _, w in alone]]))


def association(yes: np.ndarray, no: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The factor of a term's weight: above 0, rising with chi-squared between the classes, at most 1."""
    a, b, n = yes.astype(float), no.astype(float), float(n1 + n0)
    chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (max(n1, 1) * max(n0, 1) * np.maximum(a + b, 1) * np.maximum(n - a - b, 1))
    return (chi2 + LITTLE) / (chi2 + HALF)


def _found(index: Index, grams: _Terms, data: np.ndarray, at: np.ndarray):
    """(row, examples, cosines) of the rows with terms."""
    row, term, count = index.lookup.rows(*grams.rows(data, at))
    cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else np.zeros(1, np.int64)
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    for k in range(0, len(parts), 128):
        some = parts[k : k + 128]
        for (i, _), found in zip(some, index.search([(term[i:j], count[i:j], -1, None) for i, j in some]), strict=True):
            yield row[i], *found


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> DataFrame:
    """id, held_out, score, predicted, evidence (nearest examples as `id:label:cosine`, best first) of every row."""
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    held = source.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, folds).plain())
    id_type = source.schema["_id"].dataType.simpleString()

    def run(batches):
        model, grams = Model.of(held.value), _Terms()
        index = model.index
        for b, (data, at) in _chunks(batches):
            score, evidence = np.full(b.num_rows, model.final(model.empty)), [""] * b.num_rows
            if index:
                for i, ids, cosine in _found(index, grams, data, at):
                    score[i] = model.final(index.vote(ids, cosine, model.prior))
                    evidence[i] = ",".join(f"{index.ids[x]}:{int(index.toxic[x])}:{c:.3f}" for x, c in zip(ids[:3], cosine[:3], strict=True))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(score, pa.float64()), pa.array(evidence, pa.string())], ["id", "score", "evidence"])

    scored = common.settled(source.mapInArrow(common.tidy(run), f"id {id_type}, score double, evidence string"), "scores")
    out = F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0
    return scored.select(F.col("id").alias(id_col), F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows with a score below `most`, all columns as they are; texts are neither shuffled nor joined."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col).plain())
    marked = docs.withColumn("__sw_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def run(batches):
        model, grams = Model.of(held.value), _Terms()
        index = model.index
        for b, (data, at) in _chunks(batches, "__sw_text"):
            keep = np.full(b.num_rows, model.final(model.empty) < most)
            if index:
                for i, ids, cosine in _found(index, grams, data, at):
                    keep[i] = model.final(index.vote(ids, cosine, model.prior)) < most
            kept = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

    # written here, as the batches of a table that is written elsewhere hold ten times as many texts
    return common.settled(marked.mapInArrow(common.tidy(run), docs.schema), "clean")
