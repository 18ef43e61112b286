"""Vector, lexical and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import tables as T


#: Queries and corpus rows of a block, and queries that are scored at once.
QUERY_BLOCK, ROW_BLOCK, AT_ONCE = 1024, 16_384, 64


def _best_of_block(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """topk() of one block of queries and one of rows, without ranks."""
    owner, ids, scores = [], [], []
    names = held.column("id").to_numpy(zero_copy_only=False) if held.num_rows else np.zeros(0)
    order = np.unique(names, return_inverse=True)[1]
    sizes = [np.array([len(v) for v in t.column("vector")], np.int64) for t in (asked, held)]
    for n in set(sizes[0]) & set(sizes[1]) - {0}:
        some, there = (np.flatnonzero(x == n) for x in sizes)
        x, y = (np.stack([t.column("vector")[int(i)].values.to_numpy(zero_copy_only=False) for i in at]) for t, at in ((asked, some), (held, there)))
        for start in range(0, len(some), AT_ONCE):
            score = np.round(x[start : start + AT_ONCE] @ y.T, 9)
            for i, row in zip(some[start : start + AT_ONCE], score, strict=True):
                good = np.flatnonzero(~np.isnan(row))
                top = good[np.lexsort((order[there[good]], -row[good]))][:k]
                owner.append(np.full(len(top), i))
                ids.append(there[top])
                scores.append(row[top])
    join = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
    return pa.table({"query": asked.column("id").take(join(owner, np.int64)), "id": held.column("id").take(join(ids, np.int64)), "score": join(scores, float)})


def topk(corpus: DataFrame, queries: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """(query, id, score, rank): inner products, best first, the smaller id on ties. corpus and queries: id, vector.

    Stated queries against all rows, in blocks: every block of queries meets every block of rows in a task of its own, as a matrix
    product, and keeps k rows for each query; only these are merged. Nothing is broadcast. Null vectors, and vectors of another
    length than the query's, have no score.
    """
    many, rows = queries.count(), corpus.count()
    q_blocks = max(1, -(-many // QUERY_BLOCK))
    r_blocks = max(1, -(-rows // ROW_BLOCK), min(corpus.sparkSession.sparkContext.defaultParallelism, rows // 1000))
    full = lambda df: df.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = full(queries).withColumn("q", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("r", numbers(r_blocks))
    right = full(corpus).withColumn("r", F.pmod(F.xxhash64("id"), F.lit(r_blocks)).cast("int")).withColumn("q", numbers(q_blocks))

    def best(_: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        return _best_of_block(asked, held, k)

    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, corpus)]
    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(best, f"query {kinds[0]}, id {kinds[1]}, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out if min_score is None else out.where(F.col("score") >= min_score)


#: Query terms that are broadcast after they were counted; more are joined by a shuffle.
TERMS = 1 << 18


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, average: float = 50.0, sample: int = 16) -> DataFrame:
    """(query, id, score, rank): the k best documents of each query that share a term with it, the smaller id on ties (scores to nine
    places). idf is 1 and the average length fixed; repeated query terms count. docs, queries: id, text. Ids of docs are unique.

    Up to `TERMS` query terms: documents are scored where they are read, and of each slice only those leave that can be among the k best
    of a query (see bm25_scores), so a task's memory doesn't grow with its documents.

    More, top k by score bounds: words are reduced to query terms before anything is counted or shuffled, and postings are dealt by document
    and term. The k-th best score within a `sample`-th of the documents is a floor of the result. A query's terms whose highest
    scores together stay below its floor, the most frequent first, can't lift a document by themselves: their postings aren't joined with
    the query, but only added to documents that its other terms found and that can still reach the floor. So the result is exact.
    """
    asked = queries.select(F.col("id").alias("query"), F.explode(C.words(F.lower("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = T.stored(asked, "asked")

    def top(scores: DataFrame) -> DataFrame:
        # Spark keeps k rows of each query in every task before it shuffles them
        order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
        return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if asked.count() <= TERMS:
        return top(bm25_scores(docs, queries, k1, b, average, k))
    words = docs.select("id", C.words(F.lower("text")).alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    tf = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    worth = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
    postings = T.stored(tf.select("id", "term", worth.alias("worth")), "postings")
    score = F.sum(F.col("times") * F.col("worth")).alias("score")

    some = postings.where(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0).join(asked, "term").groupBy("query", "id").agg(score)
    floors = top(some).groupBy("query").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    bounds = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("worth").alias("most"))
    upto = Window.partitionBy("query").orderBy(F.desc("df"), "term")
    plan = asked.join(bounds, "term").join(floors, "query", "left").withColumn("bound", F.sum(F.col("times") * F.col("most")).over(upto))
    plan = T.stored(plan.select("query", "term", "times", "floor", "bound", (F.coalesce(F.col("bound") < F.col("floor") - SLACK, F.lit(False))).alias("spare")), "plan")
    left = plan.groupBy("query").agg(F.coalesce(F.max(F.when(F.col("spare"), F.col("bound"))), F.lit(0.0)).alias("left"), F.coalesce(F.first("floor"), F.lit(0.0)).alias("floor"))
    found = postings.join(plan.where("not spare").select("query", "term", "times"), "term").groupBy("query", "id").agg(score)
    found = T.stored(found.join(left, "query").where(F.col("score") + F.col("left") >= F.col("floor") - SLACK).select("query", "id", "score"), "found")
    rest = postings.join(plan.where("spare").select("term").distinct(), "term", "left_semi").groupBy("id").agg(F.collect_list(F.struct("term", "worth")).alias("w"))
    rest = found.join(rest, "id").select("query", "id", F.explode("w").alias("w")).select("query", "id", "w.term", "w.worth")
    rest = rest.join(plan.where("spare").select("query", "term", "times"), ["query", "term"]).groupBy("query", "id").agg(score)
    return top(found.unionByName(rest).groupBy("query", "id").agg(F.sum("score").alias("score")))


#: What sums of scores may be off by.
SLACK = 1e-6
#: Documents that are scored at once, and cells of a matrix of query terms by queries.
SLICE, CELLS = 128, 1 << 23


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, average: float = 50.0, k: int | None = None) -> DataFrame:
    """(query, id, score): bm25()'s scores of all pairs that share a term. Ids of docs are unique. With k, pairs are left out that k others of
    the same query and slice of documents surpass by more than `SLACK`.

    A document meets all queries where it is read, so neither its words nor the scores are shuffled: its query terms are a row of a
    matrix, and a product with the matrix of terms by queries gives its scores. Queries are cut into parts whose matrix is bounded; the
    terms of all are sent to the executors after they were counted, and more than `TERMS` are joined by a shuffle.
    """
    asked = queries.select(F.col("id").alias("query"), F.explode(C.words(F.lower("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = T.stored(asked, "asked")
    words = docs.select("id", C.words(F.lower("text")).alias("w"))
    if asked.count() > TERMS:
        tf = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
        worth = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
        return tf.select("id", "term", worth.alias("worth")).join(asked, "term").groupBy("query", "id").agg(F.sum(F.col("times") * F.col("worth")).alias("score"))
    held = asked.orderBy("query", "term").toArrow()  # TERMS rows at most
    names, at = np.unique(held.column("query").to_numpy(), return_inverse=True)
    terms = held.column("term").combine_chunks().dictionary_encode()
    known, term, times = terms.dictionary, terms.indices.to_numpy(), held.column("times").to_numpy()
    parts, first = [], 0  # (places in names, from and up to; the part's terms; where they and their queries are; times)
    while first < len(names):
        last = min(len(names), first + max(1, CELLS // len(known)))
        here = (at >= first) & (at < last)
        own, column = np.unique(term[here], return_inverse=True)
        parts.append((first, last, own, column, at[here] - first, times[here]))
        first = last
    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, docs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = []
        for first, last, own, row, column, n in parts:
            m = np.zeros((len(own), last - first))
            m[row, column] = n
            matrices.append((first, own, m))
        for x in batches:
            for start in range(0, x.num_rows, step):
                some = x.slice(start, step)
                w = some.column("w")
                length = pc.list_value_length(w).to_numpy()
                found = pc.index_in(w.flatten(), value_set=known)
                place = found.fill_null(-1).to_numpy()
                owner = np.repeat(np.arange(len(length)), length)[place >= 0]
                tf = np.zeros((len(length), len(known)))
                np.add.at(tf, (owner, place[place >= 0]), 1.0)
                worth = tf * (k1 + 1) / (tf + (k1 * (1 - b + b * length / average))[:, None])
                for first, own, m in matrices:
                    score = worth[:, own] @ m
                    kept = score > 0
                    if k is not None and k < len(score):
                        kept &= score >= np.partition(score, len(score) - k, axis=0)[len(score) - k] - SLACK
                    i, j = np.nonzero(kept)
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(first + j)), some.column("id").take(pa.array(i)), pa.array(score[i, j])], ["query", "id", "score"])

    step = max(1, min(SLICE, CELLS // max(1, len(known))))
    query_ids = pa.array(names, held.schema.field("query").type)
    return words.mapInArrow(run, f"query {kinds[0]}, id {kinds[1]}, score double")


def hybrid(semantic: DataFrame, lexical: DataFrame, k: int = 3, weights: tuple[float, float] = (0.7, 0.3), least: float = 0.1) -> DataFrame:
    """Semantic top 2k and lexical top 2k (as a share of the query's best), weighted and added; the k best above `least`. Both sides
    have 2k rows of each query at least, where there are as many."""
    best = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))).where(F.col("r") <= 2 * k)
    s = best(semantic.where("score >= 0.1")).select("query", "id", F.col("score").alias("s"))
    x = best(lexical.where("score > 0"))
    x = x.select("query", "id", (F.col("score") / F.max("score").over(Window.partitionBy("query"))).alias("x"))
    both = s.join(x, ["query", "id"], "full").select("query", "id", F.round(weights[0] * F.coalesce("s", F.lit(0.0)) + weights[1] * F.coalesce("x", F.lit(0.0)), 3).alias("score"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where((F.col("rank") <= k) & (F.col("score") > least))


def rrf(*rankings: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query, id, rank)."""
    out = rankings[0].select("query", "id", "rank")
    for r in rankings[1:]:
        out = out.unionByName(r.select("query", "id", "rank"))
    return out.groupBy("query", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def mmr(candidates: DataFrame, k: int = 5, balance: float = 0.7) -> DataFrame:
    """Greedy diversity re-ranking of a bounded list per query: query, id, score, vector to query, id, rank."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(rows["vector"].to_numpy()).astype(float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(n == 0, 1, n)
        similar, taken = v @ v.T, []
        while len(taken) < min(k, len(rows)):
            worth = balance * rows["score"].to_numpy() - (1 - balance) * (similar[:, taken].max(1) if taken else 0)
            worth[taken] = -np.inf
            taken.append(int(np.argmax(worth)))
        return pd.DataFrame({"query": rows["query"].iloc[0], "id": rows["id"].to_numpy()[taken], "rank": range(1, len(taken) + 1)})

    return candidates.groupBy("query").applyInPandas(run, "query long, id long, rank int")


def tag_rerank(hits: DataFrame, tags: DataFrame, wanted: DataFrame, bonus: float = 0.1) -> DataFrame:
    """Adds a bonus for each tag of the row that the query wants. tags: id, tag; wanted: query, tag."""
    extra = hits.join(tags, "id").join(wanted, ["query", "tag"]).groupBy("query", "id").agg((bonus * F.count(F.lit(1))).alias("extra"))
    return hits.join(extra, ["query", "id"], "left").select("query", "id", F.round(F.col("score") + F.coalesce("extra", F.lit(0.0)), 6).alias("score"))


def fallback_answer(hits: DataFrame, docs: DataFrame, n: int = 2, text: str = "nothing found") -> DataFrame:
    """The contents of the n best hits of each query, joined in order."""
    rows = hits.where(F.col("rank") <= n).join(docs, "id").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("t"))
    return rows.select("query", F.coalesce(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), F.lit(text)).alias("answer"))


def fast_path(queries: DataFrame, greetings: list[str]) -> DataFrame:
    t = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    return queries.select("id", F.when(t == "", "blank").when(t.isin(greetings), "greeting").otherwise("search").alias("path"))


def intent(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """The intent with the most keyword hits, the first by name on ties. keywords: keyword, intent."""
    hits = queries.select("id", F.explode(F.array_distinct(C.words(F.lower("text")))).alias("keyword")).join(keywords, "keyword").groupBy("id", "intent").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy("id").agg(F.min_by("intent", F.struct(-F.col("n"), F.col("intent"))).alias("intent"))
    return queries.select("id").join(best, "id", "left").select("id", F.coalesce("intent", F.lit("general")).alias("intent"))


def expand(queries: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Words replaced by their expansion, order kept. abbreviations: short, full."""
    words = queries.select("id", F.posexplode(C.words(F.col("text"))).alias("pos", "w")).join(abbreviations, F.lower("w") == F.col("short"), "left")
    rows = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("full", "w").alias("w")))).alias("t"))
    return rows.select("id", F.array_join(F.transform("t", lambda x: x["w"]), " ").alias("text"))


def log_odds(docs: DataFrame, label: str, smooth: float = 1.0, least: int = 20) -> DataFrame:
    """(term, label, log_odds): smoothed log of a term's document rate in a class against the rest."""
    t = docs.select(F.col(label).alias("label"), F.explode(F.array_distinct(C.words(F.lower("text")))).alias("term"))
    n = t.groupBy("term", "label").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("term").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
    size = docs.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("docs"))
    size = size.withColumn("rest", F.sum("docs").over(Window.partitionBy()) - F.col("docs"))
    j = n.join(total, "term").join(size, "label")
    return j.select("term", "label", F.round(F.log((F.col("n") + smooth) / (F.col("docs") + 2 * smooth)) - F.log((F.col("all") - F.col("n") + smooth) / (F.col("rest") + 2 * smooth)), 6).alias("log_odds"))


def term_label_share(docs: DataFrame, label: str, least: int = 20) -> DataFrame:
    """Of the documents with a term, the share of each label."""
    t = docs.select(F.col(label).alias("label"), F.explode(F.array_distinct(C.words(F.lower("text")))).alias("term")).groupBy("term", "label").agg(F.count(F.lit(1)).alias("n"))
    total = t.groupBy("term").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
    return t.join(total, "term").select("term", "label", F.round(F.col("n") / F.col("all"), 6).alias("share"))
