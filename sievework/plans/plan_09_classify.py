"""Text classification of the documents by language, and roles by embedding similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .base import registrar, table

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", F.when(F.col("doc_id") % 11 == 0, 0.5).otherwise(1.0).alias("weight"))


_FEATURES = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2) AS w FROM documents),
 t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
 c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
 v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) AS idf FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT 5000),
 x AS (SELECT doc_id, term, (1 + ln(n)) * idf AS x FROM c JOIN v USING (term)),
 f AS (SELECT doc_id, count(*) FILTER (x <> 0)::INT AS terms, sum(x) / sqrt(sum(x * x)) AS weights, max(x) / sqrt(sum(x * x)) AS heaviest FROM x GROUP BY doc_id),
 e AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')[1:768], lambda x: (list_sum(list_transform(string_split(x, ''), lambda c: unicode(c)))::BIGINT % 100) / 100.0::DOUBLE) AS e FROM documents),
 m AS (SELECT doc_id, 0.3 * list_sum(list_transform(range(1, len(e) + 1), lambda i: i * e[i])) / nullif(sqrt(list_sum(list_transform(e, lambda y: y * y))), 0) AS embedding FROM e)
 SELECT doc_id, coalesce(terms, 0)::INT AS terms, round(coalesce(weights, 0), 6) AS weights, round(coalesce(heaviest, 0), 6) AS heaviest, round(coalesce(embedding, 0), 4) AS embedding FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("occ_features", _FEATURES)
def occ_features(s, d):
    """Of the features of each document: terms with a weight, the sum of the weights, the largest, and the embedding as a sum weighted
    by place, so that no two dimensions can be exchanged."""
    from pyspark.ml.functions import vector_to_array

    from ..operators import classify as K

    docs = _docs(s, d)
    found = K.features().fit(docs).transform(docs)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    embedded = vector_to_array("_embedding")
    held = found.select("doc_id", K.values("_unit").alias("x"), F.transform(embedded, lambda x, i: x * (i + 1)).alias("e"))
    return held.select("doc_id", F.size("x").alias("terms"), F.round(total("x"), 6).alias("weights"), F.round(F.coalesce(F.array_max("x"), F.lit(0.0)), 6).alias("heaviest"), F.round(total("e"), 4).alias("embedding"))


@query("occ_train")
def occ_train(s, d):
    from ..operators import classify as K

    docs = _docs(s, d)
    seen, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    out = None
    for name, found in (("logistic", K.predict(K.train(seen, "lang", "weight"), held, "doc_id")), ("svc", K.CalibratedSVC("lang").fit(seen).predict(held, "doc_id"))):
        best = found.groupBy("id").agg(F.max_by("class", F.struct("p", "class")).alias("predicted"))
        row = best.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("held_out"), F.count_if(F.col("predicted") == F.col("lang")).alias("right"))
        out = row if out is None else out.unionByName(row)
    return out


@query("occ_batch")
def occ_batch(s, d):
    from ..operators import classify as K

    docs = _docs(s, d)
    # each half is judged by a model of the other
    p = None
    for half in (0, 1):
        part = K.predict(K.train(docs.where(F.col("doc_id") % 2 != half), "lang", "weight"), docs.where(F.col("doc_id") % 2 == half), "doc_id")
        p = part if p is None else p.unionByName(part)
    return p.groupBy("id").agg(F.max_by("class", F.struct("p", "class")).alias("predicted"))


@query("rol_semantic", """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(e) AS c FROM x GROUP BY ALL), v AS (SELECT label, list(c ORDER BY i) AS v FROM c GROUP BY label),
 s AS (SELECT vec_id, v.label AS role, round(greatest(0, least(1, list_cosine_similarity(embedding::DOUBLE[], v))), 9) AS score FROM embeddings, v)
 SELECT vec_id, role, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, role)::INT AS rank FROM s) WHERE rank <= 3""")
def rol_semantic(s, d):
    from ..functions import columns as C

    e = table(s, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "e")).groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("m"))
    roles = means.groupBy(F.col("label").alias("role")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("v"))
    # one row per role on the right
    scored = e.crossJoin(F.broadcast(roles)).select("vec_id", "role", F.round(C.cosine(F.col("embedding"), F.col("v")), 9).alias("score"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "role")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 3").withColumn("score", F.round("score", 6)).select("vec_id", "role", "score", "rank")
