"""Skills, vectors and retrieval. The dictionaries are words of the documents; benchmark items are the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import retrieve as R
from ..operators import skills as S
from .base import registrar, table

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

SYNONYMS = [("thatin", "THAT"), ("rewh", "REWH"), ("les", "French"), ("die", "German")]
SKILLS = ["the", "with", "onst", "heat of", "and the", "der die", "en la", "ing"]
CATEGORIES = [("the", "english"), ("with", "english"), ("and the", "english"), ("French", "romance"), ("en la", "romance")]


def _values(rows: list, cols: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + f") v({cols})"


_TOK = r"tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9.+#]+')) AS token FROM documents)"
_WL = r"list_filter(list_transform(regexp_extract_all(lower(text), '[^\s,;:()\[\]!?\"'']+'), lambda x: regexp_replace(x, '[.]+$', '')), lambda x: true)"
_GR = f"gw AS (SELECT doc_id, {_WL} AS t FROM documents), gi AS (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM gw, (VALUES (1), (2), (3)) v(n)), gr AS (SELECT DISTINCT doc_id, array_to_string(t[i : i + n - 1], ' ') AS g FROM gi)"
_SYN = f"{_TOK}, sy AS (SELECT DISTINCT doc_id, skill FROM tok JOIN {_values(SYNONYMS, 'synonym, skill')} ON token = synonym)"
_EX = f"{_GR}, ex AS (SELECT DISTINCT doc_id, skill FROM gr JOIN {_values([(x,) for x in SKILLS], 'skill')} ON g = lower(skill))"
_ALL = f"{_SYN}, {_EX}, al AS (SELECT * FROM sy UNION SELECT * FROM ex)"


def _docs(s, d):
    return table(s, d, "documents")


def _skills(s):
    return s.createDataFrame([(x,) for x in SKILLS], "skill string")


def _syn(s, d):
    return S.by_synonym(S.tokens(_docs(s, d), "doc_id", "text"), "doc_id", s.createDataFrame(SYNONYMS, "synonym string, skill string"))


def _exact(s, d):
    return S.exact(_docs(s, d), "doc_id", "text", _skills(s))


def _found(s, d):
    return _syn(s, d).unionByName(_exact(s, d)).distinct()


@query("skl_synonyms", f"WITH {_SYN} SELECT * FROM sy")
def skl_synonyms(s, d):
    return _syn(s, d)


@query("skl_exact", f"WITH {_EX} SELECT * FROM ex")
def skl_exact(s, d):
    return _exact(s, d)


@query("skl_fuzzy")
def skl_fuzzy(s, d):
    # some names as they are written, and long words of the benchmark without their last letter
    words = S.tokens(table(s, d, "benchmark"), "item_id", "text").where(F.length("token") >= 8).select(F.expr("left(token, length(token) - 1)").alias("skill")).distinct()
    known = s.createDataFrame([("thanedbles",), ("attions",), ("keitheits",), ("The",)], "skill string").unionByName(words)
    return S.fuzzy(S.tokens(_docs(s, d), "doc_id", "text"), "doc_id", known, found=_found(s, d))


@query("skl_extract", f"WITH {_ALL} SELECT doc_id, array_to_string(list_sort(list(DISTINCT skill)), ',') AS skills FROM al GROUP BY doc_id")
def skl_extract(s, d):
    return S.extract(_syn(s, d), _exact(s, d), key="doc_id").select("doc_id", F.array_join("skills", ",").alias("skills"))


@query("skl_categorize", f"WITH {_ALL} SELECT doc_id, coalesce(category, 'Other Skills') AS category, array_to_string(list_sort(list(DISTINCT al.skill)), ',') AS skills FROM al LEFT JOIN {_values(CATEGORIES, 'skill, category')} ON al.skill = v.skill GROUP BY ALL")
def skl_categorize(s, d):
    return S.categorize(_found(s, d), "doc_id", s.createDataFrame(CATEGORIES, "skill string, category string"))


@query("skl_demand", f"WITH {_ALL} SELECT skill, count(*) AS n FROM al GROUP BY skill")
def skl_demand(s, d):
    return S.demand(_found(s, d))


@query("skl_overlap", "SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS matched, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS missing FROM (SELECT p_partkey, list_distinct(string_split(lower(p_type), ' ')) AS a, list_distinct(list_filter(list_transform(string_split(lower(replace(p_name, ' ', ',')) || ',tin , ,steel', ','), lambda x: trim(x)), lambda x: x <> '')) AS b FROM part)")
def skl_overlap(s, d):
    from ..operators import match as M

    own = F.array_distinct(F.split(F.lower("p_type"), " "))
    needed = F.array_distinct(C.csv_items(F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit(",")), F.lit(",tin , ,steel"))))
    matched, missing = M.skill_overlap(own, needed)
    return table(s, d, "part").select("p_partkey", F.array_join(matched, ",").alias("matched"), F.array_join(missing, ",").alias("missing"))


_EMB = r"""tw AS (SELECT {id} AS id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1:768] AS w FROM {t}),
 te AS (SELECT id, list_transform(w, lambda x: (list_sum(list_transform(string_split(x, ''), lambda c: unicode(c)))::BIGINT % 100) / 100.0) AS v FROM tw)"""


@query("emb_hash", "WITH " + _EMB.format(id="doc_id", t="documents") + " SELECT id AS doc_id, len(v)::INT AS words, round(coalesce(list_sum(list_transform(v, lambda x: x::DOUBLE)) / nullif(l, 0), 0), 4) AS total, CASE WHEN l > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, list_transform(list_concat(v, [0.0, 0.0])[1:3], lambda x: round(coalesce(x::DOUBLE / nullif(l, 0), 0), 6)) AS first FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM te) WHERE len(v) > 0")
def emb_hash(s, d):
    e = _docs(s, d).select("doc_id", C.hash_embedding(F.col("text")).alias("e"), F.least(C.word_count(F.col("text")), F.lit(768)).alias("words"))
    unit = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)
    return e.where("words > 0").select("doc_id", "words", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.sqrt(unit), 4).alias("norm"), F.transform(F.slice("e", 1, 3), lambda x: F.round(x, 6)).alias("first"))


@query("vec_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cosine(s, d):
    e = table(s, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(C.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_TOPK = "tk AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0), vk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM tk)"


def _top(s, d, k):
    v = _vectors(s, d)
    return R.topk(v, v.where("id % 20 = 0"), k)


@query("vec_topk", f"WITH {_TOPK} SELECT query, id, round(score, 6) AS score, rank FROM vk WHERE rank <= 10 AND score >= 0.2")
def vec_topk(s, d):
    return _top(s, d, 10).where("score >= 0.2").withColumn("score", F.round("score", 6))


_BM = r"""dw AS (SELECT doc_id AS id, unnest(w) AS term, len(w) AS dl FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)),
 tf AS (SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM dw GROUP BY id, term),
 qw AS (SELECT item_id AS query, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark),
 qt AS (SELECT query, term, count(*) AS times FROM qw GROUP BY ALL),
 bm AS (SELECT query, id, sum(times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 50))) AS score FROM tf JOIN qt USING (term) GROUP BY ALL)"""


def _bm(s, d, k):
    return R.bm25(_docs(s, d).select(F.col("doc_id").alias("id"), "text"), table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), k)


_LEX = _BM + ", lx AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)::INT AS rank FROM bm)"


@query("lex_bm25", f"WITH {_BM} SELECT query, id, round(score, 5) AS score FROM bm")
def lex_bm25(s, d):
    scores = R.bm25_scores(_docs(s, d).select(F.col("doc_id").alias("id"), "text"), table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return scores.withColumn("score", C.rounded(F.col("score"), 5))


def _unit(name, id, t):
    """768 numbers of each text that has a word with a sum of code points above 0."""
    return f"{name} AS (WITH {_EMB.format(id=id, t=t)} SELECT id, list_transform(list_concat(v, list_transform(range(768 - len(v)), lambda i: 0.0)), lambda x: x::DOUBLE / l) AS v FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM te) WHERE l > 0)"


_HYBRID = f"""WITH {_LEX}, {_unit("de", "doc_id", "documents")}, {_unit("qe", "item_id", "benchmark")},
 p AS (SELECT qe.id AS query, de.id AS id, round(list_inner_product(de.v, qe.v), 9) AS s FROM de, qe),
 sm AS (SELECT query, id, s FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS r FROM p) WHERE r <= 6 AND s >= 0.1),
 xm AS (SELECT query, id, score / max(score) OVER (PARTITION BY query) AS x FROM lx WHERE rank <= 6 AND score > 0),
 b AS (SELECT query, id, round(0.7 * coalesce(s, 0) + 0.3 * coalesce(x, 0), 3) AS score FROM sm FULL JOIN xm USING (query, id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM b) SELECT query, id, score, rank FROM r WHERE rank <= 3 AND score > 0.1"""


@query("ret_hybrid", _HYBRID)
def ret_hybrid(s, d):
    semantic = R.topk(_docs(s, d).select(F.col("doc_id").alias("id"), C.hash_embedding(F.col("text")).alias("vector")), table(s, d, "benchmark").select(F.col("item_id").alias("id"), C.hash_embedding(F.col("text")).alias("vector")), 6)
    return R.hybrid(semantic, _bm(s, d, 6))


@query("ret_fallback_answer", f"WITH {_LEX} SELECT query, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS answer FROM lx JOIN documents ON doc_id = id WHERE rank <= 2 GROUP BY query")
def ret_fallback_answer(s, d):
    out = R.fallback_answer(_bm(s, d, 2), _docs(s, d).select(F.col("doc_id").alias("id"), "text"))
    return out.withColumn("answer", F.md5("answer"))


@query("ret_fast_path", "SELECT doc_id AS id, CASE WHEN trim(text) = '' THEN 'blank' WHEN lower(trim(text)) IN ('hello', 'hi') THEN 'greeting' ELSE 'search' END AS path FROM documents")
def ret_fast_path(s, d):
    return R.fast_path(_docs(s, d).select(F.col("doc_id").alias("id"), "text"), ["hello", "hi"])


@query("ret_rrf", f"WITH {_TOPK}, o AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id)::INT AS rank FROM vk WHERE rank <= 10) SELECT query, id, round(sum(1.0 / (60 + rank)), 8)::DOUBLE AS score FROM (SELECT query, id, rank FROM vk WHERE rank <= 10 UNION ALL SELECT * FROM o) GROUP BY ALL")
def ret_rrf(s, d):
    from pyspark.sql import Window

    a = _top(s, d, 10)
    b = a.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    return R.rrf(a, b).withColumn("score", F.round("score", 8))


def _mmr_sql(k: int = 5) -> str:
    """One step for each rank: the candidate of the most worth, given the pairs with those taken before."""
    steps = [" t1 AS (SELECT query, arg_min(id, o) AS id, 1 AS rank FROM c GROUP BY query)"]
    for i in range(2, k + 1):
        open_ones = f"SELECT c.query, c.id, c.o, 0.7 * c.score - 0.3 * max(s) AS worth FROM c JOIN p ON p.query = c.query AND p.a = c.id JOIN t{i - 1} t ON t.query = c.query AND t.id = p.b WHERE NOT EXISTS (SELECT 1 FROM t{i - 1} x WHERE x.query = c.query AND x.id = c.id) GROUP BY c.query, c.id, c.o, c.score"
        steps.append(f" t{i} AS (SELECT * FROM t{i - 1} UNION ALL SELECT query, arg_max(id, (worth, -o)), {i} FROM ({open_ones}) GROUP BY query)")
    return f"WITH {_TOPK}, c AS (SELECT query, id, score, rank AS o, embedding::DOUBLE[] AS v FROM vk JOIN embeddings ON vec_id = id WHERE rank <= 20), p AS (SELECT a.query, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM c a JOIN c b ON a.query = b.query)," + ",".join(steps) + f" SELECT query, id, rank::INT AS rank FROM t{k}"


@query("ret_mmr", _mmr_sql())
def ret_mmr(s, d):
    return R.mmr(_top(s, d, 20).join(_vectors(s, d), "id"))


@query("ret_tag_rerank", f"WITH {_TOPK} SELECT vk.query, vk.id, round(vk.score + CASE WHEN e.label = q.label THEN 0.1 ELSE 0 END, 6) AS score FROM vk JOIN embeddings e ON e.vec_id = vk.id JOIN embeddings q ON q.vec_id = vk.query WHERE rank <= 10")
def ret_tag_rerank(s, d):
    e = table(s, d, "embeddings")
    return R.tag_rerank(_top(s, d, 10), e.select(F.col("vec_id").alias("id"), F.col("label").alias("tag")), e.select(F.col("vec_id").alias("query"), F.col("label").alias("tag")))


INTENTS = [("the", "english"), ("and", "english"), ("les", "french"), ("des", "french"), ("die", "german"), ("und", "german")]


@query("ret_intent", r"WITH w AS (SELECT DISTINCT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS keyword FROM documents), h AS (SELECT id, intent, count(*) AS n FROM w JOIN " + _values(INTENTS, "keyword, intent") + " USING (keyword) GROUP BY ALL), b AS (SELECT id, arg_min(intent, (-n, intent)) AS intent FROM h GROUP BY id) SELECT doc_id AS id, coalesce(intent, 'general') AS intent FROM documents LEFT JOIN b ON doc_id = id")
def ret_intent(s, d):
    return R.intent(_docs(s, d).select(F.col("doc_id").alias("id"), "text"), s.createDataFrame(INTENTS, "keyword string, intent string"))


@query("ret_abbrev", r"SELECT item_id AS id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: CASE lower(x) WHEN 'th' THEN 'think that' WHEN 'of' THEN 'out of' ELSE x END), ' ') AS text FROM benchmark")
def ret_abbrev(s, d):
    return R.expand(table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), s.createDataFrame([("th", "think that"), ("of", "out of")], "short string, full string"))


_TERM = r"t AS (SELECT lang AS label, term, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY term) AS total FROM t)"


@query("lex_log_odds", f"WITH {_TERM}, z AS (SELECT lang AS label, count(*) AS docs, (SELECT count(*) FROM documents) - count(*) AS rest FROM documents GROUP BY lang) SELECT term, label, round(ln((n + 1.0) / (docs + 2.0)) - ln((total - n + 1.0) / (rest + 2.0)), 6) AS log_odds FROM a JOIN z USING (label) WHERE total >= 20")
def lex_log_odds(s, d):
    return R.log_odds(_docs(s, d), "lang")


@query("lex_term_label_share", f"WITH {_TERM} SELECT term, label, round(n / total, 6)::DOUBLE AS share FROM a WHERE total >= 20")
def lex_term_label_share(s, d):
    return R.term_label_share(_docs(s, d), "lang")
