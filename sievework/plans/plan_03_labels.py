"""Duplicates, label normalisation, taxonomies and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import dedup as D
from ..operators import labels as L
from ..sources.keyed import KeyedTable
from .base import registrar, table

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

HASH = r"CASE WHEN trim(text) <> '' AND trim(text) <> 'nan' THEN md5(array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''), ' ')) END"
EXACT = f"e AS (SELECT doc_id, text, source, h, min(doc_id) OVER (PARTITION BY h) AS first, h IS NOT NULL AND doc_id <> min(doc_id) OVER (PARTITION BY h) AS dup FROM (SELECT doc_id, text, source, {HASH} AS h FROM documents))"
#: Stop words of the near-duplicate search.
STOP = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()
_STOPPED = ", ".join(f"'{w}'" for w in STOP)
#: TF-IDF weights over the 10,000 most frequent terms of the rows that aren't exact copies, and the best earlier row.
NEAR = EXACT + rf""", k AS (SELECT doc_id, text FROM e WHERE NOT dup AND h IS NOT NULL),
 tk AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM k), tok AS (SELECT * FROM tk WHERE term NOT IN ({_STOPPED})),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
 voc AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 10000),
 raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM k)) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term)),
 nw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw),
 sc AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS s FROM nw a JOIN nw b ON a.term = b.term AND b.doc_id < a.doc_id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.95),
 nr AS (SELECT a AS doc_id, b AS parent, round(s, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) = 1)"""
ACTION = NEAR + ", ac AS (SELECT e.doc_id, e.first, e.dup, nr.parent, nr.score, CASE WHEN dup THEN 'exact_remove' WHEN nr.parent IS NOT NULL THEN 'near_dup_flag' ELSE 'keep' END AS action FROM e LEFT JOIN nr USING (doc_id))"


def _docs(s, d):
    return table(s, d, "documents")


@query("ded_exact", f"WITH {EXACT} SELECT doc_id, h AS _dup_hash, dup AS _exact_dup, CASE WHEN dup THEN first END AS _exact_dup_of FROM e")
def ded_exact(s, d):
    return D.exact(_docs(s, d), "doc_id", "text").select("doc_id", "_dup_hash", "_exact_dup", "_exact_dup_of")


@query("ded_near", f"WITH {NEAR} SELECT * FROM nr")
def ded_near(s, d):
    rows = D.exact(_docs(s, d), "doc_id", "text").where("not _exact_dup and _dup_hash is not null")
    return D.near(rows, "doc_id", "text", stop=STOP)


@query("ded_action", f"WITH {ACTION} SELECT doc_id, action AS _dup_action FROM ac")
def ded_action(s, d):
    return D.annotate(_docs(s, d), "doc_id", "text", stop=STOP).select("doc_id", "_dup_action")


@query("ded_report", f"WITH {ACTION} SELECT doc_id, CASE WHEN dup THEN first ELSE parent END AS parent, CASE WHEN dup THEN 'exact' ELSE 'near' END AS kind, CASE WHEN dup THEN 1.0::DOUBLE ELSE score END AS similarity, CASE WHEN dup THEN 'REMOVE' ELSE 'REVIEW' END AS action FROM ac WHERE action <> 'keep'")
def ded_report(s, d):
    return D.report(D.annotate(_docs(s, d), "doc_id", "text", stop=STOP), "doc_id")


@query("ded_summary", f"WITH {ACTION} SELECT count(*) AS total, count(*) FILTER (action = 'exact_remove') AS exact_remove, count(*) FILTER (action = 'near_dup_flag') AS near_dup_flag, count(*) FILTER (action = 'keep') AS keep FROM ac")
def ded_summary(s, d):
    return D.summary(D.annotate(_docs(s, d), "doc_id", "text", stop=STOP))


@query("ded_cluster", f"WITH RECURSIVE {NEAR}, link AS (SELECT e.doc_id, coalesce(CASE WHEN dup THEN first END, nr.parent) AS parent FROM e LEFT JOIN nr USING (doc_id)), walk AS (SELECT doc_id, doc_id AS pos FROM link UNION ALL SELECT w.doc_id, l.parent FROM walk w JOIN link l ON w.pos = l.doc_id WHERE l.parent IS NOT NULL) SELECT doc_id, min(pos) AS cluster FROM walk GROUP BY doc_id")
def ded_cluster(s, d):
    a = D.annotate(_docs(s, d), "doc_id", "text", stop=STOP)
    return D.clusters(a.select("doc_id", F.coalesce("_exact_dup_of", "_near_dup_of").alias("parent")), "doc_id", "parent")


@query("ded_file_per_owner", "WITH u AS (SELECT DISTINCT source, sha256(text) AS sha FROM documents WHERE doc_id % 2 = 1) SELECT source, sha FROM u WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id % 2 = 0 AND x.source = u.source AND sha256(x.text) = u.sha)")
def ded_file_per_owner(s, d):
    # uploads are the odd rows, existing files the even ones: two sides of one table, all of it
    files = _docs(s, d).select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return D.per_owner(files.where("doc_id % 2 = 1").select("source", "sha"), files.where("doc_id % 2 = 0"), ["source", "sha"])


SEGMENTS = [("BUILDING", "Construction"), ("AUTOMOBILE", "Cars"), ("FURNITURE", "Home"), ("HOUSEHOLD", "Home")]
_MAP = "m(source, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SEGMENTS) + ")"


def _map(s):
    return s.createDataFrame(SEGMENTS, "source string, target string")


@query("nrm_roles", f"WITH {_MAP} SELECT c_custkey, coalesce(target, trim(c_mktsegment)) AS _role_normalized, coalesce(target, trim(c_mktsegment)) <> c_mktsegment AS _role_changed FROM customer LEFT JOIN m ON trim(c_mktsegment) = source")
def nrm_roles(s, d):
    return L.normalize(table(s, d, "customer"), "c_mktsegment", _map(s)).select("c_custkey", "_role_normalized", "_role_changed")


@query("nrm_mapping_report", f"""WITH {_MAP} SELECT c_mktsegment AS source, coalesce(target, c_mktsegment) AS canonical, count(*) AS "count", coalesce(target, c_mktsegment) <> c_mktsegment AS changed FROM customer LEFT JOIN m ON c_mktsegment = source GROUP BY ALL""")
def nrm_mapping_report(s, d):
    return L.mapping_report(table(s, d, "customer"), "c_mktsegment", _map(s))


@query("nrm_merge_suggestions", "WITH n AS (SELECT DISTINCT w AS l FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part UNION ALL SELECT p_type FROM part)) SELECT a.l AS longer, max(b.l) AS shorter FROM n a JOIN n b ON contains(lower(a.l), lower(b.l)) AND length(a.l) > length(b.l) GROUP BY a.l")
def nrm_merge_suggestions(s, d):
    part = table(s, d, "part")
    names = part.select(F.explode(F.split("p_type", " ")).alias("l")).unionByName(part.select(F.col("p_type").alias("l")))
    return L.merge_suggestions(names, "l")


@query("nrm_skills", f"WITH m(source, target) AS (VALUES ('the', 'THE'), ('and', 'AND'), ('les', 'LES')), t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> ''))) AS skill FROM documents) SELECT skill, coalesce(target, skill) AS normalized, count(*) AS docs FROM t LEFT JOIN m ON skill = source GROUP BY ALL HAVING count(*) >= 100")
def nrm_skills(s, d):
    m = s.createDataFrame([("the", "THE"), ("and", "AND"), ("les", "LES")], "source string, target string")
    t = _docs(s, d).select(F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("skill")).where("skill <> ''").groupBy("skill").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 100")
    return L.normalize(t, "skill", m).select("skill", F.col("_role_normalized").alias("normalized"), "docs")


TAXONOMY = [(1, "Urgent", ["1-URGENT", "HIGHEST"]), (2, "High", ["2-HIGH"]), (3, "Medium", ["3-MEDIUM", "2-HIGH"]), (4, "Other", ["4-NOT SPECIFIED", "5-LOW"])]
_TAX = "x AS (SELECT ord, name, lower(unnest(list_concat([name], aliases))) AS a FROM (VALUES " + ", ".join(f"({o}, '{n}', [{', '.join(f"'{a}'" for a in al)}])" for o, n, al in TAXONOMY) + ") v(ord, name, aliases))"


def _tax(s):
    return s.createDataFrame(TAXONOMY, "ord int, name string, aliases array<string>")


@query("tax_find_canonical", f"WITH {_TAX}, f AS (SELECT a, arg_min(name, ord) AS canonical FROM x GROUP BY a) SELECT o_orderkey, o_orderpriority, canonical FROM orders LEFT JOIN f ON lower(trim(o_orderpriority)) = a")
def tax_find_canonical(s, d):
    return L.find_canonical(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", _tax(s))


@query("tax_aliases", "SELECT p_brand AS name, p_type AS alias FROM part GROUP BY ALL")
def tax_aliases(s, d):
    tax = table(s, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.collect_set("p_type").alias("aliases"))
    return L.aliases(tax)


@query("tax_catalog_filter", "SELECT p_partkey, p_name FROM part WHERE upper(trim(p_brand)) = upper((SELECT min(p_brand) FROM part)) AND (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a'))")
def tax_catalog_filter(s, d):
    part = table(s, d, "part")
    least = part.agg(F.min("p_brand")).first()[0]
    catalog = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("occupational_class"), F.lit("").alias("description"), F.array("p_type").alias("aliases"), F.array().cast("array<string>").alias("skills"))
    return L.catalog_filter(catalog, least, "A").select("p_partkey", F.col("name").alias("p_name"))


@query("tax_catalog_sync", "SELECT coalesce(n.p_partkey, o.p_partkey) AS slug, coalesce(upper(n.p_name), o.p_name) AS title, coalesce(n.p_partkey IS NOT NULL OR o.p_size > 25, false) AS is_active FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) o FULL JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) n USING (p_partkey)")
def tax_catalog_sync(s, d):
    part = table(s, d, "part")
    # the old and the new catalogue overlap in part
    old = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"), (F.col("p_size") > 25).alias("is_active"))
    new = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("slug"), F.upper("p_name").alias("title"))
    catalog = KeyedTable(s, tables.new_path(s, "catalog"), old.schema, ["slug"])
    catalog.merge(old)
    for number in (0, 0):  # the second time changes nothing
        L.sync_catalog(catalog, new, number)
    return catalog.read()


@query("tax_exclude_classes", "SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS class_id FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def tax_exclude_classes(s, d):
    return L.exclude_classes(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"])


_DOM = "dom AS (SELECT g, arg_min(lang, (-n, lang)) AS dominant FROM (SELECT md5(text) AS g, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY g)"
_SPLIT = _DOM + """, ranked AS (SELECT g, dominant, count(*) OVER (PARTITION BY dominant) AS n, row_number() OVER (PARTITION BY dominant ORDER BY md5('42-' || g), g) AS r FROM dom),
 cut AS (SELECT *, greatest(1, round_even(n * 0.15, 0)) AS t, CASE WHEN n > 2 THEN greatest(1, round_even(n * 0.15, 0)) ELSE 0 END AS v FROM ranked),
 sp AS (SELECT d.doc_id, d.lang, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS _split FROM documents d JOIN cut ON md5(d.text) = g)"""


def _split(s, d):
    return L.split(_docs(s, d).select("doc_id", "lang", F.md5("text").alias("g")), "g", "lang")


@query("spl_dominant_label", "SELECT source AS \"source\", arg_min(lang, (-n, lang)) AS dominant FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def spl_dominant_label(s, d):
    return L.dominant_label(_docs(s, d), "source", "lang")


@query("spl_stratified_group", f"WITH {_SPLIT} SELECT doc_id, lang, _split FROM sp")
def spl_stratified_group(s, d):
    return _split(s, d).select("doc_id", "lang", "_split")


@query("spl_ratio_guard", f"WITH {_SPLIT.replace('n * 0.15', 'n * 0.1')} SELECT _split, count(*) AS count FROM sp GROUP BY _split")
def spl_ratio_guard(s, d):
    return L.split(_docs(s, d).select("doc_id", "lang", F.md5("text").alias("g")), "g", "lang", (0.8, 0.1, 0.1)).groupBy("_split").count()


@query("spl_summary", f"WITH {_SPLIT} SELECT _split, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM sp GROUP BY _split")
def spl_summary(s, d):
    return L.split_summary(_split(s, d))


@query("spl_leakage", f"WITH {_SPLIT}, h AS (SELECT DISTINCT md5(d.text) AS g, _split FROM sp JOIN documents d USING (doc_id)) SELECT p.pair, (SELECT count(*) FROM (SELECT g FROM h WHERE _split = p.a INTERSECT SELECT g FROM h WHERE _split = p.b)) AS overlap FROM (VALUES ('train_val', 'train', 'val'), ('train_test', 'train', 'test'), ('val_test', 'val', 'test')) p(pair, a, b)")
def spl_leakage(s, d):
    return L.leakage(_split(s, d), "g")


@query("spl_complement", f"WITH {_SPLIT} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sp WHERE _split IN ('train', 'val'))")
def spl_complement(s, d):
    parts = _split(s, d)
    return L.complement(_docs(s, d).select("doc_id"), parts.where("_split = 'train'"), parts.where("_split = 'val'"), key="doc_id")


@query("spl_review_queue", "SELECT doc_id::VARCHAR AS doc_id, lang, '' AS toxic, 'short' AS reason FROM documents WHERE length(trim(text)) < 100 UNION ALL SELECT doc_id::VARCHAR, '', toxic::VARCHAR, 'toxic' FROM labels WHERE toxic = 1")
def spl_review_queue(s, d):
    short = _docs(s, d).where(F.length(F.trim("text")) < 100).withColumn("reason", F.lit("short"))
    toxic = table(s, d, "labels").where("toxic = 1").withColumn("reason", F.lit("toxic"))
    return L.review_queue(short, toxic, columns=["doc_id", "lang", "toxic", "reason"])


@query("spl_kfold", "SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM documents")
def spl_kfold(s, d):
    return L.kfold(_docs(s, d).select("doc_id", "lang"), "doc_id", "lang")
