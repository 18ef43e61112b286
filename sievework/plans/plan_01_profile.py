"""Profiling and validation over the documents, labels and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import profile as P
from ..operators import validate as V
from .base import registrar, table

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

#: The words of a text in DuckDB.
W = r"len(list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> ''))"
DOC_COLUMNS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]


def _summary_sql() -> str:
    parts = []
    for c, kind in DOC_COLUMNS:
        size, digits = (f"length({c})", 1) if kind == "string" else (c, 4)
        parts.append(f"""SELECT '{c}' AS "column", '{kind}' AS dtype, count(*) - count({c}) AS null_count,
            round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_pct, count(DISTINCT {c}) AS unique_count,
            min({size})::DOUBLE AS least, max({size})::DOUBLE AS most, round(avg({size}), {digits}) AS mean,
            (SELECT string_agg(v, ' | ' ORDER BY doc_id) FROM (SELECT doc_id, substr({c}::VARCHAR, 1, 120) AS v FROM documents WHERE {c} IS NOT NULL ORDER BY doc_id LIMIT 5)) AS samples FROM documents""")
    return " UNION ALL ".join(parts)


@query("prf_schema_summary", _summary_sql())
def prf_schema_summary(s, d):
    return P.schema_summary(table(s, d, "documents"), "doc_id").withColumn("samples", F.array_join("samples", " | "))


_SKETCHED = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, min({x})::DOUBLE AS least, max({x})::DOUBLE AS most, round(avg({x}), 4)::DOUBLE AS mean, true AS distinct_is_near, true AS median_is_near FROM documents""" for c, x in ((c, f"length({c})" if k == "string" else c) for c, k in DOC_COLUMNS))


@query("prf_sketches", _SKETCHED)
def prf_sketches(s, d):
    # stored for two parts of the documents and merged; the estimates are held against exact figures
    docs = table(s, d, "documents")
    stored = tables.stored(P.sketches(docs.where("doc_id % 3 = 0")).unionByName(P.sketches(docs.where("doc_id % 3 <> 0"))), "sketches")
    estimated = P.from_sketches(P.merged_sketches(stored))
    exact = P.schema_summary(docs).select("column", F.col("unique_count").alias("n"))
    medians = docs.agg(*(F.median(F.length(c) if k == "string" else F.col(c)).alias(c) for c, k in DOC_COLUMNS)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("exact")) for c, _ in DOC_COLUMNS))))
    near = lambda a, b, part: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(2.0), F.abs(F.col(b)) * part)
    return estimated.join(exact, "column").join(medians, "column").select("column", "rows", "nulls", "least", "most", F.round("mean", 4).alias("mean"), near("unique_count", "n", 0.06).alias("distinct_is_near"), near("median", "exact", 0.1).alias("median_is_near"))


_STATS = "SELECT '{u}' AS unit, min(n)::DOUBLE AS least, max(n)::DOUBLE AS most, round(avg(n), 2) AS mean, round(median(n), 2)::DOUBLE AS median, round(stddev_samp(n), 2) AS std FROM (SELECT {e} AS n FROM documents)"


@query("prf_text_stats", _STATS.format(u="chars", e="length(text)") + " UNION ALL " + _STATS.format(u="words", e=W.format(t="text")))
def prf_text_stats(s, d):
    return P.text_stats(table(s, d, "documents"), "text")


@query("prf_null_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls FROM documents""" for c, _ in DOC_COLUMNS))
def prf_null_profile(s, d):
    return P.null_profile(table(s, d, "documents"))


@query("prf_duplicate_rows", "SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS duplicate_rows, (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS duplicate_ids")
def prf_duplicate_rows(s, d):
    return P.duplicate_rows(table(s, d, "documents"), "doc_id")


@query("prf_class_distribution", """SELECT source AS label, count(*) AS "count", round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct, row_number() OVER (ORDER BY count(*) DESC, source)::INT AS rank FROM documents GROUP BY source""")
def prf_class_distribution(s, d):
    return P.class_distribution(table(s, d, "documents"), "source")


@query("prf_category_distribution", """SELECT lang AS label, count(*) AS "count" FROM documents GROUP BY lang""")
def prf_category_distribution(s, d):
    return P.category_distribution(table(s, d, "documents"), "lang")


@query("prf_category_summary", "SELECT count(*) AS categories, max(n) AS largest, min(n) AS smallest, count(*) FILTER (n < 10) AS weak, count(*) FILTER (n < 50) AS small FROM (SELECT count(*) AS n FROM part GROUP BY p_type)")
def prf_category_summary(s, d):
    return P.category_summary(table(s, d, "part"), "p_type")


@query("prf_weak_classes", """SELECT p_brand AS label, count(*) AS "count" FROM part GROUP BY p_brand HAVING count(*) < 80""")
def prf_weak_classes(s, d):
    return P.weak_classes(table(s, d, "part"), "p_brand", 80)


@query("prf_quality_report", """WITH n AS (SELECT (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS dup, (SELECT count(*) FROM documents WHERE length(trim(text)) < 100) AS short)
 SELECT 'duplicate_ids' AS "check", dup::DOUBLE AS value, CASE WHEN dup > 0 THEN 'warn' ELSE 'ok' END AS status, '' AS detail FROM n
 UNION ALL SELECT 'short_texts', short::DOUBLE, CASE WHEN short > 0 THEN 'warn' ELSE 'ok' END, '' FROM n
 UNION ALL """ + " UNION ALL ".join(f"SELECT 'null_pct_{c}', round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE, CASE WHEN 100.0 * (count(*) - count({c})) / count(*) > 5 THEN 'warn' ELSE 'ok' END, '{k}' FROM documents" for c, k in DOC_COLUMNS))
def prf_quality_report(s, d):
    docs = table(s, d, "documents")
    checks = docs.agg(F.count_if(F.length(F.trim("text")) < 100).alias("short")).crossJoin(V.duplicate_ids(docs, "doc_id"))
    checks = checks.select(F.inline(F.array(F.struct(F.lit("duplicate_ids").alias("check"), F.col("duplicate_ids").alias("value")), F.struct(F.lit("short_texts").alias("check"), F.col("short").alias("value")))))
    return P.quality_report(checks, P.schema_summary(docs))


@query("prf_manifest", r"SELECT count(*) AS rows, count(DISTINCT source) AS labels, count(DISTINCT doc_id) AS ids, bit_xor(('0x' || substr(md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, '\N'), coalesce(source, '\N'), coalesce(text, '\N'))), 1, 15))::BIGINT) AS fingerprint, '42' AS seed, '1' AS version FROM documents")
def prf_manifest(s, d):
    return P.manifest(table(s, d, "documents"), "doc_id", "source", "text", seed="42", version="1")


_REPORT = f"""WITH st AS ({_STATS.format(u="chars", e="length(text)")} UNION ALL {_STATS.format(u="words", e=W.format(t="text"))}), cl AS (SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM documents GROUP BY source)
 SELECT '## Text ' || unit AS section, '- least ' || least || ', most ' || most || ', mean ' || mean || ', median ' || median AS line FROM st UNION ALL SELECT '## Classes', '- ' || coalesce(source, 'null') || ': ' || n || ' (' || pct || ' %)' FROM cl
 UNION ALL """ + " UNION ALL ".join(f"SELECT '## Nulls', '- {c}: ' || (count(*) - count({c})) FROM documents" for c, _ in DOC_COLUMNS)


@query("prf_inspection_report", _REPORT)
def prf_inspection_report(s, d):
    return P.inspection_report(table(s, d, "documents"), "doc_id", "source", "text")


@query("prf_samples", "SELECT doc_id, substr(text, 1, 120) AS sample FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 5")
def prf_samples(s, d):
    return P.samples(table(s, d, "documents"), "text", "doc_id")


@query("val_columns", "SELECT count(*) AS rows FROM documents")
def val_columns(s, d):
    return V.require_columns(table(s, d, "documents"), "doc_id", "text").agg(F.count(F.lit(1)).alias("rows"))


@query("val_nulls", """WITH j AS (SELECT d.doc_id, d.text, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), c AS (SELECT 'toxic' AS "column", count(*) - count(toxic) AS nulls, 100.0 * (count(*) - count(toxic)) / count(*) AS p FROM j UNION ALL SELECT 'text', count(*) - count(text), 100.0 * (count(*) - count(text)) / count(*) FROM j)
 SELECT "column", nulls, round(p, 2)::DOUBLE AS null_pct, CASE WHEN p > 10 THEN 'error' WHEN p > 0 THEN 'warning' ELSE 'ok' END AS level FROM c""")
def val_nulls(s, d):
    return V.nulls(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), ["toxic", "text"])


_TQ = f"count(*) FILTER (n = 0) AS empty, count(*) FILTER (n > 0 AND n < 100) AS short_chars, count(*) FILTER (n > 0 AND w < 20) AS short_words, min(n) FILTER (n > 0) AS min_chars, max(n) FILTER (n > 0) AS max_chars, round(avg(n) FILTER (n > 0), 1) AS mean_chars, median(n) FILTER (n > 0) AS median_chars FROM (SELECT length(trim(text)) AS n, {W.format(t='trim(text)')} AS w FROM documents)"


@query("val_text_quality", f"SELECT {_TQ}")
def val_text_quality(s, d):
    out = V.text_quality(table(s, d, "documents"), "text")
    return out.withColumns({c: out[c].cast("long") for c in ("min_chars", "max_chars")})


@query("val_label_distribution", "SELECT count(*) AS rare, array_to_string(list_slice(list_sort(list(p_type)), 1, 10), ',') AS named FROM (SELECT p_type FROM part GROUP BY p_type HAVING count(*) < 400)")
def val_label_distribution(s, d):
    return V.label_distribution(table(s, d, "part"), "p_type", 400)


@query("val_duplicate_ids", "SELECT count(*) - count(DISTINCT l_orderkey) AS duplicate_ids FROM lineitem")
def val_duplicate_ids(s, d):
    return V.duplicate_ids(table(s, d, "lineitem"), "l_orderkey")


@query("val_suspicious", r"SELECT count(*) FILTER (len(regexp_extract_all(x, '<[^>]+>')) > 10) AS html_heavy, count(*) FILTER (regexp_matches(trim(x), '^[^\p{L}\p{Nl}\p{No}]+$')) AS symbol_only FROM (SELECT html AS x FROM pages UNION ALL SELECT page_id || ' -- ' || length(html) FROM pages)")
def val_suspicious(s, d):
    # the pages, and of each a line of numbers and marks
    pages = table(s, d, "pages")
    return V.suspicious(pages.select("html").unionByName(pages.select(F.concat("page_id", F.lit(" -- "), F.length("html")).alias("html"))), "html")


_VR = f"""WITH x AS (SELECT doc_id, source, text, length(trim(text)) AS n, {W.format(t='trim(text)')} AS w FROM documents),
 r AS (SELECT count(*) AS rows, round(100.0 * count(*) FILTER (source IS NULL) / greatest(count(*), 1), 2) AS nl, round(100.0 * count(*) FILTER (text IS NULL) / greatest(count(*), 1), 2) AS nt, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n > 0 AND n < 100) AS short_chars, count(*) FILTER (n > 0 AND w < 20) AS short_words, count(*) - count(DISTINCT doc_id) AS duplicate_ids, count(*) FILTER (len(regexp_extract_all(coalesce(text, ''), '<[^>]+>')) > 10) AS html_heavy FROM x),
 f AS (SELECT *, (SELECT count(*) FROM (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) < 5)) AS rare FROM r)
 SELECT nl <= 10 AND nt <= 10 AS passed, concat_ws('; ', CASE WHEN nl > 10 THEN 'label: too many nulls' END, CASE WHEN nt > 10 THEN 'text: too many nulls' END) AS errors, concat_ws('; ', CASE WHEN nl > 0 AND nl <= 10 THEN 'label: nulls' END, CASE WHEN nt > 0 AND nt <= 10 THEN 'text: nulls' END, CASE WHEN empty > 0 THEN 'empty texts' END, CASE WHEN short_chars > 0 THEN 'short texts' END, CASE WHEN rare > 0 THEN 'rare labels' END, CASE WHEN duplicate_ids > 0 THEN 'duplicate ids' END, CASE WHEN html_heavy > 0 THEN 'html' END) AS warnings, rows, empty, short_chars, short_words, duplicate_ids, rare, html_heavy FROM f"""


@query("val_report", _VR)
def val_report(s, d):
    return V.report(table(s, d, "documents"), "doc_id", "source", "text")


@query("src_html_pages", "SELECT page_id, len(regexp_extract_all(html, '<[^>]+>'))::INT AS tags, len(regexp_extract_all(html, '<[^>]+>')) > 10 AS html_heavy FROM pages")
def src_html_pages(s, d):
    tags = F.regexp_count("html", F.lit("<[^>]+>"))
    return table(s, d, "pages").select("page_id", tags.alias("tags"), (tags > 10).alias("html_heavy"))
