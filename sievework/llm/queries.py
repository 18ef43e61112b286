"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan(_table(spark, sf_dir, "documents"))[0]


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.shingle_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup

    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import decontaminate

    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.find(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import warc

    pages = _table(spark, sf_dir, "pages")
    records = warc.read(warc.write(pages), payload=False)
    number = lambda c: F.col(c).cast(pages.schema["page_id"].dataType)
    return records.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversation_trie

    return conversation_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import fill_in_middle

    out = fill_in_middle.transform(_table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


# --- DuckDB SQL of the queries that SQL expresses at full size; the others have plain versions in the tests ---

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: From links (a, b) with a <> b in both directions: the smallest node that each reaches.
_REACH = """reach AS (SELECT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b),
 component AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""


def _license_sql() -> str:
    from . import license_scan as L

    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    places = ", ".join(f"list_filter(range(0, greatest(0, len(w) - {len(p.split(' ')) - 1})), lambda i: w[i + 1 : i + {len(p.split(' '))}] = {quoted(p.split(' '))}) AS p{k}" for k, (p, _) in enumerate(L.PHRASES))
    every = "list_concat(" + ", ".join(f"p{k}" for k in range(len(L.PHRASES))) + ")"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(L.PHRASES)) + "], lambda x: x IS NOT NULL)"
    texts = ", ".join(f"({k}, '{label}', '{' '.join(t.split()).lower()}')" for k, (label, t) in enumerate(L.TEMPLATES))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), pl AS (SELECT r, doc_id, w, {places} FROM d),
 t0 AS (SELECT k, label, {_WORDS} AS tw FROM (VALUES {texts}) v(k, label, text)),
 t AS (SELECT k, label, list_distinct(tw) AS tokens, ceil(0.9 * len(list_distinct(tw)) - 1e-9) AS need, greatest(8, 2 ** ceil(log2(len(tw))))::BIGINT AS size, ceil(len(tw) / 0.9 - 1e-9)::BIGINT AS run FROM t0),
 c AS (SELECT d.r, w, t.* FROM d, t WHERE len(list_intersect(w, tokens)) >= need),
 bl AS (SELECT r, k, label, tokens, need, size, run, w[i + 1 : i + 2 * size] AS b FROM (SELECT *, unnest(range(0, greatest(1, len(w) - size), size)) AS i FROM c)),
 h AS (SELECT *, CASE WHEN size > {L.SHORT} THEN len(list_intersect(tokens, b)) ELSE list_max(list_transform(range(0, greatest(1, len(b) - run + 1)), lambda i: len(list_intersect(tokens, b[i + 1 : i + run])))) END AS most FROM bl WHERE len(list_intersect(tokens, b)) >= need),
 m AS (SELECT r, label, most / len(tokens) AS share FROM h WHERE most >= need),
 b AS (SELECT r, list(DISTINCT label) AS more, max(share) AS share FROM m GROUP BY r)
 SELECT doc_id, len(w)::BIGINT AS n_words, len({every})::BIGINT AS n_base, list_min({every})::BIGINT AS first_word, list_max({every})::BIGINT AS last_word, array_to_string(list_sort({base}), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat({base}, coalesce(more, [])))), ',') AS labels, CASE WHEN len({every}) > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score FROM pl LEFT JOIN b USING (r)"""


_REPEATS = """WITH x AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT r, i, md5_number(substring(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM x WHERE length(h) >= 800)),
 g AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1), s AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w SEMI JOIN g USING (k)),
 u AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM s),
 p AS (SELECT r, span, min(i) AS lo, max(i) + 400 AS hi FROM u GROUP BY r, span), q AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS past FROM p),
 c AS (SELECT r, sum(hi - lo) AS removed, count(*) AS spans, string_agg(h[2 * past + 1 : 2 * lo], '' ORDER BY lo) AS kept, max(hi) AS stop FROM q JOIN x USING (r) GROUP BY r)
 SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN c.r IS NULL THEN h ELSE kept || h[2 * stop + 1 :] END)) AS kept_sha256 FROM x LEFT JOIN c USING (r)"""

_SHINGLES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
 e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
 shared AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id WHERE 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n GROUP BY ALL),
 links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)), {_REACH}
 SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id FROM s LEFT JOIN component ON node = doc_id"""

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
 links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98), {_REACH}, degree AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN component c ON c.node = vec_id LEFT JOIN degree d ON d.node = vec_id"""


def _url_sql() -> str:
    from . import url_filter as U

    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in U.RULES)
    return rf"""WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN url[instr(url, '://') + 3 :] ELSE '' END AS rest FROM pages),
 h AS (SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS h0, rest FROM u), s AS (SELECT r, page_id, {_LOWER.replace('text', 'h0')} AS host, regexp_extract(rest[length(h0) + 1 :], '(?s)^[^?#]*') AS path FROM h),
 m AS (SELECT r, arg_max((v.host || v.path, verdict), length(v.host || v.path)) AS best FROM s JOIN (VALUES {rules}) v(verdict, host, path) ON (s.host = v.host OR ends_with(s.host, '.' || v.host)) AND starts_with(s.path, v.path) GROUP BY r)
 SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], 'allow') AS verdict FROM s LEFT JOIN m USING (r)"""


_BENCHMARK = f"""WITH i AS (SELECT item_id::VARCHAR AS item, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
 iw AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
 d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
 dw AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
 hit AS (SELECT r, n, k, item FROM dw JOIN iw USING (n, g)), pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
 who AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY r)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (r) LEFT JOIN who USING (r)"""


#: The base32 SHA-1 of h, 40 hexadecimal digits.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::BIGINT, 1)), '')"

_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
 r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY html) AS top FROM p)
 SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM r"""

#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda x, b: list_reduce(list_concat([xor(x, b)], range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"

_TRIE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
 r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = donor AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
 s AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY own, pos) AS turns, list(strlen(text) ORDER BY own, pos) AS sizes FROM r GROUP BY conv_id),
 f AS (SELECT c.conv_id, coalesce(turns, []) AS turns, coalesce(sizes, []) AS sizes FROM c LEFT JOIN s USING (conv_id)),
 p AS (SELECT conv_id, d, turns[1:d] AS path, turns[1:d - 1] AS above, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM f)),
 n AS (SELECT path, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM p GROUP BY path, d),
 k AS (SELECT above AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY above),
 x AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS own FROM n LEFT JOIN k USING (path)),
 u AS (SELECT path[1:a] AS path, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM x) GROUP BY ALL)
 SELECT x.conv_id, x.d::BIGINT AS depth, q.conv_id AS parent_conv_id, x.n_convs, x.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256 FROM x JOIN u USING (path) LEFT JOIN n q ON x.d > 0 AND q.path = x.above"""

_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 g AS (SELECT *, len(u) AS n, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS v FROM d),
 c AS (SELECT *, least(v[1] % (n + 1), v[2] % (n + 1)) AS lo, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS hi, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR v[3] % 100 >= 50 THEN 'plain' WHEN v[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
 p AS (SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix FROM c)
 SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _license_sql(), "op3_suffix_dedup": _REPEATS, "op4_ngram_join": _SHINGLES, "op5_embedding_dedup": _VECTORS, "op6_url_filter": _url_sql(), "op9_benchmark_decontamination": _BENCHMARK, "op11_warc": _WARC, "op12_conversation_trie": _TRIE, "op13_fill_in_middle": _MIDDLE}
