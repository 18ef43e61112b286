"""Cleaning and text functions over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import profile as P
from ..operators import text as X
from .base import PROFILES, profiles, registrar, table

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

WL = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"


def _docs(s, d):
    return table(s, d, "documents")


_PLAIN = "text"
for _a, _b in X.TYPOGRAPHY:
    _q = _b.replace("'", "''")
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_q}')"


@query("cln_unicode", f"SELECT doc_id, md5({_PLAIN}) AS cleaned FROM documents")
def cln_unicode(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.unicode_clean(F.col("text"))).alias("cleaned"))


def _artifacts_sql(text: str) -> str:
    """The same in RE2, which has no back-references: one replacement for each header and for each mark."""
    for h in X.HEADERS.split("|"):
        text = f"regexp_replace({text}, '({h})(\\s*[:\\-•]?\\s*{h})+', '\\1', 'gi')"
    for pattern, by in X.ARTIFACTS:
        if "\\1" in pattern:
            for c in "~`!@$%^&*()+={}[]|\\:;\"'<>,.?/":
                q = "''" if c == "'" else c
                esc = "\\" + q if not c.isalnum() and c != "'" else q
                text = f"regexp_replace({text}, '{esc}{{5,}}', '{chr(92) * 2 if c == chr(92) else q}', 'g')"
        else:
            by = by.replace("\n", "' || chr(10) || '")
            text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


@query("cln_artifacts", f"SELECT doc_id, md5({_artifacts_sql('text')}) AS cleaned FROM documents")
def cln_artifacts(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.remove_artifacts(F.col("text"))).alias("cleaned"))


@query("cln_pii_mask", f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{X.EMAIL}', '[EMAIL]', 'g'), '{X.PHONE}', '[PHONE]', 'g')) AS masked FROM documents")
def cln_pii_mask(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.mask_contacts(F.col("text"))).alias("masked"))


@query("cln_flag", "SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(trim(text)) < 100 THEN 'short' ELSE 'ok' END AS flag FROM documents")
def cln_flag(s, d):
    return _docs(s, d).select("doc_id", X.flag(F.col("text")).alias("flag"))


@query("cln_drop_flagged", "SELECT doc_id, n_chars FROM documents WHERE length(trim(text)) >= 100")
def cln_drop_flagged(s, d):
    return _docs(s, d).where(X.flag(F.col("text")) == "ok").select("doc_id", "n_chars")


_MASKED = f"regexp_replace(regexp_replace({_artifacts_sql(_PLAIN.replace('(text)', '(text)'))}, '{X.EMAIL}', '[EMAIL]', 'g'), '{X.PHONE}', '[PHONE]', 'g')"


@query("cln_pipeline", rf"SELECT doc_id, CASE WHEN length(c) = 0 THEN 'empty' WHEN length(c) < 100 THEN 'short' ELSE 'ok' END AS _text_clean_flag, md5(c) AS cleaned FROM (SELECT doc_id, regexp_replace({_MASKED}, '^\s+|\s+$', '', 'g') AS c FROM documents)")
def cln_pipeline(s, d):
    return X.clean(_docs(s, d), "text", mask=True).select("doc_id", "_text_clean_flag", F.md5("text").alias("cleaned"))


@query("flagship_class_distribution", """WITH k AS (SELECT source, md5(array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''), ' ')) AS h, doc_id FROM documents), f AS (SELECT source, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM k)
 SELECT source AS label, count(*) AS "count", round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct, row_number() OVER (ORDER BY count(*) DESC, source)::INT AS rank FROM f WHERE r = 1 GROUP BY source""")
def flagship_class_distribution(s, d):
    from ..operators import dedup

    kept = dedup.exact(_docs(s, d), "doc_id", "text").where(~F.col("_exact_dup"))
    return P.class_distribution(kept, "source")


@query("txt_clean")
def txt_clean(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.compat_clean(F.col("text"))).alias("cleaned"))


@query("txt_match_key", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s.+#]', ' ', 'g'), '\s+', ' ', 'g'))) AS match_key FROM documents")
def txt_match_key(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.match_key(F.col("text"))).alias("match_key"))


# pieces are paragraphs, or words of long ones; a fold over their lengths numbers the chunks
_CHUNKS = rf"""WITH b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda p: trim(p)), lambda p: p <> '') AS b FROM documents),
 q AS (SELECT doc_id, flatten(list_transform(b, lambda p: CASE WHEN length(p) > 500 THEN list_transform({WL.format(t='p')}, lambda w, i: {{'w': w, 'g': ' ', 'f': i = 1}}) ELSE [{{'w': p, 'g': chr(10), 'f': false}}] END)) AS x FROM b),
 r AS (SELECT doc_id, x, list_reduce(list_transform(x, lambda y: {{'l': length(y.w), 'f': y.f, 'c': [0]}}), lambda a, y: CASE WHEN y.f OR a.l + y.l + 1 > 500 THEN {{'l': y.l, 'f': y.f, 'c': list_append(a.c, a.c[-1] + 1)}} ELSE {{'l': a.l + 1 + y.l, 'f': y.f, 'c': list_append(a.c, a.c[-1])}} END).c AS c FROM q WHERE len(x) > 0),
 u AS (SELECT doc_id, unnest(x) AS y, unnest(c) AS chunk, generate_subscripts(c, 1) AS k FROM r),
 n AS (SELECT *, coalesce(lag(chunk) OVER (PARTITION BY doc_id ORDER BY k) <> chunk, true) AS opens FROM u),
 h AS (SELECT doc_id, chunk, string_agg(CASE WHEN opens THEN y.w ELSE y.g || y.w END, '' ORDER BY k) AS body FROM n GROUP BY doc_id, chunk)
 SELECT doc_id, chunk::INT AS chunk, coalesce(right(lag(body) OVER (PARTITION BY doc_id ORDER BY chunk), 50) || ' ', '') || body AS chunk_text FROM h"""


@query("txt_chunk_paragraph", _CHUNKS)
def txt_chunk_paragraph(s, d):
    return X.paragraphs(_docs(s, d), "doc_id", "text")


@query("txt_chunk_window", f"""WITH w AS (SELECT doc_id, {WL.format(t='text')} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 240) / 160.0))::BIGINT + 1)) AS chunk FROM w WHERE len(w) > 0)
 SELECT doc_id, chunk::INT AS chunk, array_to_string(w[chunk * 160 + 1 : chunk * 160 + 240], ' ') AS chunk_text FROM c""")
def txt_chunk_window(s, d):
    return X.windows(_docs(s, d), "doc_id", "text")


#: The word characters of Unicode in RE2.
_WORD = r"\p{L}\p{N}_"


@query("txt_email", f"SELECT doc_id, lower(nullif(regexp_extract(text, '[{_WORD}.+-]+@[{_WORD}-]+\\.[{_WORD}.-]+'), '')) AS email FROM documents")
def txt_email(s, d):
    return _docs(s, d).select("doc_id", X.email(F.col("text")).alias("email"))


@query("txt_phone", r"SELECT doc_id, CASE WHEN regexp_matches(text, '[+]?[\d\s()-]{10,15}') THEN regexp_replace(regexp_extract(text, '[+]?[\d\s()-]{10,15}'), '^\s+|\s+$', '', 'g') END AS phone FROM documents")
def txt_phone(s, d):
    return _docs(s, d).select("doc_id", X.phone(F.col("text")).alias("phone"))


@query("txt_urls", r"""SELECT page_id, unnest(regexp_extract_all(url, 'https?://[^\s)\]>]+')) AS found FROM pages""")
def txt_urls(s, d):
    return table(s, d, "pages").select("page_id", F.explode(X.urls(F.col("url"))).alias("found"))


@query("txt_years_experience", r"SELECT p_partkey, coalesce(list_max(list_transform(regexp_extract_all(t, '(\d+(?:\.\d+)?)\s*\+?\s*(?:years|year|yrs|yr)\b', 1), lambda x: x::DOUBLE)), 0.0) AS years FROM (SELECT p_partkey, p_name || ' ' || p_size || '+ years, ' || (p_partkey % 30) || ' yrs' AS t FROM part)")
def txt_years_experience(s, d):
    t = F.concat("p_name", F.lit(" "), "p_size", F.lit("+ years, "), F.col("p_partkey") % 30, F.lit(" yrs"))
    return table(s, d, "part").select("p_partkey", C.years_of_experience(t).alias("years"))


@query("txt_content_hash", f"SELECT doc_id, md5(array_to_string({WL.format(t='lower(text)')}, ' ')) AS content_hash FROM documents")
def txt_content_hash(s, d):
    return _docs(s, d).select("doc_id", C.content_hash(F.col("text")).alias("content_hash"))


@query("txt_file_hash", "SELECT page_id, sha256(html) AS file_hash FROM pages")
def txt_file_hash(s, d):
    return table(s, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("file_hash"))


_NL = "chr(10)"
_HEADS = "CASE " + " ".join(f"WHEN regexp_matches(trim(lower(l)), '^(?:{w})|(?:{w}):') THEN '{n}'" for n, w in ((n, "|".join(ws)) for n, ws in X.SECTIONS.items())) + " END"
_SEGMENTS = rf"""{PROFILES}, ls AS (SELECT doc_id, unnest(l) AS l, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM profiles)),
 hd AS (SELECT doc_id, l, pos, {_HEADS} AS head FROM ls), sg AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM hd),
 nm AS (SELECT doc_id, seg, coalesce(max(head), 'general') AS section, string_agg(l, chr(10) ORDER BY pos) FILTER (head IS NULL) AS body FROM sg GROUP BY doc_id, seg)
 SELECT doc_id, section, regexp_replace(body, '^\s+|\s+$', '', 'g') AS body FROM nm WHERE body IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY seg DESC) = 1"""


@query("sec_segment", f"WITH {_SEGMENTS.replace(chr(92) * 2, chr(92))}")
def sec_segment(s, d):
    return profiles(s, d).select("doc_id", F.explode(X.sections(F.col("text"))).alias("section", "body"))


@query("txt_profile_fields")
def txt_profile_fields(s, d):
    return profiles(s, d).select("doc_id", *(c.alias(n) for n, c in X.profile_fields(F.col("text")).items()))


@query("txt_snippet", f"SELECT doc_id, array_to_string({WL.format(t='text')}[1:30], ' ') AS snippet FROM documents")
def txt_snippet(s, d):
    return _docs(s, d).select("doc_id", X.snippet(F.col("text"), 30).alias("snippet"))


@query("val_min_text", f"SELECT doc_id FROM documents WHERE length(text) >= 200 AND len({WL.format(t='text')}) >= 30")
def val_min_text(s, d):
    return _docs(s, d).where((F.length("text") >= 200) & (C.word_count(F.col("text")) >= 30)).select("doc_id")


@query("emb_cache_key", r"SELECT doc_id, md5(trim(text)) AS cache_key FROM documents")
def emb_cache_key(s, d):
    return _docs(s, d).select("doc_id", F.md5(F.trim("text")).alias("cache_key"))
