"""Document quality, matching and role suggestion over profiles. Each profile is matched with the benchmark item of its number, as
its job; a job may ask for skills and years and have weights of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import tables
from ..operators import match as M
from ..operators import quality as Q
from ..operators import skills as S
from ..operators import text as X
from ..sources.keyed import KeyedTable
from .base import PROFILE_WORDS, PROFILES, profiles, registrar, table

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

W = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"
STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _analysed(s, d):
    return Q.analyse(profiles(s, d), "text")


def _sql(pattern: str) -> str:
    """A pattern for RE2, whose classes and boundaries are ASCII: Unicode words and digits where the reference has them."""
    return pattern.replace(r"[\w.-]", r"[\p{L}\p{N}_.-]").replace(r"\w+", r"[\p{L}\p{N}_]+").replace("'", "''")


def _has(pattern: str, flags: str = "") -> str:
    return f"regexp_matches(text, '{_sql(pattern)}'" + (f", '{flags}')" if flags else ")")


_CONTACT = f"{_has(Q.EMAIL)} AS has_email, {_has(Q.PHONE)} AS has_phone, {_has(Q.LINKEDIN, 'i')} AS has_linkedin, {_has(Q.GITHUB, 'i')} AS has_github"


@query("qlt_contact", f"WITH {PROFILES} SELECT doc_id, {_CONTACT} FROM profiles")
def qlt_contact(s, d):
    return profiles(s, d).select("doc_id", *(c.alias(n) for n, c in Q.contact(F.col("text")).items()))


_DETECTED = "concat_ws(',', " + ", ".join(f"CASE WHEN {_has(p, 'i')} THEN '{n}' END" for n, p in Q.SECTIONS.items()) + ")"
_MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_has(p, 'i')} THEN '{n}' END" for n, p in Q.SECTIONS.items()) + ")"


@query("qlt_sections", f"WITH {PROFILES} SELECT doc_id, {_DETECTED} AS detected, {_MISSING} AS missing FROM profiles")
def qlt_sections(s, d):
    detected, missing = Q.sections(F.col("text"))
    return profiles(s, d).select("doc_id", F.array_join(detected, ",").alias("detected"), F.array_join(missing, ",").alias("missing"))


_LINES = f"ln AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(t='x')}), lambda x: x <> '') AS ls FROM profiles)"
_BULLET = rf"(contains('{Q.BULLETS}', x[1]) OR regexp_matches(x, '^\d+\.\s+'))"


@query("qlt_bullets", f"WITH {PROFILES}, {_LINES}, b AS (SELECT doc_id, list_filter(ls, lambda x: {_BULLET}) AS b FROM ln) SELECT doc_id, len(b)::INT AS bullets, array_to_string(list_sort(list_distinct(list_filter(list_transform(b, lambda x: x[1]), lambda c: contains('{Q.BULLETS}', c)))), '') AS marks, len(list_filter(b, lambda x: len({W.format(t='x').replace('lambda x: x', 'lambda y: y')}) > 45))::INT AS long_bullets FROM b")
def qlt_bullets(s, d):
    b = Q.bullets(Q.lines(F.col("text")))
    return profiles(s, d).select("doc_id", b["bullets"].alias("bullets"), F.array_join(F.sort_array(b["bullet_symbols"]), "").alias("marks"), b["long_bullets"].alias("long_bullets"))


_VERBS = ", ".join(f"'{v}'" for v in Q.VERBS)


@query("qlt_action_verbs", rf"WITH {PROFILES} SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct(list_transform(regexp_extract_all(' ' || lower(text) || ' ', '[\p{{L}}\p{{N}}_]+'), lambda x: x)), [{_VERBS}])), ',') AS verbs FROM profiles".replace("[{_VERBS}]", f"list_filter([{_VERBS}], lambda v: length(v) >= 4)"))
def qlt_action_verbs(s, d):
    return profiles(s, d).select("doc_id", F.array_join(Q.action_verbs(F.col("text")), ",").alias("verbs"))


@query("qlt_metrics", f"WITH {PROFILES} SELECT doc_id, len(regexp_extract_all(text, '{Q.METRIC}'))::INT AS metric_count FROM profiles")
def qlt_metrics(s, d):
    return profiles(s, d).select("doc_id", Q.metrics(F.col("text")).alias("metric_count"))


@query("qlt_long_paragraphs", f"WITH {PROFILES} SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP.format(t='x')}), lambda p: len({W.format(t='p')}) > 65 AND NOT contains('{Q.BULLETS}', p[1])))::INT AS long_paragraphs FROM profiles")
def qlt_long_paragraphs(s, d):
    return profiles(s, d).select("doc_id", Q.long_paragraphs(F.col("text")).alias("long_paragraphs"))


_TYPOS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in Q.TYPOS.items()) + "}"


@query("qlt_typos", rf"WITH {PROFILES}, w AS (SELECT doc_id, list_filter(list_transform({W.format(t='lower(text)')}, lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda x: map_contains({_TYPOS}, x)) AS w FROM profiles) SELECT doc_id, array_to_string(list_transform(w[1:4], lambda x: x || '>' || {_TYPOS}[x]), ',') AS typos FROM w")
def qlt_typos(s, d):
    found = F.transform(Q.typos(F.col("text")), lambda x: F.concat(x["word"], F.lit(">"), x["suggested"]))
    return profiles(s, d).select("doc_id", F.array_join(found, ",").alias("typos"))


# a match is a word of letters, blanks, and the same word; of a run of equal words every second begins one
_REPEATED = r"""rt AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS t FROM profiles)),
 rn AS (SELECT *, lead(t) OVER w AS gap, lead(t, 2) OVER w AS next FROM rt WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
 rw AS (SELECT doc_id, t, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, regexp_matches(t, '^[A-Za-z]{2,}$') AND regexp_matches(coalesce(gap, ''), '^\s+$') AND lower(t) = lower(coalesce(next, '')) AS same FROM rn WHERE regexp_matches(t, '^[\p{L}\p{N}_]')),
 rg AS (SELECT doc_id, t, p, i - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM rw WHERE same),
 rr AS (SELECT doc_id, t, p, row_number() OVER (PARTITION BY doc_id, g ORDER BY p) AS r FROM rg)"""


@query("qlt_repeated_words", f"WITH {PROFILES}, {_REPEATED}, rs AS (SELECT doc_id, string_agg(t, ',' ORDER BY p) AS repeated FROM rr WHERE r % 2 = 1 GROUP BY doc_id) SELECT doc_id, coalesce(repeated, '') AS repeated FROM profiles LEFT JOIN rs USING (doc_id)")
def qlt_repeated_words(s, d):
    return profiles(s, d).select("doc_id", F.array_join(Q.repeated_words(F.col("text")), ",").alias("repeated"))


_PAST = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in Q.PAST.items()) + "}"
_BARE = STRIP.format(t=r"regexp_replace(l, '^[•*▪▫►✓0-9.-]+\s*', '')")
_TENSE = rf"""le AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM ln),
 lf AS (SELECT *, CASE WHEN regexp_matches(lower(l), '{"|".join(Q.OPENS)}') THEN 1 WHEN regexp_matches(lower(l), '{"|".join(Q.CLOSES)}') THEN 0 END AS turn FROM le),
 li AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS inside, {_BARE} AS bare FROM lf),
 lt AS (SELECT doc_id, pos, bare, lower(regexp_extract(bare, '^\S+')) AS verb FROM li WHERE inside = 1),
 ts AS (SELECT doc_id, pos, bare[1:45] || CASE WHEN length(bare) > 45 THEN '...' ELSE '' END AS cur, verb, {_PAST}[verb] AS past FROM lt WHERE map_contains({_PAST}, verb)),
 tn AS (SELECT doc_id, string_agg({STRIP.format(t="upper(past[1]) || past[2:] || ' ' || cur[length(verb) + 2:]")}, ' | ' ORDER BY pos) AS suggested FROM ts GROUP BY doc_id)"""


@query("qlt_tense", f"WITH {PROFILES}, {_LINES}, {_TENSE} SELECT doc_id, coalesce(suggested, '') AS suggested FROM profiles LEFT JOIN tn USING (doc_id)")
def qlt_tense(s, d):
    lined = profiles(s, d).select("doc_id", Q.lines(F.col("text")).alias("lines"))
    return lined.select("doc_id", F.array_join(F.transform(Q.tense(F.col("lines")), lambda x: x["suggested"]), " | ").alias("suggested"))


_DATES = "concat_ws(',', " + ", ".join(f"CASE WHEN {_has(p.replace('(?i)', ''), 'i' if '(?i)' in p else '')} THEN '{n}' END" for n, p in Q.DATES.items()) + ")"


@query("qlt_date_formats", f"WITH {PROFILES} SELECT doc_id, {_DATES} AS styles FROM profiles")
def qlt_date_formats(s, d):
    return profiles(s, d).select("doc_id", F.array_join(Q.date_formats(F.col("text")), ",").alias("styles"))


@query("qlt_est_pages", f"WITH {PROFILES} SELECT doc_id, greatest(1, round_even(len({W.format(t='text')}) / 400, 0))::INT AS pages FROM profiles")
def qlt_est_pages(s, d):
    return profiles(s, d).select("doc_id", Q.pages(C.word_count(F.col("text"))).alias("pages"))


def _count(text: str, by: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0 ELSE len(string_split({text}, '{by}')) END"


_POINTS = {"Contact Information": 15, "Work Experience / History": 25, "Skills & Competencies": 25, "Education & Qualifications": 15, "Summary / Objective": 10}
_SECTION_POINTS = " + ".join(f"CASE WHEN contains(detected, '{n}') THEN {p} ELSE 0 END" for n, p in _POINTS.items())
_FEATURES = "SELECT * FROM (SELECT doc_id, len(" + W.format(t="text") + f") AS words FROM (WITH {PROFILES} SELECT * FROM profiles))" + "".join(f" JOIN ({ORACLE[f'qlt_{k}']}) USING (doc_id)" for k in ("contact", "sections", "bullets", "long_paragraphs", "typos", "repeated_words", "tense", "date_formats", "est_pages"))
_SUBSCORES = f"""qf AS ({_FEATURES}), qc AS (SELECT *, {_count('repeated', ',')} AS d, {_count('suggested', ' | ')} AS t, {_count('typos', ',')} AS sp, {_count('styles', ',')} AS ds, length(marks) > 1 AS mixed FROM qf),
 qs AS (SELECT doc_id, words, greatest(10, least(100, 85 - CASE WHEN words < 150 THEN 45 WHEN words < 300 OR words > 1500 THEN 20 ELSE 0 END - CASE WHEN long_paragraphs > 2 THEN 15 WHEN long_paragraphs = 1 THEN 5 ELSE 0 END + CASE WHEN bullets >= 8 THEN 15 WHEN bullets = 0 THEN -25 ELSE 0 END)) AS ats_readability,
 90 - CASE WHEN pages > 2 THEN 15 ELSE 0 END AS formatting_layout, least(100, 40 + {_SECTION_POINTS}) AS section_structure,
 greatest(20, least(100, CASE WHEN bullets = 0 THEN 25 WHEN bullets < 4 THEN 55 WHEN bullets >= 8 THEN 95 ELSE 80 END - CASE WHEN mixed THEN 15 ELSE 0 END - CASE WHEN long_bullets > 2 THEN 10 ELSE 0 END)) AS bullet_quality, 90 AS typography,
 greatest(20, 92 - 12 * sp - 10 * least(4, d + least(t, greatest(1, 3 - d)))) AS grammar_spelling, 88 - CASE WHEN mixed THEN 15 ELSE 0 END - CASE WHEN ds > 1 THEN 15 ELSE 0 END AS consistency,
 60 + CASE WHEN has_email THEN 20 ELSE 0 END + CASE WHEN has_phone THEN 15 ELSE 0 END + CASE WHEN has_linkedin OR has_github THEN 5 ELSE 0 END AS contact_information FROM qc),
 qz AS (SELECT doc_id, words, {', '.join(f'CASE WHEN words < 5 THEN 0 ELSE {k} END::INT AS {k}' for k in Q.WEIGHTS)} FROM qs),
 qo AS (SELECT doc_id, words, CASE WHEN words < 5 THEN 0 ELSE greatest(10, least(100, round_even(({' + '.join(f'{round(w * 100)} * {k}' for k, w in Q.WEIGHTS.items())}) / 100, 0)::INT)) END::INT AS overall FROM qz),
 qg AS (SELECT doc_id, overall, CASE WHEN words < 5 THEN 'F' WHEN overall >= 90 THEN 'A+' WHEN overall >= 80 THEN 'A' WHEN overall >= 70 THEN 'B' WHEN overall >= 60 THEN 'C' ELSE 'Needs Improvement' END AS grade, overall >= 70 AS is_ats_friendly FROM qo)"""


@query("qlt_subscores", f"WITH {_SUBSCORES} SELECT doc_id, {', '.join(Q.WEIGHTS)} FROM qz")
def qlt_subscores(s, d):
    return _analysed(s, d).select("doc_id", *Q.WEIGHTS)


@query("qlt_overall", f"WITH {_SUBSCORES} SELECT * FROM qg")
def qlt_overall(s, d):
    return _analysed(s, d).select("doc_id", "overall", "grade", "is_ats_friendly")


@query("qlt_issues")
def qlt_issues(s, d):
    return Q.issues(_analysed(s, d), "doc_id")


@query("ats_quality_refresh", f"""WITH {_SUBSCORES} SELECT doc_id, overall AS ats_score, '{{"lang":"' || lang || '","grade":"' || grade || '","score":"' || overall || '","is_ats_friendly":"' || is_ats_friendly || '"}}' AS health FROM qg JOIN documents USING (doc_id)""")
def ats_quality_refresh(s, d):
    stored = table(s, d, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("grade"), F.lit("?")).alias("m"))
    fresh = _analysed(s, d).select("doc_id", F.col("overall").alias("ats_score"), "grade", F.col("overall").cast("string").alias("score"), F.col("is_ats_friendly").cast("string").alias("friendly"))
    merged = F.map_concat(F.map_filter("m", lambda k, v: ~k.isin("grade", "score", "is_ats_friendly")), F.create_map(F.lit("grade"), F.col("grade"), F.lit("score"), F.col("score"), F.lit("is_ats_friendly"), F.col("friendly")))
    return stored.join(fresh, "doc_id").select("doc_id", "ats_score", F.to_json(merged).alias("health"))


# --- jobs and pairs ---

SKILLS = ["Python", "Java", "SQL", "Docker", "Kubernetes", "Machine Learning", "C++", "Node.js", "Go", "Data Analysis"]
SYNONYMS = [("golang", "Go"), ("py", "Python"), ("k8s", "Kubernetes"), ("nodejs", "Node.js")]
JOB_SKILLS = "Python, SQL, Kubernetes,"


def _jobs(s, d):
    """item_id, text, asked (skills as text; null for some), years (0 for some), config (weights; null for most)."""
    text = F.col("text")
    for a, b in PROFILE_WORDS:
        text = F.replace(text, F.lit(a), F.lit(b))
    own = F.create_map(F.lit("semantic"), F.lit(0.5), F.lit("skills"), F.lit(0.2), F.lit("projects"), F.lit(0.1), F.lit("experience"), F.lit(0.1), F.lit("education"), F.lit(0.1))
    return table(s, d, "benchmark").select("item_id", text.alias("text"), F.when(F.col("item_id") % 3 == 0, JOB_SKILLS).alias("asked"), (F.col("item_id") % 5).cast("int").alias("years"), F.when(F.col("item_id") % 4 == 1, own).alias("config"))


_JOB_TEXT = PROFILES[PROFILES.index("replace(") : PROFILES.rindex(" AS text")]
_JOBS = f"jobs AS (SELECT item_id, {_JOB_TEXT} AS text, CASE WHEN item_id % 3 = 0 THEN '{JOB_SKILLS}' END AS asked, (item_id % 5)::INT AS years, item_id % 4 = 1 AS own FROM benchmark)"


def _features(df, key: str):
    """What a profile or a job brings into a match, once per row; texts aren't joined."""
    t = F.col("text")
    parts = X.sections(t)
    out = df.withColumn("parts", parts).withColumn("skills", S.found(t, SKILLS, SYNONYMS))
    work = F.concat(F.coalesce(F.col("parts")["experience"], F.lit("")), F.lit(" "), F.coalesce(F.col("parts")["projects"], F.lit("")))
    project = F.coalesce(F.col("parts")["projects"], F.lit(""))
    vector = lambda x: F.when(C.strip(x) != "", C.hash_embedding(x))
    return out.select(
        F.col(key), F.col("skills").alias(f"{key}_skills"), C.hash_embedding(t).alias(f"{key}_vector"), C.years_mentioned(t).alias(f"{key}_years"), (C.strip(F.coalesce(t, F.lit(""))) == "").alias(f"{key}_blank"),
        F.when(project != "", C.hash_embedding(project)).alias(f"{key}_project"), vector(work).alias(f"{key}_work"), F.lower(F.coalesce(F.col("parts")["education"], F.lit(""))).alias(f"{key}_education"), F.lower(F.coalesce(t, F.lit(""))).rlike("|".join(f"\\Q{w}\\E" for w in [*M.DEGREES, "mba", "diploma"])).alias(f"{key}_degree"),
        F.lower(F.coalesce(t, F.lit(""))).rlike("responsibilities|duties|you will|role involves|responsible for").alias(f"{key}_duties"), C.word_count(t).alias(f"{key}_words"),
    )


def _matched(s, d, links):
    """Features of the linked profiles and jobs; links: doc_id, item_id."""
    jobs = _jobs(s, d)
    jobs = _features(jobs, "item_id").join(jobs.select("item_id", "asked", F.col("years").alias("need"), "config"), "item_id")
    p = links.join(_features(profiles(s, d), "doc_id"), "doc_id").join(jobs, "item_id").withColumn("needed", F.sort_array(F.array_union("item_id_skills", C.csv_items(F.col("asked")))))
    matched, missing = M.skill_overlap(F.col("doc_id_skills"), F.col("needed"))
    semantic = F.round(C.cosine(F.col("doc_id_vector"), F.col("item_id_vector")), 9)
    p = p.withColumns({"matched": matched, "missing": missing, "semantic": semantic, "have": F.col("doc_id_years")})
    own = F.when(F.col("doc_id_project").isNotNull(), F.round(C.cosine(F.col("doc_id_project"), F.col("item_id_vector")), 9))
    return p.withColumns({"projects": M.projects(own, F.col("semantic")), "experience": M.experience(F.col("have"), F.col("need")), "education": M.education(F.col("doc_id_education")), "blank": F.col("doc_id_blank") | F.col("item_id_blank")})


def _links(s, d, more: int = 0):
    """(doc_id, item_id): each document's job by number, and up to `more` of its successors."""
    last = table(s, d, "benchmark").agg(F.max("item_id").alias("last"))
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.pmod("doc_id", F.lit(1 + more)).cast("long")))
    return table(s, d, "documents").crossJoin(F.broadcast(last)).select("doc_id", "last", steps.alias("k")).select("doc_id", F.pmod(F.col("doc_id") + F.col("k"), F.col("last") + 1).alias("item_id"))  # one row on the right


def _pairs(s, d):
    return _matched(s, d, _links(s, d))


def _vector_sql(t: str) -> str:
    return f"list_transform(({W.format(t=f'lower({t})')})[1:768], lambda x: (list_sum(list_transform(string_split(x, ''), lambda c: unicode(c)))::BIGINT % 100) / 100.0)"


def _skill_sql(t: str) -> str:
    toks = rf"chr(1) || array_to_string(list_transform(regexp_extract_all(lower({t}), '[^\s,;:()\[\]!?\"'']+'), lambda x: regexp_replace(x, '[.]+$', '')), chr(1)) || chr(1)"
    exact = ", ".join(f"CASE WHEN contains(k, chr(1) || '{x.lower().replace(' ', chr(39) + ' || chr(1) || ' + chr(39))}' || chr(1)) THEN '{x}' END" for x in SKILLS)
    other = ", ".join(f"CASE WHEN list_contains(y, '{a}') THEN '{b}' END" for a, b in SYNONYMS)
    return f"list_sort(list_distinct(list_filter([{exact}, {other}], lambda x: x IS NOT NULL)))", toks


def _side(name: str, source: str, key: str) -> str:
    skills, toks = _skill_sql("text")
    segments = f"{name}l AS (SELECT {key}, unnest(l) AS l, generate_subscripts(l, 1) AS pos FROM (SELECT {key}, string_split(text, chr(10)) AS l FROM {source})), {name}h AS (SELECT *, {_HEADS} AS head FROM {name}l), {name}g AS (SELECT *, count(head) OVER (PARTITION BY {key} ORDER BY pos) AS seg FROM {name}h), {name}n AS (SELECT {key}, seg, coalesce(max(head), 'general') AS section, string_agg(l, chr(10) ORDER BY pos) FILTER (head IS NULL) AS body FROM {name}g GROUP BY {key}, seg), {name}b AS (SELECT {key}, section, {STRIP.format(t='body')} AS body FROM {name}n WHERE body IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key}, section ORDER BY seg DESC) = 1), {name}p AS (SELECT {key}, max(body) FILTER (section = 'projects') AS project, max(body) FILTER (section = 'education') AS edu, max(body) FILTER (section = 'experience') AS work FROM {name}b GROUP BY {key})"
    years = r"coalesce(list_max(list_transform(regexp_extract_all(lower(text), '(\d+(?:\.\d+)?)\+?\s*(?:years?|yrs?)', 1), lambda x: x::DOUBLE)), 0.0)"
    return f"""{segments}, {name}t AS (SELECT *, {toks} AS k, regexp_extract_all(lower(text), '[a-zA-Z0-9.+#]+') AS y FROM {source}),
 {name}f AS (SELECT {name}t.*, {skills} AS skills, {_vector_sql('text')} AS v, {years} AS yrs, CASE WHEN coalesce(project, '') <> '' THEN {_vector_sql('project')} END AS pv, lower(coalesce(edu, '')) AS edu FROM {name}t LEFT JOIN {name}p USING ({key}))"""


_HEADS = "CASE " + " ".join(f"WHEN regexp_matches({STRIP.format(t='lower(l)')}, '^(?:{w})|(?:{w}):') THEN '{n}'" for n, w in ((n, "|".join(ws)) for n, ws in X.SECTIONS.items())) + " END"
_COS = "coalesce(round(greatest(0, least(1, list_sum(list_transform(list_zip({a}[1:least(len({a}), len({b}))], {b}[1:least(len({a}), len({b}))]), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / nullif(sqrt(list_sum(list_transform({a}, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda z: z::DOUBLE * z::DOUBLE))), 0))), 9), 0)"
_DEG = "|".join(w.replace(".", r"\.") for w in M.DEGREES)
_W = M.WEIGHTS
_PAIRS = f"""{PROFILES}, {_JOBS}, {_side('d', 'profiles', 'doc_id')}, {_side('j', 'jobs', 'item_id')},
 pj AS (SELECT df.doc_id, jf.item_id, df.skills AS mine, list_sort(list_distinct(list_concat(jf.skills, list_filter(list_transform(string_split(coalesce(asked, ''), ','), lambda x: trim(x)), lambda x: x <> '')))) AS needed, df.v AS dv, jf.v AS jv, df.pv AS pv, df.yrs AS have, years AS need, df.edu AS edu, own FROM df JOIN jf ON jf.item_id = df.doc_id % ((SELECT max(item_id) FROM benchmark) + 1)),
 pq AS (SELECT *, list_sort(list_intersect(mine, needed)) AS matched, list_sort(list_filter(needed, lambda x: NOT list_contains(mine, x))) AS missing, {_COS.format(a='dv', b='jv')} AS semantic, CASE WHEN pv IS NOT NULL THEN {_COS.format(a='pv', b='jv')} END AS psim FROM pj),
 ps AS (SELECT *, coalesce(psim, 0.8 * semantic) AS projects, CASE WHEN need <= 0 THEN 1.0 ELSE least(1.0, have / need) END AS experience, CASE WHEN regexp_matches(edu, '{_DEG}') THEN 1.0 ELSE 0.75 END AS education, CASE WHEN len(needed) = 0 THEN 0 ELSE len(matched) / len(needed) END AS skills FROM pq),
 pr AS (SELECT *, CASE WHEN len(needed) = 0 THEN 0.55 * semantic + 0.25 * projects + 0.10 * experience + 0.10 * education WHEN own THEN 0.5 * semantic + 0.2 * skills + 0.1 * projects + 0.1 * experience + 0.1 * education ELSE 0.25 * semantic + 0.40 * skills + 0.15 * projects + 0.10 * experience + 0.10 * education END AS raw FROM ps),
 pc AS (SELECT *, least(0.98, greatest(0.10, 1 / (1 + exp(-8 * (raw - 0.35))))) AS calibrated FROM pr), pf AS (SELECT *, round_even(calibrated, 3) AS final FROM pc)"""


def _scored(s, d):
    return M.score(_pairs(s, d), "config")


@query("mat_score", f"WITH {_PAIRS} SELECT doc_id, item_id, round(semantic, 6)::DOUBLE AS semantic, round(skills, 6)::DOUBLE AS skills, round(raw, 6)::DOUBLE AS raw, final::DOUBLE AS final, floor(calibrated * 100)::INT AS percent FROM pf")
def mat_score(s, d):
    return _scored(s, d).select("doc_id", "item_id", *(C.rounded(F.col(c), 6).alias(c) for c in ("semantic", "skills", "raw")), "final", "percent")


@query("mat_projects", f"WITH {_PAIRS} SELECT doc_id, round(projects, 6)::DOUBLE AS projects, psim IS NOT NULL AS own FROM ps")
def mat_projects(s, d):
    return _pairs(s, d).select("doc_id", C.rounded(F.col("projects"), 6).alias("projects"), F.col("doc_id_project").isNotNull().alias("own"))


@query("mat_experience", f"WITH {_PAIRS} SELECT doc_id, have::DOUBLE AS have, need, round(experience, 6)::DOUBLE AS experience FROM ps")
def mat_experience(s, d):
    return _pairs(s, d).select("doc_id", "have", "need", C.rounded(F.col("experience"), 6).alias("experience"))


@query("mat_education", f"WITH {_PAIRS} SELECT doc_id, education::DOUBLE AS education FROM ps")
def mat_education(s, d):
    return _pairs(s, d).select("doc_id", "education")


_PLURAL = "CASE WHEN len(matched) >= 6 THEN 'Excellent skill coverage: matches ' || len(matched) || ' required competencies including ' || array_to_string(matched[1:4], ', ') || '.' WHEN len(matched) >= 4 THEN 'Strong skill match: ' || array_to_string(matched[1:4], ', ') || '.' WHEN len(matched) > 0 THEN 'Matches key skills: ' || array_to_string(matched, ', ') || '.' END"
_EXPLAIN = f"""ex AS (SELECT *, format('{{:.1f}}', have::DOUBLE) AS h, need::VARCHAR AS n FROM pf),
 el AS (SELECT doc_id, calibrated, matched, missing, have, need, concat_ws(' ', {_PLURAL}, CASE WHEN semantic >= 0.8 THEN 'Very high contextual relevance — resume content closely aligns with role requirements.' WHEN semantic >= 0.7 THEN 'High semantic relevance to role requirements.' END, CASE WHEN need > 0 AND have >= need THEN 'Meets experience criteria (' || h || ' years detected vs ' || n || ' required).' END) AS strengths,
 concat_ws(' ', CASE WHEN semantic >= 0.7 THEN NULL WHEN semantic >= 0.5 THEN 'Moderate semantic alignment — consider tailoring resume language to match the job description more closely.' ELSE 'Low semantic alignment — resume may need significant restructuring to match the target role.' END, CASE WHEN need > 0 AND have < need THEN CASE WHEN have >= need * 0.7 THEN 'Experience is slightly below target (' || h || ' years vs ' || n || ' required). Consider highlighting project or freelance experience.' ELSE 'Experience gap: ' || h || ' years detected vs ' || n || ' required.' END END, CASE WHEN len(missing) > 5 THEN 'Significant skill gaps: missing ' || len(missing) || ' desired competencies including ' || array_to_string(missing[1:4], ', ') || '.' WHEN len(missing) > 0 THEN 'Missing desired competencies: ' || array_to_string(missing[1:4], ', ') || '.' END) AS improvements,
 concat_ws(' ', CASE WHEN need > 0 AND have < need * 0.7 THEN 'Gain experience through open-source contributions, freelance projects, or relevant certifications.' END, CASE WHEN len(missing) > 5 THEN 'Prioritize learning: ' || array_to_string(missing[1:3], ', ') || ' to improve match score.' WHEN len(missing) > 0 THEN 'Consider adding coursework or projects in: ' || array_to_string(missing[1:3], ', ') || '.' END, CASE WHEN calibrated < 0.5 THEN 'This role may not be the strongest fit. Consider roles that better align with your current skill set.' WHEN calibrated < 0.7 THEN 'Good potential — addressing the skill gaps identified above could significantly improve your match.' END) AS advice FROM ex)"""
_ELSE = "CASE WHEN {c} = '' THEN '{d}' ELSE {c} END AS {c}"


@query("mat_explain", f"WITH {_PAIRS}, {_EXPLAIN} SELECT doc_id, 'Candidate achieved a ' || floor(calibrated * 100)::INT || '% match. Matched ' || len(matched) || ' core skills with ' || len(missing) || ' skill gaps identified.' AS summary, {_ELSE.format(c='strengths', d='Basic role eligibility met.')}, {_ELSE.format(c='improvements', d='Profile closely aligns with the job profile.')}, {_ELSE.format(c='advice', d='Continue refining your resume for ATS optimization.')}, round_even(len(matched) / greatest(len(matched) + len(missing), 1), 2)::DOUBLE AS match_ratio, CASE WHEN need > 0 THEN have >= need ELSE true END AS meets_requirement FROM el")
def mat_explain(s, d):
    out = M.explain(_scored(s, d))
    return out.select("doc_id", "summary", F.array_join("strengths", " ").alias("strengths"), F.array_join("improvements", " ").alias("improvements"), F.array_join("advice", " ").alias("advice"), "match_ratio", "meets_requirement")


@query("mat_recommend", f"""WITH {_PAIRS} SELECT doc_id, concat_ws(' ', CASE WHEN len(missing) > 0 THEN 'Consider acquiring or highlighting experience in: ' || array_to_string(missing[1:5], ', ') || '.' END, CASE WHEN need > 0 AND have < need THEN format('Target role requests {{}} years; resume indicates approximately {{:.1f}} years.', need, have::DOUBLE) END, CASE WHEN len(needed) > 0 AND len(matched) = 0 THEN 'Align the technical terms in your experience sections directly with the target job keywords.' END) AS recommendations FROM ps""")
def mat_recommend(s, d):
    return M.recommend(_scored(s, d)).select("doc_id", F.array_join("recommendations", " ").alias("recommendations"))


# every application of a document: to the jobs of its number and of its successors, as many as its number says
_APPS = "ap AS (SELECT doc_id, (doc_id + unnest(range(0, 1 + doc_id % 3))) % ((SELECT max(item_id) FROM benchmark) + 1) AS item_id FROM documents)"


_SCREEN = _PAIRS.replace("FROM df JOIN jf ON jf.item_id = df.doc_id % ((SELECT max(item_id) FROM benchmark) + 1)", "FROM ap JOIN df USING (doc_id) JOIN jf ON jf.item_id = ap.item_id")


@query("mat_batch_screen", f"WITH {_APPS}, {_SCREEN} SELECT item_id, doc_id, final::DOUBLE AS final, final::DOUBLE AS score, round(semantic, 6)::DOUBLE AS semantic, len(matched)::INT AS n_matched, len(missing)::INT AS n_missing, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id)::INT AS rank FROM pf")
def mat_batch_screen(s, d):
    # every application has a score of nothing yet, and those of even documents an old result
    links = tables.stored(_links(s, d, 2), "links")
    key = ["item_id", "doc_id"]
    applications = KeyedTable(s, tables.new_path(s, "applications"), "item_id long, doc_id long, stage string, score double", key)
    results = KeyedTable(s, tables.new_path(s, "results"), "item_id long, doc_id long, final double, semantic double, skills double, matched array<string>, missing array<string>", key)
    applications.merge(links.select("item_id", "doc_id", F.lit("applied").alias("stage")))
    results.merge(links.where("doc_id % 2 = 0").select("item_id", "doc_id", F.lit(0.0).alias("final")))
    scored = M.score(_matched(s, d, links), "config")
    M.screen(applications, results, scored, 0)
    M.screen(applications, results, scored.limit(0), 0)  # delivered again
    done = M.rank(results.read(), "item_id", "final", "doc_id").join(applications.read(), key)
    return done.select("item_id", "doc_id", "final", "score", C.rounded(F.col("semantic"), 6).alias("semantic"), F.size("matched").alias("n_matched"), F.size("missing").alias("n_missing"), "rank")


_SIGNALS = " + ".join("regexp_matches(lower(text), '" + "|".join(w.replace(".", r"\.") for w in ws) + "')::INT" for ws in M.SIGNALS.values())


@query("jdm_sufficiency", f"WITH {_JOBS}, {_side('j', 'jobs', 'item_id')}, r AS (SELECT item_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN len({W.format(t='text')}) < 12 AND asked IS NULL THEN 'short' WHEN len({W.format(t='text')}) < 25 AND (len(skills) > 0 OR asked IS NOT NULL)::INT + {_SIGNALS} < 2 THEN 'few signals' END AS reason FROM jf) SELECT item_id, reason IS NULL AS sufficient, reason FROM r")
def jdm_sufficiency(s, d):
    ok, why = M.sufficiency(F.col("text"), S.found(F.col("text"), SKILLS, SYNONYMS), C.csv_items(F.col("asked")))
    return _jobs(s, d).select("item_id", ok.alias("sufficient"), why.alias("reason"))


def _dims(s, d):
    """Dimensions of a match; a job without figures, degrees or duties gives none of them."""
    p = _pairs(s, d)
    stretched = lambda x: F.bround(100 * C.clamp((x - 0.10) / 0.75, 0.05, 0.98), 0)
    duties = F.when(F.col("doc_id_work").isNotNull(), stretched(F.round(C.cosine(F.col("doc_id_work"), F.col("item_id_vector")), 9))).otherwise(stretched(F.col("semantic")))
    p = p.withColumn("cosine", F.col("semantic")).withColumn("need", F.col("item_id_years")).withColumn("degree", F.when(F.col("item_id_degree"), F.col("doc_id_degree"))).withColumn("duties", F.when(F.col("item_id_duties") | (F.col("item_id_words") >= 30), duties))
    return M.dimensions(p)


_WORKV = _vector_sql("coalesce(dp.work, '') || ' ' || coalesce(dp.project, '')")
_DEG2 = _DEG + "|mba|diploma"
_STRETCH = "round_even(100 * least(0.98, greatest(0.05, ({x} - 0.10) / 0.75)), 0)"
_DIMS = f"""dw AS (SELECT df.doc_id, CASE WHEN len({_WORKV}) > 0 THEN {_WORKV} END AS wv, regexp_matches(lower(df.text), '{_DEG2}') AS deg FROM df LEFT JOIN dp USING (doc_id)),
 jq AS (SELECT item_id, yrs, regexp_matches(lower(text), '{_DEG2}') AS asks, regexp_matches(lower(text), 'responsibilities|duties|you will|role involves|responsible for') OR len({W.format(t='text')}) >= 30 AS duty FROM jf),
 jx AS (SELECT ps.*, yrs, asks, duty, deg, wv, CASE WHEN wv IS NOT NULL THEN {_COS.format(a='wv', b='jv')} END AS wsim FROM ps JOIN dw USING (doc_id) JOIN jq USING (item_id)),
 jd AS (SELECT doc_id, {_STRETCH.format(x='semantic')}::DOUBLE AS d_semantic, CASE WHEN len(needed) > 0 THEN round_even(100 * len(matched) / len(needed), 0) END::DOUBLE AS d_skills, CASE WHEN yrs > 0 THEN round_even(100 * least(1.0, have / yrs), 0) END::DOUBLE AS d_experience, CASE WHEN asks THEN CASE WHEN deg THEN 100.0 ELSE 40.0 END END::DOUBLE AS d_education, CASE WHEN duty THEN CASE WHEN wv IS NOT NULL THEN {_STRETCH.format(x='wsim')} ELSE {_STRETCH.format(x='semantic')} END END::DOUBLE AS d_responsibility FROM jx)"""


@query("jdm_dimensions", f"WITH {_PAIRS}, {_DIMS} SELECT * FROM jd")
def jdm_dimensions(s, d):
    return _dims(s, d).select("doc_id", *(f"d_{k}" for k in M.DIMENSIONS))


_NUM = " + ".join(f"{w} * coalesce(d_{k}, 0)" for k, w in M.DIMENSIONS.items())
_DEN = " + ".join(f"CASE WHEN d_{k} IS NOT NULL THEN {w} ELSE 0 END" for k, w in M.DIMENSIONS.items())
_APP = ", ".join(f"CASE WHEN d_{k} IS NOT NULL THEN '{k}' END" for k in M.DIMENSIONS)


@query("jdm_overall", f"WITH {_PAIRS}, {_DIMS} SELECT doc_id, round_even(round(({_NUM})::DOUBLE / ({_DEN})::DOUBLE, 6), 0)::DOUBLE AS overall, concat_ws(',', {_APP}) AS applicable FROM jd")
def jdm_overall(s, d):
    return M.overall(_dims(s, d)).select("doc_id", "overall", "applicable")


@query("ana_overall")
def ana_overall(s, d):
    _, _, general = Q.feedback()
    quality = _analysed(s, d).select("doc_id", F.col("overall").cast("double").alias("quality"), F.transform(Q.feedback()[0], lambda i: i["recommendation"]).alias("advice"), general.alias("general"))
    ok = _jobs(s, d).select("item_id", M.sufficiency(F.col("text"), S.found(F.col("text"), SKILLS, SYNONYMS), C.csv_items(F.col("asked")))[0].alias("sufficient"))
    o = M.overall(_dims(s, d)).select("doc_id", "item_id", "overall", F.col("missing").alias("missing_skills"), "d_experience", "d_responsibility", "d_education").join(ok, "item_id").join(quality, "doc_id")
    return o.select("doc_id", M.composite(F.col("overall"), F.col("quality"), F.col("sufficient") & F.col("overall").isNotNull()).alias("composite"), F.array_join(M.improvements(o), "\n").alias("suggestions"))


# --- roles ---

ROLES = [
    ("Software Engineer", "INFORMATION-TECHNOLOGY", ["Software Developer", "Programmer"], ["Python", "Java", "C++", "Algorithms", "Git", "Docker"]),
    ("Data Scientist", "INFORMATION-TECHNOLOGY", ["Predictive Modeler"], ["Python", "SQL", "Machine Learning", "Statistics"]),
    ("Machine Learning Engineer", "INFORMATION-TECHNOLOGY", ["ML Engineer"], ["Python", "Docker", "Machine Learning"]),
    ("Data Analyst", "INFORMATION-TECHNOLOGY", ["Reporting Analyst"], ["SQL", "Excel", "Data Analysis"]),
    ("DevOps Engineer", "INFORMATION-TECHNOLOGY", ["Platform Engineer"], ["Docker", "Kubernetes", "Git"]),
    ("General Manager", "BUSINESS", ["Operations Lead"], ["Lead", "Manage"]),
    ("Operations Manager", "BUSINESS", ["Site Manager"], ["Lead", "Manage", "Users"]),
    ("Teacher", "EDUCATION", ["Instructor"], ["Education", "Degree", "Science"]),
    ("Accountant", "FINANCE", ["Bookkeeper"], []),
]
_FIELDS, _JOBS_OF_FIELD = ["Cloud", "Network", "Security", "Web", "Research", "Systems", "Product"], ["Engineer", "Analyst", "Architect", "Consultant", "Tester", "Trainer", "Lead"]
#: 58 roles in all.
ROLES += [(f"{f} {j}", ["INFORMATION-TECHNOLOGY", "BUSINESS", "EDUCATION", "FINANCE"][(i + k) % 4], [f"{j} of {f} Services"], [["Python", "SQL", "Docker", "Java"][i % 4], ["Users", "Lead", "Manage"][k % 3], f]) for i, f in enumerate(_FIELDS) for k, j in enumerate(_JOBS_OF_FIELD)]
CLASSES = {"en": "information-technology", "fr": "Business", "de": "EDUCATION", "es": "finance"}


def _roles(s, d):
    held, whole = M.role_terms(F.col("text"), ROLES)
    return profiles(s, d).withColumn("held", held).withColumn("whole", whole)


def _cls():
    return F.element_at(F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv)), F.col("lang"))


def _terms(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w.lower()}'" for w in words) + "]::VARCHAR[]"


_CATALOGUE = "ro AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{c}', {_terms(a)}, {_terms(k)})" for i, (n, c, a, k) in enumerate(ROLES)) + ") v(ord, name, class, aliases, skills))"
_NAMES = sorted({t.lower() for n, _, a, _ in ROLES for t in [n, *a]})
_EVERY = sorted({*_NAMES, *(t.lower() for *_, k in ROLES for t in k)})


def _whole_sql(term: str) -> str:
    """A whole word: no word character of Unicode on either side, or one after a term that ends with a mark; RE2 has no such boundary."""
    after = r"(?:$|[^\p{L}\p{N}_])" if term[-1].isalnum() else r"[\p{L}\p{N}_]"
    return f"CASE WHEN regexp_matches(low, '(?:^|[^\\p{{L}}\\p{{N}}_])\\Q{term}\\E{after}') THEN '{term}' END".replace("\\\\", "\\")


_SOME = lambda items: "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
_RS = f"""{PROFILES}, {_CATALOGUE}, lx AS (SELECT doc_id, lang, text, lower(text) AS low FROM profiles),
 lw AS (SELECT doc_id, lang, text, {_SOME(f"CASE WHEN contains(low, '{t}') THEN '{t}' END" for t in _NAMES)} AS held, {_SOME(map(_whole_sql, _EVERY))} AS whole FROM lx),
 rh AS (SELECT doc_id, lang, text, ord, name, class, list_contains(held, lower(name)) AS named, len(list_filter(aliases, lambda a: list_contains(held, a))) AS aka, list_contains(whole, lower(name)) AS wnamed, len(list_filter(aliases, lambda a: list_contains(whole, a))) AS waka, list_filter(skills, lambda k: list_contains(whole, k)) AS hit, len(skills) AS n FROM lw, ro),
 rs AS (SELECT *, round(CASE WHEN named THEN 3.5 ELSE 0 END + 2.5 * aka + 1.2 * len(hit) + CASE WHEN n > 0 THEN 3.0 * len(hit) / n ELSE 0 END, 6)::DOUBLE AS score FROM rh)"""
_CONF = "least(0.96, round_even(0.55 + least({s}, 8.0) / 8.0 * 0.40, 2))::DOUBLE"


@query("rol_score", f"WITH {_RS} SELECT doc_id, ord, name, len(hit)::INT AS hits, score FROM rs")
def rol_score(s, d):
    scored = _roles(s, d).select("doc_id", F.inline(M.score_roles(F.col("held"), F.col("whole"), ROLES)))
    return scored.select("doc_id", "ord", "name", "hits", "score")


@query("rol_suggest", f"""WITH {_RS}, {_side('d', 'profiles', 'doc_id')}, mine AS (SELECT doc_id, list_transform(skills, lambda x: lower(x)) AS mine FROM df),
 rw AS (SELECT rh.doc_id, ord, name, text, wnamed, waka, n, list_filter(ro.skills, lambda k: list_contains(hit, k) OR list_contains(mine, k)) AS got FROM rh JOIN mine USING (doc_id) JOIN ro USING (ord, name) WHERE NOT starts_with(lower(name), 'general ')),
 rr AS (SELECT *, CASE WHEN wnamed THEN 35 ELSE 0 END + CASE WHEN waka > 0 THEN 20 ELSE 0 END + 8.0 * len(got) + CASE WHEN n > 0 THEN 35.0 * len(got) / n ELSE 0 END AS raw FROM rw),
 rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, ord)::INT AS rank FROM rr)
 SELECT doc_id, rank, name AS role, CASE WHEN raw > 0 THEN least(96, round_even(round(60 + least(raw, 60.0) / 60 * 36, 6), 0))::INT ELSE 55 END AS score, len(got[1:6])::INT AS n_skills FROM rk WHERE rank <= 3 AND trim(text) <> ''
 UNION ALL SELECT doc_id, rank, role, score, 0 FROM profiles, (VALUES (1, 'Software Engineer', 75), (2, 'Full Stack Developer', 72), (3, 'Data Analyst', 70)) v(rank, role, score) WHERE trim(coalesce(text, '')) = ''""")
def rol_suggest(s, d):
    best = M.suggest_roles(F.col("text"), F.col("whole"), F.col("mine"), ROLES, 3)
    rows = _roles(s, d).withColumn("mine", S.found(F.col("text"), SKILLS, SYNONYMS)).select("doc_id", F.posexplode(best).alias("p", "b"))
    return rows.select("doc_id", (F.col("p") + 1).alias("rank"), "b.role", "b.score", F.size("b.skills").alias("n_skills"))


_BEST = "SELECT doc_id, arg_max(name, (score, -ord)) AS name, max(score) AS score FROM {t} WHERE score > 0 GROUP BY doc_id"
_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v.upper()}'" for k, v in CLASSES.items()) + " END"


@query("rol_specific", f"""WITH {_RS}, own AS (SELECT * FROM rs WHERE class = {_CASE}), i AS ({_BEST.format(t='own')}), e AS ({_BEST.format(t='rs')}), fi AS (SELECT class, arg_min(name, ord) AS first FROM ro GROUP BY class),
 b AS (SELECT doc_id, lw.text, first, CASE WHEN coalesce(i.score, 0) < 2.0 AND coalesce(e.score, 0) >= 3.0 THEN e.name ELSE i.name END AS name, CASE WHEN coalesce(i.score, 0) < 2.0 AND coalesce(e.score, 0) >= 3.0 THEN e.score ELSE i.score END AS score FROM lw LEFT JOIN i USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN fi ON fi.class = {_CASE})
 SELECT doc_id, CASE WHEN text = '' THEN 'General Professional' ELSE coalesce(name, first, 'Software Engineer') END AS role, CASE WHEN text = '' THEN 0.0 WHEN name IS NOT NULL THEN {_CONF.format(s='score')} ELSE 0.5 END::DOUBLE AS confidence FROM b""")
def rol_specific(s, d):
    scores = M.score_roles(F.col("held"), F.col("whole"), ROLES)
    r = _roles(s, d).withColumn("scores", scores)
    return r.select("doc_id", M.specific_role(F.col("text"), _cls(), F.col("scores"), ROLES).alias("r")).select("doc_id", "r.*")


@query("rol_infer", f"WITH {_RS}, e AS ({_BEST.format(t='rs')}) SELECT doc_id, CASE WHEN score >= 1.0 THEN name ELSE 'Software Engineer' END AS role, CASE WHEN score >= 1.0 THEN {_CONF.format(s='score')} ELSE 0.5 END::DOUBLE AS confidence FROM profiles LEFT JOIN e USING (doc_id)")
def rol_infer(s, d):
    r = _roles(s, d).withColumn("scores", M.score_roles(F.col("held"), F.col("whole"), ROLES))
    return r.select("doc_id", M.infer_role(F.col("text"), F.col("scores")).alias("r")).select("doc_id", "r.*")
