"""Matching of documents with jobs, ranking, and role suggestion. Features are computed once per document and job, then joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import phrases, ranks, tables
from ..sources.keyed import KeyedTable

#: Weights of the parts of a match, and those without required skills.
WEIGHTS = {"semantic": 0.25, "skills": 0.40, "projects": 0.15, "experience": 0.10, "education": 0.10}
NO_SKILLS = {"semantic": 0.55, "skills": 0.0, "projects": 0.25, "experience": 0.10, "education": 0.10}
#: Weights of the nullable dimensions.
DIMENSIONS = {"semantic": 0.30, "skills": 0.35, "experience": 0.15, "education": 0.10, "responsibility": 0.10}


def skill_overlap(own: Column, needed: Column) -> tuple[Column, Column]:
    """matched and missing, sorted."""
    return F.sort_array(F.array_intersect(own, needed)), F.sort_array(F.array_except(needed, own))


def experience(have: Column, need: Column) -> Column:
    return F.when(F.coalesce(need, F.lit(0.0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), have / need))


#: Words of a degree in an education section.
DEGREES = ["bachelor", "master", "phd", "b.tech", "b.e", "m.tech", "degree", "bs", "ms"]


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def education(section: Column) -> Column:
    """section: the education section, null without one."""
    return F.when(_any(F.lower(F.coalesce(section, F.lit(""))), DEGREES), 1.0).otherwise(0.75)


def projects(section: Column, semantic: Column) -> Column:
    """The section's own similarity, else a share of the document's."""
    return F.coalesce(section, 0.8 * semantic)


def score(pairs: DataFrame, config: str | None = None) -> DataFrame:
    """pairs: semantic, projects, experience, education, matched, needed (arrays), blank. Adds skills, raw, calibrated, final, percent.

    config names a map of weights by part, which replaces the usual weights where it isn't null and skills are needed; a part that
    it lacks has its usual weight.
    """
    none = F.size("needed") == 0
    skills = F.when(none, 0.0).otherwise(F.least(F.lit(1.0), F.size("matched") / F.size("needed")))
    out = pairs.withColumn("skills", skills)
    raw = F.lit(0.0)
    for part, usual in WEIGHTS.items():
        own = F.coalesce(F.element_at(config, F.lit(part)), F.lit(usual)) if config else F.lit(usual)
        raw = raw + F.when(none, NO_SKILLS[part]).otherwise(own) * F.col(part)
    out = out.withColumn("raw", F.when(F.col("blank"), 0.0).otherwise(raw))
    out = out.withColumn("calibrated", F.when(F.col("blank"), 0.0).otherwise(C.clamp(C.sigmoid(F.col("raw")), 0.10, 0.98)))
    return out.withColumn("final", F.bround("calibrated", 3)).withColumn("percent", (F.col("calibrated") * 100).cast("int"))


def _list(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def _first(items: Column, n: int) -> Column:
    return F.array_join(F.slice(items, 1, n), ", ")


def _or(items: Column, default: str) -> Column:
    return F.when(F.size(items) == 0, F.array(F.lit(default))).otherwise(items)


def explain(scored: DataFrame) -> DataFrame:
    """Adds summary, strengths, improvements, advice, match_ratio and meets_requirement. scored: as from score(), with have and need."""
    c = F.col
    hits, gaps, have, need = F.size("matched"), F.size("missing"), C.one_decimal(c("have")), c("need").cast("int").cast("string")
    say = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    # fixed values: texts and thresholds
    strong = _list(
        F.when(hits >= 6, say("Excellent skill coverage: matches ", hits, " required competencies including ", _first(c("matched"), 4), "."))
        .when(hits >= 4, say("Strong skill match: ", _first(c("matched"), 4), "."))
        .when(hits > 0, say("Matches key skills: ", F.array_join("matched", ", "), ".")),
        F.when(c("semantic") >= 0.8, "Very high contextual relevance — resume content closely aligns with role requirements.").when(c("semantic") >= 0.7, "High semantic relevance to role requirements."),
        F.when((c("need") > 0) & (c("have") >= c("need")), say("Meets experience criteria (", have, " years detected vs ", need, " required).")),
    )
    near = c("have") >= c("need") * 0.7
    weak = _list(
        F.when(c("semantic") >= 0.7, None).when(c("semantic") >= 0.5, "Moderate semantic alignment — consider tailoring resume language to match the job description more closely.").otherwise("Low semantic alignment — resume may need significant restructuring to match the target role."),
        F.when((c("need") > 0) & (c("have") < c("need")), F.when(near, say("Experience is slightly below target (", have, " years vs ", need, " required). Consider highlighting project or freelance experience.")).otherwise(say("Experience gap: ", have, " years detected vs ", need, " required."))),
        F.when(gaps > 5, say("Significant skill gaps: missing ", gaps, " desired competencies including ", _first(c("missing"), 4), ".")).when(gaps > 0, say("Missing desired competencies: ", _first(c("missing"), 4), ".")),
    )
    advice = _list(
        F.when((c("need") > 0) & (c("have") < c("need")) & ~near, "Gain experience through open-source contributions, freelance projects, or relevant certifications."),
        F.when(gaps > 5, say("Prioritize learning: ", _first(c("missing"), 3), " to improve match score.")).when(gaps > 0, say("Consider adding coursework or projects in: ", _first(c("missing"), 3), ".")),
        F.when(c("calibrated") < 0.5, "This role may not be the strongest fit. Consider roles that better align with your current skill set.").when(c("calibrated") < 0.7, "Good potential — addressing the skill gaps identified above could significantly improve your match."),
    )
    return scored.withColumns(
        {
            "summary": say("Candidate achieved a ", c("percent"), "% match. Matched ", hits, " core skills with ", gaps, " skill gaps identified."),
            "strengths": _or(strong, "Basic role eligibility met."),
            "improvements": _or(weak, "Profile closely aligns with the job profile."),
            "advice": _or(advice, "Continue refining your resume for ATS optimization."),
            "match_ratio": F.bround(hits / F.greatest(hits + gaps, F.lit(1)), 2),
            "meets_requirement": F.when(c("need") > 0, c("have") >= c("need")).otherwise(True),
        }
    )


def recommend(scored: DataFrame, most: int = 5) -> DataFrame:
    """The first missing skills, the experience gap and advice without any match."""
    rest = _list(
        F.when(F.size("missing") > 0, F.concat(F.lit("Consider acquiring or highlighting experience in: "), _first(F.col("missing"), most), F.lit("."))),
        F.when((F.col("need") > 0) & (F.col("have") < F.col("need")), F.concat(F.format_string("Target role requests %d years; resume indicates approximately ", F.col("need").cast("int")), C.one_decimal(F.col("have")), F.lit(" years."))),
        F.when((F.size("needed") > 0) & (F.size("matched") == 0), "Align the technical terms in your experience sections directly with the target job keywords."),
    )
    return scored.withColumn("recommendations", rest)


#: Words that signal a role, duties, experience and education in a job's text.
SIGNALS = {
    "role": "developer engineer analyst manager specialist consultant lead architect executive associate administrator designer coordinator officer intern scientist accountant director technician programmer".split(),
    "duties": "responsibilities duties develop building build create analyze manage maintain collaborate coordinate lead design implement oversee execute handle support deliver architect deploy optimize test writing".split(),
    "experience": ["year", "years", "yrs", "experience", "exp", "fresher", "freshers", "entry level", "entry-level", "senior", "junior"],
    "education": ["bachelor", "master", "phd", "b.tech", "b.e", "m.tech", "degree", "bs", "ms", "mba", "diploma", "graduate"],
}


def sufficiency(text: Column, found: Column, asked: Column) -> tuple[Column, Column]:
    """Whether a job text says enough, and why not. found: skills found in the text; asked: the job's own list of skills."""
    low = F.lower(F.coalesce(text, F.lit("")))
    signals = ((F.size(found) > 0) | (F.size(asked) > 0)).cast("int")
    for words in SIGNALS.values():
        signals = signals + _any(low, words).cast("int")
    n = C.word_count(text)
    reason = F.when(C.strip(low) == "", "blank").when((n < 12) & (F.size(asked) == 0), "short").when((n < 25) & (signals < 2), "few signals")
    return reason.isNull(), reason


def dimensions(pairs: DataFrame) -> DataFrame:
    """Percentages; null where the job gives no signal. pairs: cosine, matched, needed, have, need, degree (null: not asked), duties."""
    return pairs.select("*", F.bround(100 * C.clamp((F.col("cosine") - 0.10) / 0.75, 0.05, 0.98), 0).alias("d_semantic"), F.when(F.size("needed") > 0, F.bround(100.0 * F.size("matched") / F.size("needed"), 0)).alias("d_skills"), F.when(F.col("need") > 0, F.bround(100 * F.least(F.lit(1.0), F.col("have") / F.col("need")), 0)).alias("d_experience"), F.when(F.col("degree").isNotNull(), F.when(F.col("degree"), 100.0).otherwise(40.0)).alias("d_education"), F.col("duties").alias("d_responsibility"))


def overall(dims: DataFrame) -> DataFrame:
    """Weights re-normalised over the dimensions that are there, as a whole number; null if none is."""
    num, den = F.lit(0.0), F.lit(0.0)
    for d, w in DIMENSIONS.items():
        num, den = num + w * F.coalesce(f"d_{d}", F.lit(0.0)), den + F.when(F.col(f"d_{d}").isNotNull(), w).otherwise(0.0)
    names = F.array_compact(F.array(*(F.when(F.col(f"d_{d}").isNotNull(), F.lit(d)) for d in DIMENSIONS)))
    return dims.withColumn("overall", F.when(den > 0, F.bround(F.round(num / den, 6), 0))).withColumn("applicable", F.array_join(names, ","))


def composite(match: Column, quality: Column, sufficient: Column) -> Column:
    return F.round(F.when(sufficient, 0.7 * match + 0.3 * quality).otherwise(quality), 1)


def improvements(analysed: DataFrame) -> Column:
    """Suggestions in order, each once. analysed: sufficient, missing_skills, d_experience, d_responsibility, d_education, advice (of
    the issues, all of them) and general (taken while there are fewer than ten)."""
    c = F.col
    skills = F.transform(F.slice("missing_skills", 1, 4), lambda x: F.concat(F.lit("Add experience or projects demonstrating required skill: "), x))
    # fixed values: texts and thresholds
    of_match = _list(
        F.when(c("d_experience") < 70, "Highlight direct years of experience and leadership responsibilities aligned with the role expectations."),
        F.when(c("d_responsibility") < 75, "Align your bullet points with the core duties in the job description using industry action verbs."),
        F.when(c("d_education") < 70, "Clarify your relevant degree, certifications, or specialized coursework in your education section."),
    )
    none = F.array().cast("array<string>")
    first = F.array_distinct(F.concat(F.when(c("sufficient"), F.concat(skills, of_match)).otherwise(none), "advice"))
    more = F.slice(F.array_except("general", first), F.lit(1), F.greatest(F.lit(0), 10 - F.size(first)))
    both = F.concat(first, more)
    usual = ["Tailor your professional summary to mirror the primary objectives of the target role.", "Quantify achievements in work experience with metrics, percentages, or measurable impact.", "Ensure standard ATS section headers (Summary, Skills, Experience, Education) are clearly visible."]
    return F.when(F.size(both) == 0, F.array(*map(F.lit, usual))).otherwise(both)


def screen(applications: KeyedTable, results: KeyedTable, scored: DataFrame, number: int) -> None:
    """Puts a batch of scored applications in: each one's result is written or replaced whole, and `score` of the application set;
    scores of applications that aren't there are left out of it. Both tables take a batch once, so one that comes again, or again
    after it broke off between the two, changes nothing that was written.

    scored: the keys of both tables, `final`, and the columns of results.
    """
    scored = tables.stored(scored.select(*results.keys, *results.rest), "scored")
    results.merge(scored, writer="screen", number=number)
    applications.merge(scored.select(*applications.keys, F.col("final").alias("score")), writer="screen", number=number, matched_only=True)


def rank(results: DataFrame, group: str, value: str, key: str, least: float = 0.0) -> DataFrame:
    """Rows with a value from `least` on, with their rank in the group, the smaller key first on ties. A large group is ranked in several
    tasks."""
    return ranks.ranked(results.where(F.col(value) >= least), [group], [F.desc(value), key])


def rank_page(ranked: DataFrame, group: str, value: str, page: int = 1, per_page: int = 50) -> DataFrame:
    """A page of each group of rank()'s rows with the page's statistics; `total` and `pages` are those of the whole group. A group
    without rows on the page has none."""
    here = ranked.where(F.col("rank").between((page - 1) * per_page + 1, page * per_page))
    stats = {"avg_score": F.round(F.avg(value), 3), "max_score": F.round(F.max(value), 3), "min_score": F.round(F.min(value), 3), "above_80": F.count_if(F.col(value) >= 0.80)}
    shown = here.groupBy(group).agg(*(c.alias(n) for n, c in stats.items()))
    total = ranked.groupBy(group).agg(F.max("rank").alias("total"))
    return here.join(total, group).join(shown, group).withColumn("pages", F.ceil(F.col("total") / per_page).cast("int"))


def tier(value: Column) -> Column:
    return F.when(value >= 0.90, "excellent").when(value >= 0.75, "strong").when(value >= 0.60, "moderate").when(value >= 0.40, "below_average").otherwise("poor")


# --- roles: a catalogue is a list of (name, class, aliases, skills); every role is scored in one projection, without a join ---

Role = tuple[str, str, list[str], list[str]]
#: What an empty document is offered, and the role of a text that fits none.
DEFAULT_ROLES, DEFAULT_ROLE = [("Software Engineer", 75), ("Full Stack Developer", 72), ("Data Analyst", 70)], "Software Engineer"


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def role_terms(text: Column, roles: list[Role]) -> tuple[Column, Column]:
    """The catalogue's terms that a text holds: names and aliases anywhere, and names, aliases and skills as whole words. One pass over
    the text finds all."""
    names = sorted({t.lower() for n, _, aliases, _ in roles for t in [n, *aliases]})
    every = names + sorted({t.lower() for *_, skills in roles for t in skills} - set(names))
    hits = phrases.found(F.lower(F.coalesce(text, F.lit(""))), every)
    terms = _strings(every)
    named = lambda places: F.transform(places, lambda k: F.get(terms, k))
    return named(F.filter(hits["held"], lambda k: k < len(names))), named(hits["whole"])


def _catalogue(roles: list[Role]) -> Column:
    """The roles as one constant, so a plan doesn't grow with them."""
    row = lambda i, r: F.struct(F.lit(i).alias("ord"), F.lit(r[0]).alias("name"), F.lit(r[0].lower()).alias("low"), F.lit(r[1]).alias("class"), _strings(r[2]).alias("aliases"), _strings(r[3]).alias("skills"))
    return F.array(*(row(i, r) for i, r in enumerate(roles)))


def _in_order(terms: Column, there: Column) -> Column:
    return F.filter(terms, lambda t: F.array_contains(there, F.lower(t)))


def _share(part: Column, whole: Column, points: float) -> Column:
    return F.when(whole > 0, points * part / whole).otherwise(0.0)


def score_roles(held: Column, whole: Column, roles: list[Role]) -> Column:
    """An array of (ord, name, class, hits, score) for all roles, from role_terms(): 3.5 for the name, 2.5 for each alias, 1.2 for each
    skill and 3.0 for the share of skills."""

    def scored(r: Column) -> Column:
        def of(hits: Column) -> Column:
            points = F.when(F.array_contains(held, r["low"]), 3.5).otherwise(0.0) + 2.5 * F.size(_in_order(r["aliases"], held)) + 1.2 * hits + _share(hits, F.size(r["skills"]), 3.0)
            return F.struct(r["ord"].alias("ord"), r["name"].alias("name"), r["class"].alias("class"), hits.alias("hits"), F.round(points, 6).alias("score"))

        return C.let(F.size(_in_order(r["skills"], whole)), of)

    return F.transform(_catalogue(roles), scored)


def best_role(scores: Column) -> Column:
    """The (name, score) of the highest score above 0, the earliest on ties; null without one."""
    kind = "struct<name:string,score:double>"
    return F.aggregate(scores, F.lit(None).cast(kind), lambda b, x: F.when(x["score"] > F.coalesce(b["score"], F.lit(0.0)), F.struct(x["name"].alias("name"), x["score"].alias("score")).cast(kind)).otherwise(b))


def _confidence(score: Column) -> Column:
    return F.least(F.lit(0.96), F.bround(0.55 + F.least(score, F.lit(8.0)) / 8.0 * 0.40, 2))


def infer_role(text: Column, scores: Column, least: float = 1.0) -> Column:
    """(role, confidence): the best of all roles from `least` on, else the default."""
    best = best_role(scores)
    sure = best.isNotNull() & (best["score"] >= least)
    return F.struct(F.when(sure, best["name"]).otherwise(DEFAULT_ROLE).alias("role"), F.when(sure, _confidence(best["score"])).otherwise(0.50).alias("confidence"))


def specific_role(text: Column, cls: Column, scores: Column, roles: list[Role], enough: float = 2.0, other: float = 3.0) -> Column:
    """(role, confidence): the best role of the class; below `enough` the best of all classes if it has `other`; else the class's first
    role, else the default. A blank text or class is a General Professional."""
    own_class = F.upper(C.strip(cls))
    inside, every = best_role(F.filter(scores, lambda x: x["class"] == own_class)), best_role(scores)
    weak = F.coalesce(inside["score"], F.lit(0.0)) < enough
    best = F.when(weak & (F.coalesce(every["score"], F.lit(0.0)) >= other), every).otherwise(inside)
    first = F.get(F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("class")) for n, c, *_ in roles)), lambda x: x["class"] == own_class), 0)["name"]
    none = (F.coalesce(text, F.lit("")) == "") | (F.coalesce(cls, F.lit("")) == "")
    role = F.when(none, "General Professional").otherwise(F.coalesce(best["name"], first, F.lit(DEFAULT_ROLE)))
    return F.struct(role.alias("role"), F.when(none, 0.0).when(best.isNotNull(), _confidence(best["score"])).otherwise(0.50).alias("confidence"))


def suggest_roles(text: Column, whole: Column, own_skills: Column, roles: list[Role], k: int = 5) -> Column:
    """The k best roles (role, score, skills): 35 for the name, 20 for an alias, 8 for each skill and 35 for the share of skills, as a
    percentage from 55 to 96; catalogue order on ties. own_skills: the skills found in the text. Names that begin with `general ` are
    left out; blank texts get defaults."""
    kind = "array<struct<role:string,score:int,skills:array<string>>>"

    def judged(have: Column) -> Column:
        def points(r: Column) -> Column:
            def of(hits: Column) -> Column:
                raw = F.when(F.array_contains(whole, r["low"]), 35.0).otherwise(0.0) + F.when(F.size(_in_order(r["aliases"], whole)) > 0, 20.0).otherwise(0.0) + 8.0 * F.size(hits) + _share(F.size(hits), F.size(r["skills"]), 35.0)
                return F.struct((-raw).alias("order"), r["ord"].alias("ord"), r["name"].alias("role"), F.slice(hits, 1, 6).alias("skills"))

            return C.let(_in_order(r["skills"], have), of)

        return F.slice(F.array_sort(F.transform(F.filter(_catalogue(roles), lambda r: ~r["low"].startswith("general ")), points)), 1, k)

    percent = lambda x: F.when(x["order"] < 0, F.least(F.lit(96), F.bround(F.round(60 + F.least(-x["order"], F.lit(60.0)) / 60.0 * 36, 6), 0).cast("int"))).otherwise(55)
    have = C.let(F.array_union(whole, F.transform(own_skills, lambda x: F.lower(x))), judged)
    best = F.transform(have, lambda x: F.struct(x["role"].alias("role"), percent(x).alias("score"), x["skills"].alias("skills"))).cast(kind)
    usual = F.array(*(F.struct(F.lit(n).alias("role"), F.lit(v).alias("score"), F.array().cast("array<string>").alias("skills")) for n, v in DEFAULT_ROLES)).cast(kind)
    return F.when(C.strip(F.coalesce(text, F.lit(""))) == "", usual).otherwise(best)
