"""Relational queries and writes of a hiring pipeline.

Frames: jobs (job_id, recruiter_id, org_id, title, status, created), applications (app_id, job_id, candidate_id, stage, score,
created), candidates (candidate_id, name), recruiters (recruiter_id, org_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ranks

STAGES = ["applied", "screening", "shortlisted", "interview", "offer", "hired"]
ADVANCED = ["shortlisted", "interview", "technical", "final", "offer", "hired"]


def overview(jobs: DataFrame, applications: DataFrame, candidates: DataFrame) -> DataFrame:
    """Four totals; each side is one row."""
    j = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "active").alias("active_jobs"))
    return j.crossJoin(applications.agg(F.count(F.lit(1)).alias("applications"))).crossJoin(candidates.agg(F.count(F.lit(1)).alias("candidates")))


def recruiter_overview(jobs: DataFrame, applications: DataFrame, org, tenant_only: bool = False) -> DataFrame:
    """Job counts of an organisation and application counts, of the organisation too if tenant_only."""
    own = jobs.where(F.col("org_id") == org)
    apps = applications.join(own.select("job_id"), "job_id", "left_semi") if tenant_only else applications
    j = own.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "active").alias("active_jobs"))
    return j.crossJoin(apps.agg(F.count(F.lit(1)).alias("applications"), F.count_if(F.col("stage").isin(ADVANCED)).alias("shortlisted"), F.count_if(F.col("stage") == "hired").alias("hired")))


def funnel(applications: DataFrame, stages: DataFrame) -> DataFrame:
    """Counts per named stage, zeros kept. stages: ord, stage."""
    n = applications.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return stages.join(n, "stage", "left").select("ord", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def score_histogram(applications: DataFrame) -> DataFrame:
    s = F.coalesce("score", F.lit(0.0))
    bucket = F.when(s >= 0.90, "excellent").when(s >= 0.75, "good").when(s >= 0.60, "fair").otherwise("low")
    return applications.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def stage_counts(applications: DataFrame) -> DataFrame:
    return applications.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def dashboard_counts(applications: DataFrame) -> DataFrame:
    return applications.agg(F.count_if(F.col("stage").isin("shortlisted", "interview")).alias("in_review"), F.count_if(F.col("stage").isin("hired", "offer")).alias("won"))


def public_jobs(jobs: DataFrame, org=None) -> DataFrame:
    out = jobs.where(F.col("status").isin("published", "active") & F.col("recruiter_id").isNotNull() & F.col("org_id").isNotNull())
    return (out if org is None else out.where(F.col("org_id") == org)).orderBy(F.desc("created"), "job_id")


def jobs_of(jobs: DataFrame, recruiter=None, org=None, status: str | None = None) -> DataFrame:
    for c, v in (("recruiter_id", recruiter), ("org_id", org), ("status", status)):
        if v is not None:
            jobs = jobs.where(F.col(c) == v)
    return jobs.orderBy(F.desc("created"), "job_id")


def search_jobs(jobs: DataFrame, text: str, fields: list[str], **equal: str) -> DataFrame:
    """Case-insensitive substring in any field and equality filters; `All` filters nothing."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(text.lower()))
    out = jobs.where(hit)
    for c, v in equal.items():
        out = out if v == "All" else out.where(F.col(c) == v)
    return out


def list_applications(applications: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Applications with the names of candidate and job where there are any, newest first."""
    out = applications.join(candidates.select("candidate_id", "name"), "candidate_id", "left").join(jobs.select("job_id", "title"), "job_id", "left")
    return out.select("app_id", F.coalesce("name", F.lit("Applicant")).alias("name"), "title", "stage", "score", "created").orderBy(F.desc("created"), "app_id")


def candidate_dashboard(applications: DataFrame, latest: int = 10) -> DataFrame:
    """Per candidate: totals, active ones, interviews, and the ids of the latest applications."""
    w = Window.partitionBy("candidate_id").orderBy(F.desc("created"), "app_id")
    ranked = applications.withColumn("r", F.row_number().over(w))
    newest = F.array_sort(F.collect_list(F.when(F.col("r") <= latest, F.struct("r", "app_id"))))
    return ranked.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("stage").isin("rejected", "hired")).alias("active"), F.count_if(F.col("stage") == "interview").alias("interviews"), F.array_join(F.transform(newest, lambda x: x["app_id"].cast("string")), ",").alias("latest"))


def candidate_search(candidates: DataFrame, applications: DataFrame, text: str = "", skill: str = "", limit: int = 200) -> DataFrame:
    """Candidates whose name, e-mail or role holds the text and one of whose skills holds `skill`, case-insensitively. Filters first, then
    the limit, in order of id; with the number of applications."""
    hit = F.lit(not text)
    for c in ("name", "email", "role"):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    able = F.exists(F.coalesce("skills", F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(skill.lower()))) if skill else F.lit(True)
    found = candidates.where(hit & able).orderBy("candidate_id").limit(limit)
    n = applications.join(found.select("candidate_id"), "candidate_id", "left_semi").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("applications"))
    return found.join(n, "candidate_id", "left").select("candidate_id", "name", "email", F.coalesce("applications", F.lit(0)).alias("applications"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """The rows of a page in order; the order should tell rows apart."""
    return ranks.page(df, order, number, size)


def orphan_jobs(jobs: DataFrame, recruiters: DataFrame, title: str = r"^Lead AI Engineer [0-9a-f]{8}$") -> DataFrame:
    """Jobs without a recruiter that exists, or with a generated title, and why."""
    known = recruiters.select("recruiter_id", F.lit(True).alias("known"))
    out = jobs.join(known, "recruiter_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("recruiter_id").isNull(), "no recruiter"), F.when(F.col("recruiter_id").isNotNull() & F.col("known").isNull(), "unknown recruiter"), F.when(F.col("title").rlike(title), "generated title")))
    return out.withColumn("reasons", F.array_join(reasons, "; ")).where("reasons <> ''").select("job_id", "reasons")


def remap(parents: DataFrame, children: DataFrame, old: str, foreign: str, salt: str) -> tuple[DataFrame, DataFrame]:
    """New keys from a hash of salt and old key; children of unknown parents go."""
    key = lambda c: F.sha2(F.concat(F.lit(f"{salt}:"), c.cast("string")), 256)
    new = parents.withColumn("new_id", key(F.col(old)))
    return new, children.join(new.select(F.col(old).alias(foreign), F.col("new_id").alias("new_parent")), foreign)


def migrate(users: DataFrame, existing: DataFrame, candidates: DataFrame, recruiters: DataFrame, jobs: DataFrame, applications: DataFrame) -> dict[str, DataFrame]:
    """Five tables with new keys. Users take the id of an existing user of the same e-mail, else a hash; candidates and recruiters need their
    user; jobs without a known recruiter go to the first one; applications need job and candidate, and go otherwise.

    Joins deal the old keys only, which are short; new ones are made of them at the end. Applications tell the new keys of their user and
    recruiter too, so no table need be joined by hashes.

    users, existing: user_id, email; candidates: candidate_id, user_id; recruiters: recruiter_id, user_id; jobs: job_id, recruiter_id;
    applications: app_id, job_id, candidate_id.
    """
    key = lambda name, c: F.sha2(F.concat(F.lit(f"{name}:"), F.col(c).cast("string")), 256)
    user = F.coalesce(F.col("old").cast("string"), key("user", "user_id"))
    known = existing.groupBy(F.lower("email").alias("email")).agg(F.min("user_id").alias("old"))
    u = users.join(known, F.lower(users["email"]) == known["email"], "left").select("user_id", "old")
    c = candidates.join(u, "user_id").select("candidate_id", "user_id", "old")
    r = recruiters.join(u, "user_id").select("recruiter_id", "user_id", "old")
    first = r.agg(F.min("recruiter_id").alias("first"))
    j = jobs.join(r.select("recruiter_id", F.col("recruiter_id").alias("own")), "recruiter_id", "left").crossJoin(F.broadcast(first))  # one row on the right
    j = j.select("job_id", F.coalesce("own", "first").alias("recruiter"))
    a = applications.select("app_id", "job_id", "candidate_id").join(j, "job_id").join(c, "candidate_id")
    new = {"new_job": key("job", "job_id"), "new_candidate": key("candidate", "candidate_id"), "new_user": user, "new_recruiter": key("recruiter", "recruiter")}
    return {
        "users": u.select("user_id", user.alias("new_user")),
        "candidates": c.select("candidate_id", *(new[k].alias(k) for k in ("new_candidate", "new_user"))),
        "recruiters": r.select("recruiter_id", key("recruiter", "recruiter_id").alias("new_recruiter"), user.alias("new_user")),
        "jobs": j.select("job_id", *(new[k].alias(k) for k in ("new_job", "new_recruiter"))),
        "applications": a.select("app_id", key("application", "app_id").alias("new_app"), *(x.alias(k) for k, x in new.items())),
    }


def apply_new(existing: DataFrame, wanted: DataFrame, score: float = 0.85) -> DataFrame:
    """Existing applications and those wanted ones whose (job, candidate) isn't there."""
    fresh = wanted.select("job_id", "candidate_id").distinct().join(existing, ["job_id", "candidate_id"], "left_anti")
    return existing.select("job_id", "candidate_id", "stage", "score").unionByName(fresh.select("job_id", "candidate_id", F.lit("applied").alias("stage"), F.lit(score).alias("score")))


def update_stage(applications: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest change of each application wins; stages are lower-cased. changes: app_id, new_stage, at."""
    last = changes.groupBy("app_id").agg(F.max_by(F.lower("new_stage"), F.struct("at", "new_stage")).alias("new_stage"))
    return applications.join(last, "app_id", "left").select("app_id", F.coalesce("new_stage", "stage").alias("stage"))


def versions(uploads: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """Versions by owner from 1; the last is current."""
    w = Window.partitionBy(owner).orderBy(*order)
    return uploads.withColumn("version", F.row_number().over(w)).withColumn("is_current", F.lead(order[0]).over(w).isNull())


def write_versions(existing: DataFrame, uploads: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """existing (owner, order columns, version, is_current) with the uploads of the same owners and others added: versions go on from the
    number of rows that an owner has, and only the last row of an owner with uploads stays current."""
    have = existing.groupBy(owner).agg(F.count(F.lit(1)).alias("_have"))
    fresh = versions(uploads, owner, order).join(have, owner, "left").withColumn("version", (F.coalesce("_have", F.lit(0)) + F.col("version")).cast("int"))
    gone = existing.join(uploads.select(owner).distinct().withColumn("_new", F.lit(True)), owner, "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull())
    columns = [owner, *(c for c in order if c != owner), "version", "is_current"]
    return gone.select(*columns).unionByName(fresh.select(*columns))


def patch(base: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Partial update: values that are there replace the old ones."""
    c = changes.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields))
    out = base.join(c, key, "left")
    return out.select(*(F.coalesce(f"_new_{x}", x).alias(x) if x in fields else F.col(x) for x in base.columns))


def patch_supplied(base: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Partial update by presence: of `fields`, those that a change names in its array `supplied` take its value, null included."""
    c = changes.select(key, F.col("supplied").alias("_supplied"), *(F.col(f).alias(f"_new_{f}") for f in fields))
    out = base.join(c, key, "left")
    return out.select(*(F.when(F.array_contains("_supplied", x), F.col(f"_new_{x}")).otherwise(F.col(x)).alias(x) if x in fields else F.col(x) for x in base.columns))


#: States in which a job can begin, and what a field has that wasn't given.
FIRST_STATES, JOB_DEFAULTS = ["draft", "published", "active"], {"required_skills": "", "experience_required": 0, "location": "Remote", "job_type": "Full-time", "salary": "", "department": ""}


def create_jobs(requests: DataFrame, users: DataFrame, recruiters: DataFrame, organizations: DataFrame, company: str, weights: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """New jobs and new recruiters. A user without a recruiter gets one, named by user name, e-mail or `Recruiter`; a user without
    an organisation takes the first one; a state that a job can't begin in, and null, becomes `published`; fields that are null or that
    requests don't have take their defaults, scoring weights too.

    requests: job_id, user_id, title, and any of status, company_name, scoring_config and the fields with defaults; users: user_id, username,
    email, org_id; recruiters: recruiter_id, user_id, company_name; organizations: org_id.
    """
    given = lambda c, kind: F.col(c) if c in requests.columns else F.lit(None).cast(kind)
    known = recruiters.groupBy("user_id").agg(F.min_by(F.struct("recruiter_id", "company_name"), "recruiter_id").alias("r"))
    first = organizations.agg(F.min("org_id").alias("first_org"))
    r = requests.select("*", given("company_name", "string").alias("_company")).join(users, "user_id", "left").join(known, "user_id", "left").crossJoin(F.broadcast(first))  # one row on the right
    made = F.sha2(F.concat(F.lit("recruiter:"), F.col("user_id").cast("string")), 256)
    name = F.coalesce(F.nullif("username", F.lit("")), F.nullif(F.split_part("email", F.lit("@"), F.lit(1)), F.lit("")), F.lit("Recruiter"))
    new = r.where("r is null").groupBy("user_id").agg(F.first(made).alias("recruiter_id"), F.first(name).alias("name"), F.coalesce(F.min_by("_company", F.struct("job_id")), F.lit(company)).alias("company_name"))
    r = r.join(new.select("user_id", F.col("company_name").alias("new_company")), "user_id", "left")
    state = F.when(F.col("status").isin(*FIRST_STATES), F.col("status")).otherwise("published") if "status" in requests.columns else F.lit("published")
    fields = [F.coalesce(given(c, "string" if isinstance(v, str) else "int"), F.lit(v)).alias(c) for c, v in JOB_DEFAULTS.items()]
    config = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    jobs = r.select("job_id", F.coalesce(F.col("r.recruiter_id").cast("string"), made).alias("recruiter_id"), F.coalesce("org_id", "first_org").alias("org_id"), "title", *fields, F.coalesce("_company", "r.company_name", "new_company").alias("company_name"), F.coalesce(given("scoring_config", "map<string,double>"), config).alias("scoring_config"), state.alias("status"))
    return jobs, new


def publish_jobs(jobs: DataFrame, requests: DataFrame, recruiters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs with those published that their recruiter, or a user who is none, asked for; and the refused requests. requests: job_id, user_id."""
    asked = requests.distinct().join(recruiters.groupBy("user_id").agg(F.min("recruiter_id").cast("string").alias("asking")), "user_id", "left")
    asked = asked.join(jobs.select("job_id", F.col("recruiter_id").cast("string").alias("owner")), "job_id")
    allowed = F.col("asking").isNull() | F.col("asking").eqNullSafe(F.col("owner"))
    done = asked.where(allowed).select("job_id", F.lit("published").alias("status")).distinct()
    return patch(jobs, done, "job_id", ["status"]), asked.where(~allowed).select("job_id", "user_id")


def upsert_profiles(base: DataFrame, changes: DataFrame, key: str, lists: list[str], csv: list[str], years: list[str]) -> DataFrame:
    """base with a change of each key: only supplied fields are taken. Values come as text: `csv` fields are split at commas, `lists` hold the
    one value, `years` that aren't numbers become null. Keys that base doesn't have are added with what was supplied.

    changes: key, supplied (array of names), and the fields as strings.
    """
    fields = [c for c in base.columns if c != key]

    def typed(c: str):
        if c in csv:
            return F.when(F.col(c).isNotNull(), C.csv_items(F.col(c)))
        if c in lists:
            return F.array(F.col(c))
        return F.trim(c).try_cast("int") if c in years else F.col(c)

    ch = changes.select(key, "supplied", *(typed(c).alias(c) for c in fields))
    known = patch_supplied(base, ch, key, fields)
    fresh = ch.join(base.select(key), key, "left_anti")
    return known.unionByName(fresh.select(key, *(F.when(F.array_contains("supplied", c), F.col(c)).alias(c) for c in fields)))


def lookup(df: DataFrame, wanted: DataFrame, on: list[str], fold: list[str] | None = None) -> DataFrame:
    """The rows of df whose `on` values are wanted; of `fold` columns blanks at the ends and case don't count. Nulls find nothing."""
    same = lambda c: F.lower(F.trim(c)) if c in (fold or []) else F.col(c)
    keys = wanted.select(*(same(c).alias(f"_{c}") for c in on)).distinct()
    match = F.lit(True)
    for c in on:
        match = match & (same(c) == F.col(f"_{c}"))
    return df.join(keys, match, "left_semi")


def candidate_applications(applications: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Applications with title, company and kind of their job, and score and skills of their match where there is one (results: app_id,
    final, matched)."""
    j = jobs.select("job_id", F.col("title").alias("job_title"), "company_name", F.col("kind").alias("job_type"))
    m = results.select("app_id", F.col("final").alias("match_score"), F.col("matched").alias("matched_skills"))
    return applications.join(j, "job_id", "left").join(m, "app_id", "left")
