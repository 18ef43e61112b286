"""Hiring-pipeline queries: customers are candidates, suppliers recruiters, nations organisations, parts jobs, and line items
with their orders applications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import hiring as H
from ..operators.match import WEIGHTS
from .base import registrar, table

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

VIEWS = """jobs AS (SELECT p_partkey AS job_id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 120 END AS recruiter_id, p_partkey % 25 AS org_id, p_name AS title, p_type AS kind, ['draft', 'published', 'active', 'closed'][p_size % 4 + 1] AS status, p_retailprice AS created FROM part),
 apps AS (SELECT l_orderkey * 10 + l_linenumber AS app_id, l_partkey AS job_id, o_custkey AS candidate_id, ['applied', 'screening', 'shortlisted', 'interview', 'technical', 'final', 'offer', 'hired', 'rejected'][(l_suppkey + l_linenumber) % 9 + 1] AS stage, CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_quantity / 50, 2) END AS score, o_orderdate AS created FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 cands AS (SELECT c_custkey AS candidate_id, c_name AS name FROM customer), recs AS (SELECT s_suppkey AS recruiter_id, s_nationkey AS org_id FROM supplier)"""


def _of(names: list[str], i):
    return F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


def jobs(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("job_id"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_partkey") % 120).alias("recruiter_id"), (F.col("p_partkey") % 25).alias("org_id"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"), _of(["draft", "published", "active", "closed"], F.col("p_size") % 4).alias("status"), F.col("p_retailprice").alias("created"))


def apps(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stage = _of(["applied", "screening", "shortlisted", "interview", "technical", "final", "offer", "hired", "rejected"], (F.col("l_suppkey") + F.col("l_linenumber")) % 9)
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("app_id"), F.col("l_partkey").alias("job_id"), F.col("o_custkey").alias("candidate_id"), stage.alias("stage"), F.when(F.col("l_linenumber") != 7, F.round(F.col("l_quantity") / 50, 2)).alias("score"), F.col("o_orderdate").alias("created"))


def cands(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("name"))


def recs(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("recruiter_id"), F.col("s_nationkey").alias("org_id"))


def _q(name: str, sql: str):
    return query(name, f"WITH {VIEWS} {sql}")


@_q("ats_overview", "SELECT (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM jobs WHERE status = 'active') AS active_jobs, (SELECT count(*) FROM apps) AS applications, (SELECT count(*) FROM cands) AS candidates")
def ats_overview(s, d):
    return H.overview(jobs(s, d), apps(s, d), cands(s, d))


_ADV = "stage IN ('shortlisted', 'interview', 'technical', 'final', 'offer', 'hired')"


@_q("ats_recruiter_overview", f"SELECT (SELECT count(*) FROM jobs WHERE org_id = 3) AS jobs, (SELECT count(*) FROM jobs WHERE org_id = 3 AND status = 'active') AS active_jobs, count(*) AS applications, count(*) FILTER ({_ADV}) AS shortlisted, count(*) FILTER (stage = 'hired') AS hired FROM apps WHERE job_id IN (SELECT job_id FROM jobs WHERE org_id = 3)")
def ats_recruiter_overview(s, d):
    return H.recruiter_overview(jobs(s, d), apps(s, d), 3, tenant_only=True)


@_q("ats_funnel", "SELECT ord, f.stage, count(app_id) AS n FROM (VALUES (1, 'applied'), (2, 'screening'), (3, 'shortlisted'), (4, 'interview'), (5, 'offer'), (6, 'hired')) f(ord, stage) LEFT JOIN apps USING (stage) GROUP BY ALL")
def ats_funnel(s, d):
    return H.funnel(apps(s, d), s.createDataFrame([(i + 1, x) for i, x in enumerate(H.STAGES)], "ord int, stage string"))


@_q("ats_score_histogram", "SELECT CASE WHEN coalesce(score, 0) >= 0.9 THEN 'excellent' WHEN coalesce(score, 0) >= 0.75 THEN 'good' WHEN coalesce(score, 0) >= 0.6 THEN 'fair' ELSE 'low' END AS bucket, count(*) AS n FROM apps GROUP BY ALL")
def ats_score_histogram(s, d):
    return H.score_histogram(apps(s, d))


@_q("ats_stage_counts", "SELECT stage, count(*) AS n FROM apps GROUP BY stage")
def ats_stage_counts(s, d):
    return H.stage_counts(apps(s, d))


@_q("ats_dashboard_counts", "SELECT count(*) FILTER (stage IN ('shortlisted', 'interview')) AS in_review, count(*) FILTER (stage IN ('hired', 'offer')) AS won FROM apps")
def ats_dashboard_counts(s, d):
    return H.dashboard_counts(apps(s, d))


@_q("ats_list_jobs", "SELECT job_id, title, status FROM jobs WHERE status IN ('published', 'active') AND recruiter_id IS NOT NULL AND org_id IS NOT NULL")
def ats_list_jobs(s, d):
    return H.public_jobs(jobs(s, d)).select("job_id", "title", "status")


@_q("ats_active_jobs", "SELECT job_id, title FROM jobs WHERE status = 'active' AND org_id = 7")
def ats_active_jobs(s, d):
    return H.jobs_of(jobs(s, d), org=7, status="active").select("job_id", "title")


@_q("ats_jobs_by_recruiter", "SELECT job_id, title FROM jobs WHERE recruiter_id = 11")
def ats_jobs_by_recruiter(s, d):
    return H.jobs_of(jobs(s, d), recruiter=11).select("job_id", "title")


@_q("ats_search_jobs", "SELECT job_id FROM jobs WHERE (contains(lower(title), 'an') OR contains(lower(kind), 'an') OR contains(lower(status), 'an')) AND status = 'active'")
def ats_search_jobs(s, d):
    return H.search_jobs(jobs(s, d), "AN", ["title", "kind", "status"], status="active", kind="All").select("job_id")


@_q("ats_distinct_domains", "SELECT DISTINCT kind FROM jobs")
def ats_distinct_domains(s, d):
    return jobs(s, d).select("kind").distinct().orderBy("kind")


@_q("ats_list_applications", "SELECT app_id, coalesce(name, 'Applicant') AS name, title, stage, score, created FROM (SELECT app_id, job_id, candidate_id, stage, score, created FROM apps) LEFT JOIN cands USING (candidate_id) LEFT JOIN jobs j USING (job_id)".replace("score, created FROM (", "score, apps_created AS created FROM (").replace("stage, score, created FROM apps", "stage, score, created AS apps_created FROM apps"))
def ats_list_applications(s, d):
    return H.list_applications(apps(s, d), cands(s, d), jobs(s, d))


@_q("ats_application_detail", "SELECT app_id, name, title, stage FROM apps JOIN cands USING (candidate_id) JOIN jobs USING (job_id) WHERE app_id = (SELECT min(app_id) FROM apps)")
def ats_application_detail(s, d):
    a = apps(s, d)
    one = a.agg(F.min("app_id").alias("app_id"))
    return H.list_applications(a.join(F.broadcast(one), "app_id", "left_semi"), cands(s, d), jobs(s, d)).select("app_id", "name", "title", "stage")


@_q("ats_applications_by_job", "SELECT app_id, job_id, coalesce(name, 'Applicant') AS name, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC NULLS LAST, app_id)::INT AS rank FROM apps LEFT JOIN cands USING (candidate_id)")
def ats_applications_by_job(s, d):
    from pyspark.sql import Window

    # line numbers repeat over orders, so the candidate tells applications of one number apart
    ranked = ranks.ranked(apps(s, d), ["job_id"], [F.desc_nulls_last("score"), "app_id", "candidate_id"])
    return ranked.join(cands(s, d), "candidate_id", "left").select("app_id", "job_id", F.coalesce("name", F.lit("Applicant")).alias("name"), "score", "rank")


@_q("ats_candidate_applications", "SELECT app_id, candidate_id, title AS job_title, 'Org ' || org_id AS company_name, kind AS job_type, apps.stage, score, CASE WHEN app_id % 3 = 0 AND count(*) OVER (PARTITION BY app_id) = 1 THEN score END AS match_score, CASE WHEN app_id % 3 = 0 AND count(*) OVER (PARTITION BY app_id) = 1 THEN array_to_string(string_split(title, ' ')[1:2], ',') END AS matched_skills FROM apps LEFT JOIN jobs USING (job_id)")
def ats_candidate_applications(s, d):
    a = apps(s, d)
    j = jobs(s, d).withColumn("company_name", F.concat(F.lit("Org "), "org_id"))
    # every third application with a number of its own was matched; the skills are words of the title
    own = a.groupBy("app_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("app_id")
    results = a.where("app_id % 3 = 0").join(own, "app_id", "left_semi").join(j.select("job_id", "title"), "job_id").select("app_id", F.col("score").alias("final"), F.slice(F.split("title", " "), 1, 2).alias("matched"))
    return H.candidate_applications(a, j, results).select("app_id", "candidate_id", "job_title", "company_name", "job_type", "stage", "score", "match_score", F.array_join("matched_skills", ",").alias("matched_skills"))


@_q("ats_candidate_dashboard", "SELECT candidate_id, count(*) AS total, count(*) FILTER (stage NOT IN ('rejected', 'hired')) AS active, count(*) FILTER (stage = 'interview') AS interviews, string_agg(app_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 10) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY created DESC, app_id) AS r FROM apps) GROUP BY candidate_id")
def ats_candidate_dashboard(s, d):
    return H.candidate_dashboard(apps(s, d))


def _people(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("name"), F.concat(F.lit("mail"), F.col("c_custkey") % 97, F.lit("@x.org")).alias("email"), F.col("c_mktsegment").alias("role"), F.array(F.lower("c_mktsegment"), F.concat(F.lit("Skill"), F.col("c_nationkey"))).alias("skills"))


@_q("ats_candidate_search", ", people AS (SELECT c_custkey AS candidate_id, c_name AS name, 'mail' || c_custkey % 97 || '@x.org' AS email, c_mktsegment AS role, [lower(c_mktsegment), 'Skill' || c_nationkey] AS skills FROM customer) SELECT c.candidate_id, name, email, (SELECT count(*) FROM apps a WHERE a.candidate_id = c.candidate_id) AS applications FROM (SELECT * FROM people WHERE (contains(lower(name), 'l1') OR contains(email, 'l1') OR contains(lower(role), 'l1')) AND len(list_filter(skills, lambda x: contains(lower(x), 'skill1'))) > 0 ORDER BY candidate_id LIMIT 200) c")
def ats_candidate_search(s, d):
    return H.candidate_search(_people(s, d), apps(s, d), "L1", "skill1")


@_q("ats_resume_versions", "SELECT candidate_id, app_id, row_number() OVER (PARTITION BY candidate_id ORDER BY created, app_id)::INT AS version, lead(app_id) OVER (PARTITION BY candidate_id ORDER BY created, app_id) IS NULL AS is_current FROM apps")
def ats_resume_versions(s, d):
    return H.versions(apps(s, d), "candidate_id", ["created", "app_id"]).select("candidate_id", "app_id", "version", "is_current")


@_q("ats_resume_version_write", """, old AS (SELECT candidate_id, created, app_id, row_number() OVER (PARTITION BY candidate_id ORDER BY created, app_id) AS v, lead(app_id) OVER (PARTITION BY candidate_id ORDER BY created, app_id) IS NULL AS c FROM apps WHERE app_id % 3 <> 0),
 new AS (SELECT candidate_id, app_id, row_number() OVER (PARTITION BY candidate_id ORDER BY created, app_id) AS v, lead(app_id) OVER (PARTITION BY candidate_id ORDER BY created, app_id) IS NULL AS c FROM apps WHERE app_id % 3 = 0)
 SELECT candidate_id, app_id, v::INT AS version, c AND candidate_id NOT IN (SELECT candidate_id FROM new) AS is_current FROM old
 UNION ALL SELECT candidate_id, app_id, (v + (SELECT count(*) FROM old o WHERE o.candidate_id = new.candidate_id))::INT, c FROM new""")
def ats_resume_version_write(s, d):
    # every third upload arrives after the others are stored
    order = ["created", "app_id"]
    stored = H.versions(apps(s, d).where("app_id % 3 <> 0"), "candidate_id", order)
    return H.write_versions(stored, apps(s, d).where("app_id % 3 = 0"), "candidate_id", order).select("candidate_id", "app_id", "version", "is_current")


@_q("mat_current_version", "SELECT candidate_id, max((created, app_id))[2] AS app_id FROM apps GROUP BY candidate_id".replace("max((created, app_id))[2]", "arg_max(app_id, (created, app_id))"))
def mat_current_version(s, d):
    return H.versions(apps(s, d), "candidate_id", ["created", "app_id"]).where("is_current").select("candidate_id", "app_id")


@query("ats_resume_analysis", "SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, -1) AS k, coalesce(json_extract_string(props, '$.missing.deep'), 'none') AS deep FROM events")
def ats_resume_analysis(s, d):
    p = F.from_json("props", "k long, missing struct<deep:string>")
    return table(s, d, "events").select("event_id", F.coalesce(p["k"], F.lit(-1)).alias("k"), F.coalesce(p["missing"]["deep"], F.lit("none")).alias("deep"))


@query("ats_chat_history", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) <= 50")
def ats_chat_history(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(s, d, "conversations").withColumn("r", F.row_number().over(w)).where("r <= 50").select("conv_id", "turn", "role", "text")


@query("ats_role_by_name", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an_%'")
def ats_role_by_name(s, d):
    return table(s, d, "part").where(F.col("p_name").ilike("%an_%")).select("p_partkey", "p_name")


@_q("ats_page", "SELECT app_id, score FROM apps ORDER BY score DESC NULLS LAST, app_id LIMIT 20 OFFSET 40")
def ats_page(s, d):
    return H.page(apps(s, d), [F.desc_nulls_last("score"), "app_id"], 3, 20).select("app_id", "score")


@_q("ats_orphan_jobs", "SELECT job_id, concat_ws('; ', CASE WHEN j.recruiter_id IS NULL THEN 'no recruiter' END, CASE WHEN j.recruiter_id IS NOT NULL AND r.recruiter_id IS NULL THEN 'unknown recruiter' END) AS reasons FROM jobs j LEFT JOIN recs r USING (recruiter_id) WHERE r.recruiter_id IS NULL".replace("LEFT JOIN recs r USING (recruiter_id)", "LEFT JOIN recs r ON j.recruiter_id = r.recruiter_id"))
def ats_orphan_jobs(s, d):
    return H.orphan_jobs(jobs(s, d), recs(s, d))


@_q("ats_remap_keys", """, us AS (SELECT c_custkey AS user_id, lower(c_name) AS email FROM customer UNION ALL SELECT 1000000 + s_suppkey, lower(s_name) FROM supplier WHERE s_suppkey % 4 <> 0), old AS (SELECT c_custkey + 5000 AS id, upper(c_name) AS email FROM customer WHERE c_custkey % 7 = 0),
 u AS (SELECT user_id, coalesce(id::VARCHAR, sha256('user:' || user_id)) AS nu FROM us LEFT JOIN old ON lower(old.email) = us.email),
 c AS (SELECT candidate_id, sha256('candidate:' || candidate_id) AS nc, nu FROM cands JOIN u ON u.user_id = candidate_id WHERE candidate_id % 5 <> 0),
 r AS (SELECT recruiter_id, sha256('recruiter:' || recruiter_id) AS nr FROM recs JOIN u ON u.user_id = 1000000 + recruiter_id),
 j AS (SELECT job_id, sha256('job:' || job_id) AS nj, coalesce(nr, (SELECT arg_min(nr, recruiter_id) FROM r)) AS nr FROM jobs LEFT JOIN r USING (recruiter_id))
 SELECT app_id, sha256('application:' || app_id) AS new_app, nj AS new_job, nc AS new_candidate, nu AS new_user, nr AS new_recruiter FROM apps JOIN j USING (job_id) JOIN c USING (candidate_id)""")
def ats_remap_keys(s, d):
    customers, suppliers = table(s, d, "customer"), table(s, d, "supplier")
    users = customers.select(F.col("c_custkey").alias("user_id"), F.lower("c_name").alias("email")).unionByName(suppliers.where("s_suppkey % 4 <> 0").select((F.lit(1000000) + F.col("s_suppkey")).alias("user_id"), F.lower("s_name").alias("email")))
    existing = customers.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 5000).alias("user_id"), F.upper("c_name").alias("email"))
    people = cands(s, d).where("candidate_id % 5 <> 0").withColumn("user_id", F.col("candidate_id"))
    t = H.migrate(users, existing, people, recs(s, d).withColumn("user_id", F.lit(1000000) + F.col("recruiter_id")), jobs(s, d), apps(s, d))
    return t["applications"].select("app_id", "new_app", "new_job", "new_candidate", "new_user", "new_recruiter")


@_q("ats_apply", "SELECT job_id, candidate_id, stage, score FROM apps UNION ALL SELECT job_id, candidate_id, 'applied', 0.85::DOUBLE FROM (SELECT DISTINCT job_id + 1 AS job_id, candidate_id FROM apps WHERE stage = 'hired') w WHERE NOT EXISTS (SELECT 1 FROM apps a WHERE a.job_id = w.job_id AND a.candidate_id = w.candidate_id)")
def ats_apply(s, d):
    a = apps(s, d)
    return H.apply_new(a, a.where("stage = 'hired'").select((F.col("job_id") + 1).alias("job_id"), "candidate_id"))


@_q("ats_update_stage", "SELECT app_id, coalesce(n, stage) AS stage FROM apps LEFT JOIN (SELECT app_id, arg_max(lower(s), (t, s)) AS n FROM (SELECT app_id, 'OFFER' AS s, 1 AS t FROM apps WHERE app_id % 2 = 0 UNION ALL SELECT app_id, 'HIRED', 2 FROM apps WHERE app_id % 6 = 0) GROUP BY app_id) USING (app_id)")
def ats_update_stage(s, d):
    a = apps(s, d)
    changes = a.where("app_id % 2 = 0").select("app_id", F.lit("OFFER").alias("new_stage"), F.lit(1).alias("at")).unionByName(a.where("app_id % 6 = 0").select("app_id", F.lit("HIRED").alias("new_stage"), F.lit(2).alias("at")))
    return H.update_stage(a, changes)


_JOB_WRITE = """u AS (SELECT s_suppkey AS user_id, s_suppkey AS recruiter_id FROM supplier),
 rq AS (SELECT job_id + 1000000000 AS job_id, job_id % 150 AS user_id, title, CASE WHEN job_id % 3 > 0 THEN status END AS status, CASE WHEN job_id % 2 = 0 THEN 'Site ' || org_id END AS location FROM jobs WHERE job_id % 5 = 0),
 cr AS (SELECT job_id, coalesce(recruiter_id::VARCHAR, sha256('recruiter:' || user_id)) AS recruiter_id, title, coalesce(location, 'Remote') AS location, CASE WHEN status IN ('draft', 'published', 'active') THEN status ELSE 'published' END AS status, CASE WHEN recruiter_id IS NULL THEN 'Made' ELSE 'Company' END AS company_name FROM rq LEFT JOIN u USING (user_id)),
 ask AS (SELECT job_id, CASE WHEN job_id % 8 = 0 THEN job_id % 120 ELSE job_id % 7 + 1 END AS user_id FROM jobs WHERE job_id % 4 = 0),
 ok AS (SELECT DISTINCT job_id FROM ask JOIN jobs USING (job_id) LEFT JOIN u USING (user_id) WHERE u.recruiter_id IS NULL OR u.recruiter_id IS NOT DISTINCT FROM jobs.recruiter_id),
 up AS (SELECT job_id, jobs.recruiter_id::VARCHAR AS recruiter_id, CASE WHEN job_id % 6 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN job_id % 18 = 0 THEN NULL ELSE kind END AS location, CASE WHEN job_id % 12 = 0 THEN 'active' WHEN ok.job_id IS NOT NULL THEN 'published' ELSE status END AS status, 'Company' AS company_name FROM jobs LEFT JOIN ok USING (job_id))"""


@_q("ats_job_write", f"SELECT * FROM (WITH {_JOB_WRITE} SELECT * FROM cr UNION ALL SELECT * FROM up)")
def ats_job_write(s, d):
    j = jobs(s, d)
    recruiters = table(s, d, "supplier").select(F.col("s_suppkey").alias("recruiter_id"), F.col("s_suppkey").alias("user_id"), F.lit("Company").alias("company_name"))
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.lit(None).cast("string").alias("email"), F.col("c_nationkey").alias("org_id"))
    requests = j.where("job_id % 5 = 0").select((F.col("job_id") + 1000000000).alias("job_id"), (F.col("job_id") % 150).alias("user_id"), "title", F.when(F.col("job_id") % 3 > 0, F.col("status")).alias("status"), F.when(F.col("job_id") % 2 == 0, F.concat(F.lit("Site "), "org_id")).alias("location"))
    created, _ = H.create_jobs(requests, users, recruiters, table(s, d, "nation").select(F.col("n_nationkey").alias("org_id")), "Made", WEIGHTS)
    asked = j.where("job_id % 4 = 0").select("job_id", F.when(F.col("job_id") % 8 == 0, F.col("job_id") % 120).otherwise(F.col("job_id") % 7 + 1).alias("user_id"))
    there = j.select("job_id", F.col("recruiter_id").cast("string").alias("recruiter_id"), "title", F.col("kind").alias("location"), "status", F.lit("Company").alias("company_name"))
    published, _ = H.publish_jobs(there, asked, recruiters)
    supplied = F.array_compact(F.array(F.lit("title"), F.when(F.col("job_id") % 12 == 0, "status"), F.when(F.col("job_id") % 18 == 0, "location")))
    changes = j.where("job_id % 6 = 0").select("job_id", supplied.alias("supplied"), F.upper("title").alias("title"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("location"))
    updated = H.patch_supplied(published, changes, "job_id", ["title", "status", "location"])
    return created.select(*updated.columns).unionByName(updated)


@_q("ats_delete", "SELECT job_id FROM jobs WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE recruiter_id = 5 AND job_id IS NOT NULL)")
def ats_delete(s, d):
    return jobs(s, d).join(jobs(s, d).where("recruiter_id = 5").select("job_id"), "job_id", "left_anti").select("job_id")


@_q("ats_lookup", "SELECT 'pair' AS how, app_id AS id FROM apps WHERE (job_id, candidate_id) IN (SELECT job_id, candidate_id FROM apps WHERE stage = 'hired' AND score >= 0.9) UNION ALL SELECT 'email', candidate_id FROM cands WHERE candidate_id % 10 = 0 UNION ALL SELECT 'id', job_id FROM jobs WHERE job_id IN (SELECT job_id FROM apps WHERE stage = 'hired' AND score >= 0.9) UNION ALL SELECT 'user', s_suppkey FROM supplier WHERE s_suppkey IN (SELECT recruiter_id FROM jobs WHERE status = 'draft')")
def ats_lookup(s, d):
    a = apps(s, d)
    hired = a.where("stage = 'hired' and score >= 0.9")
    mail = cands(s, d).withColumn("email", F.concat("name", F.lit("@Site.org")))
    asked = mail.where("candidate_id % 10 = 0").select(F.concat(F.lit("  "), F.upper("email"), F.lit(" ")).alias("email"))
    users = table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id"))
    found = [("pair", H.lookup(a, hired, ["job_id", "candidate_id"]), "app_id"), ("email", H.lookup(mail, asked, ["email"], ["email"]), "candidate_id"), ("id", H.lookup(jobs(s, d), hired, ["job_id"]), "job_id"), ("user", H.lookup(users, jobs(s, d).where("status = 'draft'").select(F.col("recruiter_id").alias("user_id")), ["user_id"]), "user_id")]
    return reduce(DataFrame.unionByName, [df.select(F.lit(how).alias("how"), F.col(c).alias("id")) for how, df, c in found])


_UPSERT = """c AS (SELECT candidate_id, name, 2000 AS year, ['old'] AS skills, ['school'] AS education FROM cands),
 u AS (SELECT c_custkey + CASE WHEN c_custkey % 9 = 0 THEN 1000000000 ELSE 0 END AS candidate_id, 'New ' || c_custkey AS name, CASE c_custkey % 4 WHEN 0 THEN ' 2020 ' WHEN 1 THEN 'soon' END AS year, 'sql, ,' || c_mktsegment || ' ,x' AS skills, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS education, c_custkey % 2 = 0 AS sy, c_custkey % 6 = 0 AS sk, c_custkey % 12 <> 3 AS se FROM customer WHERE c_custkey % 3 = 0),
 t AS (SELECT candidate_id, name, try_cast(trim(year) AS INT) AS year, ['sql', split_part(skills, ',', 3).trim(), 'x'] AS skills, [education] AS education, sy, sk, se FROM u)"""


@_q("ats_profile_upsert", f"SELECT candidate_id, name, year, array_to_string(skills, ',') AS skills, len(education)::INT AS n_education, education[1] AS education FROM (WITH {_UPSERT} SELECT c.candidate_id, coalesce(t.name, c.name) AS name, CASE WHEN t.sy THEN t.year ELSE c.year END AS year, CASE WHEN t.sk THEN t.skills ELSE c.skills END AS skills, CASE WHEN t.se THEN t.education ELSE c.education END AS education FROM c LEFT JOIN t USING (candidate_id) UNION ALL SELECT candidate_id, name, CASE WHEN sy THEN year END, CASE WHEN sk THEN skills END, CASE WHEN se THEN education END FROM t WHERE candidate_id >= 1000000000)")
def ats_profile_upsert(s, d):
    base = cands(s, d).withColumns({"year": F.lit(2000), "skills": F.array(F.lit("old")), "education": F.array(F.lit("school"))})
    c, k = table(s, d, "customer").where("c_custkey % 3 = 0"), F.col("c_custkey")
    supplied = F.array_compact(F.array(F.lit("name"), F.when(k % 2 == 0, "year"), F.when(k % 6 == 0, "skills"), F.when(k % 12 != 3, "education")))
    changes = c.select((k + F.when(k % 9 == 0, 1000000000).otherwise(0)).alias("candidate_id"), supplied.alias("supplied"), F.concat(F.lit("New "), k).alias("name"), F.when(k % 4 == 0, " 2020 ").when(k % 4 == 1, "soon").alias("year"), F.concat(F.lit("sql, ,"), "c_mktsegment", F.lit(" ,x")).alias("skills"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("education"))
    out = H.upsert_profiles(base, changes, "candidate_id", ["education"], ["skills"], ["year"])
    return out.select("candidate_id", "name", "year", F.array_join("skills", ",").alias("skills"), F.size("education").alias("n_education"), F.get("education", 0).alias("education"))


_RANKED = "r AS (SELECT app_id, job_id, candidate_id, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, app_id)::INT AS rank, CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.6 THEN 'moderate' WHEN score >= 0.4 THEN 'below_average' ELSE 'poor' END AS tier FROM apps WHERE score >= 0.2)"


def _ranked(s, d):
    from ..operators import match as M

    return M.rank(apps(s, d), "job_id", "score", "app_id", 0.2).withColumn("tier", M.tier(F.col("score")))


@query("rnk_candidates", f"WITH {VIEWS}, {_RANKED}, tot AS (SELECT job_id, count(*) AS total FROM r GROUP BY job_id), pg AS (SELECT *, (rank - 1) // 10 + 1 AS page FROM r), st AS (SELECT job_id, round(avg(score), 3) AS avg_score, round(max(score), 3) AS max_score, round(min(score), 3) AS min_score, count(*) FILTER (score >= 0.8) AS above_80 FROM pg WHERE page = 2 GROUP BY job_id) SELECT app_id, job_id, score, rank, total::INT AS total, ceil(total / 10)::INT AS pages, avg_score, max_score, min_score, above_80 FROM pg JOIN st USING (job_id) JOIN tot USING (job_id) WHERE page = 2")
def rnk_candidates(s, d):
    from ..operators import match as M

    return M.rank_page(_ranked(s, d), "job_id", "score", 2, 10).select("app_id", "job_id", "score", "rank", "total", "pages", "avg_score", "max_score", "min_score", "above_80")


@query("rnk_rankings", f"WITH {VIEWS}, {_RANKED} SELECT app_id, job_id, name, score, rank FROM r LEFT JOIN cands USING (candidate_id)")
def rnk_rankings(s, d):
    return _ranked(s, d).join(cands(s, d), "candidate_id", "left").select("app_id", "job_id", "name", "score", "rank")


@query("rnk_tier", f"WITH {VIEWS}, {_RANKED} SELECT tier, count(*) AS n FROM r GROUP BY tier")
def rnk_tier(s, d):
    return _ranked(s, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
