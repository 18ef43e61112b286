"""Operators on small frames."""

import hashlib
import math
import random
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from sievework.functions import columns as C
from sievework.operators import audit, decide, dedup, evaluate, hiring, labels, match, profile, quality, retrieve, skills, text, validate


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_exact_duplicates_keep_the_least_id_and_exempt_blanks(spark):
    df = spark.createDataFrame([(3, "A  b"), (1, "a b"), (2, "c"), (4, None), (5, None), (6, " "), (7, "nan"), (8, "nan")], "id long, t string")
    assert rows(dedup.exact(df, "id", "t"), "id", "_exact_dup", "_exact_dup_of") == [(i, i == 3, 1 if i == 3 else None) for i in range(1, 9)]


def test_near_duplicates_point_to_the_most_similar_earlier_row(spark):
    base = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, base), (2, base + " extra"), (3, "something else entirely here"), (4, base + " extra more")], "id long, t string")
    found = {r.id: r.parent for r in dedup.near(df, "id", "t", 0.9).collect()}
    assert found == {2: 1, 4: 2}
    assert rows(dedup.clusters(spark.createDataFrame([(1, None), (2, 1), (4, 2), (5, None)], "k long, p long"), "k", "p")) == [(1, 1), (2, 1), (4, 1), (5, 5)]


def test_cleaning(spark):
    df = spark.createDataFrame([(1, None), (2, "nan"), (3, "“Hi”…\r\n\r\n\r\n\r\nC++, C# and Node.js!!!!!!  ok"), (4, "x" * 200)], "id int, t string")
    out = {r.id: r for r in text.clean(df, "t").collect()}
    assert out[1].t == "" and out[2].t == "" and out[1]._text_clean_flag == "empty"
    assert out[3].t == '"Hi"...\n\nC++, C# and Node.js! ok' and out[3]._text_clean_flag == "short"
    assert out[4]._text_clean_flag == "ok"
    assert text.clean(df, "t", drop_flagged=True).count() == 1


def test_unicode_composition(spark):
    df = spark.createDataFrame([("éa",), ("plain",)], "t string")
    assert rows(df.select(text.unicode_clean(F.col("t")).alias("t"))) == [("plain",), ("éa",)]


def test_chunks_and_sections(spark):
    df = spark.createDataFrame([(1, "aaa bbb\n\nccc\n\n" + "w " * 30), (2, ""), (3, None)], "id int, t string")
    out = text.paragraphs(df, "id", "t", size=20, overlap=3).collect()
    assert {r.id for r in out} == {1} and all(len(r.chunk_text) <= 24 for r in out) and out[0].chunk_text == "aaa bbb\nccc" and out[1].chunk_text == "ccc " + " ".join("w" * 10)
    assert rows(text.windows(spark.createDataFrame([(1, "a b c d e"), (2, " ")], "id int, t string"), "id", "t", 3, 2)) == [(1, 0, "a b c"), (1, 1, "c d e")]
    sec = spark.createDataFrame([("intro\nSkills\nspark\nsql\nExperience: x\nyears\nSkills\nagain\nProjects\nSkills:\n",), ("",), (None,)], "t string")
    assert [r[0] for r in sec.select(text.sections(F.col("t"))).collect()] == [{"general": "intro", "experience": "years", "skills": "again"}, {}, {}]


def test_expressions(spark):
    df = spark.createDataFrame([("3 years and 7+ yrs, 2.5 years", "a, b ,,c", [1.0, 0.0], [1.0, 1.0]), (None, None, None, [1.0])], "t string, l string, a array<double>, b array<double>")
    out = df.select(C.years_of_experience(F.col("t")).alias("y"), C.csv_items(F.col("l")).alias("l"), F.round(C.cosine(F.col("a"), F.col("b")), 4).alias("c")).collect()
    assert (out[0].y, out[0].l, out[0].c) == (7.0, ["a", "b", "c"], 0.7071) and (out[1].y, out[1].l, out[1].c) == (0.0, [], 0.0)


def test_validation(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "<b>" * 11), (2, "b", "!!!")], "id int, label string, t string")
    assert rows(validate.nulls(df, ["t", "label"], 50.0)) == [("label", 0, 0.0, "ok"), ("t", 1, 33.33, "warning")]
    assert validate.duplicate_ids(df, "id").first()[0] == 1
    assert tuple(validate.suspicious(df, "t").first()) == (1, 1)
    with pytest.raises(validate.MissingColumns):
        validate.require_columns(df, "nothing")
    assert not validate.report(df, "id", "label", "t").first().passed


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, t string")
    assert [r.null_pct for r in profile.schema_summary(df).collect()] == [0.0, 0.0]


def test_split_has_no_leak_and_is_stable(spark):
    df = spark.createDataFrame([(i, f"g{i // 2}", "xy"[i % 40 > 30]) for i in range(200)], "id int, g string, label string")
    out = labels.split(df, "g", "label")
    assert {r.overlap for r in labels.leakage(out, "g").collect()} == {0}
    assert rows(out, "id", "_split") == rows(labels.split(df.repartition(7), "g", "label"), "id", "_split")
    with pytest.raises(ValueError):
        labels.split(df, "g", "label", (0.5, 0.1, 0.1))


def test_normalisation(spark):
    df = spark.createDataFrame([("Data Science ",), ("Other",)], "r string")
    m = spark.createDataFrame([("Data Science", "Data Scientist")], "source string, target string")
    assert rows(labels.normalize(df, "r", m), "_role_normalized", "_role_changed") == [("Data Scientist", True), ("Other", False)]
    assert rows(labels.normalize(df, "r", m, strict=True), "_role_normalized") == [("Data Scientist",), ("Unknown",)]


def test_review_gate_and_fusion(spark):
    p = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.3), (1, 2, 0.2), (2, 0, 0.36), (2, 1, 0.34), (2, 2, 0.30)], "id int, class int, p double")
    out = {r.id: r for r in decide.review_gate(decide.top2(p)).collect()}
    assert not out[1].review_required and out[2].review_reasons == "low confidence; small margin"
    forced = decide.argmax(decide.override(p, spark.createDataFrame([(1, 2)], "id int, class int")))
    assert dict(rows(forced, "id", "predicted")) == {1: 2, 2: 0}
    both = p.withColumn("model", F.lit("a"))
    total = decide.product_of_experts(both, {"a": (1.0, 1.0)}).groupBy("id").agg(F.round(F.sum("p"), 9)).collect()
    assert all(r[1] == 1.0 for r in total)


def test_metrics_use_the_union_of_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "t string, p string")
    assert rows(evaluate.per_class(df, "t", "p")) == [("a", 2, 1.0, 0.5, 0.6667), ("b", 2, 0.5, 0.5, 0.5), ("c", 0, 0.0, 0.0, 0.0)]
    m = evaluate.metrics(df, "t", "p").first()
    assert (m.accuracy, m.macro_f1, m.errors) == (0.5, 0.3889, 2)


def test_audit_rules_keep_their_order(spark):
    rules = [(["teacher", "head of school"], "t", "teaches"), (["nurse", "c++"], "n", "nurses")]
    late = "word " * 100 + "Head of  School"
    df = spark.createDataFrame([("a nurse and a Teacher",), ("teachers, nursery",), (None,), (late,), ("nurse " + late,), ("word " * 200 + "nurse",), ("énurse",), ("nurse.",)], "x string")
    out = df.select(audit.rule_match(F.col("x"), rules).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in out] == [("t", "teaches"), None, None, ("t", "teaches (identified in career history)"), ("n", "nurses"), None, None, ("n", "nurses")]


def test_blind_audits_without_a_rule(spark):
    industry = (["BPO"], [(["claim"], "ADVOCATE", 0.90), (["clerk"], "HR", 0.85)], ["manager"], ["health"], ["CARE"])
    rows_ = [("x", "T", "T"), ("x", "B", "T"), ("an old claim of a clerk", "BPO", None), ("clerks", "BPO", None), ("none", "BPO", None), ("health managers", "T", None), ("health managers", "CARE", None), ("word " * 80 + "claim", "BPO", None), (None, "T", None)]
    df = spark.createDataFrame(rows_, "x string, l string, r string")
    out = df.select(audit.decide_blind(F.col("r"), F.col("l"), F.col("x"), industry).alias("b")).collect()
    assert [tuple(r.b) for r in out] == [("CORRECT_LABEL", "T", 1.0), ("LIKELY_MISLABELED", "T", 0.95), ("LIKELY_MISLABELED", "ADVOCATE", 0.9), ("LIKELY_MISLABELED", "HR", 0.85), ("AMBIGUOUS", "BPO", 0.6), ("AMBIGUOUS", "T", 0.65), ("CORRECT_LABEL", "CARE", 0.85), ("AMBIGUOUS", "BPO", 0.6), ("CORRECT_LABEL", "T", 0.85)]


def test_phrases_are_found_between_word_boundaries(spark):
    from sievework.functions import phrases

    words = ["c++", "node.js", "go", "data science", "science"]
    texts = ["go data science", "gopher ago", "c++ go, node.js", "(data science)", "c++a", None, "", "égo go"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(phrases.found(F.col("t"), words).alias("f")).collect()
    assert [(r.f.held, r.f.whole) for r in out] == [([2, 3, 4], [2, 3, 4]), ([2], []), ([0, 1, 2], [1, 2]), ([3, 4], [3, 4]), ([0], [0]), ([], []), ([], []), ([2], [2])]


def test_dimensions_without_signal_drop_out(spark):
    df = spark.createDataFrame([(0.85, ["a"], [], 1.0, 0.0, None, None), (0.10, ["a"], ["a", "b"], 1.0, 2.0, True, 50.0)], "cosine double, matched array<string>, needed array<string>, have double, need double, degree boolean, duties double")
    out = match.overall(match.dimensions(df)).collect()
    assert out[0].overall == 98.0 and out[0].applicable == "semantic" and out[1].overall == 42.0
    assert out[1].d_skills == 50.0 and out[1].d_education == 100.0


def test_skills(spark):
    df = spark.createDataFrame([(1, "I know C++, machine learning and pyton"), (2, None)], "id int, t string")
    s = spark.createDataFrame([("C++",), ("Machine Learning",), ("Python",)], "skill string")
    assert rows(skills.exact(df, "id", "t", s)) == [(1, "C++"), (1, "Machine Learning")]
    low = spark.createDataFrame([("python",), ("Pyton",)], "skill string")
    toks = skills.tokens(df, "id", "t")
    assert rows(skills.fuzzy(toks, "id", low, 90.0)) == [(1, "python")]
    rich = spark.createDataFrame([(1, x) for x in "abc"], "id int, skill string")
    assert rows(skills.fuzzy(toks, "id", low, 90.0, found=rich)) == [] and rows(skills.fuzzy(toks, "id", low, 90.0, found=rich.limit(2))) == [(1, "python")]
    assert df.select(skills.found(F.col("t"), ["C++", "Machine Learning"], [("pyton", "Python")])).collect()[0][0] == ["C++", "Machine Learning", "Python"]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "spark sql spark"), (2, "pandas")], "id long, text string")
    q = spark.createDataFrame([(9, "spark")], "id long, text string")
    assert [r.id for r in retrieve.bm25(docs, q, 5).collect()] == [1]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vector array<double>")
    top = retrieve.topk(v, v.where("id = 1"), 3)
    assert [r.id for r in top.orderBy("rank").collect()] == [1, 2, 3]
    assert [r.id for r in retrieve.mmr(top.join(v, "id"), 2, 0.3).orderBy("rank").collect()] == [1, 3]


def test_hiring_writes(spark):
    a = spark.createDataFrame([(1, 10, 5, "applied", 0.5), (2, 11, 5, "hired", None)], "app_id int, job_id int, candidate_id int, stage string, score double")
    w = spark.createDataFrame([(10, 5), (12, 5), (12, 5)], "job_id int, candidate_id int")
    assert hiring.apply_new(a, w).count() == 3
    ch = spark.createDataFrame([(1, "OFFER", 1), (1, "Hired", 2)], "app_id int, new_stage string, at int")
    assert rows(hiring.update_stage(a, ch)) == [(1, "hired"), (2, "hired")]


PROFILES = [
    None,
    "",
    "four words are few",
    "Jo Doe\nme@x.org 555 123-4567 github.com/jo\nSummary\nEngineer\nExperience\n- Develop things with a team in in Paris\n* Lead 12 users\n- managed databse 01/2020\n- Build it\nSkills\nPython, SQL\nEducation\nBachelor Jan 2020",
    "Work history\n" + "• Test seperate parts of the the system and and report growth of 25% to 1,200 clients\n" * 9 + "Projects\nlead nothing\n2019 - 2021",
    "word " * 70 + "\n\n" + "text " * 80 + "\n\n" + "more " * 1400 + "\nexperience\nManage " + "very " * 50 + "\n1. Create\n2. write on",
    "Analyst\nExperience: Bank, 2010\nteam of six\nthird\nfourth\nEducation:\nMaster of Arts\nCity College\nskills: a, Excel; Word | PowerPoint, Access\nemployment",
]


def test_quality_equals_a_plain_version(spark):
    df = spark.createDataFrame(list(enumerate(PROFILES)), "id int, t string")
    analysed = quality.analyse(df, "t")
    got = {r.id: r for r in analysed.withColumn("issues", quality.feedback()[0]).withColumn("good", quality.feedback()[1]).collect()}
    for i, t in enumerate(PROFILES):
        want = plain.analyse(t)
        assert {k: got[i][k] for k in (*quality.WEIGHTS, "overall", "grade", "words", "pages")} == {k: want[k] for k in (*quality.WEIGHTS, "overall", "grade", "words", "pages")}, i
        assert [x.problem for x in got[i].issues] == want["problems"] and len(got[i].good) == want["n_good"], i
        assert [x.recommendation for x in got[i].issues if x.problem == "Possible grammar/tense issue"] == want["suggested"], i
    assert quality.issues(analysed, "id").count() == sum(len(plain.analyse(t)["problems"]) for t in PROFILES)


def test_profile_fields_equal_a_plain_version(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PROFILES) if t], "id int, t string")
    out = {r[0]: tuple(r[1:]) for r in df.select("id", *text.profile_fields(F.col("t")).values()).collect()}
    assert out == {i: plain.fields(t) for i, t in enumerate(PROFILES) if t}


def test_matches_and_explanations(spark):
    cases = [(["a"] * k, [f"m{j}" for j in range(g)], h, n, s) for k, g in ((0, 0), (0, 2), (2, 0), (4, 3), (6, 7)) for h, n in ((0.0, 0), (5.0, 4), (3.0, 4), (1.0, 4)) for s in (0.3, 0.6, 0.75, 0.9)]
    df = spark.createDataFrame([(i, m, g, m + g, h, n, s) for i, (m, g, h, n, s) in enumerate(cases)], "id int, matched array<string>, missing array<string>, needed array<string>, have double, need int, semantic double")
    pairs = df.withColumn("experience", match.experience(F.col("have"), F.col("need"))).withColumn("education", F.lit(0.75)).withColumn("projects", match.projects(F.lit(None).cast("double"), F.col("semantic"))).withColumn("blank", F.col("id") == 0)
    out = {r.id: r for r in match.explain(match.score(pairs)).collect()}
    for i, (m, g, h, n, s) in enumerate(cases):
        r, none = out[i], not m and not g
        w = match.NO_SKILLS if none else match.WEIGHTS
        raw = w["semantic"] * s + w["skills"] * (0 if none else len(m) / len(m + g)) + w["projects"] * 0.8 * s + w["experience"] * (1.0 if n <= 0 else min(1.0, h / n)) + w["education"] * 0.75
        sure = 0.0 if i == 0 else min(0.98, max(0.10, 1 / (1 + math.exp(-8 * (raw - 0.35)))))
        assert abs(r.calibrated - sure) < 1e-9 and r.percent == int(sure * 100) and abs(r.final - round(sure, 3)) < 1e-9
        assert (len(r.strengths), len(r.improvements), len(r.advice)) == plain.lines_of_match(m, g, h, n, s, sure), cases[i]
        assert r.match_ratio == round(len(m) / max(len(m + g), 1), 2) and r.meets_requirement == (h >= n if n > 0 else True)
    own = pairs.where("id = 20").withColumn("w", F.create_map(F.lit("semantic"), F.lit(1.0)))
    assert match.score(own, "w").first().raw > match.score(own).first().raw


def test_suggestions_keep_their_order(spark):
    df = spark.createDataFrame([(True, ["a", "b", "c", "d", "e"], 50.0, None, 90.0, ["x", "y", "x"], ["y", "z"]), (False, ["a"], 1.0, 1.0, 1.0, [], []), (False, [], None, None, None, [], [str(i) for i in range(20)])], "sufficient boolean, missing_skills array<string>, d_experience double, d_responsibility double, d_education double, advice array<string>, general array<string>")
    one, two, three = (r[0] for r in df.select(match.improvements(df)).collect())
    assert len(one) == 8 and one[0].endswith("skill: a") and one[3].endswith("skill: d") and one[5:] == ["x", "y", "z"]
    assert len(two) == 3 and three == [str(i) for i in range(10)]


def test_roles(spark):
    roles = [("Data Engineer", "IT", ["ETL Developer"], ["Spark", "C#"]), ("Chef", "FOOD", ["Cook"], []), ("General Helper", "FOOD", [], ["Spark"])]
    df = spark.createDataFrame([(1, "a data engineer with spark", "it"), (2, "the cooks", "food"), (3, "nothing", "none"), (4, "", "it"), (5, "a chef", "it")], "id int, t string, c string")
    held, whole = match.role_terms(F.col("t"), roles)
    df = df.withColumn("held", held).withColumn("whole", whole).withColumn("s", match.score_roles(F.col("held"), F.col("whole"), roles))
    out = {r.id: r for r in df.select("id", "s", match.specific_role(F.col("t"), F.col("c"), F.col("s"), roles).alias("r"), match.infer_role(F.col("t"), F.col("s")).alias("i"), match.suggest_roles(F.col("t"), F.col("whole"), F.array().cast("array<string>"), roles, 2).alias("k")).collect()}
    assert [x.score for x in out[1].s] == [6.2, 0.0, 4.2] and tuple(out[1].r) == ("Data Engineer", 0.86)
    assert [x.score for x in out[2].s] == [0.0, 2.5, 0.0] and tuple(out[2].i) == ("Chef", 0.68)  # an alias counts inside a word
    assert tuple(out[3].r) == ("Software Engineer", 0.5) and tuple(out[4].r) == ("General Professional", 0.0) and tuple(out[5].r) == ("Chef", 0.73)
    assert [(x.role, x.score, x.skills) for x in out[1].k] == [("Data Engineer", 96, ["Spark"]), ("Chef", 55, [])] and len(out[4].k) == 3


def test_artifacts_and_contacts(spark):
    given = ["SKILLS: Skills - skills now", "•••••x ----- y\r\nz", "!!!!!!!a b   c\n\n\n\nd", "me.x@y.org and 555-123-4567 or 15551234567"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "id int, t string")
    out = [r[0] for r in df.orderBy("id").select(text.mask_contacts(text.remove_artifacts(F.col("t")))).collect()]
    assert out == ["SKILLS now", " x   y\nz".replace("   ", " "), "!a b c\n\nd", "[EMAIL] and [PHONE] or 15551234567"]
    assert [tuple(r) for r in spark.createDataFrame([("ﬁ\x85  x\n\n\ny",), (None,)], "t string").select(text.compat_clean(F.col("t")), text.without_accents(F.lit("éñ"))).collect()] == [("fi x\n\ny", "en"), (None, "en")]


def test_versions_go_on_and_keys_move(spark):
    old = spark.createDataFrame([(1, 1, 1, False), (1, 2, 2, True), (2, 1, 1, True)], "o int, at int, version int, is_current boolean")
    new = spark.createDataFrame([(1, 9), (1, 8), (3, 1)], "o int, at int")
    assert rows(hiring.write_versions(old, new, "o", ["at"])) == [(1, 1, 1, False), (1, 2, 2, False), (1, 8, 3, False), (1, 9, 4, True), (2, 1, 1, True), (3, 1, 1, True)]


def test_pairwise_thresholds(spark):
    p = spark.createDataFrame([(1, 0, 0.40), (1, 1, 0.35), (1, 2, 0.25), (2, 0, 0.7), (2, 1, 0.3)], "id int, class int, p double")
    tau = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "class int, tau double")
    kappa = spark.createDataFrame([(0, 1, 1.2), (0, 2, 1.2)], "a int, b int, kappa double")
    assert rows(decide.thresholds(p, tau, kappa=kappa), "id", "predicted") == [(1, 1), (2, 0)] and rows(decide.thresholds(p, tau), "id", "predicted") == [(1, 0), (2, 0)]


def test_near_duplicates_by_blocks_equal_pairs(spark, monkeypatch):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(50):
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(60)] = rnd.choice([*vocabulary, "café", "the"])
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    pairs = rows(dedup.near(df, "id", "t", 0.9, stop=["the"]))
    monkeypatch.setattr(dedup, "PAIRED", 3)
    monkeypatch.setattr(dedup, "BLOCK", 10)
    assert rows(dedup.near(df, "id", "t", 0.9, stop=["the"])) == pairs and len(pairs) > 20
    same = spark.createDataFrame([(1, "the café noir est bon"), (2, "CAFE the noir; est bon"), (3, "cafe noir est bon, the")], "id long, t string")
    assert rows(dedup.near(same, "id", "t", stop=["the"])) == [(2, 1, 1.0), (3, 1, 1.0)]


def test_classifier_on_held_out_rows(spark):
    from sievework.operators import classify

    rnd = random.Random(1)
    words = {"a": ["red", "green", "blue"], "b": ["one", "two", "six"]}
    df = spark.createDataFrame([(i, " ".join(rnd.choice(words["ab"[i % 2]]) for _ in range(8)), "ab"[i % 2], 1.0) for i in range(60)], "id int, text string, label string, w double")
    seen, held = df.where("id < 40"), df.where("id >= 40")
    for out in (classify.predict(classify.train(seen, "label", "w", 100), held, "id"), classify.CalibratedSVC("label", 100, 2, 5).fit(seen).predict(held, "id")):
        best = out.groupBy("id").agg(F.max_by("class", "p").alias("c"), F.sum("p").alias("p"))
        assert best.where((F.col("c") == F.when(F.col("id") % 2 == 0, "a").otherwise("b")) & (F.abs(F.col("p") - 1) < 1e-6)).count() == 20


def test_svc_converges_in_each_fold_and_the_query_leaves_its_size(spark, monkeypatch):
    from sievework.operators import classify
    from sievework.plans import plan_09_classify

    rnd = random.Random(3)
    words = ["red", "green", "blue", "one", "two", "six", "up", "down"]
    # noise keeps the classes from being separable, so a few steps don't reach the end
    df = spark.createDataFrame([(i, " ".join(rnd.choice(words[: 5 + i % 3]) for _ in range(6)), "abc"[i % 3]) for i in range(90)], "id int, text string, label string")
    held = {}
    fitted = classify.CalibratedSVC._fitted
    monkeypatch.setattr(classify.CalibratedSVC, "_fitted", lambda self, rows, *more: held.setdefault("w", (held.setdefault("rows", rows.collect()), fitted(self, rows, *more))[1]))
    svc = classify.CalibratedSVC("label", terms=50).fit(df)
    x = classify.np.array([[*r.features.toArray(), 1.0] for r in held["rows"]])
    label, fold = (classify.np.array([r[c] for r in held["rows"]]) for c in ("_label", "_fold"))
    assert held["w"].shape == (6, 3, x.shape[1]) and svc.passes > 10

    def slope(w, g, c):
        y, weight = classify.np.where(label == c, 1.0, -1.0), 30 / classify.np.bincount(label)[label] * (fold != g)
        return x.T @ (-2 * weight * y * classify.np.maximum(0, 1 - y * (x @ w))) / weight.sum() + 0.01 * classify.np.r_[w[:-1], 0]

    for g in range(6):
        for c in range(3):
            assert classify.np.linalg.norm(slope(held["w"][g, c], g, c)) <= 2e-4 * classify.np.linalg.norm(slope(0 * held["w"][g, c], g, c))

    class Made(Exception):
        pass

    def made(*args, **options):
        raise Made(real(*args, **options))

    real = classify.CalibratedSVC
    monkeypatch.setattr(classify, "CalibratedSVC", made)
    monkeypatch.setattr(classify, "train", lambda *args: None)
    monkeypatch.setattr(classify, "predict", lambda *args: None)
    with pytest.raises(Made) as found:
        plan_09_classify.occ_train(spark, "/root/testdata/sf0.001")
    asked = found.value.args[0]
    assert (asked.terms, asked.folds, asked.iterations) == (5000, 5, 5000)


def test_vocabulary_and_sublinear_counts(spark):
    from pyspark.ml.functions import vector_to_array

    from sievework.operators import classify

    df = spark.createDataFrame([(1, "bb aa aa aa"), (2, "bb aa"), (3, "cc dd dd"), (4, "cc dd"), (5, "alone alone alone alone"), (6, "")], "id int, text string")
    model = classify.features(terms=4, embedding=0).fit(df)
    # aa 4, dd 3, then the first of those with 2 by name, in any order of the rows; a word of one row is none
    assert model.stages[3].vocabulary == ["aa", "dd", "bb", "bb aa"] == classify.features(terms=4, embedding=0).fit(df.orderBy(F.desc("id")).repartition(3)).stages[3].vocabulary
    tf = {r.id: [round(x, 9) for x in r.tf] for r in model.transform(df.repartition(2)).select("id", vector_to_array("_tf").alias("tf")).collect()}
    three, two = round(1 + math.log(3), 9), round(1 + math.log(2), 9)
    assert tf == {1: [three, 0, 1, 1], 2: [1, 0, 1, 1], 3: [0, two, 0, 0], 4: [0, 1, 0, 0], 5: [0] * 4, 6: [0] * 4}


def test_pairs_of_rare_words_are_not_counted(spark, monkeypatch):
    import pyarrow as pa

    from sievework.operators import classify

    texts = pa.RecordBatch.from_arrays([pa.array(["aa bb rare aa bb", "bb aa bb", None, ""])], ["t"])
    out = next(classify._pair_counts(["aa", "bb"])(iter([texts])))
    assert out.to_pydict() == {"pair": [1, 2], "n": [3, 1], "rows": [2, 1]}
    rnd = random.Random(3)
    df = spark.createDataFrame([(" ".join(f"w{int(rnd.expovariate(0.2))}" for _ in range(30)),) for _ in range(40)], "text string")
    model = classify.features(terms=20, embedding=0).fit(df).stages[3]
    # as all terms counted where they stand
    monkeypatch.setattr(classify, "WORDS", 1)
    plain = classify.features(terms=20, embedding=0).fit(df).stages[3]
    assert (model.vocabulary, model.idf) == (plain.vocabulary, plain.idf) and any(" " in v for v in model.vocabulary)


def test_fuzzy_deals_no_tokens_by_row_and_names_stand_as_runs(spark, monkeypatch):
    toks = spark.createDataFrame([(1, "pythonn"), (1, "java"), (2, "pythonn")], "id long, token string")
    known = spark.createDataFrame([("python",)], "skill string")
    rich = spark.createDataFrame([(2, x) for x in "abc"], "id long, skill string")
    out = skills.fuzzy(toks, "id", known, 90.0, found=rich)
    # rows with enough skills leave the hits, behind the join with the matched tokens
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert rows(out) == [(1, "python")] and plan.index("LeftAnti") < plan.index("Join Inner")
    monkeypatch.setattr(skills, "SEGMENTS", 0)
    assert rows(skills.fuzzy(toks, "id", known, 90.0, found=rich)) == [(1, "python")]
    texts = ["a b", "A, b... c", "ab", "a.b", "... a", "a ... b", "", None, "  ", "(b) a.\u0085 c", "b a b c d", "x.....a", "[a];b."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    names = spark.createDataFrame([(x,) for x in ("a", "A b", "b c", "a  b", "", " a", "a b c d", "a\u0085 c", "b")], "skill string")
    got = rows(skills.exact(df, "id", "t", names))
    monkeypatch.setattr(skills, "FEW", 0)
    assert got == rows(skills.exact(df, "id", "t", names)) and len(got) > 15


def test_chunks_of_odd_texts_without_a_fold_in_the_plan(spark):
    from sievework.operators import text as X

    texts = [None, "", " \n\n \x85", "aa bb\n\n cc ", "aaaa bbbb\u3000cccc dd\n \t\nee", "x" * 12 + " yy\n\nzz", "\U0001f600" * 9 + "\n\n" + "b"]
    out = X.paragraphs(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", 10, 3)
    # nothing is folded by an interpreted lambda for each word
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    smile = "\U0001f600"
    assert rows(out) == [(2, 0, "\x85"), (3, 0, "aa bb\ncc"), (4, 0, "aaaa bbbb"), (4, 1, "bbb cccc dd\nee"), (5, 0, "x" * 12), (5, 1, "xxx yy\nzz"), (6, 0, smile * 9), (6, 1, smile * 3 + " b")]


def test_phrases_of_a_batch_hold_some_texts_at_once():
    import pyarrow as pa

    from sievework.functions import phrases

    texts = pa.array(["x" * 5000 + " art of work"] * 3000 + [None, "", "part of workers"])
    out, most = _peak(lambda: phrases._finder(["art", "of work"])(texts))
    assert most < 5 and out.field("held").to_pylist() == [[0, 1]] * 3000 + [[], [], [0, 1]] and out.field("whole").to_pylist() == [[0, 1]] * 3000 + [[], [], []]
    assert len(phrases._finder(["art"])(texts.slice(0, 0))) == 0


def test_bm25_of_few_terms_leaves_only_what_can_be_among_the_best(spark, monkeypatch):
    rnd = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(["the", "of", "a", "b", "c"], k=rnd.randint(1, 9)))) for i in range(300)], "id long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "the a"), (2, "of b b")], "id long, text string")
    slim = retrieve.bm25_scores(docs, queries, k=2)
    assert slim.count() < retrieve.bm25_scores(docs, queries).count() / 4
    best = rows(retrieve.bm25(docs, queries, 2).selectExpr("query", "id", "round(score, 6)", "rank"))
    monkeypatch.setattr(retrieve, "TERMS", 0)
    assert best == rows(retrieve.bm25(docs, queries, 2).selectExpr("query", "id", "round(score, 6)", "rank")) and len(best) == 4


def test_row_order_and_partitions_dont_matter(spark):
    df = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "id int, t string")
    assert rows(dedup.exact(df, "id", "t")) == rows(dedup.exact(df.orderBy(F.desc("id")).repartition(5), "id", "t"))


def test_jobs_are_created_with_defaults_and_published_by_their_owner(spark):
    users = spark.createDataFrame([(1, "ann", "a@x.org", 7), (2, "", "bo@x.org", None), (3, None, None, None)], "user_id long, username string, email string, org_id long")
    recruiters = spark.createDataFrame([(10, 1, "Acme")], "recruiter_id long, user_id long, company_name string")
    orgs = spark.createDataFrame([(5,), (4,)], "org_id long")
    asked = spark.createDataFrame([(100, 1, "t", "draft", None), (101, 2, "t", "closed", "Beta"), (102, 2, "u", None, None), (103, 3, "v", "active", None)], "job_id long, user_id long, title string, status string, company_name string")
    jobs, new = hiring.create_jobs(asked, users, recruiters, orgs, "Unnamed", {"skills": 1.0})
    out = {r.job_id: r for r in jobs.collect()}
    assert [(out[k].org_id, out[k].status, out[k].company_name, out[k].location, out[k].experience_required) for k in sorted(out)] == [(7, "draft", "Acme", "Remote", 0), (4, "published", "Beta", "Remote", 0), (4, "published", "Beta", "Remote", 0), (4, "active", "Unnamed", "Remote", 0)]
    assert out[100].recruiter_id == "10" and out[101].recruiter_id == out[102].recruiter_id != out[103].recruiter_id and out[100].scoring_config == {"skills": 1.0}
    assert sorted((r.user_id, r.name, r.company_name) for r in new.collect()) == [(2, "bo", "Beta"), (3, "Recruiter", "Unnamed")]
    there = spark.createDataFrame([(1, "10", "draft"), (2, "11", "draft"), (3, None, "draft")], "job_id long, recruiter_id string, status string")
    done, refused = hiring.publish_jobs(there, spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 9), (99, 1)], "job_id long, user_id long"), recruiters)
    assert rows(done, "job_id", "status") == [(1, "published"), (2, "draft"), (3, "published")] and rows(refused) == [(2, 1)]


def test_profiles_take_supplied_fields_only(spark):
    base = spark.createDataFrame([(1, "old", 1999, ["a"], ["s"])], "id long, name string, year int, skills array<string>, education array<string>")
    changes = spark.createDataFrame([(1, ["name", "skills", "year"], None, "soon", " x, ,y", "no"), (2, ["education", "year"], "no", " 2021", "z", "uni")], "id long, supplied array<string>, name string, year string, skills string, education string")
    assert rows(hiring.upsert_profiles(base, changes, "id", ["education"], ["skills"], ["year"])) == [(1, None, None, ["x", "y"], ["s"]), (2, None, 2021, None, ["uni"])]
    people = spark.createDataFrame([(1, "Ann@X.org"), (2, None)], "id long, email string")
    assert rows(hiring.lookup(people, spark.createDataFrame([("  ann@x.ORG ",), (None,)], "email string"), ["email"], ["email"])) == [(1, "Ann@X.org")]


def test_ranks_over_ranges_equal_windows(spark):
    from pyspark.sql import Window

    from sievework.functions import ranks

    rnd = random.Random(3)
    data = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, 0.1, 0.5, 0.5, 0.9]), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v double, id int").repartition(5)
    order = [F.desc_nulls_last("v"), "id"]
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(rows(ranks.ranked(df, ["g"], order)), key=repr) == sorted(rows(want), key=repr)
    every = [r.id for r in df.orderBy(*order).collect()]
    for number, size in ((1, 7), (3, 50), (100, 5), (101, 5), (1, 1000)):
        assert [r.id for r in ranks.page(df, order, number, size).collect()] == every[(number - 1) * size : number * size]
    assert ranks.ranked(df.limit(0), ["g"], order).count() == 0 and ranks.page(df.limit(0), order, 1, 5).count() == 0


def test_sketches_of_parts_make_those_of_the_whole(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 500).alias("n"), F.concat(F.lit("t"), F.col("id")).alias("t"), F.lit(None).cast("string").alias("none"), (F.col("id") % 2 == 0).alias("flag"))
    stored = profile.sketches(df.where("t < 't2'")).unionByName(profile.sketches(df.where("t >= 't2'"))).unionByName(profile.sketches(df.limit(0)))
    out = {r.column: r for r in profile.from_sketches(profile.merged_sketches(stored)).collect()}
    assert (out["n"].rows, out["n"].nulls, out["n"].least, out["n"].most) == (3000, 1000, 0.0, 499.0) and abs(out["n"].median - 250) < 15
    assert abs(out["t"].unique_count - 3000) < 90 and out["t"].most == 5.0 and out["flag"].unique_count == 2 and out["flag"].median is None
    assert (out["none"].nulls, out["none"].unique_count, out["none"].mean, out["none"].median) == (3000, 0, None, None)


def test_schema_summary_counts_values_and_repeats(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, "a"), (3, "", "b" * 200)], "id int, x string, y string")
    out = {r.column: r for r in profile.schema_summary(df, "id", 2, 5).collect()}
    assert (out["x"].null_count, out["x"].unique_count, out["x"].samples) == (1, 2, ["a", "a"]) and out["y"].samples == ["a", "bbbbb"] and out["id"].unique_count == 3
    assert rows(profile.duplicate_rows(df, "id")) == [(1, 1)] and rows(profile.duplicate_rows(spark.createDataFrame([("a", None), (None, "a")], "x string, y string"), "x")) == [(0, 0)]


@pytest.mark.parametrize("least", [92.0, 80.0, 65.0])
def test_fuzzy_skills_equal_a_comparison_of_all(spark, least):
    rnd = random.Random(int(least))
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 26))) for _ in range(60)] + ["", "é" * 9]
    tokens = [(k, "".join(c for c in w if rnd.random() > 0.06) + rnd.choice(["", "a", "bc"])) for k, w in enumerate(words * 3)] + [(999, "é" * 10)]
    ratio = lambda a, b: skills.indel_ratio.func(__import__("pandas").Series([a]), __import__("pandas").Series([b]))[0]
    want = set()
    for k, t in tokens:
        best = min(((-ratio(t, w), w) for w in words if w), default=None) if len(t) >= 4 else None
        if best and -best[0] >= least:
            want.add((k, best[1]))
    out = skills.fuzzy(spark.createDataFrame(tokens, "id long, token string"), "id", spark.createDataFrame([(w,) for w in words], "skill string"), least)
    assert set(rows(out)) == want and len(want) > 10


@pytest.mark.parametrize(("k", "sample"), [(3, 1), (3, 4), (1, 1), (500, 2)])
def test_bm25_keeps_the_best_of_all_scores(spark, k, sample):
    rnd = random.Random(k)
    words = ["the"] * 30 + ["of"] * 10 + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(200)] + [(500, None), (501, ""), (502, "the"), (503, "the")]
    queries = [(1, "w1 w2 the"), (2, "the"), (3, "of w3 w3 W4 the"), (4, "absent"), (5, None)]
    want = []
    for q, text in queries:
        scores = {}
        for i, t in docs:
            own = (t or "").split()
            s = sum(own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.25 + 0.75 * len(own) / 50)) for w in (text or "").lower().split())
            if s:
                scores[i] = s
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]
        want += [(q, i, round(scores[i], 6), n + 1) for n, i in enumerate(best)]
    out = retrieve.bm25(spark.createDataFrame(docs, "id long, text string").repartition(7), spark.createDataFrame(queries, "id long, text string"), k, sample=sample)
    assert sorted((r.query, r.id, round(r.score, 6), r["rank"]) for r in out.collect()) == sorted(want)


def test_without_rare_labels_none_is_named(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "l string")
    assert rows(validate.label_distribution(df, "l", 2)) == [(0, None)] and rows(validate.label_distribution(df, "l", 3)) == [(2, "a,b")]


def test_families_of_equal_mass_to_six_places_are_tied(spark):
    p = spark.createDataFrame([(1, 0, 0.4000002), (1, 3, 0.2), (1, 4, 0.2000001), (2, 0, 0.7), (2, 3, 0.1)], "id long, class int, p double")
    families = spark.createDataFrame([(c, c // 3) for c in range(6)], "class int, family int")
    assert rows(decide.hierarchy(p, families), "id", "family", "predicted") == [(1, 1, 4), (2, 0, 0)]


def test_numbers_are_rounded_as_binary_products(spark):
    x = [(0.2579875, 0.257987), (0.5214785, 0.521478), (0.5, 0.5), (-0.0000015, -0.000002), (12.3456789, 12.345679)]
    df = spark.createDataFrame(x, "x double, want double")
    assert [tuple(r) for r in df.select(C.rounded(F.col("x"), 6), "want").collect()] == [(b, b) for _, b in x]


@pytest.mark.parametrize(("terms", "cells"), [(1 << 18, 1 << 23), (1 << 18, 10), (0, 10)])
def test_bm25_scores_are_those_of_all_pairs_with_a_term_in_common(spark, monkeypatch, terms, cells):
    monkeypatch.setattr(retrieve, "TERMS", terms)
    monkeypatch.setattr(retrieve, "CELLS", cells)
    rnd = random.Random(5)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(300)] + [(500, None), (501, ""), (502, "the"), (503, "The\nw1")]
    queries = [(1, "w1 w2 the"), (2, "the"), (3, "of w3 w3 W4 the"), (4, "absent"), (5, None)]
    want = []
    for q, text in queries:
        for i, t in docs:
            own = (t or "").lower().split()
            s = sum(own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.25 + 0.75 * len(own) / 50)) for w in (text or "").lower().split())
            want += [(q, i, round(s, 6))] * (s > 0)
    out = retrieve.bm25_scores(spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(queries, "id long, text string"))
    assert sorted((r.query, r.id, round(r.score, 6)) for r in out.collect()) == sorted(want) and len(want) > 600
    assert retrieve.bm25_scores(out.selectExpr("id", "'the' AS text"), spark.createDataFrame([(5, None)], "id long, text string")).count() == 0


def test_the_bm25_query_keeps_every_score(spark):
    from sievework.plans import plan_04_retrieval

    out = plan_04_retrieval.QUERIES["lex_bm25"](spark, "/root/testdata/sf0.001")
    assert out.groupBy("query").count().agg(F.max("count")).first()[0] > 10 and "rank" not in plan_04_retrieval.ORACLE["lex_bm25"].split("SELECT")[-1]


def _peak(f):
    """(result, MB of Python and numpy at the most)."""
    import tracemalloc

    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def test_a_block_of_vectors_needs_no_memory_for_all_its_scores():
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    asked, held = (pa.table({"id": pa.array(np.arange(n)), "vector": pa.array(list(rnd.random((n, 4))))}) for n in (1024, 16_384))
    out, most = _peak(lambda: retrieve._best_of_block(asked, held, 2))
    assert out.num_rows == 2048 and most < 60  # all scores: 134 MB
    x, y = (np.stack(t.column("vector").to_numpy()) for t in (asked, held))
    assert out.column("id").to_pylist()[:2] == list(np.argsort(-np.round(x[0] @ y.T, 9), kind="stable")[:2])


def test_an_embedding_holds_the_words_of_few_texts_at_once():
    import pyarrow as pa

    texts = pa.array([f"w{i} " + "ab cd " * 200 for i in range(2000)] + [None, ""])
    out, most = _peak(lambda: C._embedder(8 * 50)(texts))
    assert most < 2002 * 400 * 8 / 1e6 * 2 + 20 and len(out) == 2002  # the result twice, and a part's words
    assert out.slice(1999, 1).equals(C._embedder(400)(texts.slice(1999, 1))) and not any(out[2000].as_py())


def test_one_decimal_is_that_of_the_exact_double(spark):
    values = [0.0, 0.05, 0.25, 0.35, 0.45, 0.95, 0.96, 1.05, 1.25, 2.25, 2.675, 7.75, 8.35, 9.95, 10.05, 12.25, 99.95, 1234567.85, 4503599627370495.5]
    values += [random.Random(3).randrange(10**7) / 10 ** (1 + k % 6) for k in range(200)]
    found = spark.createDataFrame([(x,) for x in values], "x double").select("x", C.one_decimal(F.col("x")).alias("t")).collect()
    assert [r.t for r in found] == [f"{r.x:.1f}" for r in found]


def test_section_patterns_match_only_where_a_held_word_stands(spark):
    for name, pattern in quality.SECTIONS.items():
        for part in pattern.replace(r"\b(", "").replace(r")\b", "").split("|"):
            assert any(w in part for w in quality.HELD[name]), (name, part)
    odd = ["my sKills", "ſkılls", "skİlls", "SKILLS", "unskills", "skillset", "a@b.c", "a@b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id long, t string")
    found = {r.id: r.d for r in df.select("id", quality.sections(F.col("t"))[0].alias("d")).collect()}
    plain_way = {r.id: [n for n in quality.SECTIONS if r[n]] for r in df.select("id", *(F.col("t").rlike(f"(?iU){p}").alias(n) for n, p in quality.SECTIONS.items())).collect()}
    assert found == plain_way and all(found[i] == ["Skills & Competencies"] for i in range(4)) and found[6] == ["Contact Information"] and not found[4]


def test_sections_and_tense_cost_in_proportion_to_the_lines(spark):
    """A fold that copied all lines of a section for each further line took the square of them."""
    many = 40_000
    body = "Experience\n" + "\n".join(f"- manage item {i}" for i in range(many))
    df = spark.createDataFrame([(1, body)], "id long, t string")
    started = time.time()
    found = df.select(F.length(text.sections(F.col("t"))["experience"]).alias("n")).first().n
    assert found == len(body) - len("Experience\n") and time.time() - started < 20
    assert rows(spark.createDataFrame([(1, "a\nSkills:\n\nTools\nx\ny\nSkills\nExperience\n z \nEducation\n")], "id long, t string").select(F.to_json(text.sections(F.col("t"))))) == [('{"general":"a","skills":"x\\ny","experience":"z"}',)]


def test_migration_deals_no_new_key(spark):
    """New keys are hashes of 64 characters; joins take the old ones."""
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    users = frame([(1, "a@x"), (2, "b@x"), (11, "r@x")], "user_id long, email string")
    t = hiring.migrate(users, frame([(7, "B@X")], "user_id long, email string"), frame([(1, 1), (2, 2), (3, 3)], "candidate_id long, user_id long"), frame([(5, 11), (6, 12)], "recruiter_id long, user_id long"), frame([(20, 5), (21, 6), (22, None)], "job_id long, recruiter_id long"), frame([(1, 20, 1), (2, 21, 2), (3, 22, 3), (4, 23, 1)], "app_id long, job_id long, candidate_id long"))
    sha = lambda name, key: hashlib.sha256(f"{name}:{key}".encode()).hexdigest()
    assert rows(t["applications"], "app_id", "new_app", "new_job", "new_candidate", "new_user", "new_recruiter") == [
        (1, sha("application", 1), sha("job", 20), sha("candidate", 1), sha("user", 1), sha("recruiter", 5)),
        (2, sha("application", 2), sha("job", 21), sha("candidate", 2), "7", sha("recruiter", 5)),
    ]
    assert rows(t["jobs"]) == sorted([(j, sha("job", j), sha("recruiter", 5)) for j in (20, 21, 22)], key=repr)
    assert rows(t["candidates"]) == sorted([(1, sha("candidate", 1), sha("user", 1)), (2, sha("candidate", 2), "7")], key=repr)
    assert rows(t["recruiters"]) == [(5, sha("recruiter", 5), sha("user", 11))]
    plan = t["applications"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(") < plan.index("Join") and "sha2(" not in plan[plan.index("Join") :]
