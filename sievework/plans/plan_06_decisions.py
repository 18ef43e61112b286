"""Classifier decisions, label audits and evaluation over probabilities derived from the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit as A
from ..operators import decide as D
from ..operators import evaluate as E
from .base import registrar, table

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

#: Softmax of the products with class centroids; model b has centroids of the even rows and is flatter.
PROBS = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
 ca AS (SELECT label AS class, i, avg(e) AS c FROM x GROUP BY ALL), cb AS (SELECT label AS class, i, avg(e) AS c FROM x WHERE vec_id % 2 = 0 GROUP BY ALL),
 sa AS (SELECT vec_id AS id, class, exp(20 * sum(e * c)) AS s FROM x JOIN ca USING (i) GROUP BY ALL), sb AS (SELECT vec_id AS id, class, exp(8 * sum(e * c)) AS s FROM x JOIN cb USING (i) GROUP BY ALL),
 pa AS (SELECT id, class, round(s / sum(s) OVER (PARTITION BY id), 9) AS p FROM sa), pb AS (SELECT id, class, round(s / sum(s) OVER (PARTITION BY id), 9) AS p FROM sb)"""


def _top(p: str, digits: int = 4, name: str = "tp") -> str:
    return f"""r{name} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS r FROM {p}),
 {name} AS (SELECT id, max(class) FILTER (r = 1) AS predicted, round_even(max(p) FILTER (r = 1), {digits}) AS confidence, max(class) FILTER (r = 2) AS runner_up, round_even(max(p) FILTER (r = 2), {digits}) AS runner_up_p, round_even(round_even(max(p) FILTER (r = 1), {digits}) - round_even(max(p) FILTER (r = 2), {digits}), {digits}) AS margin FROM r{name} GROUP BY id)"""


TOP = PROBS + ", " + _top("pa")
#: Predictions with the given label and an audited one.
PRED = TOP + ", pr AS (SELECT e.vec_id AS id, e.label AS given, CASE WHEN e.vec_id % 7 = 0 THEN tp.predicted ELSE e.label END AS audited, tp.predicted, tp.confidence, tp.margin, tp.runner_up, CASE WHEN e.vec_id % 7 = 0 AND tp.predicted <> e.label THEN 'LIKELY_MISLABELED' WHEN e.vec_id % 11 = 0 THEN 'AMBIGUOUS' WHEN e.vec_id % 13 = 0 THEN 'POSSIBLY_NOISY' ELSE 'CORRECT_LABEL' END AS status FROM embeddings e JOIN tp ON e.vec_id = tp.id)"


def _model(s, d, sharp: float, even: bool = False):
    x = table(s, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e")).withColumn("e", F.col("e").cast("double"))
    c = (x.where("vec_id % 2 = 0") if even else x).groupBy(F.col("label").alias("class"), "i").agg(F.avg("e").alias("c"))
    centroids = c.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda v: v["c"]).alias("c"))
    # one row per class on the right
    scored = table(s, d, "embeddings").crossJoin(F.broadcast(centroids)).select(F.col("vec_id").alias("id"), "class", F.exp(sharp * C.dot(F.col("embedding"), F.col("c"))).alias("s"))
    return scored.select("id", "class", F.round(F.col("s") / F.sum("s").over(D.by_id()), 9).alias("p"))


def _a(s, d):
    return _model(s, d, 20.0)


def _b(s, d):
    return _model(s, d, 8.0, even=True)


def _pred(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("given"))
    p = e.join(D.top2(_a(s, d)), "id")
    seventh = F.col("id") % 7 == 0
    status = F.when(seventh & (F.col("predicted") != F.col("given")), A.WRONG).when(F.col("id") % 11 == 0, A.UNSURE).when(F.col("id") % 13 == 0, A.NOISY).otherwise(A.CORRECT)
    return p.select("id", "given", F.when(seventh, F.col("predicted")).otherwise(F.col("given")).alias("audited"), "predicted", "confidence", "margin", "runner_up", status.alias("status"))


@query("occ_align_classes", f"WITH {PROBS} SELECT id, class, round(p / sum(p) OVER (PARTITION BY id), 6) AS p FROM pa WHERE class < 7")
def occ_align_classes(s, d):
    return D.align(_a(s, d), s.range(7).select(F.col("id").cast("int").alias("class"))).withColumn("p", F.round("p", 6))


@query("occ_top2", f"WITH {TOP} SELECT * FROM tp")
def occ_top2(s, d):
    return D.top2(_a(s, d))


@query("occ_review_gate", f"WITH {TOP} SELECT *, concat_ws('; ', CASE WHEN confidence < 0.4 THEN 'low confidence' END, CASE WHEN margin < 0.15 THEN 'small margin' END) AS review_reasons, confidence < 0.4 OR margin < 0.15 AS review_required FROM tp")
def occ_review_gate(s, d):
    return D.review_gate(D.top2(_a(s, d)))


@query("occ_empty", f"WITH {TOP} SELECT doc_id AS id, CASE WHEN trim(text) = '' OR predicted IS NULL THEN 'UNKNOWN' ELSE predicted::VARCHAR END AS predicted, CASE WHEN trim(text) = '' OR predicted IS NULL THEN 0.0::DOUBLE ELSE confidence END AS confidence, trim(text) = '' OR predicted IS NULL OR confidence < 0.4 OR margin < 0.15 AS review_required FROM documents LEFT JOIN tp ON doc_id = id")
def occ_empty(s, d):
    return D.with_empty(table(s, d, "documents"), "doc_id", "text", D.review_gate(D.top2(_a(s, d))))


@query("fus_poe", f"WITH {PROBS}, u AS (SELECT *, 0.55 / 0.8 AS f FROM pa UNION ALL SELECT *, 0.45 / 1.2 FROM pb), s AS (SELECT id, class, sum(f * ln(greatest(p, 1e-7))) AS s FROM u GROUP BY ALL), e AS (SELECT id, class, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM s) SELECT id, class, round(e / sum(e) OVER (PARTITION BY id), 6) AS p FROM e")
def fus_poe(s, d):
    both = _a(s, d).withColumn("model", F.lit("a")).unionByName(_b(s, d).withColumn("model", F.lit("b")))
    return D.product_of_experts(both, {"a": (0.55, 0.8), "b": (0.45, 1.2)}).withColumn("p", F.round("p", 6))


_GATE = "c AS (SELECT a.id, a.c < 0.25 AND b.c > 0.12 AS use_b FROM (SELECT id, max(p) AS c FROM pa GROUP BY id) a JOIN (SELECT id, max(p) AS c FROM pb GROUP BY id) b USING (id))"


@query("fus_gate", f"WITH {PROBS}, {_GATE} SELECT id, class, p, use_b FROM pa JOIN c USING (id) WHERE NOT use_b UNION ALL SELECT id, class, p, use_b FROM pb JOIN c USING (id) WHERE use_b")
def fus_gate(s, d):
    return D.gate(_a(s, d), _b(s, d), 0.25, 0.12)


@query("fus_override", f"WITH {PROBS}, r AS (SELECT pa.id, pa.class, CASE WHEN e.vec_id % 5 = 0 AND pa.class = e.label THEN max(p) OVER (PARTITION BY pa.id) + 0.05 ELSE p END AS p FROM pa JOIN embeddings e ON e.vec_id = pa.id) SELECT id, class, round(p / sum(p) OVER (PARTITION BY id), 6) AS p FROM r")
def fus_override(s, d):
    forced = table(s, d, "embeddings").where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), F.col("label").alias("class"))
    return D.override(_a(s, d), forced).withColumn("p", F.round("p", 6))


@query("fus_argmax", f"WITH {PROBS} SELECT id, arg_max(class, (p, -class)) AS predicted, max(p) AS confidence FROM pa GROUP BY id")
def fus_argmax(s, d):
    return D.argmax(_a(s, d))


@query("fus_pool_chunks", f"WITH {PROBS} SELECT id // 4 AS id, class, round(avg(p), 6) AS p FROM pa GROUP BY ALL")
def fus_pool_chunks(s, d):
    return D.pool_chunks(_a(s, d).withColumn("id", F.floor(F.col("id") / 4))).withColumn("p", F.round("p", 6))


@query("fus_linear", f"WITH {PROBS} SELECT id, class, round(0.7 * pa.p + (1 - 0.7) * pb.p, 5) AS p FROM pa JOIN pb USING (id, class)")
def fus_linear(s, d):
    return D.linear(_a(s, d), _b(s, d), 0.7).withColumn("p", F.round("p", 5))


_T = "tn AS (SELECT given AS i, audited AS j, count(*)::DOUBLE AS n FROM pr GROUP BY ALL), tz AS (SELECT i, j, sum(n) AS n FROM (SELECT * FROM tn UNION ALL SELECT DISTINCT v, v, 10.0 FROM (SELECT i AS v FROM tn UNION SELECT j FROM tn)) GROUP BY ALL), tt AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS t FROM tz)"


@query("fus_transition", f"WITH {PRED}, {_T} SELECT id, j AS class, round(sum(p * t), 5) AS p FROM pa JOIN tt ON class = i GROUP BY ALL")
def fus_transition(s, d):
    t = D.transition(_pred(s, d).select("given", F.col("audited").alias("true")))
    return D.project(_a(s, d), t).withColumn("p", F.round("p", 5))


KAPPA = [(0, 1, 1.3), (1, 0, 1.1), (2, 5, 1.5), (5, 2, 1.2), (3, 4, 2.0), (4, 3, 1.05)]


@query("fus_thresholds", f"WITH {TOP}, ts AS (SELECT id, class, p / (1 + class % 3 * 0.25) AS s FROM pa), sc AS (SELECT id, arg_max(class, (s, -class)) AS scaled FROM ts GROUP BY id), kp AS (SELECT sc.id, arg_max(b, (y.s, -b)) AS b FROM sc JOIN ts x ON x.id = sc.id AND x.class = scaled JOIN (VALUES " + ", ".join(map(str, KAPPA)) + ") k(a, b, kappa) ON a = scaled JOIN ts y ON y.id = sc.id AND y.class = b WHERE x.s <= kappa * y.s GROUP BY sc.id) SELECT id, CASE WHEN confidence >= 0.55 AND margin >= 0.25 THEN predicted ELSE coalesce(b, scaled) END AS predicted, confidence >= 0.55 AND margin >= 0.25 AS shielded FROM tp JOIN sc USING (id) LEFT JOIN kp USING (id)")
def fus_thresholds(s, d):
    tau = s.range(10).select(F.col("id").cast("int").alias("class"), (1 + F.col("id") % 3 * 0.25).alias("tau"))
    return D.thresholds(_a(s, d), tau, kappa=s.createDataFrame(KAPPA, "a int, b int, kappa double"))


@query("fus_meta_features", f"WITH {PROBS}, {_top('pa', 6)} SELECT id, round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END), 5) AS entropy, any_value(predicted) AS predicted, any_value(confidence) AS confidence, any_value(margin) AS margin FROM pa JOIN tp USING (id) GROUP BY id")
def fus_meta_features(s, d):
    return D.meta_features(_a(s, d)).withColumn("entropy", F.round("entropy", 5))


@query("occ_hierarchy", f"WITH {PROBS}, f AS (SELECT *, class // 3 AS family FROM pa), m AS (SELECT id, family, sum(p) AS m FROM f GROUP BY ALL), b AS (SELECT id, arg_max(family, (round(m, 6), family)) AS family FROM m GROUP BY id) SELECT id, family, arg_max(class, (p, -class)) AS predicted FROM f JOIN b USING (id, family) GROUP BY ALL")
def occ_hierarchy(s, d):
    return D.hierarchy(_a(s, d), s.range(10).select(F.col("id").cast("int").alias("class"), F.floor(F.col("id") / 3).cast("int").alias("family")))


#: 22 rules in order; the words are those of the tables.
RULES = [
    (["idiot", "stupid"], "toxic", "an insult"), (["click here", "subscribe now", "all rights reserved"], "junk", "boilerplate"),
    *(([a], lang, f"{lang} words: {a}") for lang, pairs in {"de": ["die der", "der die", "und die", "die und", "in die"], "es": ["de los", "que el", "el de", "los que", "de el"], "fr": ["les des", "des les", "la de", "de la", "que la"], "en": ["in the", "to the", "and the", "of the", "the and"]}.items() for a in pairs),
]
INDUSTRY = (["es", "de"], [(["que", "con"], "fr", 0.90), (["the"], "en", 0.90), (["en", "ung"], "de", 0.85)], ["tion", "ment"], ["aux", "and"], ["en"])
_HEAD = r"array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1:{n}], ' ')"
_FIRST = lambda n: "CASE " + " ".join(f"WHEN regexp_matches({_HEAD.format(n=n)}, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(ps)})(?:$|[^\\p{{L}}\\p{{N}}_])') THEN {i}" for i, (ps, _, _) in enumerate(RULES)) + " END"
_NAMED = lambda c, k: f"CASE {c} " + " ".join(f"WHEN {i} THEN '{r[k]}'" for i, r in enumerate(RULES)) + " END"
AUD = f"a0 AS (SELECT *, {_FIRST(80)} AS near, {_FIRST(200)} AS far FROM documents), au AS (SELECT doc_id, lang, text, coalesce({_NAMED('near', 1)}, {_NAMED('far', 1)}) AS rule, coalesce({_NAMED('near', 2)}, {_NAMED('far', 2)} || '{A.LATER}') AS reason, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, CASE WHEN doc_id % 9 = 0 THEN 'en' ELSE lang END AS predicted, (doc_id % 10) / 10.0 AS confidence FROM a0)"
_DECIDE = "CASE WHEN rule = lang THEN 'CORRECT_LABEL' WHEN rule IS NOT NULL THEN CASE WHEN predicted = rule OR confidence > 0.6 THEN 'LIKELY_MISLABELED' ELSE 'AMBIGUOUS' END WHEN predicted <> lang AND confidence > 0.7 THEN 'POSSIBLY_NOISY' ELSE 'CORRECT_LABEL' END"


def _audit(s, d):
    docs = table(s, d, "documents")
    docs = docs.withColumn("match", A.rule_match(F.col("text"), RULES))
    return docs.select("doc_id", "lang", "text", F.col("match.target").alias("rule"), F.col("match.reason").alias("reason"), C.word_count(F.col("text")).alias("words"), F.when(F.col("doc_id") % 9 == 0, "en").otherwise(F.col("lang")).alias("predicted"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"))


@query("aud_rule_match", f"WITH {AUD} SELECT doc_id, rule, reason FROM au")
def aud_rule_match(s, d):
    return _audit(s, d).select("doc_id", "rule", "reason")


@query("aud_decide", f"WITH {AUD} SELECT doc_id, {_DECIDE} AS status FROM au")
def aud_decide(s, d):
    return _audit(s, d).select("doc_id", A.decide(F.col("rule"), F.col("lang"), F.col("predicted"), F.col("confidence")).alias("status"))


def _blind_sql() -> str:
    labels, cases, levels, setting, own = INDUSTRY
    some = lambda ws: "(" + " OR ".join(f"contains({_HEAD.format(n=80)}, '{w}')" for w in ws) + ")"
    quoted = lambda ws: ", ".join(f"'{w}'" for w in ws)
    row = lambda status, audited, sure: f"{{'status': '{status}', 'audited': {audited}, 'confidence': {sure}::DOUBLE}}"
    tagged = "CASE " + " ".join(f"WHEN {some(ws)} THEN {row(A.WRONG, repr(t), c)}" for ws, t, c in cases) + f" ELSE {row(A.UNSURE, 'lang', 0.6)} END"
    return f"CASE WHEN rule = lang THEN {row(A.CORRECT, 'lang', 1.0)} WHEN rule IS NOT NULL THEN {row(A.WRONG, 'rule', 0.95)} WHEN lang IN ({quoted(labels)}) THEN {tagged} WHEN {some(levels)} AND {some(setting)} AND lang NOT IN ({quoted(own)}) THEN {row(A.UNSURE, 'lang', 0.65)} ELSE {row(A.CORRECT, 'lang', 0.85)} END"


@query("aud_blind", f"WITH {AUD}, b AS (SELECT doc_id, {_blind_sql()} AS b FROM au) SELECT doc_id, b.status AS status, b.audited AS audited, b.confidence AS confidence FROM b")
def aud_blind(s, d):
    return _audit(s, d).select("doc_id", A.decide_blind(F.col("rule"), F.col("lang"), F.col("text"), INDUSTRY).alias("b")).select("doc_id", "b.*")


@query("aud_apply_verdicts", f"WITH {AUD}, v AS (SELECT doc_id, rule AS audited, {_DECIDE} AS status FROM au WHERE doc_id % 3 = 0) SELECT d.doc_id, d.lang, CASE WHEN coalesce(v.status, 'CORRECT_LABEL') = 'LIKELY_MISLABELED' THEN coalesce(v.audited, d.lang) ELSE d.lang END AS audited, coalesce(v.status, 'CORRECT_LABEL') AS status, CASE WHEN coalesce(v.status, 'CORRECT_LABEL') IN ('AMBIGUOUS', 'POSSIBLY_NOISY') THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM documents d LEFT JOIN v USING (doc_id)")
def aud_apply_verdicts(s, d):
    # an earlier audit saw every third document
    seen = _audit(s, d).where("doc_id % 3 = 0")
    v = seen.select("doc_id", F.col("rule").alias("audited"), A.decide(F.col("rule"), F.col("lang"), F.col("predicted"), F.col("confidence")).alias("status"))
    return A.apply_verdicts(table(s, d, "documents").select("doc_id", "lang"), "doc_id", "lang", v).select("doc_id", "lang", "audited", "status", "weight")


@query("aud_weights", f"WITH {PRED} SELECT id, CASE WHEN status IN ('AMBIGUOUS', 'POSSIBLY_NOISY') THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM pr")
def aud_weights(s, d):
    return _pred(s, d).select("id", A.weight(F.col("status")).alias("weight"))


@query("aud_union", f"WITH {AUD} SELECT doc_id, rule, 'train' AS audit_split FROM au WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, rule, 'val' FROM au WHERE doc_id % 5 = 0")
def aud_union(s, d):
    a = _audit(s, d).select("doc_id", "rule")
    return a.where("doc_id % 5 <> 0").withColumn("audit_split", F.lit("train")).unionByName(a.where("doc_id % 5 = 0").withColumn("audit_split", F.lit("val")))


_SUM = ", ".join(f"count(*) FILTER (status = '{x}') AS {x.lower()}" for x in (A.CORRECT, A.WRONG, A.UNSURE, A.NOISY))


@query("aud_summary", f"WITH {PRED} SELECT count(*) AS rows, {_SUM}, round(100.0 * count(*) FILTER (status = 'CORRECT_LABEL') / count(*), 2)::DOUBLE AS purity_pct, round(100.0 * count(*) FILTER (status = 'LIKELY_MISLABELED') / count(*), 2)::DOUBLE AS mislabeled_pct FROM pr")
def aud_summary(s, d):
    return A.summary(_pred(s, d))


def _ends(own: str, other: str, name: str) -> str:
    return f"{name} AS (SELECT class, array_to_string(list_sort(list({{'m': -n, 'o': o}}))[1:3].list_transform(lambda z: z.o), ',') AS {name} FROM (SELECT {own} AS class, {other}::VARCHAR AS o, count(*) AS n FROM pr WHERE given <> audited GROUP BY ALL) GROUP BY class)"


@query("aud_taxonomy_matrix", f"""WITH {PRED}, g AS (SELECT given AS class, count(*) AS rows, count(*) FILTER (given = audited) AS genuine, count(*) FILTER (given <> audited) AS o FROM pr GROUP BY given), a AS (SELECT audited AS class, count(*) AS audited_rows, count(*) FILTER (given <> audited) AS i FROM pr GROUP BY audited), {_ends('given', 'audited', 'destinations')}, {_ends('audited', 'given', 'origins')}
 SELECT class, coalesce(rows, 0) AS rows, coalesce(genuine, 0) AS genuine, coalesce(o, 0) AS "out", coalesce(audited_rows, 0) AS audited_rows, coalesce(i, 0) AS "in", round(CASE WHEN rows > 0 THEN 100.0 * genuine / rows ELSE 0 END, 2)::DOUBLE AS purity_pct, coalesce(destinations, '') AS destinations, coalesce(origins, '') AS origins FROM g FULL JOIN a USING (class) LEFT JOIN destinations USING (class) LEFT JOIN origins USING (class)""")
def aud_taxonomy_matrix(s, d):
    return A.taxonomy_matrix(_pred(s, d), "given", "audited")


@query("aud_fragile", f"""WITH {PRED}, p AS (SELECT *, id || ': ' || given || ' is ' || audited AS reason FROM pr WHERE given IN (1, 4)), m AS (SELECT *, row_number() OVER (PARTITION BY given ORDER BY id) AS n FROM p WHERE status = 'LIKELY_MISLABELED'),
 w AS (SELECT given, string_agg(audited || '=' || n, ',' ORDER BY audited) AS went FROM (SELECT given, audited, count(*) AS n FROM m GROUP BY ALL) GROUP BY given), r AS (SELECT given, string_agg(reason, '; ' ORDER BY n) AS reasons FROM m WHERE n <= 5 GROUP BY given)
 SELECT given AS class, count(*) AS rows, round(count(*) FILTER (status = 'CORRECT_LABEL') / count(*), 4)::DOUBLE AS purity, count(*) FILTER (status = 'LIKELY_MISLABELED') AS moved, any_value(went) AS went, any_value(reasons) AS reasons FROM p LEFT JOIN w USING (given) LEFT JOIN r USING (given) GROUP BY given""")
def aud_fragile(s, d):
    p = _pred(s, d).withColumn("reason", F.concat("id", F.lit(": "), "given", F.lit(" is "), "audited"))
    went = F.array_join(F.transform(F.array_sort(F.map_entries("went")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return A.fragile(p, "id", "given", "audited", "status", "reason", [1, 4]).select("class", "rows", "purity", "moved", went.alias("went"), F.array_join("reasons", "; ").alias("reasons"))


@query("evl_confusion", f"WITH {PRED} SELECT t.range::INT AS t, p.range::INT AS p, count(id) AS n FROM range(10) t CROSS JOIN range(10) p LEFT JOIN pr ON audited = t.range AND predicted = p.range GROUP BY ALL")
def evl_confusion(s, d):
    return E.confusion(_pred(s, d), "audited", "predicted", s.range(10).select(F.col("id").cast("int").alias("class")))


def _per(true: str, digits: int) -> str:
    return f"cl AS (SELECT class, sum(t)::BIGINT AS support, sum(p)::BIGINT AS np, sum(h)::BIGINT AS tp FROM (SELECT {true} AS class, 1 AS t, 0 AS p, ({true} = predicted)::INT AS h FROM pr UNION ALL SELECT predicted, 0, 1, 0 FROM pr) GROUP BY class), pc AS (SELECT class, support, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS pre, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM cl), per AS (SELECT class, support, round(pre, {digits}) AS precision, round(rec, {digits}) AS recall, round(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END, {digits}) AS f1 FROM pc)"


_MET = "met AS (SELECT round(sum(recall * support) / sum(support), 4) AS accuracy, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1, sum(support)::BIGINT AS rows FROM per)"


@query("evl_per_class", f"WITH {PRED}, {_per('audited', 4)} SELECT * FROM per")
def evl_per_class(s, d):
    return E.per_class(_pred(s, d), "audited", "predicted")


@query("evl_metrics", f"WITH {PRED}, {_per('audited', 12)}, {_MET} SELECT *, (SELECT count(*) FROM pr WHERE audited <> predicted) AS errors FROM met")
def evl_metrics(s, d):
    return E.metrics(_pred(s, d), "audited", "predicted")


@query("evl_stratified", f"WITH {PRED} SELECT status, count(*) AS rows, round(avg((audited = predicted)::INT::DOUBLE), 4) AS accuracy FROM pr GROUP BY status")
def evl_stratified(s, d):
    return E.stratified(_pred(s, d), "audited", "predicted", "status")


@query("evl_gates", f"WITH {PRED}, {_per('audited', 12)}, {_MET} SELECT accuracy >= 0.3 AS accuracy, macro_precision >= 0.3 AS macro_precision, macro_recall >= 0.3 AS macro_recall, macro_f1 >= 0.3 AS macro_f1, weighted_f1 >= 0.3 AS weighted_f1, least(accuracy, macro_precision, macro_recall, macro_f1, weighted_f1) >= 0.3 AS passed FROM met")
def evl_gates(s, d):
    return E.gates(E.metrics(_pred(s, d), "audited", "predicted"), 0.3)


@query("evl_errors", f"WITH {PRED} SELECT id, audited, predicted, confidence FROM pr WHERE audited <> predicted")
def evl_errors(s, d):
    return E.errors(_pred(s, d), "audited", "predicted").select("id", "audited", "predicted", "confidence")


@query("evl_dual_view", f"WITH {PRED} SELECT 'original' AS view, count(*) AS rows, round(avg((given = predicted)::INT::DOUBLE), 4) AS accuracy FROM pr UNION ALL SELECT 'audited', count(*), round(avg((audited = predicted)::INT::DOUBLE), 4) FROM pr")
def evl_dual_view(s, d):
    return E.dual_view(_pred(s, d), {"original": "given", "audited": "audited"}, "predicted")


@query("evl_confusion_pairs", f"WITH {PRED} SELECT least(audited, predicted) AS a, greatest(audited, predicted) AS b, count(*) AS n, count(*) FILTER (confidence < 0.3) AS unsure FROM pr WHERE audited <> predicted GROUP BY ALL ORDER BY n DESC, a, b LIMIT 10")
def evl_confusion_pairs(s, d):
    return E.confusion_pairs(_pred(s, d), "audited", "predicted")


FAMILIES = [(1, 0, None, "zero", "source"), (2, None, 3, "into three", "target"), (3, 5, 6, "five six", "pair")]
_FAM = "fam AS (SELECT *, CASE WHEN audited = 0 THEN 'zero' WHEN predicted = 3 THEN 'into three' WHEN audited = 5 AND predicted = 6 THEN 'five six' ELSE 'other' END AS family, CASE WHEN audited = 0 THEN 'source' WHEN predicted = 3 THEN 'target' WHEN audited = 5 AND predicted = 6 THEN 'pair' ELSE 'unknown' END AS cause FROM pr WHERE audited <> predicted)"


def _families(s, d):
    rules = s.createDataFrame(FAMILIES, "rule_ord int, t int, p int, family string, cause string")
    return E.family(E.errors(_pred(s, d), "audited", "predicted"), "audited", "predicted", rules)


@query("err_profile", f"WITH {PRED} SELECT id, audited, predicted, runner_up, confidence, margin, audited || ' -> ' || predicted AS pair, d.n_chars, len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda x: x <> ''))::INT AS n_words, d.lang FROM pr JOIN documents d ON d.doc_id = id WHERE audited <> predicted AND status = 'CORRECT_LABEL'")
def err_profile(s, d):
    e = E.errors(_pred(s, d), "audited", "predicted").where(F.col("status") == A.CORRECT)
    e = e.withColumn("pair", F.concat("audited", F.lit(" -> "), "predicted"))
    return e.join(table(s, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", C.word_count(F.col("text")).alias("n_words"), "lang"), "id").drop("given", "status")


@query("err_family", f"WITH {PRED}, {_FAM} SELECT id, family, cause FROM fam")
def err_family(s, d):
    return _families(s, d).select("id", "family", "cause")


_SHARE = "SELECT '{0}' AS by, {0} AS name, count(*) AS n, round(avg(confidence), 4) AS confidence, round(avg(margin), 4) AS margin FROM fam GROUP BY {0}"


@query("err_family_summary", f"WITH {PRED}, {_FAM} {_SHARE.format('family')} UNION ALL {_SHARE.format('cause')}")
def err_family_summary(s, d):
    f = _families(s, d)
    one = lambda by: E.family_summary(f, by).select(F.lit(by).alias("by"), F.col(by).alias("name"), "n", "confidence", "margin")
    return one("family").unionByName(one("cause"))


@query("err_low_margin", f"WITH {PRED} SELECT count(*) AS errors, count(*) FILTER (margin < 0.15) AS low_margin, count(*) FILTER (runner_up = audited) AS runner_up_correct, round(avg(confidence), 4) AS confidence, round(avg(margin), 4) AS margin FROM pr WHERE audited <> predicted")
def err_low_margin(s, d):
    return E.low_margin(_pred(s, d), "audited", "predicted")
