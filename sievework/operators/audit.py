"""Audits of labels by ordered rules and by a model's opinion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import phrases

CORRECT, WRONG, UNSURE, NOISY = "CORRECT_LABEL", "LIKELY_MISLABELED", "AMBIGUOUS", "POSSIBLY_NOISY"


#: (phrases, target, reason)
Rule = tuple[list[str], str, str]
#: Fixed value: what a reason gets if only the second window has a phrase.
LATER = " (identified in career history)"


def rule_match(text: Column, rules: list[Rule], windows: tuple[int, int] = (80, 200)) -> Column:
    """A struct of target and reason of the first rule of which a phrase stands, as whole words, in the first words, else of the first
    with one in more of them; null without. One pass over each window finds the phrases of all rules."""
    owner = {p.lower(): i for i, (ps, _, _) in reversed(list(enumerate(rules))) for p in ps}
    names, kind = list(owner), "struct<target:string,reason:string>"
    of = F.array(*(F.lit(owner[p]) for p in names))
    known = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(r).alias("reason")) for _, t, r in rules))

    def first(n: int) -> Column:
        head = F.lower(F.array_join(F.slice(C.words(text), 1, n), " "))
        return F.array_min(F.transform(phrases.found(head, names)["whole"], lambda k: F.get(of, k)))

    near, far = (F.get(known, first(n)) for n in windows)
    return F.when(near.isNotNull(), near.cast(kind)).when(far.isNotNull(), F.struct(far["target"].alias("target"), F.concat(far["reason"], F.lit(LATER)).alias("reason")).cast(kind))


def decide(rule: Column, label: Column, predicted: Column, confidence: Column) -> Column:
    agrees = (predicted == rule) | (confidence > 0.60)
    return F.when(rule == label, CORRECT).when(rule.isNotNull(), F.when(agrees, WRONG).otherwise(UNSURE)).when((predicted != label) & (confidence > 0.70), NOISY).otherwise(CORRECT)


#: Labels that name an industry; the cases (words, target, confidence) that tell what their holders do; then the words of levels and of a
#: setting that together blur a label, and the labels of that setting.
Industry = tuple[list[str], list[tuple[list[str], str, float]], list[str], list[str], list[str]]


def decide_blind(rule: Column, label: Column, text: Column, industry: Industry, n: int = 80) -> Column:
    """A struct of status, audited label and confidence without a model: 1.0 if the rule has the label, .95 if it has another; without a
    rule, industry labels by the first case of which the first `n` words hold a word, .60 if none does; .65 for a level within a
    setting that isn't the label's; else .85."""
    labels, cases, levels, setting, own = industry
    head = F.lower(F.array_join(F.slice(C.words(text), 1, n), " "))
    every = sorted({w.lower() for ws in ([c[0] for c in cases] + [levels, setting]) for w in ws})
    held = phrases.found(head, every)["held"]
    some = lambda ws: F.arrays_overlap(held, F.array(*(F.lit(every.index(w.lower())) for w in ws)))
    out = lambda status, audited, sure: F.struct(F.lit(status).alias("status"), audited.alias("audited"), F.lit(sure).alias("confidence"))
    tagged = out(UNSURE, label, 0.60)
    for words, target, sure in reversed(cases):
        tagged = F.when(some(words), out(WRONG, F.lit(target), sure)).otherwise(tagged)
    blurred = some(levels) & some(setting) & ~label.isin(*own)
    return F.when(rule == label, out(CORRECT, label, 1.0)).when(rule.isNotNull(), out(WRONG, rule, 0.95)).when(label.isin(*labels), tagged).when(blurred, out(UNSURE, label, 0.65)).otherwise(out(CORRECT, label, 0.85))


def apply_verdicts(df: DataFrame, key: str, label: str, verdicts: DataFrame) -> DataFrame:
    """Adds audited label, status and weight from earlier verdicts (key, audited, status); unseen rows are correct."""
    out = df.join(verdicts.select(key, "audited", "status"), key, "left")
    status = F.coalesce("status", F.lit(CORRECT))
    return out.withColumn("audited", F.when(status == WRONG, F.coalesce("audited", label)).otherwise(F.col(label))).withColumn("weight", weight(status)).withColumn("status", status)


def weight(status: Column) -> Column:
    return F.when(status.isin(UNSURE, NOISY), 0.5).otherwise(1.0)


def summary(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in (CORRECT, WRONG, UNSURE, NOISY)), F.round(100.0 * F.count_if(F.col("status") == CORRECT) / n, 2).alias("purity_pct"), F.round(100.0 * F.count_if(F.col("status") == WRONG) / n, 2).alias("mislabeled_pct"))


def taxonomy_matrix(df: DataFrame, label: str, audited: str, top: int = 3) -> DataFrame:
    """Per class: rows, rows that stay, leave and come, purity, and the most frequent destinations and origins."""
    moved = F.col(label) != F.col(audited)
    given = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~moved).alias("genuine"), F.count_if(moved).alias("out"))
    got = df.groupBy(F.col(audited).alias("class")).agg(F.count(F.lit(1)).alias("audited_rows"), F.count_if(moved).alias("in"))

    def ends(own: str, other: str, name: str) -> DataFrame:
        n = df.where(moved).groupBy(F.col(own).alias("class"), F.col(other).cast("string").alias("o")).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("class").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "o"))), 1, top), lambda x: x["o"]), ",").alias(name))

    out = given.join(got, "class", "full").join(ends(label, audited, "destinations"), "class", "left").join(ends(audited, label, "origins"), "class", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("class", *(zero(c).alias(c) for c in ("rows", "genuine", "out", "audited_rows", "in")), F.round(F.when(zero("rows") > 0, 100.0 * zero("genuine") / F.col("rows")).otherwise(0.0), 2).alias("purity_pct"), F.coalesce("destinations", F.lit("")).alias("destinations"), F.coalesce("origins", F.lit("")).alias("origins"))


def fragile(df: DataFrame, key: str, label: str, audited: str, status: str, reason: str, classes: list, samples: int = 5) -> DataFrame:
    """Of each named class: rows, purity (the share of correct labels), moved rows, where they went (audited label to rows) and the reasons
    of the first of them by key."""
    rows = df.where(F.col(label).isin(classes)).withColumn("class", F.col(label))
    moved = rows.where(F.col(status) == WRONG)
    size = rows.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.round(F.count_if(F.col(status) == CORRECT) / F.count(F.lit(1)), 4).alias("purity"), F.count_if(F.col(status) == WRONG).alias("moved"))
    went = moved.groupBy("class", audited).agg(F.count(F.lit(1)).alias("n")).groupBy("class").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(audited, "n")))).alias("went"))
    first = moved.withColumn("__n", F.row_number().over(Window.partitionBy("class").orderBy(key))).where(F.col("__n") <= samples)
    first = first.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(reason).alias("r")))), lambda x: x["r"]).alias("reasons"))
    return size.join(went, "class", "left").join(first, "class", "left")
