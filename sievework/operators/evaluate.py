"""Classification metrics and error analysis from predictions: true, predicted and further columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, true: str, predicted: str, classes: DataFrame) -> DataFrame:
    """Counts over all pairs of a fixed class list, zeros included; as many rows as classes squared."""
    grid = classes.select(F.col("class").alias("t")).crossJoin(classes.select(F.col("class").alias("p")))
    counts = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, true: str, predicted: str, digits: int = 4) -> DataFrame:
    """Support, precision, recall and F1 over the union of true and predicted labels; 0 where undefined."""
    cells = df.select(F.inline(F.array(F.struct(F.col(true).alias("class"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred"), (F.col(true) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred"), F.lit(0).alias("hit")))))
    c = cells.groupBy("class").agg(F.sum("is_true").alias("support"), F.sum("is_pred").alias("predicted"), F.sum("hit").alias("tp"))
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return c.select("class", "support", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f1, digits).alias("f1"))


def metrics(df: DataFrame, true: str, predicted: str) -> DataFrame:
    c = per_class(df, true, predicted, 12)
    n = F.sum("support")
    rates = c.agg(F.round(F.sum(F.col("recall") * F.col("support")) / n, 4).alias("accuracy"), F.round(F.avg("precision"), 4).alias("macro_precision"), F.round(F.avg("recall"), 4).alias("macro_recall"), F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / n, 4).alias("weighted_f1"), n.alias("rows"))
    return rates.crossJoin(df.agg(F.count_if(F.col(true) != F.col(predicted)).alias("errors")))  # one row each


def stratified(df: DataFrame, true: str, predicted: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg((F.col(true) == F.col(predicted)).cast("double")), 4).alias("accuracy"))


def gates(m: DataFrame, least: float = 0.90) -> DataFrame:
    names = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]
    every = F.lit(True)
    for n in names:
        every = every & (F.col(n) >= least)
    return m.select(*((F.col(n) >= least).alias(n) for n in names), every.alias("passed"))


def errors(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.where(F.col(true) != F.col(predicted))


def dual_view(df: DataFrame, views: dict[str, str], predicted: str) -> DataFrame:
    """Accuracy of one prediction against several label columns, in one pass."""
    long = df.select(predicted, F.inline(F.array(*(F.struct(F.lit(n).alias("view"), F.col(c).alias("label")) for n, c in views.items()))))
    return long.groupBy("view").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg((F.col("label") == F.col(predicted)).cast("double")), 4).alias("accuracy"))


def confusion_pairs(df: DataFrame, true: str, predicted: str, top: int = 10) -> DataFrame:
    pairs = errors(df, true, predicted).groupBy(F.least(true, predicted).alias("a"), F.greatest(true, predicted).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < 0.30).alias("unsure"))
    return pairs.orderBy(F.desc("n"), "a", "b").limit(top)


def family(df: DataFrame, true: str, predicted: str, rules: DataFrame) -> DataFrame:
    """Adds family and cause by the first rule that fits; null in a rule fits everything. rules: rule_ord, t, p, family, cause.

    The rule table is a dictionary; pairs of classes are joined with it, not rows.
    """
    pairs = df.select(F.col(true).alias("_t"), F.col(predicted).alias("_p")).distinct()
    fits = (F.coalesce(F.col("t") == F.col("_t"), F.col("t").isNull())) & (F.coalesce(F.col("p") == F.col("_p"), F.col("p").isNull()))
    found = pairs.join(F.broadcast(rules), fits, "left").groupBy("_t", "_p").agg(F.min_by(F.struct("family", "cause"), "rule_ord").alias("r"))
    return df.join(found, (F.col(true) == F.col("_t")) & (F.col(predicted) == F.col("_p"))).select(*df.columns, F.coalesce("r.family", F.lit("other")).alias("family"), F.coalesce("r.cause", F.lit("unknown")).alias("cause"))


def family_summary(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.avg("margin"), 4).alias("margin"))


def low_margin(df: DataFrame, true: str, predicted: str, below: float = 0.15) -> DataFrame:
    e = errors(df, true, predicted)
    return e.agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("margin") < below).alias("low_margin"), F.count_if(F.col("runner_up") == F.col(true)).alias("runner_up_correct"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.avg("margin"), 4).alias("margin"))
