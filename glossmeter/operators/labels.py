"""Scores of paired labels from their confusion table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import ratio


def confusion(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, a (truth), b, n; pairs with a column n stand for so many."""
    n = F.sum("n") if "n" in pairs.columns else F.count("*")
    return pairs.groupBy(*(by or []), "a", "b").agg(n.alias("n"))


def per_label(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, label, tp, n_true, n_pred, precision, recall, fscore for every label of either side; 0 where undefined."""
    by = by or []
    rows = table.select(*by, F.explode(F.array(F.struct(F.col("a").alias("label"), F.lit(True).alias("t")), F.struct(F.col("b").alias("label"), F.lit(False).alias("t")))).alias("x"), "n", (F.col("a") == F.col("b")).alias("same")).select(*by, "x.*", "n", "same")
    s = rows.groupBy(*by, "label").agg(F.coalesce(F.sum(F.when(F.col("t") & F.col("same"), F.col("n"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(F.col("t"), F.col("n"))), F.lit(0)).alias("n_true"), F.coalesce(F.sum(F.when(~F.col("t"), F.col("n"))), F.lit(0)).alias("n_pred"))
    return s.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_true")), "fscore": ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_pred"))})


def averages(table: DataFrame, average: str | None = "micro", by: list[str] | None = None) -> DataFrame:
    """by, precision, recall, fscore; average: micro, macro or weighted (by n_true), or None: one row a label, with label."""
    by, p = by or [], per_label(table, by)
    if average is None:
        return p.select(*by, "label", "precision", "recall", "fscore")
    return p.groupBy(*by).agg(*_averages(average))


def _averages(average: str) -> list[Column]:
    """precision, recall, fscore over the rows of per_label()."""
    total = lambda c: F.sum(c)
    if average == "micro":
        tp, t, p = total("tp"), total("n_true"), total("n_pred")
        return [ratio(tp, p).alias("precision"), ratio(tp, t).alias("recall"), ratio(2 * tp, t + p).alias("fscore")]
    if average == "macro":
        return [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "fscore")]
    if average == "weighted":
        return [ratio(total(F.col(c) * F.col("n_true")), total("n_true")).alias(c) for c in ("precision", "recall", "fscore")]
    raise ValueError(f"average must be micro, macro, weighted or None, not {average!r}")


def _kappa() -> Column:
    tp, n, e = F.sum("tp"), F.sum("n_true"), F.sum(F.col("n_true").cast("double") * F.col("n_pred"))
    po, pe = F.try_divide(tp.cast("double"), n.cast("double")), F.try_divide(e, n.cast("double") * n)
    return F.when(n > 0, F.coalesce(F.try_divide(po - pe, 1.0 - pe), F.lit(float("nan")))).alias("kappa")


def scores(table: DataFrame, average: str = "micro", by: list[str] | None = None) -> DataFrame:
    """by, precision, recall, fscore, kappa, accuracy, from one pass over the confusion table."""
    accuracy = F.try_divide(F.sum("tp").cast("double"), F.sum("n_true").cast("double"))
    return per_label(table, by).groupBy(*(by or [])).agg(*_averages(average), _kappa(), accuracy.alias("accuracy"))


def micro_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, precision, recall, fscore, accuracy: micro averages and accuracy of scores(), from pairs themselves.

    Each pair has one truth and one prediction, so all of them are the share of pairs that agree, and a task keeps two counts, however many labels there are.
    """
    return shares(pairs.groupBy(*(by or [])).agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("tp"), F.count("*").alias("n"), F.count("*").alias("m")), by)


def shares(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """micro_scores() from tp, n (truths) and m (predictions)."""
    tp, n, m = (F.col(c) for c in ("tp", "n", "m"))
    return counts.select(*(by or []), ratio(tp, m).alias("precision"), ratio(tp, n).alias("recall"), ratio(2 * tp, n + m).alias("fscore"), F.try_divide(tp.cast("double"), n.cast("double")).alias("accuracy"))


def kappa(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, kappa (Cohen's, unweighted); NaN where chance agreement is 1, null without pairs."""
    return per_label(table, by).groupBy(*(by or [])).agg(_kappa())


def accuracy(table: DataFrame, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """by, accuracy; without pairs null, or an error if strict."""
    by = by or []
    s = table.groupBy(*by).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("n"))
    value = F.try_divide(F.col("c").cast("double"), F.col("n").cast("double"))
    return s.select(*by, (F.coalesce(value, F.raise_error(F.lit("no pairs")).cast("double")) if strict else value).alias("accuracy"))
