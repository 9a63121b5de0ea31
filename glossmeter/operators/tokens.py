"""Token match against a reference: precision, recall, F."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where that is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def token_counts(items: DataFrame) -> DataFrame:
    """sent_id, correct, n_gold, n_pred. All items count, compounds too; lists in non-decreasing order of start.

    The nth item of a start on one side meets the nth of that start on the other and is correct if the ends agree.
    Both sides stay in the same rows, so the only exchange is on sent_id (none if the items are dealt by it already).  Rows sort by start
    first, which is nearly the order that they come in.
    """
    dealt = items.select("sent_id", "side", "ord", "start", "end")
    rows = dealt.withColumn("n", F.row_number().over(W.partitionBy("sent_id", "start", "side").orderBy("ord")))
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("end")))
    cells = rows.groupBy("sent_id", "start", "n").agg(of("a").alias("a"), of("b").alias("b"))
    return cells.groupBy("sent_id").agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("correct"), F.count("a").alias("n_gold"), F.count("b").alias("n_pred"))


def token_counts_any_order(items: DataFrame) -> DataFrame:
    """The same for lists in any order: two cursors go over both lists as given; the one with the smaller start moves on, and both at equal starts.

    A sentence's lists are two arrays of one row, and the cursors a fold's state.
    """
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("ord", "start", "end")))).alias(s)
    lists = items.select("sent_id", "side", "ord", "start", "end").groupBy("sent_id").agg(of("a"), of("b"))
    state = lambda i, j, correct: F.struct(i.alias("i"), j.alias("j"), correct.alias("correct"))
    zero = F.lit(0)

    def step(c: Column, _: Column) -> Column:
        x, y = F.get(F.col("a"), c["i"]), F.get(F.col("b"), c["j"])
        both = state(c["i"] + 1, c["j"] + 1, c["correct"] + F.when(x["end"] == y["end"], 1).otherwise(0))
        return F.when(x["start"] == y["start"], both).when(x["start"] < y["start"], state(c["i"] + 1, c["j"], c["correct"])).when(x["start"] > y["start"], state(c["i"], c["j"] + 1, c["correct"])).otherwise(c)

    steps = F.sequence(F.lit(1), F.size("a") + F.size("b"))  # beyond the end of a list nothing changes
    done = F.aggregate(steps, state(zero, zero, zero), step)["correct"]
    long = lambda c, name: c.cast("long").alias(name)
    return lists.select("sent_id", long(done, "correct"), long(F.size("a"), "n_gold"), long(F.size("b"), "n_pred"))


def token_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts summed over `by` ([]: the corpus), precision, recall, fscore."""
    s = counts.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("correct", "n_gold", "n_pred")])
    c, g, p = F.col("correct"), F.col("n_gold"), F.col("n_pred")
    return s.withColumns({"precision": ratio(c, p), "recall": ratio(c, g), "fscore": ratio(2 * c, g + p)})
