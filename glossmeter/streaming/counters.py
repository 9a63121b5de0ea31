"""Running confusion tables and scores over a stream of paired labels or of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tokens import token_scores


def stream_confusion(pairs: DataFrame) -> DataFrame:
    """a, b, n so far; for the complete or update mode. State: one row a pair of labels."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def stream_token_scores(counts: DataFrame) -> DataFrame:
    """Scores of the counts (correct, n_gold, n_pred of a sentence) that have come so far; for the complete mode. State: one row."""
    return token_scores(counts)
