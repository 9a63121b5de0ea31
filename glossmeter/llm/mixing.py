"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key that its quality weight scales (Efraimidis and Spirakis): key = -ln(u) / weight.
Within its source the documents with the smallest keys come first.  A source's token budget is first spent on complete
epochs, then on the documents whose prefix sum of sizes fits what is left; the one at the edge gives the words that still
fit.  The order over a source is never sorted in one task: rows are dealt into ranges of source and key at sampled quantiles,
about ROWS rows a range whatever the weights are, sums of ranges are summed up, and only within a range rows are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read

#: Rows of a range, about, up to so many ranges (then ranges hold more rows, narrow ones, which sort with spilling); weights of the
#: sources in their order; share of all sizes; most epochs.
ROWS, MOST_RANGES, WEIGHTS, SHARE, EPOCHS, SEED = 4096, 8192, (3, 1, 2), 1.5, 2, "mix-1"
WORD, SYMBOLS = r"[^\x20\x09-\x0D]+", "#*$%&|<>"


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text_col: str, size: Column) -> Column:
    """1 for plain prose, towards 0 as symbols crowd the words; 1 for no text."""
    symbols = F.length(text_col) - F.length(F.translate(F.col(text_col), SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.coalesce(symbols, F.lit(0)).cast("double") / F.greatest(size, F.lit(1)).cast("double"))


def uniform(id_col: str) -> Column:
    """(0, 1] from an MD5 of the id, the same in any engine; a null id counts as an empty one."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10)
    return (digits.cast("double") + 1.0) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size): weights repeat over the sources by code point, null last.

    A target stops at `most` times its source; what it leaves goes to the others by weight.  With sources ordered by the
    level at which they stop, those that stop are a prefix, so one pass of running sums finds the common level.  One task
    orders the sources, one short row each.
    """
    one = W.orderBy(F.col("source").asc_nulls_last())
    by_level = W.orderBy("stops_at", "nr")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    w = sizes.withColumn("nr", F.row_number().over(one) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("nr") % len(weights) + 1).cast("double"))
    w = w.withColumn("top", F.col("source_size").cast("double") * most).withColumn("stops_at", F.col("top") / F.col("weight"))
    w = w.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    w = w.withColumn("common", F.min(F.when(F.col("stops_at") >= F.col("level"), F.struct("stops_at", "nr", "level"))).over(everything)["level"])
    return w.select("source", "source_size", F.least(F.col("top"), F.coalesce(F.col("common") * F.col("weight"), F.col("top"))).alias("target"))


def mix_sources(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = EPOCHS, weight: Column | None = None) -> DataFrame:
    """The columns in keep, and besides them size, source, source_size, target, taken, key.

    Texts without words (null, empty) have size 0 and give nothing.  A null source is a source of its own, the last.  Equal
    keys go by id (null first), then size; rows that repeat an id have the same key and are interchangeable, and so are all rows without one, which share a key's uniform value.  No documents,
    no rows.  Columns besides those named are not read, so their names cannot clash.
    """
    size = size_of(text_col)
    slim = docs.select(*[docs[k].alias(f"k_{k}") for k in keep], docs[id_col].alias("id"), docs[source_col].alias("source"), size.alias("size"), (quality_weight(text_col, size) if weight is None else weight).alias("weight"))
    slim = slim.withColumn("key", -F.log(uniform("id")) / F.greatest(F.col("weight"), F.lit(1e-9))).withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    every = cut(slim.withColumn("row", F.monotonically_increasing_id()))
    slim = every.drop(*[f"k_{k}" for k in keep])

    per = slim.groupBy("s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goals = targets(per.select("source", "source_size"), weights, share, most).withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sources = cut(goals)

    # ranges of the order; the number of a row tells apart those that the order takes for equal, so no range has to hold a hot value
    ranges = max(1, min(MOST_RANGES, math.ceil(slim.count() / ROWS)))
    order = ("key", "id", "size", "row")
    dealt = slim.drop("source").repartitionByRange(ranges, "s", *order)
    rows = cut(dealt.withColumn("b", F.spark_partition_id()))
    sums = rows.groupBy("s", "b").agg(F.sum("size").alias("t"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("t").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("t")

    within = W.partitionBy("s", "b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["s", "b"]).join(sources, "s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("own")))
    out = {"size": F.col("size"), "source": F.col("source"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("taken"), "key": F.col("key")}
    rows = rows.withColumn("taken", taken.cast("long"))
    if set(keep) <= {id_col, source_col}:
        rows = rows.withColumns({f"k_{k}": F.col("id" if k == id_col else "source") for k in keep})
    else:  # what is wide moves once
        rows = rows.join(every.select("row", *[f"k_{k}" for k in keep]), "row")
    return rows.select(*[F.col(f"k_{k}").alias(k) for k in keep], *[c.alias(k) for k, c in out.items() if k not in keep])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    coalesce(length(text) - length(translate(text, '{SYMBOLS}', '')), 0) AS symbols,
    (CAST(CAST('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 1.0) / 281474976710656.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (1.0 / (1.0 + CAST(symbols AS DOUBLE) / CAST(greatest(size, 1) AS DOUBLE))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS nr FROM s),
w AS (SELECT *, CAST([3, 1, 2][nr % 3 + 1] AS DOUBLE) AS weight, 2.0 * CAST(source_size AS DOUBLE) AS top FROM n),
l AS (SELECT *, top / weight AS stops_at FROM w),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(top) OVER (ORDER BY stops_at, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY stops_at, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM l),
c AS (SELECT source, source_size, least(top, coalesce((SELECT arg_min(level, (stops_at, nr)) FROM v WHERE stops_at >= level) * weight, top)) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM c),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken
FROM p
"""
