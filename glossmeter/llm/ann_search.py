"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of codewords, one of each codebook; codebooks are full-dimensional and fitted one after another
on what the former leave.  Encoding is a beam search over sums.  With the squared norm of each sum stored, a query's
distance to it takes one look into a table of inner products a codebook.  Queries meet the codes of all rows in blocks of
bounded size on both sides; of each query the rows that look nearest over all blocks are ranked again by their exact distance,
and only for those do vectors move.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read

#: Rows that the codebooks are fitted on; codebooks, words in each, rounds of k-means; beam.
SAMPLE, BOOKS, WORDS, ROUNDS, BEAM = 8192, 32, 256, 6, 4
#: Rows and queries of a block; rows that are ranked exactly for each query; neighbours.
ROWS, QUERIES, SHORT, K = 16384, 1024, 256, 10


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """Codebooks [book, word, dimension] by k-means on residuals."""
    rng = np.random.default_rng(seed)
    left, out = sample.astype(np.float32).copy(), []
    words = max(1, min(words, len(sample)))
    for _ in range(books):
        c = left[np.sort(rng.choice(len(left), words, replace=False))].copy()
        for _ in range(ROUNDS):
            near = np.argmin((c * c).sum(1) - 2 * left @ c.T, axis=1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, near, left)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
        near = np.argmin((c * c).sum(1) - 2 * left @ c.T, axis=1)
        left -= c[near]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes [n, books], squared norm of the coded sum) by beam search over the codebooks."""
    n, x = len(x), x.astype(np.float32)
    left, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    cost = (left * left).sum(2)
    for c in books:
        total = cost[:, :, None] - 2 * (left @ c.T) + (c * c).sum(1)
        flat = total.reshape(n, -1)
        k = min(beam, flat.shape[1])
        best = np.argpartition(flat, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        i, w = best // len(c), best % len(c)
        codes = np.concatenate([np.take_along_axis(codes, i[:, :, None], 1), w[:, :, None].astype(np.uint8)], axis=2)
        left = np.take_along_axis(left, i[:, :, None], 1) - c[w]
        cost = np.take_along_axis(flat, best, 1)
    approx = x - left[:, 0]
    return codes[:, 0], (approx.astype(np.float64) ** 2).sum(1)


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    good = F.forall(vec, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(good & F.exists(vec, lambda v: v != 0), F.lit(False))


def _sample(df: DataFrame) -> np.ndarray:
    """At most SAMPLE vectors, drawn by a hash of id and vector; rows that repeat both count once."""
    drawn = df.select(F.xxhash64("id", "v").alias("o"), "v").withColumn("u", F.shiftrightunsigned("o", 12) / float(1 << 52))
    distinct = df.select(F.approx_count_distinct(F.xxhash64("id", "v"))).first()[0]
    drawn = drawn.where(F.col("u") <= min(1.0, 2.0 * SAMPLE / max(1, distinct))).groupBy("u").agg(F.min("v").alias("v"))
    return np.array([r["v"] for r in drawn.orderBy("u").limit(SAMPLE).collect()], np.float64)


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """The k nearest rows of each query row, Euclidean: query_id, rank (from 1), vec_id, score (exact distance in double).

    Rows without an id, and vectors that are null, zero or hold null or non-finite components, take no part, nor do those
    of another than the most frequent dimension.  Candidates are all rows but the query's own: another row with its id is
    one.  Ties go to the smaller id.  A repeated row is found as often as it is there; rows that repeat id and vector are
    asked once, and different vectors under one id each.  No usable vectors: no rows.
    """
    df = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    dims = df.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    spark = vectors.sparkSession
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = dims[0]["d"], dims[0]["count"]
    df = df.where(F.size("v") == dim)
    learned = spark.sparkContext.broadcast(fit(_sample(df)))

    def index(batches):
        for b in batches:
            for a in range(0, len(b), 1024):
                p = b.iloc[a : a + 1024]
                codes, norm = encode(np.stack(p["v"].to_list()), learned.value)
                yield pd.DataFrame({"id": p["id"], "v": p["v"], "asks": p["asks"], "codes": [c.tobytes() for c in codes], "norm": norm})

    kind = df.schema["v"].dataType.simpleString()
    coded = cut(df.mapInPandas(index, f"id long, v {kind}, asks boolean, codes binary, norm double"))
    table = coded.withColumn("row", F.monotonically_increasing_id())
    asked = cut(table.where("asks").groupBy("id", "v").agg(F.min("row").alias("row")))
    row_blocks, query_blocks = math.ceil(n / ROWS), max(1, math.ceil(asked.count() / QUERIES))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    block = lambda seed, m: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m))
    rows = table.select("id", "row", "codes", "norm", block(1, row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    asks = asked.select("row", "v", every(row_blocks).alias("rb"), block(2, query_blocks).alias("qb"))

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "row": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "near": pd.Series(dtype="float64")})
        r = r.sort_values(["id", "row"], kind="stable")
        ids, at = r["id"].to_numpy(np.int64), r["row"].to_numpy(np.int64)
        codes = np.ascontiguousarray(np.frombuffer(b"".join(r["codes"]), np.uint8).reshape(len(r), -1).T).astype(np.intp)
        norm, out = r["norm"].to_numpy(), []
        for query, v in zip(q["row"].to_numpy(np.int64), q["v"]):
            near = norm.copy()
            for m, x in enumerate(2 * (learned.value @ np.asarray(v, np.float32))):
                near -= x[codes[m]]
            near[at == query] = np.inf
            s = min(SHORT, len(near))
            edge = np.partition(near, s - 1)[s - 1]  # of equal codes the smaller ids, so ties are cut by id
            under, on = np.flatnonzero(near < edge), np.flatnonzero(near == edge)
            short = np.concatenate([under, on[: s - len(under)]])
            short = short[at[short] != query]
            out.append((np.full(len(short), query), at[short], ids[short], near[short]))
        a, b, c, d = map(np.concatenate, zip(*out))
        return pd.DataFrame({"query": a, "row": b, "id": c, "near": d})

    found = asks.groupBy("rb", "qb").cogroup(rows.groupBy("rb", "qb")).applyInPandas(meet, "query long, row long, id long, near double")
    nearest = W.partitionBy("query").orderBy("near", "id", "row")
    short = found.withColumn("nr", F.row_number().over(nearest)).where(F.col("nr") <= SHORT).select("query", "row", "id")
    far = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, d: s + d))
    pairs = short.join(table.select("row", F.col("v").alias("x")), "row").join(asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"), "v"), "query")
    scored = pairs.select("query", "query_id", F.col("id").alias("vec_id"), "row", far(F.col("v"), F.col("x")).alias("score"))
    best = W.partitionBy("query").orderBy("score", "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
