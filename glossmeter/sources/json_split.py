"""Reading the objects of JSON arrays (or JSON lines) by all tasks, however large one file is.

A file is read as text that "}" separates, which Spark splits by byte ranges like lines.  Whether a brace counts depends on what came before
it: whether a string is open, and how many objects are.  Each range says what it does for both ways to begin (within a string or not); one row a
range, these are carried over in order, and then every range knows its beginning and gives its objects.  Only objects that lie
over a range's edge are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ESCAPED = re.compile(r"\\.", re.S).sub


class _State:
    """Within a string or not, and the number of open objects, over chunks: what stands between one closing brace and the next."""

    def __init__(self, quoted: bool, depth: int = 0):
        self.quoted, self.depth = quoted, depth

    def close(self) -> bool:
        """The brace before a chunk; false if it is a string's character."""
        if not self.quoted:
            self.depth -= 1
        return not self.quoted

    def read(self, chunk: str) -> None:
        parts = (_ESCAPED("", chunk) if "\\" in chunk else chunk).split('"')
        self.depth += sum(p.count("{") for p in parts[int(self.quoted) :: 2])
        self.quoted ^= len(parts) % 2 == 0


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple[bool, str, dict]]]]:
    """((file, block), its chunks as (whether they begin the file, text, other columns)) of rows in order."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from b.to_pylist()

    for key, group in groupby(rows(), key=lambda r: (r["file"], r["block"])):
        yield key, ((k == 0 and key[1] == 0, r["value"] or "", r) for k, r in enumerate(group))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and each way to begin: the change of depth, the least depth that a brace closes to, how often, and whether strings flip."""
    for (file, block), chunks in _ranges(batches):
        both = [(_State(False), [1 << 40, 0]), (_State(True), [1 << 40, 0])]
        for begins, text, _ in chunks:
            for state, low in both:
                if not begins and state.close():
                    if state.depth < low[0]:
                        low[:] = state.depth, 0
                    low[1] += state.depth == low[0]
                state.read(text)
        row = {"file": file, "block": block, "flips": int(both[0][0].quoted)}
        for k, (state, low) in enumerate(both):
            row |= {f"d{k}": state.depth, f"low{k}": low[0], f"n{k}": low[1]}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), *[(c, pa.int64()) for c in ("block", "flips", "d0", "low0", "n0", "d1", "low1", "n1")]]))


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, n, block, text): whole objects with a null block, and the parts of others with the block that they come from."""
    kind = pa.schema([("file", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("text", pa.string())])
    for (file, block), chunks in _ranges(batches):
        out, state, parts, whole, n = [], None, [], False, 0
        for begins, text, row in chunks:
            if state is None:
                state, n = _State(row["quoted"], row["depth"]), row["ended"]
            if not begins and state.close() and not state.depth:
                if whole:
                    out.append({"file": file, "n": n, "block": None, "text": "}".join(parts) + "}"})
                elif parts:
                    out.append({"file": file, "n": n, "block": block, "text": "}".join(parts)})
                parts, whole, n = [], False, n + 1
            outside = not state.depth and not state.quoted
            state.read(text)
            if not outside:
                parts.append(text)
            elif state.depth:
                parts, whole = [text[text.index("{") :]], True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if parts:
            out.append({"file": file, "n": n, "block": block, "text": "}".join(parts)})
        yield pa.RecordBatch.from_pylist(out, kind)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0: files by name, then places in a file), text: the objects of the JSON arrays, or of the JSON lines, at path.

    Between objects stand white space, commas and the array's brackets.  A file that ends within an object fails the query.
    """
    chunks = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    per = chunks.select("file", "block", "value").mapInArrow(_summary, "file string, block long, flips long, d0 long, low0 long, n0 long, d1 long, low1 long, n1 long")
    order = W.partitionBy("file").orderBy("block")
    before, file = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("file")
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = per.withColumn("quoted", zero(F.sum("flips").over(before)) % 2 == 1)
    own = lambda c: F.when(F.col("quoted"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    per = per.select("file", "block", "flips", "quoted", *[own(c).alias(c) for c in ("d", "low", "n")])
    per = per.withColumn("depth", zero(F.sum("d").over(before)))
    per = per.withColumn("ends", F.when(F.col("low") == -F.col("depth"), F.col("n")).otherwise(0))
    per = per.withColumn("ended", zero(F.sum("ends").over(before))).withColumn("open", F.sum("d").over(file)).withColumn("odd", F.sum("flips").over(file) % 2 == 1)
    # the brace that ends a file has nothing behind it, so its object is still open
    per = per.withColumn("size", F.sum("ends").over(file) + F.col("open"))
    bad = F.raise_error(F.concat(F.lit("not whole JSON objects: "), F.col("file")))
    per = per.withColumn("size", F.when(F.col("odd") | ~F.col("open").isin(0, 1), bad.cast("long")).otherwise(F.col("size")))
    files = per.groupBy("file").agg(F.max("size").alias("size"))
    files = files.withColumn("first", zero(F.sum("size").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)))).select("file", "first")
    known = chunks.join(per.select("file", "block", "quoted", "depth", "ended"), ["file", "block"])
    known = known.withColumn("nr", F.row_number().over(W.partitionBy("file", "block").orderBy("id"))).where("nr > 0")  # a range whole in one task, in order
    found = known.mapInArrow(_objects, "file string, n long, block long, text string")
    parts = found.where("block IS NOT NULL").groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("x"))
    parts = parts.select("file", "n", F.concat(F.array_join(F.transform("x", lambda p: p["text"]), "}"), F.lit("}")).alias("text"))
    every = found.where("block IS NULL").select("file", "n", "text").unionByName(parts)
    return every.join(files, "file").select((F.col("first") + F.col("n")).alias("n"), "text")
