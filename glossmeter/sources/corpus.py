"""Corpus files and the item table.

A corpus file is one JSON array of sentences; the item table has one row an item:
sent_id long, side ('a' gold, 'b' pred), ord int (place in its list), item, start, end (code points, end exclusive),
pos, lemma, is_min, is_stop, ner_label (null: no entity).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_split import json_objects

ITEM = T.StructType([
    T.StructField("item", T.StringType()), T.StructField("startOffSet", T.IntegerType()), T.StructField("endOffSet", T.IntegerType()),
    T.StructField("pos", T.StringType()), T.StructField("lemma", T.StringType()), T.StructField("isMinimumToken", T.BooleanType()),
    T.StructField("isStopWord", T.BooleanType()), T.StructField("ner", T.StringType()),
])
#: The ner field is "" or a list; as a string it keeps its JSON, so neither is lost.
SENTENCE = T.StructType([T.StructField("query", T.StringType()), T.StructField("expanded_query", T.StringType()), T.StructField("gold", T.ArrayType(ITEM)), T.StructField("pred", T.ArrayType(ITEM))])
#: Sentences and characters after which compose() hands on what it has.
PIECE_ROWS, PIECE_CHARS = 256, 1 << 18
COLUMNS = ("sent_id", "side", "ord", "item", "start", "end", "pos", "lemma", "is_min", "is_stop", "ner_label")


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of JSON arrays (or of JSON lines), with the explicit schema; sent_id counts them from 0, files by name, then places in a file.

    sent_id does not depend on how files were dealt to tasks, so two corpora pair by it.  One large array is read by all tasks.
    """
    rows = json_objects(spark, path).withColumn("x", F.from_json("text", SENTENCE))
    return rows.select(*[F.col(f"x.{c}").alias(c) for c in SENTENCE.names], F.col("n").alias("sent_id"))


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sentences sent_id, gold, pred from two corpora whose sentences have the same sent_id; what only one of them has is left out.

    A corpus is a table of sentences with sent_id and items in gold, or in pred where it has no gold.
    """
    side = lambda df, name: df.select("sent_id", F.coalesce(*[F.col(c) for c in ("gold", "pred") if c in df.columns]).alias(name))
    return side(a, "gold").join(side(b, "pred"), "sent_id")


def _plain(sentences: DataFrame) -> DataFrame:
    """As the file has them: an item without an entity has ner ""."""
    ner = lambda x: F.transform(x, lambda i: i.withField("ner", F.coalesce(i["ner"], F.lit(""))))
    return sentences.withColumns({side: ner(F.col(side)) for side in ("gold", "pred") if side in sentences.columns})


def save_json(sentences: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, non-ASCII characters as they are; one file a partition."""
    _plain(sentences).drop("sent_id").write.mode("overwrite").json(path)


def save_json_array(sentences: DataFrame, path: str) -> None:
    """One file at path with one JSON array, in order of sent_id, UTF-8, non-ASCII characters as they are.

    All tasks write: sentences are dealt by ranges of sent_id, each range a file in order, and the file system joins these.  Where it cannot
    join files by itself, their bytes are copied one after the other, a buffer at a time.
    """
    spark = sentences.sparkSession
    rows = _plain(sentences)
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "sent_id"]))
    least = rows.agg(F.min("sent_id").alias("least"))
    every = rows.select("sent_id", line.alias("line")).join(F.broadcast(least)).repartitionByRange("sent_id").sortWithinPartitions("sent_id")

    def commas(batches):
        first = True
        for batch in batches:
            out = []
            for n, least, text in zip(*(batch.column(c).to_pylist() for c in ("sent_id", "least", "line"))):
                out.append(text if first and n == least else "," + text)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["line"])

    parts = path.rstrip("/") + "._parts"
    every.mapInArrow(commas, "line string").write.mode("overwrite").option("compression", "none").text(parts)
    _join_files(spark, parts, path, b"[\n", b"]\n")


def _join_files(spark: SparkSession, parts: str, path: str, head: bytes, tail: bytes) -> None:
    """Make the part files in a folder, in order of their names, one file at path between head and tail; the folder goes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    files = sorted((s.getPath() for s in fs.globStatus(at(parts + "/part-*")) if s.getLen()), key=lambda p: p.getName())
    first, last = at(parts + "/_head"), at(parts + "/_tail")
    for where, what in ((first, head), (last, tail)):
        out = fs.create(where, True)
        out.write(bytearray(what))
        out.close()
    try:
        rest = [*files, last]
        array = spark.sparkContext._gateway.new_array(at, len(rest))
        for i, p in enumerate(rest):
            array[i] = p
        fs.concat(first, array)
        fs.delete(at(path), True)
        fs.rename(first, at(path))
    except Exception as e:  # noqa: BLE001
        if "Unsupported" not in str(e) and "not supported" not in str(e).lower():
            raise
        fs.delete(at(path), True)
        out = fs.create(at(path), True)
        for p in (first, *files, last):
            source = fs.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
        out.close()
    fs.delete(at(parts), True)


def itemize(sentences: DataFrame, strict: bool = False) -> DataFrame:
    """The item table of both sides. isStopWord defaults to false; the first element of a ner list is the label.

    strict: an item without a key, an empty ner list or a ner that is neither "" nor a list fails the query.
    """
    parts = []
    for side, name in (("a", "gold"), ("b", "pred")):
        x = F.col("x")
        label = F.get(F.from_json(x["ner"], "array<struct<ner:string>>"), 0)["ner"]
        row = sentences.select("sent_id", F.posexplode(name).alias("ord", "x"))
        if strict:
            bad = x["item"].isNull() | x["startOffSet"].isNull() | x["endOffSet"].isNull() | x["pos"].isNull() | x["lemma"].isNull() | x["isMinimumToken"].isNull() | x["ner"].isNull() | ((x["ner"] != "") & label.isNull())
            row = row.withColumn("x", F.when(bad, F.raise_error(F.lit("an item lacks a key or has a malformed ner"))).otherwise(x))
        parts.append(row.select("sent_id", F.lit(side).alias("side"), "ord", x["item"].alias("item"), x["startOffSet"].alias("start"), x["endOffSet"].alias("end"), x["pos"].alias("pos"), x["lemma"].alias("lemma"), x["isMinimumToken"].alias("is_min"), F.coalesce(x["isStopWord"], F.lit(False)).alias("is_stop"), F.when(x["ner"] != "", label).alias("ner_label")))
    return parts[0].unionByName(parts[1])


def compose(sentences: DataFrame, make_segmenter: Callable[[], object] | None) -> DataFrame:
    """Sentences with pred set to what a segmenter's segment(text) -> JSON gives for expanded_query, else query.

    make_segmenter builds one segmenter in each Python worker's partition; None leaves the sentences as they are.  What it gives is many times
    the text, so it goes back to Spark every PIECE_ROWS sentences or PIECE_CHARS characters, whatever a batch holds.
    """
    if make_segmenter is None:
        return sentences
    others = [c for c in sentences.columns if c != "pred"]

    def run(batches):
        segmenter = make_segmenter()
        for b in batches:
            text = b["expanded_query"].where(b["expanded_query"].notna(), b["query"]) if "expanded_query" in b else b["query"]
            rows, chars = np.arange(len(b)) // PIECE_ROWS, text.str.len().fillna(0).astype("int64").cumsum().to_numpy() // PIECE_CHARS
            edges = [0, *(np.flatnonzero((np.diff(rows) != 0) | (np.diff(chars) != 0)) + 1).tolist(), len(b)]
            for i, j in zip(edges, edges[1:]):
                yield b.iloc[i:j].assign(pred=[segmenter.segment(t) for t in text.iloc[i:j]])

    plain = sentences.select(*others)
    schema = T.StructType([*plain.schema.fields, T.StructField("pred", T.StringType())])
    return plain.mapInPandas(run, schema).withColumn("pred", F.from_json("pred", T.ArrayType(ITEM)))


def from_lists(spark: SparkSession, sentences: list[dict]) -> DataFrame:
    """Sentences given as Python dicts, for small inputs and tests."""
    text = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    keys = [f.name for f in ITEM]
    rows = [(i, s.get("query"), s.get("expanded_query"), *[[tuple(text(it.get(k, "")) if k == "ner" else it.get(k) for k in keys) for it in s.get(side, [])] for side in ("gold", "pred")]) for i, s in enumerate(sentences)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("sent_id", T.LongType()), *SENTENCE.fields]))
