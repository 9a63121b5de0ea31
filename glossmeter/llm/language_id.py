"""Language identification by compression.

For each language a raw-content zstandard dictionary holds text of that language.  A text is compressed with each of
them; the language whose dictionary gives the fewest bytes is the answer.  Where the runner-up is hardly larger, the
answer is marked as not accepted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read

#: Bounds of the learning sample: documents of each language, characters from each of them; more languages than so many are an error.
SAMPLE_DOCS, SAMPLE_BYTES, MOST_LANGUAGES = 32, 1024, 4096
#: Bytes that are compressed at a time (beyond them a text's own history would hide the dictionary), level, margin of acceptance.
BLOCK, LEVEL, MARGIN, SOFTNESS = 2048, 6, 0.005, 24.0
#: Bytes that the compressor wants of a dictionary at least.
LEAST_BYTES = 8


#: Only letters tell languages apart: digits, punctuation and white space become one blank.
_letters = re.compile(r"[\W\d_]+").sub


def remainder(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary content), most frequent language first; equal counts by name.

    The sample is drawn by a hash of text and id for each language by itself, and rows that repeat both count once, so it is
    the same each time and no language crowds another out; its bound does not grow with the table.
    """
    unit = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 12) / float(1 << 52)
    half = F.greatest(F.lit(1), (F.length(text_col) / 2).cast("int") - SAMPLE_BYTES // 2)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    usable = usable.select(F.col(lang_col).alias("lang"), unit.alias("u"), F.substring(F.col(text_col), half, F.lit(SAMPLE_BYTES)).alias("t"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("u").alias("texts")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    if not counts:
        return []
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4.0 * SAMPLE_DOCS / max(1, r["texts"]))) for r in counts], "lang string, share double")
    drawn = usable.join(F.broadcast(share), "lang").where("u <= share").groupBy("lang", "u").agg(F.min("t").alias("t"))
    drawn = drawn.withColumn("nr", F.row_number().over(W.partitionBy("lang").orderBy("u"))).where(F.col("nr") <= SAMPLE_DOCS)
    parts: dict[str, list] = {}
    for r in drawn.collect():
        parts.setdefault(r["lang"], []).append((r["u"], r["t"]))
    out = [(r["lang"], "\n".join(_letters(" ", t.lower()) for _, t in sorted(parts.get(r["lang"], []))).encode()[-SAMPLE_DOCS * SAMPLE_BYTES :]) for r in counts]
    return [(lang, content * -(-LEAST_BYTES // len(content))) for lang, content in out if content.strip()]  # a few letters are repeated; without any there is nothing to learn


class Compressors:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.names = [n for n, _ in dictionaries]
        self.each = []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); the score is a softmax over the bits that each language takes."""
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        raw = _letters(" ", text.lower()).encode()
        parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c(p)) for p in parts) for c in self.each]
        best = min(range(len(sizes)), key=sizes.__getitem__)  # ties: the more frequent language
        score = 1.0 / sum(math.exp(-8.0 * (s - sizes[best]) / SOFTNESS) if s - sizes[best] < 2000 else 0.0 for s in sizes)
        margin = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best]) - sizes[best]
        return self.names[best], score, margin >= max(2, MARGIN * sizes[best])


_MADE: dict[int, Compressors] = {}


def language_id(docs: DataFrame, dictionaries: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, held_out, lang_pred, score, accepted for every row.

    Null texts, and texts without a letter, are `und` with score 0; so is everything if no language was learned.  A null id
    is not held out.  Texts of any length are read whole; repeated rows stay; other columns are not read.
    """
    key = hash(tuple(dictionaries))
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # MOST_LANGUAGES * SAMPLE_DOCS * SAMPLE_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = Compressors(sent.value)
        predict = _MADE[key].predict
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                done = [predict(t.as_py()) for t in part.column(2)]
                cols = [part.column(0), part.column(1), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.float64()), pa.array([x[2] for x in done], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "lang_pred", "score", "accepted"])

    slim = docs.select(docs[id_col].alias(id_col), F.coalesce(remainder(id_col) == 1, F.lit(False)).alias("held_out"), docs[text_col].cast("string").alias(text_col))
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id(docs, learn(docs.where(remainder() != 1)))
