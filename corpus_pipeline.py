"""From raw documents to encoded training text: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes every stage's result as Parquet into the
shared folder and reads it back.  All stages but the last return the columns of documents; what other columns documents has,
also ones with names that operators use themselves, does not come along.  An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmeter.llm import bpe_tree, line_dedup, mixing, ngram_join, quality_rules
from glossmeter.llm.common import cut, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go.

    Rows are judged one by one, by their whole text: repeated rows and rows that repeat an id stay or go by themselves, a null
    or empty text goes (it has under 50 words), a null id, lang or source does not matter.  Without labels only the base rules count.
    """
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs.select(*COLUMNS), rules, keep=COLUMNS).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks and passages of whole lines that occurred before go from the text; n_chars follows.

    Documents stay, also with an empty text; a null text stays null, with null n_chars.  Rows that repeat id and text are one
    document and keep the same lines; the first occurrence by id (null last), then text, then place, keeps a chunk.
    """
    out = line_dedup.dedup_lines(docs, keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, of those with the smallest id; rows without id or words all stay.

    Rows count one by one, also where they repeat an id or are equal; of equal rows of one id one stays.  A very large group
    of copies is one node.
    """
    rows = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    found = ngram_join.shingle_components(rows, id_col="row").where("n_shingles > 0").select("row", "node", "component_id")
    members = cut(found.join(rows.where("doc_id IS NOT NULL").select("row", "doc_id"), "row"))
    kept = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "node", "row")).alias("x")).select("x.row")
    gone = members.select("row").join(kept, "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: taken / size, rounded half up; so up to twice, or not at all.

    Documents without words go.  A null source is a source of its own; rows that repeat an id have one key, and ties of key,
    id and size are rows that may stand for each other.
    """
    mixed = mixing.mix_sources(docs, keep=COLUMNS)
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), times))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as byte-level BPE ids, decoded again: one row a row, in any number; a null text counts as empty."""
    return bpe_tree.bpe_encode_decode(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Learned rules, components of near-duplicates and BPE are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
