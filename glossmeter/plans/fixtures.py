"""Two annotations of the driver's tables, derived by rule: the same rules in Spark and in DuckDB's SQL.

There is no annotated corpus among the tables, so gold tokens are the blank-separated words of documents, predictions merge
and cut some of them, and labels follow from the words.  Tag sequences come from events, labels of annotators from labels.
All rows and whole texts take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Characters of text in a task: some 300,000 words, which sort in some 100 MB with all their items.
TASK_CHARS = 2_000_000


def dealt(texts: DataFrame, task_chars: int = TASK_CHARS) -> DataFrame:
    """texts (sent_id, text) dealt by sent_id to tasks of about so many characters, however many there are.

    Whole texts move, which are a fifth of the rows that they are cut into, and all that is cut from them stays dealt by sent_id.  The number of
    tasks follows the characters, as rows of words would not fit a task's memory if it followed the bytes of texts.
    """
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, chars // task_chars + 1), "sent_id")


#: Bytes of text that are looked through at once.
PIECE = 1 << 20


def _word_places(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts between offsets of UTF-8 data: how many each text has, the number of blanks before each word of its text, and of characters."""
    blank = data == 32
    begins = ~blank
    begins[1:] &= blank[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[first] = ~blank[first]
    at = np.flatnonzero(begins)
    text = np.searchsorted(offsets, at, "right") - 1
    before = lambda what: np.concatenate([[0], np.cumsum(what, dtype="i4")])
    blanks, chars = before(blank), before((data & 0xC0) != 0x80)
    since = offsets[:-1][text]
    return np.bincount(text, minlength=len(offsets) - 1), blanks[at] - blanks[since], chars[at] - chars[since]


@F.arrow_udf(T.StructType([T.StructField("ords", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType()))]))
def _places(text: pa.Array) -> pa.Array:
    """Of each text's words that are not empty: their numbers among all (null: 0, 1, ...), and where they start."""
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, "i8")[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, "u1") if data is not None else np.empty(0, "u1")
    n, ords, starts = [], [], []
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        for out, x in zip((n, ords, starts), _word_places(offsets[at : end + 1] - offsets[at], data[offsets[at] : offsets[end]])):
            out.append(x)
        at = end
    n, ords, starts = (np.concatenate(x or [np.empty(0, "i4")]) for x in (n, ords, starts))
    ends = np.concatenate([[0], np.cumsum(n)])
    plain = n == 0
    plain[~plain] = ords[ends[1:][~plain] - 1] == n[~plain] - 1
    lists = lambda values, ends, mask=None: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()), mask=mask)
    numbered = lists(ords[~np.repeat(plain, n)], np.concatenate([[0], np.cumsum(np.where(plain, 0, n))]), pa.array(plain))
    return pa.StructArray.from_arrays([numbered, lists(starts, ends)], ["ords", "starts"])


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, ord, item, n, start, nx, nx_n: words of each document and their lengths, where they start, and the next word.

    Places move with the text, so that its words need no window nor sort."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("sent_id"), "text")
    docs = dealt(docs.withColumn("at", _places("text"))).select("sent_id", F.array_remove(F.split("text", " ", -1), "").alias("words"), "at.ords", "at.starts")
    # outer, as else the words would be made once more to see whether there are any
    rows = docs.select("sent_id", "words", "ords", "starts", F.posexplode_outer("words").alias("pos", "item")).where("item IS NOT NULL")
    rows = rows.select("sent_id", F.coalesce(F.get("ords", "pos"), "pos").alias("ord"), "item", F.get("starts", "pos").alias("start"), F.get("words", F.col("pos") + 1).alias("nx"))
    return rows.withColumns({"n": F.length("item"), "nx_n": F.length("nx")}).select("sent_id", "ord", "item", "start", "n", "nx", "nx_n")


#: Kinds of items of a word, gold's first.
WORD, COMPOUND, CUT, CUT_REST, MERGED, HALF, HALF_REST, SAME = range(8)


def _labels(items: DataFrame) -> DataFrame:
    """pos, lemma and ner_label from the item and its length n; the two sides differ a little."""
    n, pred = F.col("n"), F.col("side") == "b"
    upper = F.substring("item", 1, 1) != F.lower(F.substring("item", 1, 1))
    pos = F.when(pred & (n % 5 == 0), "ADJ").when(upper, "PROPN").when(n <= 3, "ADP").when(n % 2 == 0, "NOUN").otherwise("VERB")
    lemma = F.when(pred, F.translate(F.lower("item"), "éèêñóí", "eeenoi")).otherwise(F.lower("item"))
    kind = F.element_at(F.array(F.lit("LOC"), F.lit("PER"), F.lit("ORG")), F.pmod(n + F.when(pred & (F.col("ord") % 8 == 0), 1).otherwise(0), F.lit(3)) + 1)
    ner = F.when(upper & ~(pred & (F.col("ord") % 10 == 4)), kind)
    return items.select("sent_id", "side", "ord", "item", "start", (F.col("start") + n).alias("end"), pos.alias("pos"), lemma.alias("lemma"), "is_min", F.lit(False).alias("is_stop"), ner.alias("ner_label"))


def items(spark: SparkSession, sf_dir: str, compounds: bool = False) -> DataFrame:
    """The item table. Gold: words, ord doubled. Predictions: of each seven words the fourth and fifth are one token, cut again two
    characters behind the fourth if that has an even number and the fifth two characters; words over eight characters are halved.
    compounds: each pair of words 10k and 10k + 1 is a gold item more, before its parts, and no minimum token.

    All items of a word come from its row, as a number each, so the table is read once, stays dealt by sent_id, and texts of items are made only if asked for."""
    w = words(spark, sf_dir)
    n, nx, merged = F.col("n"), F.col("nx_n"), (F.col("ord") % 7 == 3) & F.col("nx_n").isNotNull()
    kinds = lambda *k: F.array(*[F.lit(x) for x in k])

    def both(*gold: int) -> Column:
        pred = F.when(merged & (F.col("ord") % 2 == 0) & (nx >= 2), kinds(*gold, CUT, CUT_REST)).when(merged, kinds(*gold, MERGED))
        return pred.when((n > 8) & (F.col("ord") % 7 != 4), kinds(*gold, HALF, HALF_REST)).when(F.col("ord") % 7 != 4, kinds(*gold, SAME)).otherwise(kinds(*gold))

    all_of = F.when((F.col("ord") % 10 == 0) & nx.isNotNull(), both(COMPOUND, WORD)).otherwise(both(WORD)) if compounds else both(WORD)
    rows = w.withColumn("kind", F.explode(all_of))
    half = F.floor(n / 2).cast("int")
    whole = F.concat("item", F.lit(" "), "nx")

    def of(default: Column, **values: Column) -> Column:
        names = {"compound": COMPOUND, "cut": CUT, "cut_rest": CUT_REST, "merged": MERGED, "half": HALF, "half_rest": HALF_REST}
        out = F
        for k, v in values.items():
            out = out.when(F.col("kind") == names[k], v)
        return out.otherwise(default)

    ord_ = F.col("ord") * 2 + of(F.lit(0), compound=F.lit(-1), cut_rest=F.lit(1), half_rest=F.lit(1))
    start = F.col("start") + of(F.lit(0), cut_rest=n + 2, half_rest=half)
    size = of(n, compound=n + 1 + nx, cut=n + 2, cut_rest=nx - 1, merged=n + 1 + nx, half=half, half_rest=n - half)
    item = of(F.col("item"), compound=whole, cut=F.substring(whole, F.lit(1), n + 2), cut_rest=F.substring(whole, n + 3, F.length(whole)), merged=whole, half=F.substring(F.col("item"), F.lit(1), half), half_rest=F.substring(F.col("item"), half + 1, n))
    side = F.when(F.col("kind") <= COMPOUND, "a").otherwise("b")
    return _labels(rows.select("sent_id", side.alias("side"), ord_.alias("ord"), item.alias("item"), start.cast("int").alias("start"), size.alias("n"), (F.col("kind") != COMPOUND).alias("is_min")))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, side, ord, tag: one sequence of event types for each user and thousand events, and a disturbed copy."""
    e = read(spark, sf_dir, "events")
    gold = F.element_at(F.create_map(*[F.lit(x) for kv in (("error", "B-ERR"), ("click", "I-ERR"), ("view", "O"), ("signup", "B-SGN"), ("purchase", "I-SGN")) for x in kv]), F.col("event_type"))
    swap = F.when(gold.endswith("ERR"), F.concat(F.left(gold, F.lit(2)), F.lit("SGN"))).when(gold.endswith("SGN"), F.concat(F.left(gold, F.lit(2)), F.lit("ERR"))).otherwise(gold)
    pred = F.when(F.col("event_id") % 9 == 0, "O").when(F.col("event_id") % 13 == 0, "B-ERR").when(F.floor(F.col("event_id") / 100) % 4 == 0, swap).otherwise(gold)
    rows = e.select((F.col("user_id") * 1000000 + F.floor(F.col("event_id") / 1000)).alias("sent_id"), "event_id", gold.alias("a"), pred.alias("b"))
    rows = rows.withColumn("ord", F.row_number().over(W.partitionBy("sent_id").orderBy("event_id")) - 1)
    return rows.select("sent_id", "ord", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("tag")), F.struct(F.lit("b").alias("side"), F.col("b").alias("tag")))).alias("x")).select("sent_id", "x.side", "ord", "x.tag")


def annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: what labels say about quality and toxicity, as two annotators' labels."""
    return read(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("b"))


WORDS_SQL = """w0 AS (SELECT doc_id AS sent_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
w1 AS (SELECT sent_id, unnest(range(0, len(w))) AS ord, unnest(w) AS item FROM w0),
w2 AS (SELECT *, coalesce(sum(length(item) + 1) OVER (PARTITION BY sent_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w1),
w AS (SELECT *, length(item) AS n, lead(item) OVER (PARTITION BY sent_id ORDER BY ord) AS nx FROM w2 WHERE item <> '')"""

#: ia: all items with compounds; it: minimum tokens.
ITEMS_SQL = (
    WORDS_SQL
    + """,
m AS (SELECT *, item || ' ' || nx AS whole FROM w WHERE ord % 7 = 3 AND nx IS NOT NULL),
o AS (SELECT * FROM w WHERE ord % 7 <> 4 AND NOT (ord % 7 = 3 AND nx IS NOT NULL)),
raw AS (
  SELECT sent_id, 'a' AS side, ord * 2 AS ord, item, s, true AS is_min FROM w
  UNION ALL SELECT sent_id, 'a', ord * 2 - 1, item || ' ' || nx, s, false FROM w WHERE ord % 10 = 0 AND nx IS NOT NULL
  UNION ALL SELECT sent_id, 'b', ord * 2, whole, s, true FROM m WHERE NOT (ord % 2 = 0 AND length(nx) >= 2)
  UNION ALL SELECT sent_id, 'b', ord * 2, substr(whole, 1, n + 2), s, true FROM m WHERE ord % 2 = 0 AND length(nx) >= 2
  UNION ALL SELECT sent_id, 'b', ord * 2 + 1, substr(whole, n + 3), s + n + 2, true FROM m WHERE ord % 2 = 0 AND length(nx) >= 2
  UNION ALL SELECT sent_id, 'b', ord * 2, item, s, true FROM o WHERE n <= 8
  UNION ALL SELECT sent_id, 'b', ord * 2, substr(item, 1, n // 2), s, true FROM o WHERE n > 8
  UNION ALL SELECT sent_id, 'b', ord * 2 + 1, substr(item, n // 2 + 1), s + n // 2, true FROM o WHERE n > 8),
items AS (SELECT sent_id, side, ord, item, s, s + length(item) AS e, is_min, length(item) AS n, substr(item, 1, 1) <> lower(substr(item, 1, 1)) AS up, side = 'b' AS pred FROM raw),
ia AS (SELECT sent_id, side, ord, item, s, e, is_min,
  CASE WHEN pred AND n % 5 = 0 THEN 'ADJ' WHEN up THEN 'PROPN' WHEN n <= 3 THEN 'ADP' WHEN n % 2 = 0 THEN 'NOUN' ELSE 'VERB' END AS pos,
  CASE WHEN pred THEN translate(lower(item), 'éèêñóí', 'eeenoi') ELSE lower(item) END AS lemma,
  CASE WHEN up AND NOT (pred AND ord % 10 = 4) THEN ['LOC', 'PER', 'ORG'][(n + CASE WHEN pred AND ord % 8 = 0 THEN 1 ELSE 0 END) % 3 + 1] END AS ner FROM items),
it AS (SELECT * EXCLUDE (is_min) FROM ia WHERE is_min)"""
)

#: Tags of all items. Items nest or are apart here, so one is within an entity if it ends before the last end of a named one before it.
BIO_SQL = """,
bo0 AS (SELECT *, max(CASE WHEN ner IS NOT NULL THEN e END) OVER (PARTITION BY sent_id, side ORDER BY s, e DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ia),
bo1 AS (SELECT *, coalesce(e <= reach, false) AS within FROM bo0),
bo2 AS (SELECT *, last_value(CASE WHEN NOT within THEN {'s': s, 'ner': ner} END IGNORE NULLS) OVER (PARTITION BY sent_id, side ORDER BY s, e DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM bo1),
bo3 AS (SELECT sent_id, side, s, e, ord AS k, CASE WHEN within THEN CASE WHEN s <> head.s THEN 'I-' || head.ner END WHEN ner IS NULL THEN 'O' ELSE 'B-' || ner END AS tag FROM bo2),
bio AS (SELECT sent_id, side, tag, row_number() OVER (PARTITION BY sent_id, side ORDER BY s, e DESC, k) - 1 AS ord FROM bo3 WHERE tag IS NOT NULL)"""

TAGS_SQL = """e0 AS (SELECT user_id * 1000000 + event_id // 1000 AS sent_id, event_id, CASE event_type WHEN 'error' THEN 'B-ERR' WHEN 'click' THEN 'I-ERR' WHEN 'view' THEN 'O' WHEN 'signup' THEN 'B-SGN' WHEN 'purchase' THEN 'I-SGN' END AS a FROM events),
e1 AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'O' WHEN event_id % 13 = 0 THEN 'B-ERR' WHEN (event_id // 100) % 4 = 0 AND a LIKE '%ERR' THEN left(a, 2) || 'SGN' WHEN (event_id // 100) % 4 = 0 AND a LIKE '%SGN' THEN left(a, 2) || 'ERR' ELSE a END AS b,
  row_number() OVER (PARTITION BY sent_id ORDER BY event_id) - 1 AS ord FROM e0),
tags AS (SELECT sent_id, 'a' AS side, ord, a AS tag FROM e1 UNION ALL SELECT sent_id, 'b', ord, b FROM e1)"""
