"""Deduplication of content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines chooses the boundaries: a chunk ends where it has a local minimum,
and in a run of equal lines at every second one, so boundaries depend on nearby lines only and shift with them, and chunks
have two lines at least.  A chunk that occurs anywhere else in the corpus before is removed, once its bytes have been
compared with those of the first occurrence.  Only hashes are grouped over the corpus; text moves twice, to its document's row.

Chunks depend on the lines around a passage, so a second, finer chunking stands beside them: from every line with words on,
and back from it, the fewest lines that hold WORDS words.  Such windows depend on their own lines only, so those of a passage
of that many words are the same in any context, and together they cover the whole passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read

#: Words from which a passage of whole lines is found wherever it stands; lines that are tried first for a window, before as many as it may need.
WORDS, NEAR = 50, 6
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row: an expression that is named by a column is copied into each lambda that uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _span(first: Column, last: Column) -> Column:
    """A place and a length as one long: arrays compare those by hash, and a long's hash, its halves' XOR, then differs from span to span."""
    return F.shiftleft(first.cast("long"), 32) + (last - first)


def _first(span: Column) -> Column:
    return F.shiftright(span, 32).cast("int")


def _last(span: Column) -> Column:
    return _first(span) + span.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def chunks(lines: Column, words: Column) -> Column:
    """array<long> of the spans of an array of lines, counted from 0, that are chunks of several lines with a word; words counts those of each line."""
    at = F.get

    def rolling(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.pmod(F.coalesce(at(h, i - 1), F.lit(0)) * 31 + x, F.lit(1 << 32)))

    def ends(r: Column) -> Column:
        lowest = lambda i: (i > 0) & (at(r, i) < at(r, i - 1)) & (at(r, i) < at(r, i + 1))
        run = lambda i: (i % 2 == 1) & (at(r, i) == at(r, i - 1)) & (at(r, i) == at(r, i + 1))
        return F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == F.size(r) - 1) | F.coalesce(lowest(i) | run(i), F.lit(False)))

    h = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    e = let(h, lambda h: let(rolling(h), ends))
    spans = let(e, lambda e: F.transform(e, lambda x, k: _span(F.coalesce(at(e, k - 1) + 1, F.lit(0)), x)))
    return F.filter(spans, lambda s: (_last(s) > _first(s)) & F.exists(F.slice(words, _first(s) + 1, _last(s) - _first(s) + 1), lambda n: n > 0))


def windows(words: Column, least: int) -> Column:
    """array<long> of spans: from each line with words, forward and back, the fewest lines that hold `least` words."""

    def reach(w: Column, k: Column) -> Column:
        """struct<s, n>: words and lines of the window that begins at w[k]; s < least if there is none."""
        upto = lambda most: F.aggregate(F.slice(w, k + 1, most), F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.when(a["s"] >= least, a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))))
        return let(upto(NEAR), lambda a: F.when(a["s"] >= least, a).otherwise(upto(least)))  # each line has a word at least

    def of(at: Column, w: Column, back: bool) -> Column:
        ends = lambda k, n: (F.get(at, k + n - 1), F.get(at, k)) if back else (F.get(at, k), F.get(at, k + n - 1))
        all_of = F.transform(w, lambda _, k: let(reach(w, k), lambda a: F.when(a["s"] >= least, _span(*ends(k, a["n"])))))
        return F.array_compact(all_of)

    def both(full: Column) -> Column:
        at, w = F.transform(full, lambda x: x["i"]), F.transform(full, lambda x: x["w"])
        way = lambda a, v, back: let(a, lambda a: let(v, lambda v: of(a, v, back)))
        return F.concat(way(at, w, False), way(F.reverse(at), F.reverse(w), True))

    full = F.filter(F.transform(words, lambda n, i: F.struct(i.alias("i"), n.alias("w"))), lambda x: x["w"] > 0)
    return let(full, both)


def _text(lines: Column | str, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int | None = WORDS) -> DataFrame:
    """The columns in keep, n_lines, n_removed (lines), n_chunks (runs of removed lines), text (without the removed lines).

    Removed are chunks of several lines, and runs of whole lines with `words` words or more (None: chunks only), that stood
    anywhere before.  The first occurrence, by id (null last), then text, then place, stays; so what is removed always stands
    earlier in the corpus.  A window or chunk that overlaps its own first occurrence is no repetition, and one without a word
    is never compared.  A null text stays null with 0 lines; an empty one has one line.  Rows that repeat id and text are one
    document: what is in both is no repetition.  Of several texts under one id each is a document.  A document whose lines all
    go has an empty text.  Columns that are not named are not read.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    # order of the texts under one id
    tie = F.conv(F.substring(F.md5(text_col), 1, 15), 16, 10).cast("long")

    def hashed(of: Column) -> Column:
        def with_words(lines: Column, n: Column) -> Column:
            found = F.array_distinct(F.concat(chunks(lines, n), windows(n, words)) if words else chunks(lines, n))
            row = lambda h, s: F.struct(of["key"].alias("key"), of["tie"].alias("tie"), _first(s).alias("first"), _last(s).alias("last"), F.xxhash64(F.slice(h, _first(s) + 1, _last(s) - _first(s) + 1)).alias("h"))
            return let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: F.transform(found, lambda s: row(h, s)))

        return let(F.split(text_col, "\n", -1), lambda lines: let(F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))), lambda n: with_words(lines, n)))

    # the hashes of a text are in the array, or generated code would take them for each chunk again
    slim = cut(docs.select(F.col(id_col).alias("id"), F.explode(let(F.struct(key.alias("key"), tie.alias("tie")), hashed)).alias("c")).select("id", "c.*"))
    # hashes in more than one place, then their rows: most are in one only, and their ids stay where they are
    place = F.xxhash64("key", "first")
    common = slim.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h")
    twice = cut(slim.join(common, "h"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "tie", "first", "last", "key")
    before = cut(twice.groupBy("h").agg(F.min(order).alias("o")).select("h", F.col("o.key").alias("okey"), F.col("o.first").alias("ofirst"), F.col("o.last").alias("olast")))
    # one join of hashes with first occurrences, which adaptive execution may split; no group of equal chunks is gathered
    later = twice.join(before, "h").where((F.col("key") != F.col("okey")) | (F.col("first") > F.col("olast")))

    # spans that lie as far from the same document's lines join to runs, so no text moves once a window
    side = W.partitionBy("key", "okey", "by").orderBy("first", "last")
    later = later.select("key", "okey", (F.col("first") - F.col("ofirst")).alias("by"), "first", "last").distinct()
    later = later.withColumn("apart", F.coalesce(F.col("first") > F.max("last").over(side.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True)).cast("long"))
    later = later.withColumn("run", F.sum("apart").over(side.rowsBetween(W.unboundedPreceding, 0)))
    runs = later.groupBy("key", "okey", "by", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    runs = cut(runs.select("key", "okey", "first", "last", (F.col("first") - F.col("by")).alias("ofirst"), (F.col("last") - F.col("by")).alias("olast")))

    # the text of first occurrences, from the documents that hold them
    held = runs.select("okey", "ofirst", "olast").distinct().groupBy(F.col("okey").alias("key")).agg(F.collect_list(F.struct(F.col("ofirst").alias("first"), F.col("olast").alias("last"))).alias("held"))
    source = docs.select(key.alias("key"), F.col(text_col).alias("t")).join(held, "key").dropDuplicates(["key"])
    texts = let(F.split("t", "\n", -1), lambda lines: F.transform("held", lambda x: F.struct(x["first"].alias("ofirst"), x["last"].alias("olast"), _text(lines, x["first"], x["last"]).alias("same"))))
    firsts = cut(source.select(F.col("key").alias("okey"), F.explode(texts).alias("x")).select("okey", "x.*"))
    against = runs.join(firsts, ["okey", "ofirst", "olast"]).groupBy("key").agg(F.collect_set(F.struct("first", "last", "same")).alias("later"))

    def judged(lines: Column) -> Column:
        """Lines that go as an array of places, so that work goes by lines, not by lines times chunks."""
        same = F.filter("later", lambda x: _text(lines, x["first"], x["last"]) == x["same"])
        gone = F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda x: F.sequence(x["first"], x["last"])))))
        left = lambda g: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g), lambda i: F.get(lines, i))
        islands = lambda g: F.size(F.filter(g, lambda x, k: F.coalesce(F.get(g, k - 1) != x - 1, F.lit(True))))
        result = lambda g: F.struct(F.size(g).alias("removed"), islands(g).alias("chunks"), F.when(F.size(g) > 0, F.array_join(left(g), "\n")).alias("text"))
        return let(gone, result)

    rows = docs.select(*[F.col(k).alias(f"k_{k}") for k in keep], key.alias("key"), F.col(text_col).alias("t")).join(against, "key", "left")
    rows = rows.withColumn("x", F.when(F.col("later").isNotNull(), let(F.split("t", "\n", -1), judged)))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    n_lines = F.coalesce(F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return rows.select(*[F.col(f"k_{k}").alias(k) for k in keep], n_lines.alias("n_lines"), count("x.removed").alias("n_removed"), count("x.chunks").alias("n_chunks"), F.coalesce("x.text", "t").alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"))


def oracle(table: str = "documents", words: int | None = WORDS) -> str:
    """The same in DuckDB's SQL; spans count lines from 1."""
    word = r"[^\x20\x09-\x0D]+"
    near = f"""
f AS (SELECT a.nr, a.i AS a, b.i AS z FROM s a ASOF JOIN s b ON a.nr = b.nr AND a.upto - a.w + {words} <= b.upto),
g AS (SELECT a.nr, b.i AS a, a.i AS z FROM s a ASOF JOIN s b ON a.nr = b.nr AND a.upto - {words} >= b.upto - b.w),
sp AS (SELECT * FROM c UNION SELECT * FROM f UNION SELECT * FROM g),""" if words else "sp AS (SELECT * FROM c),"
    return f"""
WITH d0 AS (SELECT DISTINCT doc_id, text FROM {table} WHERE text IS NOT NULL),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, row_number() OVER (ORDER BY doc_id NULLS LAST, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT)) AS nr FROM d0),
a AS (SELECT *, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h, len(lines) AS n, list_transform(lines, lambda x: len(regexp_extract_all(x, '{word}'))) AS w FROM d),
b AS (SELECT *, list_transform(h, lambda x, i: (coalesce(CASE WHEN i > 1 THEN h[i - 1] END, 0) * 31 + x) % 4294967296) AS r FROM a),
e AS (SELECT nr, w, list_filter(range(1, n + 1), lambda i: i = n OR (i > 1 AND ((coalesce(r[i] < r[i - 1], false) AND coalesce(r[i] < r[i + 1], false)) OR (i % 2 = 0 AND r[i] = r[i - 1] AND coalesce(r[i] = r[i + 1], false))))) AS e FROM b),
c0 AS (SELECT nr, w, unnest(list_transform(e, lambda x, j: {{'a': CASE WHEN j = 1 THEN 1 ELSE e[j - 1] + 1 END, 'z': x}})) AS x FROM e),
c AS (SELECT nr, x.a AS a, x.z AS z FROM c0 WHERE x.z > x.a AND list_sum(w[x.a:x.z]) > 0),
s0 AS (SELECT nr, unnest(w) AS w, unnest(range(1, n + 1)) AS i FROM a),
s AS (SELECT nr, i, w, sum(w) OVER (PARTITION BY nr ORDER BY i) AS upto FROM s0 WHERE w > 0),{near}
t AS (SELECT sp.nr, sp.a, sp.z, array_to_string(d.lines[sp.a:sp.z], chr(10)) AS t FROM sp JOIN d ON sp.nr = d.nr),
o AS (SELECT t, min((nr, a, z)) AS o FROM t GROUP BY t),
gone AS (SELECT DISTINCT nr, i FROM (SELECT t.nr, unnest(range(a, z + 1)) AS i FROM t JOIN o ON t.t = o.t WHERE t.nr <> o.o[1] OR t.a > o.o[3])),
k AS (SELECT *, i - row_number() OVER (PARTITION BY nr ORDER BY i) AS run FROM gone),
l AS (SELECT nr, list(i) AS gone, count(*) AS n_removed, count(DISTINCT run) AS n_chunks FROM k GROUP BY nr)
SELECT x.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(l.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(l.n_chunks, 0) AS BIGINT) AS n_chunks,
  CASE WHEN l.nr IS NULL THEN x.text ELSE array_to_string(list_filter(d.lines, lambda y, i: NOT list_contains(l.gone, i)), chr(10)) END AS text
FROM {table} x LEFT JOIN d ON x.doc_id IS NOT DISTINCT FROM d.doc_id AND x.text = d.text LEFT JOIN l ON d.nr = l.nr"""


ORACLE = oracle()
