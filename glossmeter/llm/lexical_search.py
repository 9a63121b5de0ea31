"""Ranked lexical search: branch and bound over a hierarchical max tree for each term.

Each document is read once: its number of terms, and its occurrences of the terms that items ask for.  Tasks then take runs of
documents and build, for each such term, a tree over document ranges: a leaf is what the term adds to a document's score, a node
the maximum of FAN nodes below it; ranges without the term have no node.  A range's bound for an item is the sum of its terms'
nodes.  Best-first search opens the range of the highest bound, until no range reaches the score of the k-th document
found so far; ranges that only equal it are still opened, as a tie may go to a smaller id.  That score is carried on from run
to run of a task; every task gives its k best documents an item, and the best k of those are the result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop, read

#: Documents found for an item; children of a node; documents and postings of a run (one document more may exceed the second).
TOP, FAN, RUN_DOCS, RUN_POSTINGS = 50, 32, 16_384, 1_500_000
#: Terms of the items of one block; the items come in as many blocks as that takes, so what is sent to tasks is bounded. Bytes of a text that are counted at once.
BLOCK_TERMS, PIECE = 200_000, 1 << 20

#: Letters, digits and all beyond ASCII belong to terms; only A-Z are lower-cased.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def occurrences(text: str | None) -> Counter:
    """How often each term (UTF-8 bytes) occurs in a text, a piece of it at a time."""
    plain = (text or "").encode().translate(_TERMS)
    if len(plain) <= PIECE:
        return Counter(plain.split())
    out, a = Counter(), 0
    while a < len(plain):
        b = plain.find(b" ", a + PIECE)
        b = len(plain) if b < 0 else b
        out.update(plain[a:b].split())
        a = b
    return out


def norms(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """50 + (50 n docs) div terms, exact also where the product has more than 64 bits."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * docs // terms for x in n], np.int64)
    return 50 + 50 * n * docs // max(terms, 1)


# -- a run of documents ------------------------------------------------------------------------


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1, and so on."""
    n = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class MaxTree:
    """Trees over the documents of one run: level 0 holds (document, value) of each term, level l + 1 maxima of FAN nodes of level l.

    Nodes of a level are ordered by term, then range.  below[l][i] to below[l][i + 1] are node i's children in level l - 1.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int):
        order = np.lexsort((doc, term))
        term, node, value = term[order], doc[order], value[order]
        self.node, self.value, self.below = [node], [value], [None]
        width = docs
        while width > 1:
            width, up = -(-width // FAN), node // FAN
            first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(up, prepend=-1) != 0))
            self.below.append(np.append(first, len(node)))
            value = np.maximum.reduceat(value, first) if len(first) else value[:0]
            term, node = term[first], up[first]
            self.node.append(node)
            self.value.append(value)
        self.roots = {int(t): i for i, t in enumerate(term)}  # the top level has one node a term

    @property
    def top(self) -> int:
        return len(self.node) - 1

    def children(self, level: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ranges, bounds, entries, edges) one level below: entries of the item's terms by range, those of range k from edges[k] to edges[k + 1]."""
        of = self.below[level]
        entries = _ranges(of[entries], of[entries + 1])
        node = self.node[level - 1][entries]
        order = np.argsort(node, kind="stable")
        entries, node = entries[order], node[order]
        first = np.flatnonzero(np.diff(node, prepend=-1) != 0)
        return node[first], np.add.reduceat(self.value[level - 1][entries], first), entries, np.append(first, len(entries))


class Best:
    """The k best (score, id) so far, and the least score that still counts; equal scores by ascending id, a null one last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.id, self.none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def add(self, score: np.ndarray, id_: np.ndarray, none: np.ndarray) -> None:
        self.score, self.id, self.none = (np.concatenate(x) for x in ((self.score, score), (self.id, id_), (self.none, none)))
        if len(self.score) >= self.k:
            keep = np.lexsort((self.id, self.none, -self.score))[: self.k]
            self.score, self.id, self.none = self.score[keep], self.id[keep], self.none[keep]
            self.least = max(1, int(self.score[-1]))


def search(tree: MaxTree, terms: np.ndarray, best: Best, id_: np.ndarray, none: np.ndarray) -> int:
    """Put the documents of a run into best; id_ and none are theirs. Gives the number of ranges that were opened."""
    roots = np.array([tree.roots[t] for t in terms.tolist() if t in tree.roots], np.int64)
    if not len(roots):
        return 0
    if not tree.top:  # one document
        best.add(tree.value[0][roots].sum(keepdims=True), id_, none)
        return 0
    waiting, opened = [(-int(tree.value[tree.top][roots].sum()), tree.top, 0, roots)], 0
    while waiting and -waiting[0][0] >= best.least:
        _, level, _, entries = heapq.heappop(waiting)
        node, bound, entries, edges = tree.children(level, entries)
        opened += 1
        on = np.flatnonzero(bound >= best.least)
        if level == 1:
            if len(on):
                best.add(bound[on], id_[node[on]], none[node[on]])
            continue
        for k in on.tolist():
            heapq.heappush(waiting, (-int(bound[k]), level - 1, int(node[k]), entries[edges[k] : edges[k + 1]]))
    return opened


# -- all documents -----------------------------------------------------------------------------


def _postings(docs: DataFrame, known, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the text), terms and tf (arrays: the numbers of known terms, and how often they occur), for texts with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1)):
                    if c := occurrences(t.as_py()):
                        held = [(number[x], k) for x, k in c.items() if x in number]
                        rows.append((i, c.total(), [x for x, _ in held], [k for _, k in held]))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["id", "n", "terms", "tf"])

    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n long, terms array<int>, tf array<long>")


def _block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """row, item_id, id, score of the k best documents for each of the items (row, item_id, terms), one block of them."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for r in items for t in r["terms"]}))}
    known = spark.sparkContext.broadcast({t.encode(): i for t, i in number.items()})
    postings = cut(_postings(docs, known, id_col, text_col))
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(number), np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        weight[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    asked = spark.sparkContext.broadcast((weight, [(r["row"], r["item_id"], np.array(sorted(number[t] for t in r["terms"]), np.int64)) for r in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, wanted = asked.value
        best = [Best(k) for _ in wanted]
        for part in _runs(batches):
            id_, n, terms, tf = (part.column(c) for c in range(4))
            none = np.asarray(id_.is_null())
            ids = np.asarray(id_.fill_null(0))
            size = np.diff(np.asarray(terms.offsets).astype(np.int64))
            doc = np.repeat(np.arange(len(ids)), size)
            term, tf = np.asarray(terms.flatten()).astype(np.int64), np.asarray(tf.flatten())
            value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * norms(np.asarray(n), n_docs, n_terms)[doc]))
            tree = MaxTree(term, doc, value, len(ids))
            for (_, _, own), b in zip(wanted, best):
                search(tree, own, b, ids, none)
        for (row, item, _), b in zip(wanted, best):
            m = len(b.score)
            yield pa.RecordBatch.from_arrays([pa.array([row] * m, pa.int64()), pa.array([item] * m, pa.int64()), pa.array(b.id, pa.int64(), mask=b.none), pa.array(b.score)], names=["row", "item_id", "id", "score"])

    out = cut(postings.where("size(terms) > 0").mapInArrow(run, "row long, item_id long, id long, score long"))
    drop(postings)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches as runs of at most RUN_DOCS documents and about RUN_POSTINGS postings."""
    for batch in batches:
        at = np.asarray(batch.column(2).offsets).astype(np.int64)
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(at, at[a] + RUN_POSTINGS, "left"))
            b = min(max(b, a + 1), a + RUN_DOCS, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).slice(a, b - a)) for c in range(4)], names=batch.schema.names)
            a = b


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score for every item, equal scores by ascending id (null last).

    A text's terms are its maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased.  Null or empty texts have none: they
    count for nothing and are never found, and an item without a term that a document holds has no rows.  Rows that repeat an id are
    documents of their own, and ones that repeat an item are items of their own, so equal items have equal lists.
    Whole texts count, in statistics and scores; columns that are not named are not read.  Empty tables give none.

    The items are the query set: they go to the tasks in blocks of about BLOCK_TERMS terms, each a job over all documents, so nothing
    that is sent grows with either table.
    """
    spark = docs.sparkSession

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[x.decode() for x in occurrences(t.as_py())] for t in batch.column(2)], pa.list_(pa.string()))], names=["row", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    asked = cut(rows.mapInArrow(terms, "row long, item_id long, terms array<string>").where("size(terms) > 0"))
    blocks = math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS)
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()
        part = _block(docs, own, k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    drop(asked)
    if found is None:
        found = spark.createDataFrame([], "row long, item_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", F.col("id").alias(id_col), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Every document's score for every item.
ORACLE = r"""
WITH it AS (SELECT row_number() OVER () AS r, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
q AS (SELECT r, item_id, unnest(ts) AS term FROM it),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
u AS (SELECT k, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
p AS (SELECT k, doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
x AS (SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS v FROM p JOIN w USING (term), s),
c AS (SELECT r, item_id, k, doc_id, CAST(sum(v) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50"""
