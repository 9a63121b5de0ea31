"""Removal of long byte strings that occur twice, by expanding suffix intervals of a Burrows-Wheeler transform.

Every string of `least` bytes (a window) has one anchor: the place of the smallest hash of GRAM bytes within it, the leftmost of
equal ones.  Equal windows have equal anchors at equal distances, so windows that are equal meet where their anchors' hashes do.  A run of
windows with one anchor is a context, the bytes that they cover together; contexts whose anchor's hash occurs once in the corpus
hold nothing that repeats and go no further.  Equal contexts are one string with a multiplicity.

Contexts are dealt to tasks by anchor hash.  A task joins those of some thousand hashes to one text, sorts its suffixes, and walks its
transform: intervals of strings of one byte are extended backwards, breadth first, and the first interval to end at a place gives
that place its common prefix, in increasing order.  The walk stops at `least`: places without a value by then lie between
suffixes that share a whole window.  Windows whose interval counts two occurrences or more repeat.

A hash that very many different contexts share (a passage in ever other surroundings) is split: its windows by their distance to the anchor into halves, and each half by the
bytes that all its windows contain.  That ends where a half is one distance and contexts are windows, so no task gathers an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut, drop, mix, raw_texts, read
from .lexical_search import _ranges

#: Bytes of a string that is removed; of a gram whose hash chooses anchors; bytes of a piece of a text that is hashed at once;
#: different contexts of one hash beyond which it is split; bytes of one transform (a group more may exceed it).
LEAST, GRAM, PIECE, MOST, BATCH = 200, 32, 1 << 20, 1024, 1 << 18
#: Stands between contexts; in no UTF-8 text.
END = 255

_BASE = 0xD6E8FEB86659FD93
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MORE = 2 * PIECE + (1 << 12)
with np.errstate(over="ignore"):
    _POWER = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_MORE, np.uint64(_BASE), np.uint64))])
    _INVERSE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_MORE, np.uint64(pow(_BASE, -1, 1 << 64)), np.uint64))])


def anchors(raw: np.ndarray, off: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, first, n, lead, anchor hash, context hash) of the contexts of texts raw[off[i]:off[i + 1]], all together of 2 * PIECE bytes at most.

    A context covers windows that start at first to first + n - 1 (from the text's start); lead is the anchor's distance from first.
    """
    gram, size = min(GRAM, least), np.maximum(np.diff(off) - least + 1, 0)
    if not size.sum():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[raw] * _POWER[: len(raw)])])
        hashed = lambda a, n: mix((sums[a + n] - sums[a]) * _INVERSE[a] + n.astype(np.uint64))
        m = len(raw) - gram + 1
        h = mix((sums[gram:] - sums[:m]) * _INVERSE[:m])
        width = least - gram + 1  # grams of a window
        place = np.arange(m, dtype=np.uint64)
        low = np.full(-(-m // width) * width, np.uint64(2**64 - 1))
        low[:m] = (h & ~np.uint64((1 << 24) - 1)) | place  # of equal ones the leftmost
        rows = low.reshape(-1, width)
        ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        upto = np.minimum.accumulate(rows, axis=1).ravel()
        window = _ranges(off[:-1], off[:-1] + size)
        owner = (np.minimum(ahead[window], upto[window + width - 1]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        text = np.repeat(np.arange(len(size)), size)
        begin = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        n = np.diff(np.append(begin, len(window)))
        first, anchor, text = window[begin], owner[begin], text[begin]
        lead = anchor - first
        context = mix(hashed(first, n - 1 + least) + np.uint64(_BASE) * lead.astype(np.uint64))
        return text, first - off[text], n, lead, h[anchor], context


# -- one transform -----------------------------------------------------------------------------


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first `depth` bytes at least; places are compared 8 bytes at once, then ranks of twice as many."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= wide[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    order, h = np.argsort(key), 8
    while True:
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if h >= depth or new.all():
            return order
        key = rank << 32
        key[: n - h] |= rank[h:]
        # only suffixes with equals are sorted again; their ranks are places in the order, so the others keep theirs
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        some = order[at]
        order[at] = some[np.argsort(key[some])]
        h *= 2


def shared_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place in the order whether its suffix and the one before share fewer than `least` bytes (not looked at where both hold END before that)."""
    n = len(text)
    small = np.int32 if 256 * (n + 1) < 1 << 31 else np.int64
    before = text[order - 1]  # the byte before each suffix: the transform
    column = np.argsort(before, kind="stable").astype(small)  # rows by that byte: where they go when it is put in front
    forward = np.empty(n, small)
    forward[column] = np.arange(n, dtype=small)
    later, earlier = np.full(n, n, small), np.full(n, -1, small)  # the next row with the same byte, and the one before
    same = before[column[1:]] == before[column[:-1]]
    later[column[:-1][same]] = column[1:][same]
    earlier[column[1:][same]] = column[:-1][same]
    known = np.zeros(n + 1, bool)
    low = np.searchsorted(before[column], np.arange(END + 1)).astype(small)
    high = np.append(low[1:], small(n))[:END]
    low = low[:END]
    low, high = low[high > low], high[high > low]
    known[[0, n]] = True
    known[high] = True
    for _ in range(1, least):
        if not len(low):
            break
        many = high - low > 1
        alone = low[~many]  # strings that occur once: one row, one byte before it
        alone = forward[alone[before[alone] != END]] + small(1)
        alone = alone[~known[alone]]
        low, high = low[many], high[many]
        rows = _ranges(low, high).astype(small)
        of = np.repeat(np.arange(len(low), dtype=small), high - low)
        inner = before[rows] != END
        rows, of = rows[inner], of[inner]
        # new intervals do not overlap, so their ends and their beginnings pair in order
        ends = np.sort(forward[rows[later[rows] >= high[of]]]) + small(1)
        begins = np.sort(forward[rows[earlier[rows] < low[of]]])
        new = ~known[ends]
        low, high = np.concatenate([alone - small(1), begins[new]]), np.concatenate([alone, ends[new]])
        known[high] = True
    return known[:n]


def repeated(contexts: list[bytes], times: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int]]]:
    """For each context the runs (first, last) of starts of windows that occur twice or more in all contexts; times: how often each context counts."""
    size = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join([c + bytes([END]) for c in contexts]), np.uint8)
    order = suffixes(text, least)
    group = np.cumsum(shared_prefixes(text, order, least)) - 1
    begin = np.cumsum(size + 1) - size - 1
    whole = np.zeros(len(text), np.int64)
    whole[_ranges(begin, begin + size - least + 1)] = np.repeat(times, size - least + 1)
    counted = whole[order]
    total = np.zeros(int(group[-1]) + 1, np.int64)
    np.add.at(total, group, counted)
    on = np.zeros(len(text) + 1, bool)
    on[order[(counted > 0) & (total[group] > 1)]] = True
    edge = np.flatnonzero(np.diff(on, prepend=False))
    first, last = edge[::2], edge[1::2] - 1
    of = np.searchsorted(begin, first, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for k, a, z in zip(of.tolist(), (first - begin[of]).tolist(), (last - begin[of]).tolist()):
        out[k].append((a, z))
    return out


# -- all documents -----------------------------------------------------------------------------


def _anchor_rows(least: int):
    names = ["k1", "k2", "first", "n", "lead", "h", "c"]

    def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, offsets, rows, where each begins in its row) of bounded size; pieces of a long text overlap by a window less a byte."""
        for a, part in blocks(texts, PIECE):
            raw, off = raw_texts(part)
            if len(raw) <= 2 * PIECE:
                yield raw, off, np.arange(a, a + len(part)), np.zeros(len(part), np.int64)
                continue
            for i in range(len(part)):
                own = raw[off[i] : off[i + 1]]
                for x in range(0, max(1, len(own) - least + 1), PIECE):
                    cutout = own[x : x + PIECE + least - 1]
                    yield cutout, np.array([0, len(cutout)]), np.array([a + i]), np.array([x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, off, rows, at in pieces(batch.column(2)):
                text, first, n, lead, h, c = anchors(raw, off, least)
                of = pa.array(rows[text])
                signed = lambda v: pa.array(v.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(first + at[text]), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32)), signed(h), signed(c)], names=names)

    return run


def _transforms(least: int, batch_bytes: int):
    """Rows (g, c, times, ctx), ordered by g and c, to (g, c, runs) of contexts with windows that repeat; equal (g, c) come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        times: list[int] = []
        contexts: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            found = repeated(contexts, np.array(times, np.int64), least)
            some = [(g, c, [{"first": a, "last": z} for a, z in x]) for (g, c), x in zip(keys, found) if x]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], kind)], names=["g", "c", "runs"])

        for batch in batches:
            for g, c, t, x in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if keys and keys[-1] == (g, c):
                    continue
                if size >= batch_bytes and keys[-1][0] != g:
                    yield done()
                    keys, times, contexts, size = [], [], [], 0
                keys.append((g, c))
                times.append(t)
                contexts.append(x)
                size += len(x) + 1
        if keys:
            yield done()

    return run


def _halves(rows: DataFrame, least: int) -> DataFrame:
    """Contexts of split hashes: windows at distances lo to hi - 1 from the anchor, as two rows, each under the bytes that all windows of its half contain."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = rows.withColumn("r", F.explode(F.array(F.struct(F.col("lo").alias("x"), mid.alias("y")), F.struct(mid.alias("x"), F.col("hi").alias("y"))))).where("r.y > r.x")
    x, y, lead, n = F.col("r.x"), F.col("r.y"), F.col("lead"), F.col("n")
    parts = parts.withColumn("far", F.least(lead, y - 1)).withColumn("near", F.greatest(lead - n + 1, x)).where("near <= far")
    core = F.substring(F.col("ctx"), lead - x + 1, x + least - (y - 1))
    own = F.substring(F.col("ctx"), lead - F.col("far") + 1, F.col("far") - F.col("near") + least)
    parts = parts.select(F.xxhash64("g", x, y, core).alias("g"), x.alias("lo"), y.alias("hi"), "h", "c0", (F.col("shift") + lead - F.col("far")).alias("shift"), F.col("far").alias("lead"), (F.col("far") - F.col("near") + 1).alias("n"), "times", own.alias("ctx"))
    return parts.withColumn("c", F.xxhash64("ctx", "lead"))


def repeated_windows(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 (of id and text), runs: array<struct<first, last>> of the starts of windows that occur twice or more."""
    k1, k2 = _key(docs, id_col, text_col)
    slim = docs.select(k1.alias("k1"), k2.alias("k2"), docs[text_col].cast("string").alias("text"))
    every = cut(slim.mapInArrow(_anchor_rows(least), "k1 long, k2 long, first long, n int, lead int, h long, c long"))
    shared = cut(every.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"))  # written, so that the join's hot hashes can be split
    mine = cut(every.join(shared, "h", "left_semi"))
    drop(every, shared)
    # equal contexts are one string; its bytes come from one of the documents that hold it
    groups = mine.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "first", "n", "lead")).alias("o"))
    held = groups.select("o.k1", "o.k2", F.struct("h", "c", "times", "o.first", "o.n", "o.lead").alias("x")).groupBy("k1", "k2").agg(F.collect_list("x").alias("held"))
    whole = slim.select("k1", "k2", F.encode("text", "UTF-8").alias("raw")).join(held, ["k1", "k2"]).select("raw", F.explode("held").alias("x"))
    size = F.col("x.n") - 1 + F.lit(least)
    strings = cut(whole.select("x.h", "x.c", "x.times", "x.n", "x.lead", F.substring("raw", (F.col("x.first") + 1).cast("int"), size.cast("int")).alias("ctx")))
    hot = cut(strings.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > MOST).select("h"))
    ready, members, made = [strings.join(hot, "h", "left_anti").select(F.col("h").alias("g"), "c", "times", "ctx")], [], []
    left = strings.join(hot, "h", "left_semi").dropDuplicates(["h", "c"]).select(F.col("h").alias("g"), F.lit(0).alias("lo"), F.lit(least - min(GRAM, least) + 1).alias("hi"), "h", F.col("c").alias("c0"), F.lit(0).alias("shift"), "lead", "n", "times", "ctx")
    while not hot.isEmpty():
        rows = cut(_halves(left, least))
        own = rows.groupBy("g", "c").agg(F.sum("times").alias("times"), F.first("ctx").alias("ctx"))
        more = cut(own.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > MOST).select("g"))
        ready.append(own.join(more, "g", "left_anti").select("g", "c", "times", "ctx"))
        members.append(rows.join(more, "g", "left_anti").select("g", "c", "h", "c0", "shift"))
        left = rows.join(more, "g", "left_semi")
        made += [hot, rows]
        hot = more
    every_string = ready[0]
    for r in ready[1:]:
        every_string = every_string.unionByName(r)
    found = cut(every_string.repartition("g").sortWithinPartitions("g", "c").mapInArrow(_transforms(least, BATCH), "g long, c long, runs array<struct<first:int,last:int>>"))
    moved = lambda by: F.transform("runs", lambda r: F.struct((r["first"] + by).alias("first"), (r["last"] + by).alias("last")))
    # what was found for parts of a context goes back to the whole
    of = found.select(F.col("g").alias("h"), "c", "runs")
    for m in members:
        of = of.unionByName(found.join(m, ["g", "c"]).select("h", F.col("c0").alias("c"), moved(F.col("shift")).alias("runs")))
    out = mine.join(of, ["h", "c"]).select("k1", "k2", F.explode(moved(F.col("first"))).alias("r")).groupBy("k1", "k2").agg(F.collect_set("r").alias("runs"))
    out = cut(out)
    drop(mine, strings, hot, found, *made)
    return out


def _key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    i, t = docs[id_col], docs[text_col].cast("string")
    return F.xxhash64(i, t), F.xxhash64(F.lit(7), t, i)


def dedup_substrings(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, spans (array<struct<start, end>> of removed bytes, end exclusive), kept (binary: the other bytes).

    A byte goes if a string of `least` bytes that covers it starts anywhere else too, in the same or another document; all strings are
    judged on the input.  Null counts as empty.  Every row is a document: rows that repeat id and text repeat each other, and so do equal texts under
    other ids.  Texts of any length are whole; one shorter than `least` bytes loses nothing.  Cuts fall between bytes, so kept need not be
    valid UTF-8.  Columns that are not named are not read; an empty table gives an empty one.  Equal contexts are told by 128 bits of hashes.
    """
    runs = repeated_windows(docs, least, id_col, text_col)
    k1, k2 = _key(docs, id_col, text_col)
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"), k1.alias("k1"), k2.alias("k2")).join(runs, ["k1", "k2"], "left").select(id_col, "text", "runs")

    def spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(first, kind="stable")
        start, end = first[order], np.maximum.accumulate(last[order] + least)
        begin = np.append(True, start[1:] > end[:-1])
        return start[begin], end[np.append(np.flatnonzero(begin)[1:] - 1, len(end) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in blocks(batch.column(1)):
                n_bytes, n_removed, out, kept = [], [], [], []
                for t, r in zip(part.to_pylist(), batch.column(2).slice(a, len(part))):
                    raw = (t or "").encode()
                    pairs, at, left = [], 0, []
                    if r.is_valid:
                        v = r.values
                        start, end = spans(np.asarray(v.field("first")).astype(np.int64), np.asarray(v.field("last")).astype(np.int64))
                        pairs = list(zip(start.tolist(), end.tolist()))
                    for x, y in pairs:
                        left.append(raw[at:x])
                        at = y
                    left.append(raw[at:])
                    n_bytes.append(len(raw))
                    n_removed.append(sum(y - x for x, y in pairs))
                    out.append([{"start": x, "end": y} for x, y in pairs])
                    kept.append(b"".join(left))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "spans", "kept"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_substrings(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of every text.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS x FROM documents),
n AS (SELECT *, octet_length(x) AS n FROM d),
p AS (SELECT k, x, unnest(range(0, n - {LEAST - 1})) AS i FROM n),
w AS (SELECT k, i, x[i + 1:i + {LEAST}] AS s FROM p),
o AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT k, i, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i) > {LEAST}, true) AS fresh FROM w WHERE s IN (SELECT s FROM o)),
g AS (SELECT k, i, sum(fresh::INT) OVER (PARTITION BY k ORDER BY i) AS nr FROM r),
a AS (SELECT k, nr, min(i) AS a, max(i) + {LEAST} AS z FROM g GROUP BY k, nr),
b AS (SELECT k, nr, a, z, coalesce(lag(z) OVER (PARTITION BY k ORDER BY nr), 0) AS before FROM a),
c AS (SELECT n.k, sum(z - a) AS removed, count(*) AS spans, string_agg(hex(x[before + 1:a]), '' ORDER BY nr) || hex(any_value(x)[max(z) + 1:]) AS kept FROM b JOIN n ON b.k = n.k GROUP BY n.k)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(unhex(kept), x)) AS kept_sha256 FROM n LEFT JOIN c ON n.k = c.k"""
