"""Label pairs of aligned tokens and token matches, counted in one pass over items sorted once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .align import MISFIT, fold
from .scan import begins, span, unpacked

#: Pieces of an open sentence's pairs that are held before equal pairs in them are counted together.
PIECES = 64


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class Matches:
    """Token matches: the nth item of a start on one side and the nth on the other, right if they end alike.  Of the last start, whose items may go on, ends are kept."""

    def __init__(self):
        self.rest = [np.empty(0, t) for t in ("i8", "i8", bool)]

    def __call__(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, is_b: np.ndarray, done: bool = False) -> list[int]:
        """right, gold's and predicted items of starts that are over; key: number of the sentence, 0 for the open one."""
        n = len(self.rest[0])
        start, end, is_b = (np.concatenate(x) for x in zip(self.rest, (start, end, is_b)))
        key = np.concatenate([np.zeros(n, "i8"), key])
        cell = np.cumsum(_runs(key, start))
        now = np.ones(len(cell), bool) if done or not len(cell) else cell < cell[-1]
        self.rest = [start[~now], end[~now], is_b[~now]]
        sides = []
        for mine in (~is_b & now, is_b & now):
            c, at = cell[mine], np.arange(int(mine.sum()))
            sides.append((c, at - np.maximum.accumulate(np.where(_runs(c), at, 0)), end[mine]))
        (c, i, x), (d, j, y) = sides
        if not len(c) or not len(d):
            return [0, len(c), len(d)]
        width = int(max(i.max(), j.max())) + 1
        other = d * width + j
        at = np.minimum(np.searchsorted(other, c * width + i), len(other) - 1)
        return [int(np.sum((other[at] == c * width + i) & (y[at] == x))), len(c), len(d)]


class Pairs:
    """Pairs of the groups of align() in tokens sorted by sentence and start.

    In sentences that fit, all tokens of a group come before those of the next one, and a group ends where the last ends of both sides are the same.  A sentence goes on from batch
    to batch with its first starts, last ends, the sizes and first labels of its open group, and its pairs so far, of which equal ones are counted together.
    """

    def __init__(self, tasks: dict[str, tuple[str, bool]], by: bool, shares: bool, strict: bool, some: bool):
        self.tasks, self.by, self.shares, self.strict, self.some = tasks, by, shares, strict, some
        self.names = sorted({label for label, _ in tasks.values()})
        self.begin()

    def begin(self) -> None:
        self.lo, self.end, self.n, self.odd, self.pairs = [None, None], [None, None], [0, 0], False, 0
        self.first = {x: [None, None] for x in self.names}
        self.held: dict[str, list[pa.RecordBatch]] = {t: [] for t in self.tasks}

    def fits(self, judged: np.ndarray, odd: np.ndarray, some: np.ndarray, lo: np.ndarray, hi: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        fits = ~odd & some.all(1) & (lo[:, 0] == lo[:, 1]) & (hi[:, 0] == hi[:, 1])
        if self.strict and not fits[judged].all():
            raise ValueError(MISFIT)
        if self.some and not pairs[judged & fits].all():
            raise ValueError("a sentence has no pairs")
        return fits & judged

    def counted(self, task: str, a: np.ndarray, b: np.ndarray, key: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        """(key, a, b, n, tp) of pairs given as codes."""
        null = len(texts)
        same = (a == b) & (a != null)
        if self.shares:
            n, tp = np.bincount(key), np.bincount(key, same)
            keys = np.flatnonzero(n)
            none = pa.nulls(len(keys), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), none, none, pa.array(n[keys], pa.int64()), pa.array(tp[keys].astype("i8"), pa.int64())], names=["key", "a", "b", "n", "tp"])
        wide = null + 1
        code, n = np.unique((key * wide + a) * wide + b, return_counts=True)
        a, b = code // wide % wide, code % wide
        text = lambda c: texts.take(pa.array(c, mask=c == null))
        return pa.RecordBatch.from_arrays([pa.array(code // wide // wide, pa.int64()), text(a), text(b), pa.array(n, pa.int64()), pa.array(np.where((a == b) & (a != null), n, 0), pa.int64())], names=["key", "a", "b", "n", "tp"])

    def hold(self, task: str, piece: pa.RecordBatch) -> None:
        held = self.held[task]
        held.append(piece)
        if len(held) >= PIECES:
            whole = pa.Table.from_batches(held).group_by(["key", "a", "b"]).aggregate([("n", "sum"), ("tp", "sum")]).rename_columns({"n_sum": "n", "tp_sum": "tp"})
            held[:] = whole.select(["key", "a", "b", "n", "tp"]).combine_chunks().to_batches()

    def __call__(self, key: np.ndarray, n: int, start: np.ndarray, end: np.ndarray, is_b: np.ndarray, labels: dict[str, pa.Array]) -> Iterator[tuple[str, pa.RecordBatch]]:
        """Pairs of sentences 0 (the open one) to n - 2; sentence n - 1 stays open."""
        odd, some, judged = np.zeros(n, bool), np.zeros((n, 2), bool), np.zeros(n, bool)
        lo, hi = np.zeros((n, 2), "i8"), np.zeros((n, 2), "i8")
        odd[0] = self.odd
        at = np.arange(len(key))
        head = np.searchsorted(key, np.arange(n))  # first row of each sentence
        last = []
        for s, mine in enumerate((~is_b, is_b)):
            if self.end[s] is not None:
                some[0, s], lo[0, s], hi[0, s] = True, self.lo[s], self.end[s]
            k, x, y = key[mine], start[mine], end[mine]
            new = _runs(k)
            if len(k):
                before = np.concatenate([[0], y[:-1]])
                goes_on = ~new
                if k[0] == 0 and self.end[s] is not None:
                    goes_on[0], before[0] = True, self.end[s]
                np.logical_or.at(odd, k, (y <= x) | (goes_on & (x < before)))
                lo[k[new & ~goes_on], s] = x[new & ~goes_on]
                ends = np.flatnonzero(np.append(new[1:], True))
                hi[k[ends], s], some[k[ends], s] = y[ends], True
            row = np.maximum.accumulate(np.where(mine, at, -1)) if len(at) else at
            known = row >= head[key]
            last.append((known | ((key == 0) & (self.end[s] is not None)), np.where(known, end[row], self.end[s] or 0)))
        judged |= some.any(1)
        shared = last[0][0] & last[1][0] & (last[0][1] == last[1][1])
        starts = _runs(key)
        if len(at):
            starts[0] = key[0] != 0
            starts[1:] |= shared[:-1]
        group = np.cumsum(starts)
        groups = int(group[-1]) + 1 if len(at) else 1
        sizes, first = [], []
        for s, mine in enumerate((~is_b, is_b)):
            g = group[mine]
            size = np.bincount(g, minlength=groups)
            row = np.full(groups, s)  # the places of labels that are carried come first
            new = _runs(g)
            fresh = g[new]
            row[fresh] = at[mine][new] + 2
            if self.n[s]:
                row[0] = s
            size[0] += self.n[s]
            sizes.append(size)
            first.append(row)
        of = key[shared]
        over = group[shared]
        n_a, n_b = sizes[0][over], sizes[1][over]
        codes = {}
        for x in self.names:
            coded = pa.concat_arrays([pa.array(self.first[x], labels[x].type), labels[x]]).dictionary_encode()
            codes[x] = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype("i8"), coded.dictionary
        found, pairs = {}, np.zeros(n, "i8")
        pairs[0] = self.pairs
        for task, (label, one_to_one) in self.tasks.items():
            ok = (n_a == n_b) & ((n_a == 1) | (not one_to_one))
            code = codes[label][0]
            found[task] = of[ok], code[first[0][over[ok]]], code[first[1][over[ok]]]
            pairs += np.bincount(of[ok], minlength=n)
        closed = np.arange(n) < n - 1
        fits = np.zeros(n, bool)
        fits[closed] = self.fits(judged[closed], odd[closed], some[closed], lo[closed], hi[closed], pairs[closed])
        for task, (k, a, b) in found.items():
            if n > 1:
                if fits[0]:
                    for piece in self.held[task]:
                        yield task, piece
                self.held[task] = []
            now = fits[k]
            if now.any():
                yield task, self.counted(task, a[now], b[now], k[now] if self.by else np.zeros(int(now.sum()), "i8"), codes[self.tasks[task][0]][1])
            stays = k == n - 1
            if stays.any():
                self.hold(task, self.counted(task, a[stays], b[stays], np.zeros(int(stays.sum()), "i8"), codes[self.tasks[task][0]][1]))
        # the open sentence and its open group, which is behind the last shared end
        opened = bool(len(at)) and bool(shared[-1])
        alive = not len(at) or key[-1] == n - 1  # else the last sentence has no token yet
        for s in (0, 1):
            self.lo[s], self.end[s] = (int(lo[-1, s]), int(hi[-1, s])) if some[-1, s] else (None, None)
            self.n[s] = int(sizes[s][-1]) if alive and not opened else 0
            for x in self.names:
                code, texts = codes[x]
                c = int(code[first[s][-1]])
                self.first[x][s] = texts[c].as_py() if self.n[s] and c < len(texts) else None
        self.odd, self.pairs = bool(odd[-1]), int(pairs[-1])


def _stream(batches: Iterator[pa.RecordBatch], pairs: Pairs, names: list[str], kind: pa.DataType, tokens: str | None) -> Iterator[pa.RecordBatch]:
    """Rows (sent_id, kind: 1 for b and 2 for a minimum token, span, labels) in order, as rows of names."""
    sent, matches, by = None, Matches(), pairs.by

    def row(task: str, ids: pa.Array | None, a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array, tp: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*([ids] if by else []), pa.array([task] * len(n), pa.string()), a, b, n, m, tp], names=names)

    def out(found: Iterator[tuple[str, pa.RecordBatch]], ids: pa.Array | None) -> Iterator[pa.RecordBatch]:
        for task, x in found:
            yield row(task, ids.take(x.column(0)) if by else None, x.column(1), x.column(2), x.column(3), x.column(3), x.column(4))

    def matched(x: list[int]) -> Iterator[pa.RecordBatch]:
        none, (right, gold, pred) = pa.nulls(1, pa.string()), (pa.array([v], pa.int64()) for v in x)
        yield row(tokens, None, none, none, gold, pred, right)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = begins(sent, batch.column(0))
        fresh = batch.column(0).take(pa.array(np.flatnonzero(new)))
        ids = pa.concat_arrays([pa.nulls(1, kind) if sent is None else sent, fresh])
        key, flags, (start, end) = np.cumsum(new), batch.column(1).to_numpy(zero_copy_only=False), unpacked(batch.column(2))
        is_b, is_min = (flags & 1).astype(bool), (flags & 2).astype(bool)
        if tokens:
            yield from matched(matches(key, start, end, is_b))
        labels = {x: batch.column(3 + k) for k, x in enumerate(pairs.names)}
        if not is_min.all():
            key, start, end, is_b = (x[is_min] for x in (key, start, end, is_b))
            labels = {x: c.filter(pa.array(is_min)) for x, c in labels.items()}
        yield from out(pairs(key, len(ids), start, end, is_b, labels), ids)
        sent = ids.slice(len(ids) - 1)
    if sent is not None:
        none, empty = np.empty(0, "i8"), np.empty(0, bool)
        if tokens:
            yield from matched(matches(none, none, none, empty, done=True))
        yield from out(pairs(none, 2, none, none, empty, {x: pa.nulls(0, pa.string()) for x in pairs.names}), pa.concat_arrays([sent, sent]))


def pair_counts(items: DataFrame, tasks: dict[str, tuple[str, bool]], by: bool = False, shares: bool = False, strict: bool = False, some: bool = False, tokens: str | None = None) -> DataFrame:
    """sent_id if by, task, a, b, n, m, tp: how often labels a and b pair; tasks: label and one_to_one as in align.label_pairs(), by name.

    Rows may repeat a pair, so sums of n are what counts.  shares: a and b are null, tp: pairs of which both are the same.  some: a sentence that fits and has no pair is an
    error.  tokens: a task of this name has token matches of all items: tp right ones, n of gold, m predicted.  Items are sorted once and stream by in Arrow batches.
    """
    names = sorted({label for label, _ in tasks.values()})
    w = W.partitionBy("sent_id").orderBy("start", "side", "ord")
    rows = items.where("start IS NOT NULL AND end IS NOT NULL" + ("" if tokens else " AND is_min"))
    rows = rows.select("sent_id", "side", "ord", "start", "end", "is_min", *names).withColumn("nr", F.row_number().over(w))
    rows = rows.sortWithinPartitions("sent_id", "start", "side", "ord")  # the order that they have
    kind = F.when(F.col("side") == "b", 1).otherwise(0) + F.when(F.col("is_min"), 2).otherwise(0) + F.when(F.col("nr") == 1, 4).otherwise(0)
    sent = items.schema["sent_id"].dataType
    out = [*([T.StructField("sent_id", sent)] if by else []), *(T.StructField(c, T.StringType()) for c in ("task", "a", "b")), *(T.StructField(c, T.LongType()) for c in ("n", "m", "tp"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is not None:
            yield from _stream(_chained(head, batches), Pairs(tasks, by, shares, strict, some), [f.name for f in out], head.schema.field(0).type, tokens)

    return rows.select("sent_id", kind.cast("byte").alias("kind"), span().alias("span"), *names).mapInArrow(run, T.StructType(out))


def _chained(head: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield head
    yield from rest


class Folded:
    """Groups of whole sentences, of which the last one's tokens are kept as numbers until it is over."""

    def __init__(self, strict: bool):
        self.strict, self.rest = strict, []

    def __call__(self, key: np.ndarray, n: int, start: np.ndarray, end: np.ndarray, is_b: np.ndarray) -> list[np.ndarray]:
        """(key, group, end, n_a, n_b) of sentences 0 (the open one) to n - 2."""
        last = key == n - 1
        rest = [x[last] for x in (start, end, is_b)]
        if n == 1:
            self.rest.append(rest)
            return [np.empty(0, "i8")] * 5
        open_ = [np.concatenate(x) for x in zip(*self.rest)] if self.rest else [np.empty(0, x.dtype) for x in rest]
        key = np.concatenate([np.zeros(len(open_[0]), "i8"), key[~last]])
        start, end, is_b = (np.concatenate([x, y[~last]]) for x, y in zip(open_, (start, end, is_b)))
        self.rest = [rest]
        odd, some, lo, hi, at = np.zeros(n, bool), np.zeros((n, 2), bool), np.zeros((n, 2), "i8"), np.full((n, 2), np.iinfo("i8").min), np.arange(len(key))
        before = []
        for s, mine in enumerate((~is_b, is_b)):
            k, x, y = key[mine], start[mine], end[mine]
            new = _runs(k)
            some[k, s] = True
            lo[k[new], s] = x[new]
            np.maximum.at(hi, (k, s), y)
            flat, early = y <= x, np.zeros(len(k), bool)
            early[1:] = ~new[1:] & (x[1:] < y[:-1])
            odd[k[flat | early]] = True
            row = np.maximum.accumulate(np.where(mine, at, -1)) if len(at) else at
            before.append((row, (row >= 0) & (key[row] == key)))
        same = some.all(1) & (lo[:, 0] == lo[:, 1]) & (hi[:, 0] == hi[:, 1])
        if self.strict and not same[some.any(1)].all():
            raise ValueError("a and b need to cover the same total span")
        (i, a), (j, b) = before
        plain = (same & ~odd)[key]
        over = np.flatnonzero(plain & a & b & (end[i] == end[j])) if len(at) else at
        sizes = []
        for mine in (~is_b, is_b):
            upto = np.cumsum(mine & plain)[over]
            sizes.append(np.diff(upto, prepend=0))
        k = key[over]
        out = [[k, np.arange(len(k)) - np.searchsorted(k, k), end[over], *sizes]]
        for nr in np.flatnonzero(same & odd).tolist():
            i, j = np.searchsorted(key, [nr, nr + 1])
            sides = [list(zip(*(x[i:j][m].tolist() for x in (start, end)))) for m in (~is_b[i:j], is_b[i:j])]
            groups = fold(*sides)
            if groups:
                ends = [max(sides[s][m][1] for s, members in enumerate(g) for m in members) for g in groups]
                out.append([np.full(len(groups), nr), np.arange(len(groups)), np.array(ends), *(np.array([len(g[s]) for g in groups]) for s in (0, 1))])
        return [np.concatenate(x) for x in zip(*out)]


def folded_sizes(items: DataFrame, strict: bool = False) -> DataFrame:
    """sent_id, group, end (the last one of its tokens), n_a, n_b: sizes of the groups of align.align_folded(), from minimum tokens sorted once; no token comes back from Python.

    One sentence at a time is held, as its numbers.
    """
    w = W.partitionBy("sent_id").orderBy("start", "side", "ord")
    rows = items.where("is_min AND start IS NOT NULL AND end IS NOT NULL").select("sent_id", "side", "ord", "start", "end").withColumn("nr", F.row_number().over(w))
    rows = rows.sortWithinPartitions("sent_id", "start", "side", "ord")  # the order that they have
    kind = (F.when(F.col("side") == "b", 1).otherwise(0) + F.when(F.col("nr") == 1, 4).otherwise(0)).cast("byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, folded = None, Folded(strict)
        table = lambda ids, x: pa.RecordBatch.from_arrays([ids.take(pa.array(x[0])), *(pa.array(c, pa.int64()) for c in x[1:])], names=["sent_id", "group", "end", "n_a", "n_b"])
        for batch in batches:
            if not batch.num_rows:
                continue
            new = begins(sent, batch.column(0))
            fresh = batch.column(0).take(pa.array(np.flatnonzero(new)))
            ids = pa.concat_arrays([fresh.slice(0, 1) if sent is None else sent, fresh])
            yield table(ids, folded(np.cumsum(new), len(ids), *unpacked(batch.column(2)), (batch.column(1).to_numpy(zero_copy_only=False) & 1).astype(bool)))
            sent = ids.slice(len(ids) - 1)
        if sent is not None:
            none = np.empty(0, "i8")
            yield table(sent, folded(none, 2, none, none, none.astype(bool)))

    out = [T.StructField("sent_id", items.schema["sent_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("group", "end", "n_a", "n_b"))]
    return rows.select("sent_id", kind.alias("kind"), span().alias("span")).mapInArrow(run, T.StructType(out))
