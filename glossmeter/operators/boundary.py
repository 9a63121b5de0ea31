"""Agreement on token boundaries: edit counts with transpositions, and kappa."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import begins, span, unpacked

COUNTS = ("n_match", "n_ad", "n_trans", "w_trans", "n_pot", "n_a", "n_b")


def boundary_masses(items: DataFrame) -> DataFrame:
    """Minimum tokens in their given order: sent_id, side, gap_at, at (boundary places; gap_at null without a gap), total.

    Windows go over the sentence, both sides together, so there is one exchange on sent_id (none if the items are dealt by it
    already) and one sort, by the order that rows come in; what belongs to a side is summed for each side and chosen.
    """
    w = W.partitionBy("sent_id").orderBy("ord", "side")
    sent, behind = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), w.rowsBetween(W.unboundedPreceding, -1)
    own = lambda f, c, w: F.when(F.col("side") == "a", f(F.when(F.col("side") == "a", F.col(c))).over(w)).otherwise(f(F.when(F.col("side") == "b", F.col(c))).over(w))
    rows = items.where("is_min").select("sent_id", "side", "ord", "start", "end")
    before = F.coalesce(own(lambda x: F.last(x, ignorenulls=True), "end", behind), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("gap", F.greatest(F.col("start") - F.col("before"), F.lit(0))).withColumn("len", F.col("end") - F.col("start")).withColumn("mass", F.col("gap") + F.col("len"))
    rows = rows.withColumn("upto", own(F.sum, "mass", w.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", own(F.sum, "mass", sent))
    return rows.select("sent_id", "side", F.when(F.col("gap") > 0, F.col("upto") - F.col("len") - 1).alias("gap_at"), (F.col("upto") - 1).alias("at"), "total")


def boundary_positions(items: DataFrame) -> DataFrame:
    """sent_id, side, place (characters before it, less one), n_pot (characters less one), one row a boundary.

    Tokens have positive length; a sentence without minimum tokens on a side has no rows on that side.
    """
    m = boundary_masses(items)
    return m.select("sent_id", "side", F.explode(F.array_distinct(F.array_compact(F.array("gap_at", "at")))).alias("place"), (F.col("total") - 1).alias("n_pot")).where("place < n_pot")


class _Open:
    """What is known of the sentence that may go on in the next batch: for each side the last end, characters so far (None: no token yet) and places not yet
    counted, the first place that a transposition may take next, and its sums."""

    def __init__(self, sent: pa.Array | None = None):
        self.sent, self.end, self.upto, self.held = sent, [0, 0], [None, None], [np.empty(0, "i8")] * 2
        self.walk, self.sums = None, np.zeros(6, "i8")


def _side(open_: _Open, s: int, key: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and places of a side's boundaries, the open sentence's held ones first, and characters of each of n sentences, with whether there is a token."""
    upto, some = np.zeros(n, "i8"), np.zeros(n, bool)
    some[0], upto[0] = open_.upto[s] is not None, open_.upto[s] or 0
    held = open_.held[s]
    if not len(key):
        open_.end[s] = 0 if n > 1 else open_.end[s]
        return np.zeros(len(held), "i8"), held, upto, some
    first, last = np.ones(len(key), bool), np.ones(len(key), bool)
    first[1:] = last[:-1] = key[1:] != key[:-1]
    before = np.concatenate([[0], end[:-1]])
    before[first] = 0
    if key[0] == 0:
        before[0] = open_.end[s]
    gap = np.maximum(start - before, 0)
    mass = gap + end - start
    so_far = np.cumsum(mass)
    so_far = so_far - (so_far - mass)[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] + np.where(key == 0, upto[0], 0)
    upto[key[last]], some[key[last]] = so_far[last], True
    at = np.stack([so_far - (end - start) - 1, so_far - 1], 1).ravel()
    shown = np.stack([gap > 0, np.ones(len(key), bool)], 1).ravel()
    open_.end[s] = int(end[-1]) if key[-1] == n - 1 else 0 if n > 1 else open_.end[s]
    return np.concatenate([np.zeros(len(held), "i8"), np.repeat(key, 2)[shown]]), np.concatenate([held, at[shown]]), upto, some


def _walked(open_: _Open, key: np.ndarray, is_b: np.ndarray, start: np.ndarray, end: np.ndarray, whole: bool, done: bool, winlen: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of sentences 0 (the open one) to the last of key, characters of each side and whether it has any; the last sentence stays open unless done.

    What is counted of the open sentence: places before the last ones of both sides, or nothing yet if whole.  A place is a number that goes on from sentence to
    sentence with a gap wider than winlen, so all of them are walked together.
    """
    n = int(key[-1]) + 1 if len(key) else 1
    sides = [_side(open_, s, key[m], start[m], end[m], n) for s, m in enumerate((~is_b, is_b))]
    upto, some = np.stack([x[2] for x in sides], 1), np.stack([x[3] for x in sides], 1)
    every = np.concatenate([x[1] for x in sides] + [[0]])
    low = int(every.min())
    width = int(every.max()) - low + winlen + 4
    limit = np.iinfo("i8").max  # of the last sentence's places that are counted now
    if not done:
        limit = int(upto[-1].min()) - winlen - 2 if some[-1].all() and not whole else low - 1
    numbers, held = [], []
    for s, (k, at, _, _) in enumerate(sides):
        now = (k == n - 1) & (not done)
        held.append(at[now & (at > limit)])
        kept = now | (at < upto[k, s] - 1)
        numbers.append((k[kept] * width + at[kept] - low) * 2 + s)
    both = np.concatenate(numbers)
    both.sort(kind="stable")
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    place, is_b = both >> 1, (both & 1).astype(bool)
    most = (n - 1) * width + limit - low if not done else np.iinfo("i8").max
    same = np.zeros(len(place) + 1, bool)  # whether a place is the one before it
    same[1:-1] = place[1:] == place[:-1]
    of = lambda places: np.bincount(places[places <= most] // width, minlength=n)
    n_match, alone = of(place[same[:-1]]), ~(same[:-1] | same[1:])
    place, is_b = place[alone], is_b[alone]
    only_a, only_b = of(place[~is_b]), of(place[is_b])
    # the next place of the other side is the first of the next run
    runs = np.flatnonzero(is_b[1:] != is_b[:-1]) + 1 if len(is_b) else np.empty(0, "i8")
    at = np.arange(runs[-1] if len(runs) else 0)
    opp = place[runs[np.searchsorted(runs, at, "right")]]
    hit = (opp - place[at] <= winlen) & (place[at] <= most)
    place, opp = place[at][hit], opp[hit]
    after = np.searchsorted(place, opp + 2).tolist()
    k = 0 if open_.walk is None else int(np.searchsorted(place, open_.walk - low))
    taken = []
    while k < len(after):
        taken.append(k)
        k = after[k]
    far, of_taken = (opp - place)[taken], place[taken] // width
    sums = np.stack([n_match, only_a + only_b, n_match + only_a, n_match + only_b, np.bincount(of_taken, minlength=n), np.bincount(of_taken, far, minlength=n).astype("i8")], 1)
    sums[0] += open_.sums
    if len(taken) and of_taken[-1] == n - 1:
        open_.walk = int(opp[taken[-1]]) + 2 - (n - 1) * width + low
    elif n > 1:
        open_.walk = None
    open_.held, open_.sums, open_.upto = held, sums[-1], [int(u) if x else None for u, x in zip(upto[-1], some[-1])]
    return sums, upto, some


def _counted(batches: Iterator[pa.RecordBatch], winlen: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row a sentence from rows (sent_id, kind: 1 for b and 2 for whole, span), whose sentences stand together in their given order."""
    open_ = _Open()

    def table(sent: pa.Array, sums: np.ndarray, upto: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        lengths = [pa.array(upto[:, s], pa.int64(), mask=~some[:, s]) for s in (0, 1)]
        return pa.RecordBatch.from_arrays([sent, *lengths, *(pa.array(sums[:, c], pa.int64()) for c in range(sums.shape[1]))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = begins(open_.sent, batch.column(0))
        key, kind, (start, end) = np.cumsum(new), batch.column(1).to_numpy(zero_copy_only=False), unpacked(batch.column(2))
        none = open_.sent is None
        sums, upto, some = _walked(open_, key, (kind & 1).astype(bool), start, end, bool(kind[-1] & 2), False, winlen)
        first = batch.column(0).take(pa.array(np.flatnonzero(new)))
        ids = first if none else pa.concat_arrays([open_.sent, first])
        open_.sent = ids.slice(len(ids) - 1)
        out = slice(int(none), -1)
        yield table(ids.slice(0, len(ids) - 1), sums[out], upto[out], some[out])
    if open_.sent is not None:
        none = np.empty(0, "i8")
        yield table(open_.sent, *_walked(open_, none, none.astype(bool), none, none, False, True, winlen))


def boundary_counts(items: DataFrame, winlen: int = 1) -> DataFrame:
    """sent_id and COUNTS. Sentences where a side has no minimum token, or the lengths differ, have valid = false.

    Places on one side only are walked from the left; one with its opposite within winlen makes a transposition of weight
    1 - distance / (winlen + 1), and the walk goes on two places behind that opposite.  Tokens are sorted once and stream by in Arrow batches; of a sentence
    that goes on, only the places are kept by which one side is ahead of the other (all of them if a token ends before its start, so that places may go back).
    """
    w = W.partitionBy("sent_id").orderBy("ord", "side")
    rows = items.where("is_min AND start IS NOT NULL AND end IS NOT NULL").select("sent_id", "side", "ord", "start", "end")
    rows = rows.withColumn("whole", F.bool_or(F.col("end") < F.col("start")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = rows.sortWithinPartitions("sent_id", "ord", "side")  # the order that they have
    kind = F.when(F.col("side") == "b", 1).otherwise(0) + F.when(F.col("whole"), 2).otherwise(0)
    names = ["sent_id", "ta", "tb", "n_match", "n_odd", "n_a", "n_b", "n", "far"]
    kinds = T.StructType([T.StructField(c, T.LongType() if k else items.schema["sent_id"].dataType) for k, c in enumerate(names)])
    per = rows.select("sent_id", kind.cast("byte").alias("kind"), span().alias("span")).mapInArrow(lambda batches: _counted(batches, winlen, names), kinds)
    valid = F.coalesce(F.col("ta") == F.col("tb"), F.lit(False))
    return per.select("sent_id", valid.alias("valid"), "n_match", (F.col("n_odd") - 2 * F.col("n")).alias("n_ad"), F.col("n").alias("n_trans"), (F.col("n") - F.col("far") / F.lit(float(winlen + 1))).alias("w_trans"), (F.col("ta") - 1).alias("n_pot"), "n_a", "n_b")


def boundary_kappa(counts: DataFrame, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Kappa of the summed counts; NaN where there is no boundary or chance is 1; null without sentences.

    strict: an invalid sentence fails the query, and so does a corpus without sentences; else it is left out.
    """
    ok = F.when(~F.col("valid"), F.raise_error(F.lit("both sides need minimum tokens over the same characters"))).otherwise(True) if strict else F.col("valid")
    s = counts.where(ok).groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in COUNTS])
    if strict:
        s = s.withColumn("n_match", F.coalesce("n_match", F.raise_error(F.lit("no sentences"))))
    nan = F.lit(float("nan"))
    part = F.try_divide(F.col("n_ad") + F.col("w_trans"), (F.col("n_ad") + F.col("n_trans") + F.col("n_match")).cast("double"))
    chance = F.try_divide(F.col("n_a").cast("double") * F.col("n_b"), F.col("n_pot").cast("double") * F.col("n_pot"))
    kappa = F.coalesce(F.try_divide(1.0 - part - chance, 1.0 - chance), nan)
    return s.withColumn("kappa", F.when(F.col("n_match").isNotNull(), kappa))
