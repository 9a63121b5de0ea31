"""Alignment of two token lists: by span, and by edit path; contiguity; lookup."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import carry

MISFIT = "a and b need to cover the same total span with tokens that have a length and do not overlap"


def align(items: DataFrame, strict: bool = False) -> DataFrame:
    """Minimum tokens of sentences whose sides cover the same span, with group: the smallest end that both sides share and that is not before the token's own.

    Tokens of a side have a positive length and do not overlap; gaps are allowed.  strict: a sentence that lacks a side, or
    whose spans or tokens break this, fails the query; else it is left out (align_folded takes any tokens).  One exchange and
    one sort: every window goes over the sentence from its last end to its first, so each keeps a running value.  A token is odd if
    one of its side that ends with it or behind it begins before its end; where none is, ends of a side differ, so two that are equal are shared.
    """
    rows = _judged(items)
    return rows.withColumn("fits", F.col("same") & ~F.col("odd")).where(_wanted("fits", strict)).drop("fits", "same", "odd", "shared_from", "shared_in_all")


def _judged(items: DataFrame) -> DataFrame:
    """Minimum tokens with group, and of their sentence same (both sides cover one span) and odd (tokens overlap or have no length); shared_from, shared_in_all: tokens
    that end where one of the other side does, from here to the sentence's end and in all of it."""
    down = W.partitionBy("sent_id").orderBy(F.desc("end"), F.desc("side"))
    behind, so_far, sent = down.rowsBetween(W.unboundedPreceding, -1), down.rowsBetween(W.unboundedPreceding, 0), down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    on = lambda f, c, s: f(F.when(F.col("side") == s, F.col(c)))
    rows = items.where("is_min").withColumns({"back": F.lag("end").over(down), "next": F.lead("end").over(down), "least_a": on(F.min, "start", "a").over(behind), "least_b": on(F.min, "start", "b").over(behind)})
    no = lambda c: F.coalesce(c, F.lit(False))
    odd = (F.col("end") <= F.col("start")) | no(F.when(F.col("side") == "a", F.col("least_a")).otherwise(F.col("least_b")) < F.col("end"))
    shared = F.when(no(F.col("back") == F.col("end")) | no(F.col("next") == F.col("end")), F.col("end"))
    rows = rows.withColumns({"odd": odd, "shared": shared}).drop("back", "next", "least_a", "least_b")
    same = (on(F.min, "start", "a").over(sent) == on(F.min, "start", "b").over(sent)) & (on(F.max, "end", "a").over(sent) == on(F.max, "end", "b").over(sent))
    counts = {"shared_from": F.count("shared").over(so_far), "shared_in_all": F.count("shared").over(sent)}
    return rows.withColumns({"group": F.min("shared").over(so_far), "same": no(same), "odd": F.bool_or("odd").over(sent), **counts}).drop("shared")


#: Characters of a block at most: ends of its tokens are bits 1 to 60 of a number, and sums of two such numbers fit 64 bits.
BLOCK = 60


def _block(span: int) -> tuple[int, Column, Column]:
    """Width of a block, block and range of a token: blocks hold ends behind block * width and up to the next one's begin, ranges about span characters."""
    width = min(BLOCK, span)
    block = F.floor((F.col("end") - 1) / width)
    return width, block, F.floor(block / (span // width))


def _blocks(items: DataFrame, span: int, label: str | None = None) -> DataFrame:
    """sent_id, range, block, rest, ends: one row for each block of characters in which minimum tokens end, dealt by ranges.

    ends: array of (label, a, b), the bits at which tokens of each label end on each side (label null if none is asked for).  rest: the first start on either side, and 1 if the
    block's tokens are odd: without a length, or two of a side in one place.  Those of a side that have lengths and different ends and starts (cut off at the block's
    begin) are apart if the difference of ends and starts, as numbers, has as many bits as the tokens have characters.
    """
    width, block, range_ = _block(span)
    keys, at = ["sent_id", "range", "block"], lambda c: (F.col(c) - F.col("block") * width).cast("int")
    bit = lambda c: F.expr(f"shiftleft(1L, {c})")
    rows = items.where("is_min").withColumn("block", block).withColumn("range", range_)
    rows = rows.select(*keys, "side", "start", F.lit(None).cast("string").alias("label") if label is None else F.col(label).alias("label"), (F.col("end") <= F.col("start")).alias("flat"), at("end").alias("x1"), F.least(F.greatest(at("start"), F.lit(0)), F.lit(width)).alias("x0"))
    aggs = {"flat": F.bool_or("flat")}
    for s in "ab":
        of = lambda c, s=s: F.when(F.col("side") == s, c)
        aggs |= {f"e_{s}": F.coalesce(F.bit_or(of(bit("x1"))), F.lit(0).cast("long")), f"s_{s}": F.coalesce(F.bit_or(of(bit("x0"))), F.lit(0).cast("long")), f"n_{s}": F.count(of(F.lit(1))), f"size_{s}": F.coalesce(F.sum(of(F.col("x1") - F.col("x0"))), F.lit(0)), f"lo_{s}": F.min(of(F.col("start").cast("long")))}
    parts = rows.groupBy(*keys, *(["label"] if label else [])).agg(*[v.alias(k) for k, v in aggs.items()])
    entry = F.struct(F.col("label") if label else F.lit(None).cast("string").alias("label"), F.col("e_a").alias("a"), F.col("e_b").alias("b"))
    if label:
        how = {"e": F.bit_or, "s": F.bit_or, "n": F.sum, "size": F.sum, "lo": F.min}
        parts = parts.groupBy(*keys).agg(F.collect_list(entry).alias("ends"), F.bool_or("flat").alias("flat"), *[f(f"{c}_{s}").alias(f"{c}_{s}") for c, f in how.items() for s in "ab"])
    else:
        parts = parts.withColumn("ends", F.array(entry))
    odd = F.col("flat")
    for s in "ab":
        odd |= (F.bit_count(f"e_{s}") != F.col(f"n_{s}")) | (F.bit_count(f"s_{s}") != F.col(f"n_{s}")) | (F.bit_count(F.col(f"e_{s}") - F.col(f"s_{s}")) != F.col(f"size_{s}"))
    return parts.select(*keys, F.array("lo_a", "lo_b", odd.cast("long")).alias("rest"), "ends").where("sent_id IS NOT NULL AND range IS NOT NULL").repartition("sent_id", "range")


def _ends(blocks: DataFrame, width: int) -> DataFrame:
    """blocks with a, b: bits of all ends of a side; shared: of both; lo_shared: where the first shared one is; tail_a, tail_b: tokens behind the last shared one."""
    blocks = blocks.withColumns({s: F.expr(f"aggregate(ends, 0L, (bits, x) -> bits | x.{s})") for s in "ab"})
    blocks = blocks.withColumn("shared", F.col("a").bitwiseAND(F.col("b")))
    # without the highest shared end and what is below it
    tail = lambda s: F.bit_count(F.when(F.col("shared") == 0, F.col(s)).otherwise(F.expr(f"shiftright({s}, length(bin(shared)))"))).cast("long")
    return blocks.withColumns({"lo_shared": F.when(F.col("shared") != 0, F.col("block") * width + _lowest("shared")), "tail_a": tail("a"), "tail_b": tail("b")})


def _lowest(c: str) -> Column:
    """Place of a number's lowest bit."""
    return F.expr(f"bit_count(({c} & -{c}) - 1)")


def _open(rows: DataFrame, keys: list[str], order: str, begun: bool = False) -> DataFrame:
    """rows with open_a, open_b: tokens of a side since the last shared end before a row; begun: rows have open_a and open_b from what is before their keys."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"sum_{s}": F.coalesce(F.sum(f"tail_{s}").over(before), F.lit(0)) for s in "ab"})
    last = {f"last_{s}": F.max(F.when(F.col("lo_shared").isNotNull(), F.col(f"sum_{s}"))).over(before) for s in "ab"}
    opened = lambda s: F.col(f"sum_{s}") - F.coalesce(f"last_{s}", -F.col(f"open_{s}") if begun else F.lit(0))
    return rows.withColumns(last).withColumns({f"open_{s}": opened(s) for s in "ab"}).drop("sum_a", "sum_b", "last_a", "last_b")


def _found(items: DataFrame, span: int, strict: bool = False, label: str | None = None) -> DataFrame:
    """Blocks of the sentences that fit, with a, b, shared of _ends(), open_a, open_b, and next: the first shared end behind the block.

    Blocks are dealt by range.  What passes from range to range (the next shared end, tokens since the last one, where each side's tokens begin and end) comes from one row a
    range, and a sentence uses as many tasks as it has ranges.
    """
    width, range_ = min(BLOCK, span), ["sent_id", "range"]
    blocks = _blocks(items, span, label)
    whole = _ends(blocks, width).withColumns({f"lo_{s}": F.get("rest", F.lit(k)) for k, s in enumerate("ab")} | {f"hi_{s}": F.when(F.col(s) != 0, F.col("block") * width + F.length(F.bin(s)) - 1) for s in "ab"})
    up = W.partitionBy(*range_).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    early = lambda hi: F.coalesce(F.col("lo_a") < hi("a"), F.lit(False)) | F.coalesce(F.col("lo_b") < hi("b"), F.lit(False))
    whole = _open(whole.withColumn("odd", (F.get("rest", F.lit(2)) != 0) | early(lambda s: F.max(f"hi_{s}").over(up))), range_, "block")
    # a range's own tail: that of its last block, with what was open before it if the block has no shared end
    tail = lambda s: F.max_by(F.col(f"tail_{s}") + F.when(F.col("lo_shared").isNull(), F.col(f"open_{s}")).otherwise(0), "block").alias(f"tail_{s}")
    per = whole.groupBy(*range_).agg(*[f(c).alias(c) for c, f in (("lo_a", F.min), ("lo_b", F.min), ("hi_a", F.max), ("hi_b", F.max), ("lo_shared", F.min), ("odd", F.bool_or))], tail("a"), tail("b"))
    per = carry(carry(per, "sent_id", "range", {"hi_a": F.max, "hi_b": F.max}), "sent_id", "range", {"lo_shared": F.min}, down=True)
    per = _open(per, ["sent_id"], "range").withColumn("odd", F.col("odd") | early(lambda s: F.col(f"hi_{s}_carried")))
    over = lambda f, c: f(c).over(W.partitionBy("sent_id"))
    same = (over(F.min, "lo_a") == over(F.min, "lo_b")) & (over(F.max, "hi_a") == over(F.max, "hi_b"))
    per = per.select(*range_, "open_a", "open_b", F.col("lo_shared_carried").alias("next"), (F.coalesce(same, F.lit(False)) & ~over(F.bool_or, "odd")).alias("fits"))
    # rest is asked for here too, so that both uses of the blocks have the same columns and read one exchange
    rows = blocks.join(per, range_).withColumn("fits", F.when(F.get("rest", F.lit(2)) == 0, F.col("fits")).otherwise(False)).where(_wanted("fits", strict))
    rows = _open(_ends(rows, width), range_, "block", begun=True)
    down = W.partitionBy(*range_).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("next", F.least(F.min("lo_shared").over(down), "next"))


def align_ranged(items: DataFrame, span: int, strict: bool = False) -> DataFrame:
    """align() for sentences that are more than a task should hold: they are dealt by ranges of about `span` characters, as blocks whose ends are bits.

    Tokens then look up their block, so they move once.
    """
    width, block, range_ = _block(span)
    rows = items.where("is_min").withColumn("block", block).withColumn("range", range_)
    rows = rows.join(_found(items, span, strict).select("sent_id", "range", "block", "shared", "next"), ["sent_id", "range", "block"])
    own = F.expr(f"shiftright(shared, CAST(end - block * {width} AS INT))")  # shared ends from the token's own
    rows = rows.withColumn("own", own).withColumn("group", F.when(F.col("own") != 0, F.col("end") + _lowest("own")).otherwise(F.col("next")).cast(items.schema["end"].dataType))
    return rows.select(*items.columns, "group")


def group_sizes_ranged(items: DataFrame, span: int, strict: bool = False) -> DataFrame:
    """sent_id, group, n_a, n_b: sizes of the groups of align_ranged(), from blocks alone; a group without a shared end behind its tokens does not exist where spans agree."""
    width = min(BLOCK, span)
    rows = _found(items, span, strict).where("shared <> 0")
    rows = rows.withColumn("at", F.expr(f"filter(sequence(1, {width}), k -> shiftright(shared, k) & 1 = 1)"))
    rows = rows.select("sent_id", "block", "a", "b", "open_a", "open_b", "at", F.posexplode("at").alias("nr", "k")).withColumn("from", F.when(F.col("nr") == 0, 0).otherwise(F.get("at", F.col("nr") - 1)))
    size = lambda s: (F.bit_count(F.expr(f"shiftright({s} & (shiftleft(1L, k + 1) - 1), from + 1)")) + F.when(F.col("nr") == 0, F.col(f"open_{s}")).otherwise(0)).cast("long").alias(f"n_{s}")
    return rows.select("sent_id", (F.col("block") * width + F.col("k")).alias("group"), size("a"), size("b"))


def single_pairs_ranged(items: DataFrame, label: str, span: int, strict: bool = False) -> DataFrame:
    """sent_id, a, b: labels of the groups of align_ranged() that have one token on each side, from blocks alone.

    Such a group is a shared end that follows a shared one.  Adding the bits above shared ends to those that are no ends carries each of them to the next end.
    """
    rows = _found(items, span, strict, label).where("shared <> 0").withColumn("any", F.expr("a | b"))
    first = F.when((F.col("open_a") == 0) & (F.col("open_b") == 0), F.expr("any & -any")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("ok", F.expr(f"(({2 ** (BLOCK + 1) - 1}L & ~any) + shiftleft(shared, 1)) & any").bitwiseOR(first).bitwiseAND(F.col("shared")))
    rows = rows.select("sent_id", "ok", "ends", F.explode("ends").alias("x")).select("sent_id", F.col("x.label").alias("a"), F.expr("ok & x.a").alias("ok"), "ends").where("ok <> 0")
    rows = rows.select("sent_id", "a", "ok", F.explode("ends").alias("y")).select("sent_id", "a", F.col("y.label").alias("b"), F.expr("bit_count(ok & y.b)").alias("n")).where("n > 0")
    return rows.select("sent_id", "a", "b", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("one")).drop("one")


def _wanted(fits: str, strict: bool) -> Column:
    return F.when(~F.col(fits), F.raise_error(F.lit(MISFIT))).otherwise(True) if strict else F.col(fits)


def fold(a: Sequence[tuple[int, int]], b: Sequence[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """Groups of places in a and b, for (start, end) in any order and with overlaps.

    Of the next token of each side, by start and then longer first, the one that ends first joins the open group; two that end
    together close it.  What no common end closes is in no group.
    """
    x, y = (sorted(range(len(t)), key=lambda k, t=t: (t[k][0], -t[k][1])) for t in (a, b))
    out, left, right, i, j = [], [], [], 0, 0
    while i < len(x) and j < len(y):
        p, q = a[x[i]][1], b[y[j]][1]
        if p <= q:
            left.append(x[i])
            i += 1
        if q <= p:
            right.append(y[j])
            j += 1
        if p == q:
            out.append((left, right))
            left, right = [], []
    return out


def align_folded(items: DataFrame, strict: bool = False) -> DataFrame:
    """align() for tokens that overlap or have no length; group counts from 0.

    Sentences without such tokens get their groups from the windows of align(), as folding them comes to the same, and pass through; the tokens of one
    odd sentence at a time are folded by two cursors.  strict: a sentence that lacks a side or whose spans differ fails the query; else it is left out.
    """
    rows = _judged(items.withColumn("whole", F.struct("start", "end", "ord", (F.col("side") == "b").alias("is_b"))))
    nr = F.floor((F.col("shared_in_all") - F.col("shared_from")) / 2).cast("int")
    kept = F.when(~F.col("same"), F.raise_error(F.lit("a and b need to cover the same total span"))).otherwise(True) if strict else F.col("same")
    columns = [f.name for f in items.schema.fields]
    rows = rows.where(kept).select(*columns, nr.alias("group"), "odd", "whole", F.col("sent_id").alias("sent"))

    def fold_odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of one odd sentence

        def folded() -> Iterator[pa.RecordBatch]:
            if waiting:
                yield _folded(pa.concat_batches(waiting), len(columns))
                waiting.clear()

        for batch in batches:
            sent, odd = batch.column(len(columns) + 3).to_numpy(zero_copy_only=False), batch.column(len(columns) + 1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(odd[1:] | odd[:-1]) + 1).tolist(), batch.num_rows] if odd.any() else [0, batch.num_rows]
            cuts = [c for c in cuts if c in (0, batch.num_rows) or sent[c] != sent[c - 1]]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if waiting and (not odd[i] or waiting[-1].column(len(columns) + 3)[-1].as_py() != part.column(len(columns) + 3)[0].as_py()):
                    yield from folded()
                if odd[i]:
                    waiting.append(part)
                else:
                    yield part.select(range(len(columns) + 1))
        yield from folded()

    return rows.mapInArrow(fold_odd, T.StructType([*items.schema.fields, T.StructField("group", T.IntegerType())]))


def _folded(sentence: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """The first n columns of a sentence's rows that are in a group, and the group's number."""
    whole = sentence.column(n + 2).to_pylist()
    at = [sorted((k for k, x in enumerate(whole) if x["is_b"] == side), key=lambda k: whole[k]["ord"]) for side in (False, True)]
    groups = fold(*([(whole[k]["start"], whole[k]["end"]) for k in i] for i in at))
    found = [(k, i[m]) for k, group in enumerate(groups) for i, members in zip(at, group) for m in members]
    rows = sentence.take(pa.array([k for _, k in found], pa.int64()))
    return pa.RecordBatch.from_arrays([*rows.columns[:n], pa.array([k for k, _ in found], pa.int32())], names=sentence.schema.names[: n + 1])


def aligned_tokens(items: DataFrame, strict: bool = False, folded: bool = False, span: int | None = None) -> DataFrame:
    """align(); folded: tokens may overlap; span: sentences are dealt by ranges of so many characters."""
    if folded and span:
        raise ValueError("a sentence of tokens that overlap is folded whole: folded and span exclude each other")
    return align_ranged(items, span, strict) if span else (align_folded if folded else align)(items, strict)


def align_groups(items: DataFrame, strict: bool = False, folded: bool = False, span: int | None = None) -> DataFrame:
    """sent_id, group, a, b: arrays of (start, end, item, pos, lemma) in order of start."""
    aligned = aligned_tokens(items, strict, folded, span)
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("start", "end", "item", "pos", "lemma"))))
    return aligned.groupBy("sent_id", "group").agg(of("a").alias("a"), of("b").alias("b"))


class _Masks:
    """For each value of a list an integer with a bit for every place that holds it; kept only for values in many places, so that memory goes by the list's length."""

    def __init__(self, values: Sequence, many: int = 64):
        self.places: dict = {}
        for j, y in enumerate(values):
            self.places.setdefault(y, []).append(j)
        self.kept: dict = {}
        self.many = many

    def __getitem__(self, x) -> int:
        got = self.kept.get(x)
        if got is None:
            got = 0
            for j in self.places.get(x, ()):
                got |= 1 << j
            if len(self.places.get(x, ())) > self.many:
                self.kept[x] = got
        return got


def edit_path(a: Sequence, b: Sequence) -> list[tuple]:
    """Pairs (x or None, y or None) of a cheapest way from a to b.

    Equal elements pair at no cost. Otherwise a step costs one; of equally cheap ones dropping from a comes first, then
    adding from b, then replacing.

    A row of the cost table is held as bits: where its cost rises or falls from one place of b to the next, and from the row above.  Every
    square root of len(a) rows one is kept; the way back is read between two of them, whose rows are made again.  Memory goes by
    len(b) * sqrt(len(a)) / 2 bits, and a row costs a dozen operations on integers of len(b) bits.
    """
    full, masks, every = (1 << len(b)) - 1, _Masks(b), math.isqrt(max(0, len(a) - 1)) + 1

    def rows(begin: int, end: int, rise: int, fall: int) -> Iterator[tuple[int, int, int]]:
        """(rise, fall: of the cost along the row; higher: where it is above the row before) for rows begin + 1 to end."""
        for i in range(begin, end):
            eq = masks[a[i]]
            free = (((eq & rise) + rise) ^ rise) | eq | fall  # places that cost as much as the one up and left of them
            higher = fall | (full & ~(free | rise))
            lower = ((free & rise) << 1) & full
            shifted = ((higher << 1) | 1) & full
            rise, fall = lower | (full & ~(free | shifted)), free & shifted
            yield rise, fall, higher

    kept, state = [], (full, 0)
    for begin in range(0, len(a), every):
        kept.append((begin, *state))
        for *state, _ in rows(begin, min(begin + every, len(a)), *state):  # noqa: B020
            pass
    out, j = [], len(b)
    while kept:
        begin, rise, fall = kept.pop()
        own = list(rows(begin, min(begin + every, len(a)), rise, fall))
        i = len(own)
        while i and j:
            x, y, (along, _, above) = a[begin + i - 1], b[j - 1], own[i - 1]
            if x == y or not (above | along) >> (j - 1) & 1:
                out.append((x, y))
                i, j = i - 1, j - 1
            elif above >> (j - 1) & 1:
                out.append((x, None))
                i -= 1
            else:
                out.append((None, y))
                j -= 1
        out += [(a[begin + k], None) for k in range(i - 1, -1, -1)]
    out += [(None, b[k]) for k in range(j - 1, -1, -1)]
    return out[::-1]


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for every value, in their order (null first), and the values by number; the last one, null, stands for none."""
    coded = values.dictionary_encode(null_encoding="encode")
    texts = coded.dictionary.to_pylist()
    order = sorted(range(len(texts)), key=lambda k: (texts[k] is not None, texts[k] or ""))
    rank = np.empty(len(texts), dtype="i4")
    rank[order] = np.arange(len(texts), dtype="i4")
    return rank[coded.indices.to_numpy(zero_copy_only=False)], pa.array([*(texts[k] for k in order), None], values.type)


class _Known:
    """Edit paths of lists of numbers as two arrays, with none where a side has nothing; short lists that come again are worked out once."""

    def __init__(self, none: int, short: int = 16):
        self.none, self.short, self.paths = none, short, {}

    def __call__(self, x: np.ndarray, y: np.ndarray) -> tuple[array, array]:
        key = (x.tobytes(), y.tobytes()) if len(x) + len(y) <= self.short else None
        if key is None or (got := self.paths.get(key)) is None:
            got = array("i"), array("i")
            for pair in edit_path(x.tolist(), y.tolist()):
                for side, v in zip(got, pair):
                    side.append(self.none if v is None else v)
            if key:
                self.paths[key] = got
        return got


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])))
def _paths(a: pa.Array, b: pa.Array) -> pa.Array:
    """Labels are numbers from the batch's first list to its last path, so that lists of whole sentences take some bytes a label."""
    codes, texts = _codes(pa.concat_arrays([a.flatten(), b.flatten()]))
    sizes = [pa.compute.list_value_length(s).to_numpy(zero_copy_only=False) for s in (a, b)]
    known, steps, ends = _Known(len(texts) - 1), (array("i"), array("i")), [0]
    i, j = 0, int(sizes[0].sum())
    for n, m in zip(*(s.tolist() for s in sizes)):
        for side, found in zip(steps, known(codes[i : i + n], codes[j : j + m])):
            side.extend(found)
        i, j = i + n, j + m
        ends.append(len(steps[0]))
    labels = [texts.take(pa.array(np.frombuffer(s, dtype="i4") if s else np.empty(0, "i4"))) for s in steps]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(labels, ["a", "b"]))


def edit_ops(a: Column | str, b: Column | str) -> Column:
    """array<struct<a, b>> for two array<string> columns: the edit path, in Arrow batches."""
    return _paths(a, b)


def first_labels(aligned: DataFrame, labels: Sequence[str]) -> DataFrame:
    """sent_id, group, n_a, n_b, and a_<label> and b_<label> of the first token of each side, for aligned tokens."""
    of = lambda s, x: F.when(F.col("side") == s, x)
    first = lambda s: F.min(of(s, F.struct("start", *labels))).alias(s)
    g = aligned.groupBy("sent_id", "group").agg(F.count(of("a", F.lit(1))).alias("n_a"), F.count(of("b", F.lit(1))).alias("n_b"), first("a"), first("b"))
    return g.select("sent_id", "group", "n_a", "n_b", *[F.col(f"{s}.{x}").alias(f"{s}_{x}") for x in labels for s in "ab"])


def first_labels_in_order(aligned: DataFrame, labels: Sequence[str]) -> DataFrame:
    """first_labels() of what align() gives, in its order: without an exchange, a sort or a group's rows together.

    A group has tokens of both sides, and goes from its shared end to the token that starts it; so at its last row each side's latest token is
    its first one, and its sizes are what was counted since the last row of the group before.
    """
    down = W.partitionBy("sent_id").orderBy(F.desc("end"), F.desc("side"))
    so_far = down.rowsBetween(W.unboundedPreceding, 0)
    of = lambda s, x: F.when(F.col("side") == s, x)
    seen = {f"seen_{s}": F.count(of(s, F.lit(1))).over(so_far) for s in "ab"} | {s: F.last(of(s, F.struct(*labels)), ignorenulls=True).over(so_far) for s in "ab"}
    rows = aligned.select("sent_id", "side", "end", "group", *labels).withColumns(seen | {"after": F.lead("group").over(down)})
    rows = rows.where("after IS NULL OR after <> group")
    size = lambda s: F.col(f"seen_{s}") - F.coalesce(F.lag(f"seen_{s}").over(down), F.lit(0))
    return rows.withColumns({"n_a": size("a"), "n_b": size("b")}).select("sent_id", "group", "n_a", "n_b", *[F.col(f"{s}.{x}").alias(f"{s}_{x}") for x in labels for s in "ab"])


def _group_steps(batch: pa.RecordBatch, new: np.ndarray, even: bool) -> pa.RecordBatch:
    """The steps of whole groups; new: where a row begins one."""
    sent, _, is_b, start, label = batch.columns
    codes, texts = _codes(label)
    nr, is_b = np.cumsum(new) - 1, is_b.to_numpy(zero_copy_only=False)
    order = np.lexsort((codes, start.to_numpy(zero_copy_only=False), is_b, nr))
    codes, n = codes[order], int(nr[-1]) + 1
    n_a, n_b = (np.bincount(nr[s], minlength=n) for s in (~is_b, is_b))
    begin = np.cumsum(n_a + n_b) - n_a - n_b
    easy = (n_a == n_b) if even else (n_a == 1) & (n_b == 1)
    at, known = begin[easy], _Known(len(texts) - 1)
    hard, left, right = array("i"), array("i"), array("i")
    for k in np.flatnonzero(~easy).tolist():
        i, j = begin[k], begin[k] + n_a[k]
        x, y = known(codes[i:j], codes[j : j + n_b[k]])
        hard.extend([k] * len(x))
        left.extend(x)
        right.extend(y)
    of = np.concatenate([np.flatnonzero(easy), hard]).astype("i8")
    text = lambda first, more: texts.take(pa.array(np.concatenate([codes[first], more]).astype("i4")))
    sent = sent.take(pa.array(np.flatnonzero(new)[of]))
    return pa.RecordBatch.from_arrays([sent, pa.array(n_a[of], pa.int64()), pa.array(n_b[of], pa.int64()), text(at, left), text(at + n_a[easy], right)], names=["sent_id", "n_a", "n_b", "a", "b"])


def edit_steps(aligned: DataFrame, label: str, even: bool = False, in_order: bool = False) -> DataFrame:
    """sent_id, n_a, n_b, a, b: for each group the steps of the edit path between its sides' labels in order of start, with the group's sizes; null where a side has none.

    even: groups with as many tokens on each side give their first labels only.  in_order: aligned is what align() gives, whose groups stand together, so
    nothing moves, sorts or comes together but one group; else tokens are dealt by group.
    """
    rows = aligned.select("sent_id", "group", (F.col("side") == "b").alias("is_b"), "start", label, "end", "side")
    if in_order:
        rows = rows.sortWithinPartitions("sent_id", F.desc("end"), F.desc("side"))  # the order that they have
    else:
        rows = rows.repartition("sent_id", "group").sortWithinPartitions("sent_id", "group")
    rows = rows.drop("end", "side")

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # of the last group, which may go on
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                keys = [batch.column(c) for c in (0, 1)]
                before = [waiting[-1].column(c).slice(waiting[-1].num_rows - 1) if waiting else k.slice(0, 1) for c, k in enumerate(keys)]
                new = np.zeros(batch.num_rows, dtype=bool)
                for k, was in zip(keys, before):
                    k = pa.concat_arrays([was, k]).to_numpy(zero_copy_only=False)
                    new |= k[1:] != k[:-1]
                if not new.any():
                    waiting.append(batch)
                    continue
                cut = int(np.flatnonzero(new)[-1])
                whole = pa.concat_batches([*waiting, batch.slice(0, cut)])
                new = np.concatenate([np.zeros(whole.num_rows - cut, dtype=bool), new[:cut]])
                waiting = [batch.slice(cut)]
            elif waiting:
                whole = pa.concat_batches(waiting)
                new = np.zeros(whole.num_rows, dtype=bool)
            else:
                continue
            new[0] = True
            yield _group_steps(whole, new, even)

    text = T.StringType()
    kinds = {"sent_id": aligned.schema["sent_id"].dataType, "n_a": T.LongType(), "n_b": T.LongType(), "a": text, "b": text}
    return rows.mapInArrow(steps, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


def edit_pairs(aligned: DataFrame, label: str, one_to_one: bool, in_order: bool = False) -> DataFrame:
    """sent_id, a, b of all groups: those that label_pairs would skip pair by the edit path of their labels, MISALIGNED where a side has none."""
    easy = F.col("n_a") == F.col("n_b") if not one_to_one else (F.col("n_a") == 1) & (F.col("n_b") == 1)
    mark = lambda c: F.when(easy, F.col(c)).otherwise(F.coalesce(c, F.lit("MISALIGNED"))).alias(c)
    return edit_steps(aligned, label, even=not one_to_one, in_order=in_order).select("sent_id", mark("a"), mark("b"))


def label_pairs(items: DataFrame, label: str, skip_unaligned: bool = True, one_to_one: bool = True, strict: bool = False, folded: bool = False, span: int | None = None) -> DataFrame:
    """sent_id, a, b: labels of aligned tokens.

    one_to_one: groups of one token on each side pair (parts of speech); else groups of as many tokens pair by their first
    ones (lemmas).  skip_unaligned false: the others pair by the edit path of their labels, MISALIGNED where a side has none.
    folded: tokens may overlap; span: sentences are dealt by ranges of so many characters.
    """
    if span and one_to_one and skip_unaligned and not folded and items.schema[label].dataType == T.StringType():
        return single_pairs_ranged(items, label, span, strict)
    aligned = aligned_tokens(items.select("sent_id", "side", "ord", "start", "end", "is_min", label), strict, folded, span)
    if not skip_unaligned:
        return edit_pairs(aligned, label, one_to_one, in_order=not (folded or span))
    pairs = (first_labels if folded or span else first_labels_in_order)(aligned, [label]).where("n_a = 1 AND n_b = 1" if one_to_one else "n_a = n_b")
    return pairs.select("sent_id", F.col(f"a_{label}").alias("a"), F.col(f"b_{label}").alias("b"))


def is_contiguous(items: DataFrame) -> DataFrame:
    """sent_id, side, contiguous: every item ends where the next one, in the given order, starts."""
    after = F.lead("start").over(W.partitionBy("sent_id", "side").orderBy("ord"))
    rows = items.select("sent_id", "side", "ord", "start", "end").withColumn("ok", F.coalesce(F.col("end") == after, F.lit(True)))
    return rows.groupBy("sent_id", "side").agg(F.bool_and("ok").alias("contiguous"))


def find_gold_term(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """For rows (sent_id, item, start) of wanted: the first gold item with that text and start, as gold_* columns; nulls if none.

    Gold and wanted rows stay in one table, so nothing moves if both are dealt by sent_id alike, and a join would deal both anew by all its keys.
    """
    keys, found = ["sent_id", "item", "start"], ["ord", "end", "pos", "lemma"]
    wanted = wanted.withColumn("start", F.col("start").cast("int"))
    first = F.struct(*[F.col(c).alias(f"gold_{c}") for c in found])
    gold = items.where("side = 'a'").where(" AND ".join(f"{c} IS NOT NULL" for c in keys))
    gold = gold.select(*[F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.schema.fields], first.alias("found_gold"))
    rows = wanted.withColumn("found_gold", F.lit(None).cast(gold.schema["found_gold"].dataType)).withColumn("is_wanted", F.lit(True)).unionByName(gold.withColumn("is_wanted", F.lit(False)))
    rows = rows.withColumn("found_gold", F.min("found_gold").over(W.partitionBy("sent_id", "start", "item"))).where("is_wanted")
    return rows.select(*keys, *[c for c in wanted.columns if c not in keys], "found_gold.*")
