"""Entities: from items to tags, from tags to entities, and their scores under four schemas."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import ratio

SCHEMAS = ("strict", "ent_type", "partial", "exact")
METRICS = ("correct", "incorrect", "partial", "missed", "spurious")
#: What a case adds one to, in each schema of SCHEMAS. same: identical; type: same bounds, other type; bounds: overlap, same
#: type; both: overlap, other type; spurious: a prediction with nothing below it; missed: a truth never met.
CASES = {
    "same": ("correct", "correct", "correct", "correct"),
    "type": ("incorrect", "incorrect", "correct", "correct"),
    "bounds": ("incorrect", "correct", "partial", "incorrect"),
    "both": ("incorrect", "incorrect", "partial", "incorrect"),
    "spurious": ("spurious",) * 4,
    "missed": ("missed",) * 4,
}


def _owners(key: np.ndarray, start: np.ndarray, end: np.ndarray, named: np.ndarray, levels: int) -> np.ndarray:
    """For each item the place of the entity that it is or is in, else -1; items in order, key: number of their list, ascending."""
    owner, rows = np.full(len(key), -1), np.arange(len(key))
    least, width = (end.min(), int(end.max() - end.min()) + 1) if len(end) else (0, 1)
    for _ in range(levels):
        if not len(rows):
            return owner
        reach = (end[rows] - least) + key * width
        head = np.concatenate([[True], reach[1:] > np.maximum.accumulate(reach)[:-1]])
        first = np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))
        ours = named[rows[first]]
        owner[rows[ours]] = rows[first[ours]]
        key, rows = np.cumsum(head)[~ours & ~head], rows[~ours & ~head]
    now, open_ = None, -1
    for nr, k in zip(key.tolist(), rows.tolist()):
        if nr != now:
            now, open_ = nr, -1
        if open_ < 0 or end[k] > end[open_]:
            open_ = k if named[k] else -1
        owner[k] = open_
    return owner


def _tagged(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Rows (sent_id, side, nr, start, end, label) in order, nr counting from 1 for each sentence and side, with their tags.

    From batch to batch go the entity that is open and the number of tags before; the entity stands as an item more before the next batch.
    """
    held, count = None, 0  # (start, end, label)
    for batch in batches:
        if not batch.num_rows:
            continue
        nr, start, end = (batch.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in (2, 3, 4))
        label = batch.column(5)
        first = nr == 1
        more = 0 if first[0] or held is None else 1
        count = 0 if first[0] else count
        if more:
            start, end, first = np.concatenate([[held[0]], start]), np.concatenate([[held[1]], end]), np.concatenate([[False], first])
            label = pa.concat_arrays([pa.array([held[2]], label.type), label])
        key = np.cumsum(first)
        coded = label.dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("i8")
        own = _owners(key, start, end, code >= 0, levels)
        at, names, n = np.arange(len(own)), coded.dictionary.to_pylist(), len(coded.dictionary)
        tag = np.where(own < 0, 0, np.where(own == at, 1, 1 + n) + code[own])
        shown = (own < 0) | (own == at) | (start != start[own])
        shown[:more] = False
        so_far = np.cumsum(shown)
        begin = np.maximum.accumulate(np.where(first, at, 0))
        ord_ = so_far - np.where(key > 0, so_far[begin] - shown[begin], -count) - 1
        held = None if own[-1] < 0 else (int(start[own[-1]]), int(end[own[-1]]), names[code[own[-1]]])
        count = int(ord_[-1]) + 1
        rows = pa.array(np.flatnonzero(shown))
        texts = pa.array(["O", *(f"B-{x}" for x in names), *(f"I-{x}" for x in names)], pa.string())
        mine = pa.array(np.flatnonzero(shown) - more)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(mine), batch.column(1).take(mine), pa.array(ord_.astype("i4")).take(rows), texts.take(pa.array(tag)).take(rows)], names=["sent_id", "side", "ord", "tag"])


def bio_from_items(items: DataFrame, levels: int = 4) -> DataFrame:
    """sent_id, side, ord, tag for all items, compounds too, by start, then longer first, then as given.

    An item that ends behind all before it opens a stretch; nothing reaches over from one stretch to the next.  A stretch whose
    first item has a label is that entity, whatever else is in it: I-, or no tag where an item starts with it.  A first item without a label is O, and the rest of
    its stretch falls into stretches in the same way, and so on.  A sentence is sorted once and streams by in Arrow batches, whose stretches are running
    maxima; under more than `levels` unlabelled items, each within the next, items are read one by one.  One entity at most goes on from a batch to the next.
    """
    w = W.partitionBy("sent_id", "side").orderBy("start", F.desc("end"), "ord")
    rows = items.select("sent_id", "side", "ord", "start", "end", F.col("ner_label").alias("label")).withColumn("nr", F.row_number().over(w))
    rows = rows.sortWithinPartitions("sent_id", "side", "start", F.desc("end"), "ord")  # the order that they have
    kinds = {"sent_id": items.schema["sent_id"].dataType, "side": T.StringType(), "ord": T.IntegerType(), "tag": T.StringType()}
    return rows.select("sent_id", "side", "nr", "start", "end", "label").mapInArrow(lambda batches: _tagged(batches, levels), T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sent_id, side, ord, e_type, s, e, n) from tags in order: one for each entity, and one with n, the number of tags, and no type for each sentence and side.

    From batch to batch go the last tag, which may be an entity's last one, where that entity begins and its number."""
    held = None  # the last row, its type, where its entity begins, the entity's number
    names = ["sent_id", "side", "ord", "e_type", "s", "e", "n"]

    def table(ids: pa.Array, side: pa.Array, types: pa.Array, nr, s, e, runs: np.ndarray, ends: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.concatenate([runs, ends]))
        long = lambda x: pa.concat_arrays([pa.array(x[runs], pa.int64()), pa.nulls(len(ends), pa.int64())])
        return pa.RecordBatch.from_arrays([ids.take(at), side.take(at), long(nr), pa.concat_arrays([types.take(pa.array(runs)), pa.nulls(len(ends), pa.string())]), long(s), long(e), pa.concat_arrays([pa.nulls(len(runs), pa.int64()), pa.array(n[ends], pa.int64())])], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in range(4)]
        if held:
            columns = [pa.concat_arrays([x, c]) for x, c in zip(held[0], columns)]
        ids, side, ord_, tag = columns
        ord_, coded = ord_.to_numpy(zero_copy_only=False).astype("i8"), tag.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        types = pa.array([None if x == "O" else x[2:] for x in kinds], pa.string()).dictionary_encode()
        of = types.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("i8")
        code = coded.indices.to_numpy(zero_copy_only=False)
        kind, is_b = of[code], np.array([x.startswith("B") for x in kinds])[code]
        at, first = np.arange(len(code)), ord_ == 0
        before = np.concatenate([[-1], kind[:-1]])
        opens = (kind >= 0) & (first | (before != kind) | is_b)
        nr = np.cumsum(opens)
        begin = np.maximum.accumulate(np.where(first, at, -1))
        nr = nr - np.where(begin >= 0, nr[begin] - opens[begin], 0)
        start = ord_[np.maximum.accumulate(np.where(opens, at, 0))]
        if held:
            opens_later = np.maximum.accumulate(opens[1:]) if len(at) > 1 else opens[1:]
            own = np.concatenate([[True], ~opens_later])  # rows before any entity of this batch begins
            start = np.where(own, held[1], start)
            nr = np.where(begin < 0, np.cumsum(np.concatenate([[0], opens[1:]])) + held[2], nr)
            if first[0]:
                nr = np.where(begin == 0, np.cumsum(np.concatenate([[0], opens[1:]])) + held[2], nr)
        last = np.append(first[1:], False)
        over = (kind >= 0) & np.append(first[1:] | opens[1:] | (kind[1:] < 0), False)
        yield table(ids, side, types.dictionary.take(pa.array(kind, mask=kind < 0)), nr, start, ord_, np.flatnonzero(over), np.flatnonzero(last), ord_ + 1)
        held = [c.slice(len(c) - 1) for c in columns], int(start[-1]), int(nr[-1])
    if held:
        (ids, side, ord_, tag), start, nr = held
        kind, end = tag[0].as_py(), ord_.to_numpy(zero_copy_only=False).astype("i8")
        types = pa.array([None if kind == "O" else kind[2:]], pa.string())
        yield table(ids, side, types, np.array([nr]), np.array([start]), end, np.flatnonzero([kind != "O"]), np.array([0]), end + 1)


def entities_of_items(items: DataFrame, skip: bool = False, levels: int = 4) -> tuple[DataFrame, DataFrame]:
    """entities_from_tags() and label_set() of same_length() tags of bio_from_items(), without a tag that moves.

    Entities leave the pass that makes tags, with the numbers of tags, and are cut after that; both results read one exchange of them.
    """
    w = W.partitionBy("sent_id", "side").orderBy("start", F.desc("end"), "ord")
    rows = items.select("sent_id", "side", "ord", "start", "end", F.col("ner_label").alias("label")).withColumn("nr", F.row_number().over(w))
    rows = rows.sortWithinPartitions("sent_id", "side", "start", F.desc("end"), "ord")  # the order that they have
    kinds = [T.StructField("sent_id", items.schema["sent_id"].dataType), *(T.StructField(c, T.StringType() if c in ("side", "e_type") else T.LongType()) for c in ("side", "ord", "e_type", "s", "e", "n"))]
    found = rows.select("sent_id", "side", "nr", "start", "end", "label").mapInArrow(lambda batches: _in_runs(_tagged(batches, levels)), T.StructType(kinds))
    sent = W.partitionBy("sent_id")
    tags = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("n"))).over(sent), F.lit(0))
    found = found.withColumns({"n_a": tags("a"), "n_b": tags("b")}).withColumn("n", F.least("n_a", "n_b")).where("n_a = n_b" if skip else "true")
    found = found.where("e_type IS NOT NULL AND ord > 0 AND e >= s AND s < n").select("sent_id", "side", "ord", "e_type", "s", F.least("e", F.col("n") - 1).alias("e"), "n")
    kept = found.where(~((F.col("e") == F.col("n") - 1) & ((F.col("s") == 0) | (F.col("e_type") == "")))).drop("n")
    return kept, label_set(found.select(F.concat(F.lit("I-"), "e_type").alias("tag")))


def entities_from_tags(tags: DataFrame, compat: bool = True) -> DataFrame:
    """sent_id, side, ord, e_type, s, e (inclusive) from (sent_id, side, ord, tag); ord counts from 0.

    compat: an entity from the first tag to the last, or one without a type at the end, is not counted.
    """
    w = W.partitionBy("sent_id", "side").orderBy("ord")
    kind = F.when(F.col("tag") != "O", F.substring("tag", 3, 1 << 30))
    rows = tags.select("sent_id", "side", "ord", "tag", kind.alias("e_type")).withColumn("before", F.lag("e_type").over(w)).withColumn("n", F.count("*").over(W.partitionBy("sent_id", "side")))
    opens = F.col("e_type").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("e_type")) | F.col("tag").startswith("B"))
    rows = rows.withColumn("id", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))).where("e_type IS NOT NULL")
    found = rows.groupBy("sent_id", "side", "id").agg(F.first("e_type").alias("e_type"), F.min("ord").alias("s"), F.max("ord").alias("e"), F.first("n").alias("n"))
    if compat:
        found = found.where(~((F.col("e") == F.col("n") - 1) & ((F.col("s") == 0) | (F.col("e_type") == ""))))
    return found.select("sent_id", "side", F.col("id").alias("ord"), "e_type", "s", "e")


def same_length(tags: DataFrame, skip: bool = False, strict: bool = False) -> DataFrame:
    """Tags of sentences whose sides differ in length are cut to the shorter; skip: left out; strict: an error. A side without tags has length 0."""
    sent = W.partitionBy("sent_id")
    of = lambda s: F.count(F.when(F.col("side") == s, 1)).over(sent)
    rows = tags.withColumn("n_a", of("a")).withColumn("n_b", of("b"))
    differ = F.col("n_a") != F.col("n_b")
    if strict:
        rows = rows.where(F.when(differ, F.raise_error(F.lit("tag lists differ in length"))).otherwise(True))
    rows = rows.where(~differ) if skip else rows.where(F.col("ord") < F.least("n_a", "n_b"))
    return rows.drop("n_a", "n_b")


def label_set(tags: DataFrame) -> DataFrame:
    """label: every tag without B- and I- wherever they stand in it, and O."""
    labels = tags.select(F.replace(F.replace("tag", F.lit("B-"), F.lit("")), F.lit("I-"), F.lit("")).alias("label"))
    return labels.unionByName(tags.sparkSession.createDataFrame([("O",)], "label string")).distinct()


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two half-open ranges share a place."""
    return F.greatest(s1, s2) < F.least(e1, e2)


class _Sweep:
    """First truths of one sentence's predictions. Entities come by start, truths before predictions.

    A truth that a prediction meets begins before it or with it and is still open (open_, by list order), or begins while the prediction is open: the least of the
    truths that came since, of which late holds only those that no later one precedes in the list.  What is closed is
    dropped, so memory goes by the entities that are open at once, not by the sentence.
    """

    def __init__(self):
        self.open_: list[tuple] = []  # heap of (ord, end, truth)
        self.alive = 0
        self.waiting: list[tuple] = []  # heap of (end, number, prediction, truth so far or None, number of truths before it)
        self.late: list[tuple] = []  # (number, ord, truth), ascending in both
        self.seen = self.number = 0
        self.at, self.same = None, {}  # truths that begin here, by end

    def _met(self, first: tuple | None, since: int) -> tuple | None:
        k = bisect_left(self.late, since, key=lambda x: x[0])
        other = self.late[k][2] if k < len(self.late) else None
        return min((t for t in (first, other) if t), default=None, key=lambda t: t[0])

    def to(self, start: int | None) -> Iterator[tuple]:
        """(prediction, truth or None) of predictions that end up to start; None: of all."""
        while self.waiting and (start is None or self.waiting[0][0] <= start):
            _, _, p, first, since = heapq.heappop(self.waiting)
            yield p, self._met(first, since)
        if not self.waiting:
            self.late.clear()
        elif len(self.late) > 64 and len(self.late) > 4 * len(self.waiting):  # only what a waiting prediction may ask for
            del self.late[: bisect_left(self.late, min(w[4] for w in self.waiting), key=lambda x: x[0])]

    def truth(self, t: tuple) -> None:
        """t: (ord, type, start, end)."""
        order, _, start, end = t
        if start != self.at:
            self.at, self.same = start, {}
        if end not in self.same or order < self.same[end][0]:
            self.same[end] = t
        if end <= start:
            return
        heapq.heappush(self.open_, (order, end, t))
        if len(self.open_) > 2 * self.alive + 64:
            self.open_ = [x for x in self.open_ if x[1] > start]
            heapq.heapify(self.open_)
            self.alive = len(self.open_)
        if self.waiting:
            while self.late and self.late[-1][1] >= order:
                self.late.pop()
            self.late.append((self.seen, order, t))
        self.seen += 1

    def prediction(self, start: int, end: int, p: tuple) -> None:
        while self.open_ and self.open_[0][1] <= start:
            heapq.heappop(self.open_)
        found = [self.same[end]] if start == self.at and end in self.same else []
        if end > start and self.open_:
            found.append(self.open_[0][2])
        self.number += 1
        heapq.heappush(self.waiting, (end, self.number, p, min(found, default=None, key=lambda t: t[0]), self.seen))


_SWEPT = "sent_id long, side string, e_type string, s long, e long, hit boolean, t struct<t_ord:long,t_type:string,ts:long,te:long>"


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sent_id, side, ord, e_type, s, e, hit), ordered by sent_id, s, side: each once, a prediction without a hit with the truth that it meets."""
    names = [x.split()[0] for x in _SWEPT.split(", ")]
    kind = pa.struct([("t_ord", pa.int64()), ("t_type", pa.string()), ("ts", pa.int64()), ("te", pa.int64())])
    now, sweep = None, _Sweep()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 7
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        met = pa.array([None if t is None else dict(zip(("t_ord", "t_type", "ts", "te"), t)) for t in cols[6]], kind)
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), met], names=names)

    for batch in batches:
        out = []
        for sent, side, order, kind_of, s, e, hit in zip(*(batch.column(c).to_pylist() for c in range(7))):
            if sent != now:
                out += [(*p, t) for p, t in sweep.to(None)]
                now, sweep = sent, _Sweep()
            row = (sent, side, kind_of, s, e, hit)
            out += [(*p, t) for p, t in sweep.to(s)]
            if side == "a":
                sweep.truth((order, kind_of, s, e))
            if side == "b" and not hit:
                sweep.prediction(s, e, row)
            else:
                out.append((*row, None))
        yield table(out)
    yield table([(*p, t) for p, t in sweep.to(None)])


def classify(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """sent_id, case (of CASES), label (credited; null for spurious) for every prediction and every missed truth of the types in labels.

    The first truth in list order with the same bounds, or that overlaps, is met; the last token of an entity does not count
    for overlap.  Predictions may meet the same truth.  Both sides stay in the same rows, dealt by sent_id and swept by start: a row an
    entity moves, however long entities are.
    """
    kept = entities.join(labels.select(F.col("label").alias("e_type")).distinct(), "e_type", "left_semi")
    same = W.partitionBy("sent_id", "e_type", "s", "e")
    rows = kept.repartition("sent_id").withColumn("hit", F.min("side").over(same) != F.max("side").over(same))
    long = lambda c: F.col(c).cast("long").alias(c)
    rows = rows.sortWithinPartitions("sent_id", "s", "side").select(long("sent_id"), "side", long("ord"), "e_type", long("s"), long("e"), "hit").mapInArrow(_swept, _SWEPT)
    own = (F.col("side") == "a") | F.col("hit")
    goal = {c: F.when(own, F.col(c)).otherwise(F.col(f"t.{t}")) for c, t in (("e_type", "t_type"), ("s", "ts"), ("e", "te"))}
    rows = rows.select("sent_id", "side", "hit", "t", "e_type", "s", "e", *[c.alias(f"goal_{k}") for k, c in goal.items()])
    found = F.max("side").over(W.partitionBy("sent_id", *[f"goal_{k}" for k in goal])) == "b"
    bounds = (F.col("s") == F.col("t.ts")) & (F.col("e") == F.col("t.te"))
    case = F.when(F.col("side") == "a", F.when(~found, "missed")).when(F.col("hit"), "same").when(F.col("t").isNull(), "spurious").when(bounds, "type").when(F.col("e_type") == F.col("t.t_type"), "bounds").otherwise("both")
    return rows.select("sent_id", case.alias("case"), F.col("goal_e_type").alias("label")).where("case IS NOT NULL")


def _derive(s: DataFrame) -> DataFrame:
    c, i, p, m, u = (F.col(x) for x in METRICS)
    s = s.withColumn("possible", c + i + p + m).withColumn("actual", c + i + p + u)
    credit = F.when(F.col("schema").isin("partial", "ent_type"), c + 0.5 * p).otherwise(c.cast("double"))
    s = s.withColumn("precision", ratio(credit, F.col("actual"))).withColumn("recall", ratio(credit, F.col("possible")))
    return s.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def _schemas(cases: DataFrame, keys: list[str]) -> DataFrame:
    """One row a schema from columns named by CASES."""
    cell = lambda k, metric: sum((F.col(c) for c, v in CASES.items() if v[k] == metric), F.lit(0).cast("long"))
    rows = F.array(*[F.struct(F.lit(name).alias("schema"), *[cell(k, m).alias(m) for m in METRICS]) for k, name in enumerate(SCHEMAS)])
    return _derive(cases.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*"))


def _counted(judged: DataFrame, by: list[str]) -> DataFrame:
    """by, label, case, n: what both kinds of score are sums of; with the same `by` Spark computes it once."""
    return judged.groupBy(*by, "label", "case").agg(F.count("*").alias("n"))


def _of_case(c: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("case") == c, F.col("n"))), F.lit(0)).alias(c)


def ner_overall(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, schema, METRICS, possible, actual, precision, recall, f1; without judged rows all 0."""
    by = by or []
    return _schemas(_counted(judged, by).groupBy(*by).agg(*[_of_case(c) for c in CASES]), by)


def ner_per_label(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """label and the same for every label; a spurious prediction counts once for each label."""
    counted = _counted(judged, [])
    spurious = counted.agg(_of_case("spurious"))
    others = [c for c in CASES if c != "spurious"]
    per = counted.where("label IS NOT NULL").groupBy("label").agg(*[_of_case(c) for c in others])
    rows = labels.select("label").distinct().join(per, "label", "left").fillna(0, others).join(F.broadcast(spurious))
    return _schemas(rows, ["label"])
