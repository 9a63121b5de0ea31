"""Quality rules as a learned decision list.

Statistics of each whole text come from one numpy pass.  Sequential covering learns from labelled statistics: a rule grows,
threshold by threshold, while it gains information about rejected documents; it is pruned on rows held back; what it
covers leaves the sample, and the next rule is grown.  The list is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, counts, mix, read

#: Labelled rows that the list is learned from at most; rules; least precision on rows held back; least covered rows; candidates a statistic.
SAMPLE, MAX_RULES, PRECISION, LEAST, CUTS = 20_000, 12, 0.9, 8, 64
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text; all 0 for a null."""
    w = Words(texts, lower=False)
    by_text = lambda mask: counts(mask, w.off)
    out = {"n_words": w.n, "word_chars": by_text(w.word & ((w.raw & 0xC0) != 0x80)), "n_symbols": by_text(_SYMBOL[w.raw])}
    with np.errstate(over="ignore"):
        salt = mix(w.row.astype(np.uint64) + np.uint64(1))
        out["n_distinct_words"] = np.bincount(w.row[np.unique(w.hash ^ salt, return_index=True)[1]], minlength=w.rows)
        covered = np.zeros(len(w.hash) + 1, np.int64)
        if len(w.hash) > 2:
            inside = w.row[:-2] == w.row[2:]
            h = mix(mix(mix(w.hash[:-2] ^ salt[:-2]) + w.hash[1:-1]) + w.hash[2:])[inside]
            at = np.flatnonzero(inside)
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            np.add.at(covered, at[twice], 1)
            np.add.at(covered, at[twice] + 3, -1)
        out["n_repeat_words"] = np.bincount(w.row[np.cumsum(covered)[:-1] > 0], minlength=w.rows)
    out["n_upper"] = by_text((w.raw >= 65) & (w.raw <= 90))
    out["n_digits"] = by_text((w.raw >= 48) & (w.raw <= 57))
    line, row = w.lines()
    out["n_lines"] = np.bincount(row, minlength=w.rows)
    with np.errstate(over="ignore"):
        first = np.unique(line ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[first], minlength=w.rows)
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def with_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, but for those named as one of STATS, and STATS (long) of the text."""
    keep = tuple(k for k in keep if k not in STATS)
    slim = docs.select(*[docs[k].alias(k) for k in keep], docs[text_col].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for a, part in blocks(texts):
                got = statistics(part)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, len(part)) for i in range(len(keep))] + [pa.array(got[s]) for s in STATS], names=[*keep, *STATS])

    kinds = [f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keep]
    return slim.mapInArrow(run, ", ".join([*kinds, *(f"{s} long" for s in STATS)]))


# -- features: the same as Spark columns and as numpy arrays --------------------------------------

FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "distinct_words": ("n_distinct_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}

Rule = list[tuple[str, str, float]]


def _feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rejects(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that covers the row, else 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for name, op, cut in rule:
            cond = cond & ((_feature(name) >= F.lit(float(cut))) if op == ">=" else (_feature(name) < F.lit(float(cut))))
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows. Every third row is held back for pruning and for the check of precision."""
    names = sorted(x)
    table = np.column_stack([x[n] for n in names]) if len(bad) else np.zeros((0, len(names)))
    held = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []

    def covers(rule: Rule, rows: np.ndarray) -> np.ndarray:
        out = rows.copy()
        for n, op, cut in rule:
            v = table[:, names.index(n)]
            out &= (v >= cut) if op == ">=" else (v < cut)
        return out

    def worth(rule: Rule, rows: np.ndarray) -> float:
        c = covers(rule, rows)
        p = int((c & bad).sum())
        n = int(c.sum()) - p
        return (p - n) / (p + n) if p + n else -1.0

    while len(rules) < MAX_RULES:
        grow, prune = left & ~held, left & held
        rule: Rule = []
        while len(rule) < 4:
            now = covers(rule, grow)
            p0, n0 = int((now & bad).sum()), int((now & ~bad).sum())
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for j, n in enumerate(names):
                v = table[now, j]
                y = bad[now]
                for cut in np.unique(np.quantile(v[y], np.linspace(0, 1, CUTS))):
                    for op, c in ((">=", v >= cut), ("<", v < cut)):
                        p = int((c & y).sum())
                        q = int(c.sum()) - p
                        if p < LEAST:
                            continue
                        gain = p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (n, op, float(cut)))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        while len(rule) > 1 and worth(rule[:-1], prune) >= worth(rule, prune):
            rule = rule[:-1]
        c = covers(rule, prune)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        if (p + 1) / (p + n + 2) < PRECISION or p + n < LEAST:
            break
        rules.append(rule)
        left &= ~covers(rule, left)
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Learn from at most SAMPLE labelled documents, drawn by a hash of the id; a row is bad if any of its labels says quality 0."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("__q")).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
    rows = with_statistics(docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")), text_col, ("__id", "__q"))
    # of several texts under one id always the same counts
    sample = rows.groupBy("__id").agg(F.min(F.struct("__q", *STATS)).alias("x")).select("__id", "x.*").toPandas()
    sample = sample.iloc[np.argsort(mix(sample["__id"].to_numpy(np.int64).astype(np.uint64)), kind="stable")]
    sample = sample[sample["n_words"] > 0]
    x = {n: sample[a].to_numpy(float) / np.maximum(sample[b].to_numpy(float), 1) for n, (a, b) in FEATURES.items()}
    return learn_rules(x, (sample["__q"] == 0).to_numpy())


def quality_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, STATS, base_failed, rule (number of the rule that rejects, else 0), kept.

    Base rule: under 50 words, or over half of them in repeated 3-word windows.  A null or empty text has no words and fails.
    Every row is judged by itself: repeated rows alike, very long ones whole; columns that clash with STATS or the verdict's columns are not carried.
    """
    keep = tuple(k for k in keep if k not in ("base_failed", "rule", "kept"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = with_statistics(docs, text_col, keep).withColumn("base_failed", failed).withColumn("rule", rejects(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, read(spark, sf_dir, "labels")))
