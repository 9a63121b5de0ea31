"""Tasks, modes and options brought together; the façades evaluate() and evaluate_ner()."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import align, boundary, entities, labels, paired, tokens
from ..sources import corpus

MODES = ("reference", "agreement")


@dataclass
class Options:
    """average: of pos (None: one value a label); skip_unaligned: None leaves each task its own default (pos, lemma: true; ner: false).

    winlen: reach of boundary transpositions; folded: align tokens that overlap; strict: what makes a score undefined is an error.
    span: alignment deals sentences to tasks by ranges of so many characters, for sentences beyond what a task should hold.
    """

    average: str | None = "micro"
    skip_unaligned: bool | None = None
    strict: bool = False
    winlen: int = 1
    folded: bool = False
    span: int | None = None


class Metric:
    """A task. scores() gives, for each of by, a row with its figures, and where it has them columns label and schema."""

    modes: tuple[str, ...] = MODES

    def figures(self, mode: str) -> list[str]:
        """The columns of scores() that are figures."""
        raise NotImplementedError

    def scores(self, items: DataFrame, mode: str, options: Options, by: list[str]) -> list[DataFrame]:
        raise NotImplementedError


class TokenMetric(Metric):
    def figures(self, mode: str) -> list[str]:
        return ["precision", "recall", "fscore"] if mode == "reference" else ["boundary_edit_kappa"]

    def scores(self, items: DataFrame, mode: str, options: Options, by: list[str]) -> list[DataFrame]:
        if mode == "reference":
            return [tokens.token_scores(tokens.token_counts(items), by)]
        counts = boundary.boundary_counts(items, options.winlen)
        return [boundary.boundary_kappa(counts, by, options.strict).withColumnRenamed("kappa", "boundary_edit_kappa")]


@dataclass
class LabelMetric(Metric):
    """Scores of a label of aligned tokens; tasks of this kind share one alignment."""

    label: str
    one_to_one: bool
    reference: tuple[str, ...]

    def figures(self, mode: str) -> list[str]:
        return list(self.reference) if mode == "reference" else ["kappa"]

    def scores(self, items: DataFrame, mode: str, options: Options, by: list[str]) -> list[DataFrame]:
        return [x for _, x in together({self.label: self}, items, mode, options, by)]


def _counts_only(tasks: dict[str, LabelMetric], mode: str, options: Options) -> bool:
    """Whether micro averages and accuracies are all that tasks ask for."""
    return mode == "reference" and all(set(m.reference) <= ({"precision", "recall", "fscore", "accuracy"} if options.average == "micro" else {"accuracy"}) for m in tasks.values())


def _streams(tasks: dict[str, LabelMetric], items: DataFrame, options: Options) -> bool:
    """Whether tokens are aligned and paired as they stream by: groups that pair otherwise than by their first labels and sentences in ranges are not."""
    return not (options.folded or options.span or options.skip_unaligned is False) and all(items.schema[m.label].dataType == T.StringType() for m in tasks.values())


def together(tasks: dict[str, LabelMetric], items: DataFrame, mode: str, options: Options, by: list[str], tokens: str | None = None) -> list[tuple[str, DataFrame]]:
    """(task, scores) of tasks over aligned labels: one alignment, one confusion table and one pass over it for all of them.

    Micro averages and accuracies need no table, which for lemmas has a row for nearly every two words that were paired.  tokens: a task of token matches that is counted in the
    same pass, where that goes: _streams(), _counts_only(), not strict and without by.
    """
    shares = _counts_only(tasks, mode, options)
    if _streams(tasks, items, options):
        some = options.strict and any("accuracy" in m.figures(mode) for m in tasks.values())
        pairs = paired.pair_counts(items, {t: (m.label, m.one_to_one) for t, m in tasks.items()}, bool(by), shares, options.strict, some, tokens)
    else:
        pairs = _paired(tasks, items, mode, options)
    table = None if shares else labels.confusion(pairs, ["task", *by])
    out = []
    if (table is not None and mode == "reference" and options.average is None) and (each := [t for t, m in tasks.items() if "precision" in m.reference]):
        out += [(t, labels.averages(table.where(F.col("task") == t).drop("task"), None, by)) for t in each]
        tasks = {t: m for t, m in tasks.items() if t not in each}
    if tasks:
        if not shares:
            all_of = labels.scores(table.where(F.col("task").isin(*tasks)), options.average or "micro", ["task", *by])
        elif "tp" in pairs.columns:
            all_of = labels.shares(pairs.groupBy("task", *by).agg(*[F.sum(c).alias(c) for c in ("tp", "n", "m")]), ["task", *by])
        else:
            all_of = labels.micro_scores(pairs, ["task", *by])
        names = [*([tokens] if tokens else []), *tasks]
        if not by:  # a task without pairs has a row as well
            all_of = items.sparkSession.createDataFrame([(t,) for t in names], "task string").join(all_of, "task", "left").fillna(0.0, ["precision", "recall", "fscore"])
        if options.strict:
            all_of = all_of.withColumn("accuracy", F.coalesce("accuracy", F.raise_error(F.lit("no pairs")).cast("double")))
        out += [(t, all_of) for t in names]
    return out


def _paired(tasks: dict[str, LabelMetric], items: DataFrame, mode: str, options: Options) -> DataFrame:
    """sent_id, task, a, b: all pairs."""
    names = sorted({m.label for m in tasks.values()})
    aligned = align.aligned_tokens(items.select("sent_id", "side", "ord", "start", "end", "is_min", *names), options.strict, options.folded, options.span)
    if options.skip_unaligned is False:
        parts = [align.edit_pairs(aligned, m.label, m.one_to_one, in_order=not (options.folded or options.span)).select("sent_id", F.lit(t).alias("task"), "a", "b") for t, m in tasks.items()]
        pairs = parts[0]
        for p in parts[1:]:
            pairs = pairs.unionByName(p)
    else:
        pair = lambda t, m: F.when((F.col("n_a") == F.col("n_b")) & (F.lit(not m.one_to_one) | (F.col("n_a") == 1)), F.struct(F.lit(t).alias("task"), F.col(f"a_{m.label}").alias("a"), F.col(f"b_{m.label}").alias("b")))
        first = align.first_labels if options.folded or options.span else align.first_labels_in_order
        groups = first(aligned, names).withColumn("pairs", F.array_compact(F.array(*[pair(t, m) for t, m in tasks.items()])))
        if options.strict and any("accuracy" in m.figures(mode) for m in tasks.values()):  # a sentence that has no pair to be right on
            some = F.max(F.size("pairs")).over(W.partitionBy("sent_id"))
            groups = groups.withColumn("some", some).where(F.when(F.col("some") == 0, F.raise_error(F.lit("a sentence has no pairs"))).otherwise(True))
        pairs = groups.select("sent_id", F.explode("pairs").alias("x")).select("sent_id", "x.*")
    return pairs


class EntityMetric(Metric):
    modes = ("reference",)

    def figures(self, mode: str) -> list[str]:
        return [*entities.METRICS, "possible", "actual", "precision", "recall", "f1"]

    def scores(self, items: DataFrame, mode: str, options: Options, by: list[str]) -> list[DataFrame]:
        """Overall, and without by also for each label."""
        found, known = entities.entities_of_items(items, bool(options.skip_unaligned))
        judged = entities.classify(found, known)
        return [entities.ner_overall(judged, by)] + ([] if by else [entities.ner_per_label(judged, known)])


#: Tasks by name; further ones may be entered.
METRICS: dict[str, Metric] = {
    "token": TokenMetric(),
    "pos": LabelMetric("pos", True, ("precision", "recall", "fscore")),
    "lemma": LabelMetric("lemma", False, ("accuracy",)),
    "ner": EntityMetric(),
}


@dataclass
class Evaluator:
    """tasks: names in METRICS. verbose: evaluate() also shows its figures."""

    tasks: list[str]
    mode: str = "reference"
    options: Options = field(default_factory=Options)
    verbose: bool = False

    def __post_init__(self) -> None:
        if unknown := [t for t in self.tasks if t not in METRICS]:
            raise ValueError(f"unknown task: {', '.join(unknown)}")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if wrong := [t for t in self.tasks if self.mode not in METRICS[t].modes]:
            raise ValueError(f"{', '.join(wrong)}: only the reference mode")
        if self.options.average not in ("micro", "macro", "weighted", None):
            raise ValueError("average must be micro, macro, weighted or None")

    def table(self, items: DataFrame, by: list[str] | None = None) -> DataFrame:
        """task, by, label, schema, metric, value of all tasks over an item table; lazy, one row a figure."""
        by, out = by or [], []

        def long(task: list[str], df: DataFrame) -> None:
            """df has the figures of these tasks, with a column task if there are several."""
            none = F.lit(None).cast("string")
            cell = lambda t: F.array(*[F.struct(F.lit(t).alias("task"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS[t].figures(self.mode)])
            cells = cell(task[0])
            if "task" in df.columns:
                cells = F.when(F.col("task") == task[0], cells)
                for t in task[1:]:
                    cells = cells.when(F.col("task") == t, cell(t))
            own = [F.col(c) if c in df.columns else none.alias(c) for c in ("label", "schema")]
            out.append(df.select(*by, *own, F.explode(cells).alias("x")).select("x.task", *by, "label", "schema", "x.metric", "x.value"))

        aligned = {t: METRICS[t] for t in self.tasks if isinstance(METRICS[t], LabelMetric)}
        same_pass = None
        if aligned and not by and not self.options.strict and _counts_only(aligned, self.mode, self.options) and _streams(aligned, items, self.options):
            same_pass = next((t for t in self.tasks if type(METRICS[t]) is TokenMetric), None)
        for task in self.tasks:
            if task not in aligned and task != same_pass:
                for df in METRICS[task].scores(items, self.mode, self.options, by):
                    long([task], df)
        if aligned:
            frames: dict[int, tuple[list[str], DataFrame]] = {}
            for task, df in together(aligned, items, self.mode, self.options, by, same_pass):
                frames.setdefault(id(df), ([], df))[0].append(task)
            for task, df in frames.values():
                long(task, df)
        first, *rest = out
        for df in rest:
            first = first.unionByName(df)
        return first

    def evaluate(self, a: DataFrame, b: DataFrame | None = None) -> dict:
        """task -> name -> value; for ner results and results_per_label by schema; for pos without an average name -> label -> value.

        a: an item table; or, with b, two corpora of sentences, paired by place up to the end of the shorter.  A handful of
        figures is collected.
        """
        rows = self.table(a if b is None else corpus.itemize(corpus.pair(a, b)))
        out: dict = {t: {} for t in self.tasks}
        for r in rows.collect():
            at = out[r["task"]]
            if r["schema"] is not None:
                at = at.setdefault("results", {}) if r["label"] is None else at.setdefault("results_per_label", {}).setdefault(r["label"], {})
                at.setdefault(r["schema"], {})[r["metric"]] = r["value"]
            elif r["label"] is not None:
                at.setdefault(r["metric"], {})[r["label"]] = r["value"]
            else:
                at[r["metric"]] = r["value"]
        if self.verbose:
            for task, figures in out.items():
                print(f"{task}: {figures}")
        return out


def evaluate(spark: SparkSession, path: str, key: str):
    """Scores of a corpus file: key pos or lemma gives weighted and average P, R, F, accuracy, and for pos those of each label; key ner gives (overall, per label)."""
    if key not in ("pos", "lemma", "ner"):
        raise ValueError("key must be pos, lemma or ner")
    items = corpus.itemize(corpus.load_json(spark, path)).persist()  # read once for all figures
    try:
        return _figures(items, key)
    finally:
        items.unpersist()


def _figures(items: DataFrame, key: str):
    if key == "ner":
        got = Evaluator(["ner"]).evaluate(items)["ner"]
        return got["results"], got["results_per_label"]
    table = labels.confusion(align.label_pairs(items, key, one_to_one=key == "pos"))
    out = {}
    for name, kind in (("weighted", "weighted"), ("average", "macro")):
        r = labels.averages(table, kind).first()
        out |= {f"{name}_f1": r["fscore"], f"{name}_precision": r["precision"], f"{name}_recall": r["recall"]}
    out["accuracy"] = labels.accuracy(table).first()["accuracy"]
    if key == "pos":
        out["per_label"] = {r["label"]: {"f1": r["fscore"], "precision": r["precision"], "recall": r["recall"]} for r in labels.per_label(table).collect()}
    return out


def tags_from_lists(spark: SparkSession, gold: list[list[str]], pred: list[list[str]]) -> DataFrame:
    """The tag table of two parallel lists of tag lists; lengths must agree."""
    if len(gold) != len(pred):
        raise ValueError("the numbers of documents differ")
    if any(len(a) != len(b) for a, b in zip(gold, pred)):
        raise ValueError("tag lists differ in length")
    rows = [(i, side, k, t) for side, lists in (("a", gold), ("b", pred)) for i, tags in enumerate(lists) for k, t in enumerate(tags)]
    return spark.createDataFrame(rows, "sent_id long, side string, ord int, tag string")


def evaluate_ner(spark: SparkSession, gold: list[list[str]], pred: list[list[str]], label_set: list[str]) -> tuple[dict, dict]:
    """(schema -> figures, label -> schema -> figures) of tag lists, for the labels of label_set; a repeated label counts once."""
    known = spark.createDataFrame([(x,) for x in dict.fromkeys(label_set)], "label string")
    judged = entities.classify(entities.entities_from_tags(tags_from_lists(spark, gold, pred)), known)
    overall = {r["schema"]: {k: v for k, v in r.asDict().items() if k != "schema"} for r in entities.ner_overall(judged).collect()}
    per: dict = {}
    for r in entities.ner_per_label(judged, known).collect():
        per.setdefault(r["label"], {})[r["schema"]] = {k: v for k, v in r.asDict().items() if k not in ("label", "schema")}
    return overall, per
