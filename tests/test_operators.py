"""Goldens of the scoring operators, and random cases against small sequential models."""

import json
import math
import pathlib
import random
import re
import shutil
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmeter.functions import text
from glossmeter.operators import align, boundary, entities, labels, paired, tokens
from glossmeter.plans.evaluate import Evaluator, Options, evaluate, evaluate_ner
from glossmeter.sources import corpus

ITEMS = "sent_id long, side string, ord int, item string, start int, end int, pos string, lemma string, is_min boolean, is_stop boolean, ner_label string"


def table(spark, *sentences):
    """Sentences as (gold, pred), each a list of (start, end[, pos[, lemma[, is_min[, ner]]]])."""
    rows = []
    for i, sides in enumerate(sentences):
        for side, spans in zip("ab", sides):
            for k, x in enumerate(spans):
                s, e, pos, lemma, is_min, ner = (*x, *("X", "l", True, None)[len(x) - 2 :])
                rows.append((i, side, k, f"t{s}", s, e, pos, lemma, is_min, False, ner))
    return spark.createDataFrame(rows, ITEMS)


def bounds(bits):
    """Spans of a text whose boundary vector is bits."""
    cuts = [0, *[i + 1 for i, b in enumerate(bits) if b == "1"], len(bits) + 1]
    return list(zip(cuts, cuts[1:]))


@pytest.mark.parametrize("gold,pred,want", [
    ([(0, 8), (0, 3), (4, 8)], [(0, 3), (4, 8)], (1, 3, 2, 0.5, 1 / 3, 0.4)),
    ([(0, 1), (1, 2), (2, 3)], [], (0, 3, 0, 0, 0, 0)),
    ([(0, 9), (10, 13), (14, 22)], [(0, 9), (10, 13), (14, 22)], (3, 3, 3, 1, 1, 1)),
])
def test_token_scores(spark, gold, pred, want):
    for counts in (tokens.token_counts, tokens.token_counts_any_order):
        r = tokens.token_scores(counts(table(spark, (gold, pred)))).first()
        assert tuple(r) == pytest.approx(want)


def test_token_counts_random(spark):
    r = random.Random(1)
    side = lambda: sorted((s := r.randrange(6), s + r.randint(1, 3)) for _ in range(r.randrange(7)))
    t = table(spark, *[(side(), side()) for _ in range(150)])
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(tokens.token_counts(t)) == key(tokens.token_counts_any_order(t).select("sent_id", "correct", "n_gold", "n_pred"))


@pytest.mark.parametrize("a,b,want,kappa", [
    ("100100", "010100", (1, 0, 1, 0.5, 6, 2, 2), 0.71875), ("10100", "01010", (0, 2, 1, 0.5, 5, 2, 2), 1 / 126), ("100100", "010010", (0, 0, 2, 1.0, 6, 2, 2), 0.4375),
    ("110", "000", (0, 2, 0, 0.0, 3, 2, 0), 0.0), ("000", "000", (0, 0, 0, 0.0, 3, 0, 0), math.nan),
])
def test_boundary(spark, a, b, want, kappa):
    c = boundary.boundary_counts(table(spark, (bounds(a), bounds(b))))
    assert tuple(c.select(*boundary.COUNTS).first()) == want
    got = boundary.boundary_kappa(c).first()["kappa"]
    assert (math.isnan(got) and math.isnan(kappa)) or got == pytest.approx(kappa)


def walk(a, b, winlen):
    odd, i, n, w = [x != y for x, y in zip(a, b)], 0, 0, 0.0
    while i < len(a):
        if odd[i]:
            for k in range(1, winlen + 1):
                if i + k < len(a) and odd[i + k] and a[i] != a[i + k]:
                    n, w, i = n + 1, w + 1 - k / (winlen + 1), i + k + 1
                    break
        i += 1
    return n, w


@pytest.mark.parametrize("winlen", [1, 2, 3])
def test_boundary_random(spark, winlen):
    r = random.Random(winlen)
    pairs = [["".join(r.choice("01") for _ in range(n)) for _ in "ab"] for n in [r.randint(1, 18) for _ in range(120)]]
    got = {x["sent_id"]: (x["n_trans"], x["w_trans"]) for x in boundary.boundary_counts(table(spark, *[(bounds(a), bounds(b)) for a, b in pairs]), winlen).collect()}
    for i, (a, b) in enumerate(pairs):
        n, w = walk(a, b, winlen)
        assert got[i][0] == n and got[i][1] == pytest.approx(w)


def test_boundary_gap_and_invalid(spark):
    c = boundary.boundary_counts(table(spark, ([(0, 9), (10, 13), (14, 22)],) * 2, ([(0, 4)], [(0, 5)]), ([(0, 4)], [])))
    rows = {x["sent_id"]: x for x in c.collect()}
    assert rows[0]["n_match"] == 4 and rows[0]["n_pot"] == 21 and rows[0]["valid"] and not rows[1]["valid"] and not rows[2]["valid"]
    assert boundary.boundary_kappa(c).first()["kappa"] == pytest.approx(1)
    with pytest.raises(Exception, match="minimum tokens"):
        boundary.boundary_kappa(c, strict=True).collect()


def test_align(spark):
    t = table(spark, ([(0, 3), (3, 10)], [(0, 5), (5, 10)]), ([(0, 4), (5, 9)], [(0, 9)]), ([(0, 4), (5, 9)], [(0, 4), (5, 9)]), ([(0, 4)], [(0, 5)]))
    got = sorted((x["sent_id"], x["group"], len(x["a"]), len(x["b"])) for x in align.align_groups(t).collect())
    assert got == [(0, 10, 2, 2), (1, 9, 2, 1), (2, 4, 1, 1), (2, 9, 1, 1)]
    with pytest.raises(Exception, match="same total span"):
        align.align_groups(t, strict=True).collect()
    assert align.label_pairs(t.where("sent_id = 0"), "pos").count() == 0
    assert align.label_pairs(t.where("sent_id = 0"), "lemma", one_to_one=False).count() == 1


def test_align_leaves_out_or_folds(spark):
    over, flat, fine = ([(0, 4), (2, 6), (6, 9)], [(0, 6), (6, 9)]), ([(0, 4), (4, 4), (4, 9)], [(0, 4), (4, 9)]), ([(0, 4), (4, 9)], [(0, 9)])
    t = table(spark, over, flat, fine, ([(0, 4)], [(0, 5)]), ([(0, 4)], []), ([(0, 4), (0, 4)], [(0, 4)]))
    assert {r["sent_id"] for r in align.align(t).collect()} == {2}
    for i in (0, 1, 5):
        with pytest.raises(Exception, match="do not overlap"):
            align.align(t.where(f"sent_id = {i}"), strict=True).collect()
    got = sorted((r["sent_id"], r["group"], len(r["a"]), len(r["b"])) for r in align.align_groups(t, folded=True).collect())
    assert got == [(0, 0, 2, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1), (2, 0, 2, 1), (5, 0, 1, 1)]
    with pytest.raises(Exception, match="same total span"):
        align.align_folded(t.where("sent_id = 3"), strict=True).collect()


def test_align_folds_as_it_windows(spark):
    r = random.Random(21)

    def side():
        cuts = sorted({0, 20, *(r.randrange(1, 20) for _ in range(r.randrange(8)))})
        return [(s, e - (r.random() < 0.2 and e - s > 1 and e < 20)) for s, e in zip(cuts, cuts[1:])]

    t = table(spark, *[(side(), side()) for _ in range(120)])
    key = lambda df: sorted((x["sent_id"], [tuple(y) for y in x["a"]], [tuple(y) for y in x["b"]]) for x in df.collect())
    assert key(align.align_groups(t)) == key(align.align_groups(t, folded=True))


@pytest.mark.parametrize("a,b,want", [
    ("NV", "N", [("N", "N"), ("V", None)]), ("NV", "A", [("N", "A"), ("V", None)]), ("N", "AV", [("N", "A"), (None, "V")]), ("NVA", "VA", [("N", None), ("V", "V"), ("A", "A")]),
    ("AB", "BA", [(None, "B"), ("A", "A"), ("B", None)]), ("NN", "N", [("N", None), ("N", "N")]), ("", "N", [(None, "N")]), ("", "", []),
])
def test_edit_path(spark, a, b, want):
    assert align.edit_path(a, b) == want
    r = spark.createDataFrame([(list(a), list(b))], "a array<string>, b array<string>").select(align.edit_ops("a", "b").alias("x")).first()["x"]
    assert [(x["a"], x["b"]) for x in r] == want


def test_edit_path_long():
    assert len(align.edit_path(list(range(300)), list(range(1, 301)))) == 301


def test_misaligned(spark):
    t = table(spark, ([(0, 2, "N"), (2, 4, "V")], [(0, 4, "N")]))
    got = sorted((x["a"], x["b"]) for x in align.label_pairs(t, "pos", skip_unaligned=False).collect())
    assert got == [("N", "N"), ("V", "MISALIGNED")]


def test_contiguous_and_lookup(spark):
    t = table(spark, ([(0, 4), (5, 9)], [(0, 4), (4, 9)]), ([], [(3, 4)]))
    assert sorted(tuple(x) for x in align.is_contiguous(t).collect()) == [(0, "a", False), (0, "b", True), (1, "b", True)]
    wanted = spark.createDataFrame([(0, "t5", "5"), (0, "t5", "6")], "sent_id long, item string, start string")
    assert sorted(str(x["gold_end"]) for x in align.find_gold_term(t, wanted).collect()) == ["9", "None"]


def test_labels(spark):
    c = labels.confusion(spark.createDataFrame(list(zip("NNVA", "NVVN")), "a string, b string"))
    assert tuple(labels.averages(c, "micro").first()) == pytest.approx((0.5, 0.5, 0.5))
    assert tuple(labels.averages(c, "macro").first()) == pytest.approx((1 / 3, 0.5, 7 / 18))
    assert tuple(labels.averages(c, "weighted").first()) == pytest.approx((0.375, 0.5, 5 / 12))
    assert labels.accuracy(c).first()["accuracy"] == 0.5 and labels.kappa(c).first()["kappa"] == pytest.approx(0.2)
    assert math.isnan(labels.kappa(labels.confusion(spark.createDataFrame([("N", "N")] * 2, "a string, b string"))).first()["kappa"])
    per = {r["label"]: (r["precision"], r["recall"]) for r in labels.averages(c, None).collect()}
    assert per == {"N": (0.5, 0.5), "V": (0.5, 1.0), "A": (0.0, 0.0)}
    one = labels.scores(c, "macro").first()
    assert one["kappa"] == pytest.approx(0.2) and one["accuracy"] == 0.5 and one["precision"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        labels.averages(c, "binary")
    with pytest.raises(Exception, match="no pairs"):
        labels.accuracy(c.limit(0), strict=True).collect()
    assert labels.accuracy(c.limit(0)).first()["accuracy"] is None


BIO = [
    ([(0, 8, "LOC"), (0, 3, None), (4, 8, None)], "B-LOC I-LOC"), ([(0, 8, None), (0, 3, None), (4, 8, None)], "O O O"), ([(0, 8, "ORG"), (0, 3, "LOC"), (4, 8, None)], "B-ORG I-ORG"), ([], ""),
    ([(0, 5, "A"), (2, 7, None), (3, 5, None)], "B-A O O"), ([(0, 9, None), (0, 4, "A"), (1, 3, "B"), (4, 9, None)], "O B-A I-A O"),
]


def walk_items(items):
    """Tags by one cursor and the entity that is open."""
    out, opened = [], None
    for start, end, label in sorted(items, key=lambda x: (x[0], -x[1])):
        if opened is not None and end <= opened[1]:
            if start != opened[0]:
                out.append(f"I-{opened[2]}")
            continue
        opened = None if label is None else (start, end, label)
        out.append("O" if label is None else f"B-{label}")
    return out


def tags_of(spark, lists):
    t = table(spark, *[([(s, e, "X", "l", True, n) for s, e, n in x], []) for x in lists])
    got = {}
    for r in sorted(entities.bio_from_items(t).collect(), key=lambda r: (r["sent_id"], r["ord"])):
        assert r["ord"] == len(got.setdefault(r["sent_id"], []))
        got[r["sent_id"]].append(r["tag"])
    return [got.get(i, []) for i in range(len(lists))]


def test_bio(spark):
    assert tags_of(spark, [x for x, _ in BIO]) == [w.split() for _, w in BIO] == [walk_items(x) for x, _ in BIO]


def test_bio_random(spark):
    r = random.Random(12)
    lists = [[(s := r.randrange(12), s + r.randint(1, 8), r.choice([None, None, "A", "B"])) for _ in range(r.randrange(12))] for _ in range(300)]
    assert tags_of(spark, lists) == [walk_items(x) for x in lists]


def tag_table(spark, gold, pred):
    rows = [(i, s, k, t) for s, lists in (("a", gold), ("b", pred)) for i, x in enumerate(lists) for k, t in enumerate(x.split())]
    return spark.createDataFrame(rows, "sent_id long, side string, ord int, tag string")


@pytest.mark.parametrize("tags,want", [
    ("O B-LOC I-LOC B-LOC I-LOC O", [("LOC", 1, 2), ("LOC", 3, 4)]), ("O B-LOC I-LOC B-LOC I-LOC", [("LOC", 1, 2), ("LOC", 3, 4)]), ("O O", []), ("B-LOC", []), ("B-LOC I-LOC", []),
    ("B-LOC O", [("LOC", 0, 0)]), ("O I-LOC O", [("LOC", 1, 1)]), ("O B-A I-B I-B O", [("A", 1, 1), ("B", 2, 3)]),
])
def test_entities(spark, tags, want):
    got = entities.entities_from_tags(tag_table(spark, [tags], []))
    assert sorted((x["e_type"], x["s"], x["e"]) for x in got.collect()) == sorted(want)


def cases(spark, gold, pred, known):
    rows = [(0, s, k, *x) for s, es in (("a", gold), ("b", pred)) for k, x in enumerate(es)]
    e = spark.createDataFrame(rows, "sent_id long, side string, ord int, e_type string, s int, e int")
    names = spark.createDataFrame([(x,) for x in known.split()], "label string")
    return entities.classify(e, names), names


def counts(r):
    return "/".join(str(r[m]) for m in ("correct", "incorrect", "partial", "missed", "spurious"))


GOLDENS = [
    ([("PER", 59, 69), ("LOC", 127, 134), ("LOC", 164, 174), ("LOC", 197, 205), ("LOC", 208, 219), ("MISC", 230, 240)], [("PER", 24, 30), ("LOC", 124, 134), ("PER", 164, 174), ("LOC", 197, 205), ("LOC", 208, 219), ("LOC", 225, 243)], "PER LOC MISC", "2/3/0/1/1 3/2/0/1/1 3/0/2/1/1 3/2/0/1/1"),
    ([("PER", 59, 69)], [], "PER", "0/0/0/1/0 0/0/0/1/0 0/0/0/1/0 0/0/0/1/0"),
    ([], [("PER", 59, 69)], "PER", "0/0/0/0/1 0/0/0/0/1 0/0/0/0/1 0/0/0/0/1"),
    ([("PER", 59, 69)], [("PER", 57, 69)], "PER", "0/1/0/0/0 1/0/0/0/0 0/0/1/0/0 0/1/0/0/0"),
    ([("PER", 59, 69)], [("LOC", 59, 69)], "PER LOC", "0/1/0/0/0 0/1/0/0/0 1/0/0/0/0 1/0/0/0/0"),
    ([("PER", 59, 69)], [("LOC", 54, 69)], "PER LOC", "0/1/0/0/0 0/1/0/0/0 0/0/1/0/0 0/1/0/0/0"),
    ([("PER", 50, 52), ("ORG", 59, 69), ("ORG", 71, 72)], [("LOC", 50, 52), ("ORG", 59, 69), ("MISC", 71, 72)], "PER LOC ORG", "1/1/0/1/0 1/1/0/1/0 2/0/0/1/0 2/0/0/1/0"),
    ([("PER", 50, 52), ("ORG", 59, 69), ("MISC", 71, 72)], [("LOC", 50, 52), ("ORG", 59, 69), ("ORG", 71, 72)], "PER LOC ORG", "1/1/0/0/1 1/1/0/0/1 2/0/0/0/1 2/0/0/0/1"),
    ([("A", 1, 3)], [("A", 3, 5)], "A", "0/0/0/1/1 0/0/0/1/1 0/0/0/1/1 0/0/0/1/1"),
    ([("A", 2, 2)], [("A", 1, 3)], "A", "0/0/0/1/1 0/0/0/1/1 0/0/0/1/1 0/0/0/1/1"),
]


@pytest.mark.parametrize("gold,pred,known,want", GOLDENS)
def test_ner_cases(spark, gold, pred, known, want):
    judged, _ = cases(spark, gold, pred, known)
    got = {r["schema"]: counts(r) for r in entities.ner_overall(judged).collect()}
    assert " ".join(got[s] for s in entities.SCHEMAS) == want


def model_cases(gold, pred, known):
    """A sequential reading of the decision table."""
    gold, pred, out, met = [g for g in gold if g[0] in known], [p for p in pred if p[0] in known], [], []
    for p in pred:
        if p in gold:
            out.append("same"), met.append(p)
            continue
        for g in gold:
            if p[1:] == g[1:] or max(p[1], g[1]) < min(p[2], g[2]):
                out.append("type" if p[1:] == g[1:] else "bounds" if p[0] == g[0] else "both"), met.append(g)
                break
        else:
            out.append("spurious")
    return sorted(out + ["missed"] * sum(g not in met for g in gold))


def test_ner_random(spark):
    r = random.Random(4)
    side = lambda: [(r.choice("AB"), s := r.randrange(300), s + r.randrange(200)) for _ in range(r.randrange(6))]
    for _ in range(6):
        g, p = side(), side()
        judged, _ = cases(spark, g, p, "A B")
        assert sorted(x["case"] for x in judged.collect()) == model_cases(g, p, "AB")


def test_evaluate_ner(spark):
    t = lambda *x: [s.split() for s in x]
    overall, per = evaluate_ner(spark, t("O O B-ORG O O B-LOC I-LOC O", "O O O O O O", "O B-MISC I-MISC O O O"), t("O O B-ORG O O B-LOC I-LOC O", "O B-PER I-PER O O O", "O O O O O O"), ["PER", "LOC", "ORG", "MISC"])
    for s in entities.SCHEMAS:
        assert counts(overall[s]) == "2/0/0/1/1" and overall[s]["precision"] == pytest.approx(2 / 3) and overall[s]["possible"] == overall[s]["actual"] == 3
        assert [counts(per[x][s]) for x in ("ORG", "LOC", "PER", "MISC")] == ["1/0/0/0/1", "1/0/0/0/1", "0/0/0/0/1", "0/0/0/1/1"]
        assert (per["ORG"][s]["precision"], per["ORG"][s]["recall"]) == (0.5, 1)
    for g, p in (([["O"]] * 2, [["O"]]), ([["O", "O"]], [["O"]])):
        with pytest.raises(ValueError):
            evaluate_ner(spark, g, p, ["PER"])


SNIPPET = [{"query": "hoofdstad van Suriname", "gold": [], "pred": []}]
for _s, _ner in (("gold", [{"ner": "LOC"}]), ("pred", "")):
    for _w, _a, _b, _p in (("hoofdstad", 0, 9, "NOUN"), ("van", 10, 13, "ADP"), ("Suriname", 14, 22, "NOUN")):
        SNIPPET[0][_s].append({"item": _w, "startOffSet": _a, "endOffSet": _b, "pos": _p, "lemma": _w.lower(), "isMinimumToken": True, "ner": _ner if _w == "Suriname" else ""})


def test_file_end_to_end(spark, tmp_path):
    path = tmp_path / "eval.json"
    path.write_text(json.dumps(SNIPPET, ensure_ascii=False))
    items = corpus.itemize(corpus.load_json(spark, str(path)), strict=True).cache()
    got = Evaluator(["token", "pos", "lemma", "ner"]).evaluate(items)
    assert got["token"] == {"precision": 1, "recall": 1, "fscore": 1} and got["pos"]["fscore"] == 1 and got["lemma"] == {"accuracy": 1}
    assert counts(got["ner"]["results"]["strict"]) == "0.0/0.0/0.0/1.0/0.0" and got["ner"]["results_per_label"]["LOC"]["exact"]["missed"] == 1 and set(got["ner"]["results_per_label"]) == {"O", "LOC"}
    agree = Evaluator(["token", "pos", "lemma"], "agreement").evaluate(items)
    assert agree["token"]["boundary_edit_kappa"] == pytest.approx(1) and agree["pos"]["kappa"] == pytest.approx(1)
    pos = evaluate(spark, str(path), "pos")
    assert pos["weighted_f1"] == pos["average_recall"] == pos["accuracy"] == 1 and set(pos["per_label"]) == {"NOUN", "ADP"}
    assert "per_label" not in evaluate(spark, str(path), "lemma") and counts(evaluate(spark, str(path), "ner")[0]["partial"]) == "0.0/0.0/0.0/1.0/0.0"
    corpus.save_json(corpus.load_json(spark, str(path)), str(tmp_path / "out"))
    again = corpus.itemize(corpus.load_json(spark, str(tmp_path / "out")))
    assert sorted(map(str, again.drop("sent_id").collect())) == sorted(map(str, items.drop("sent_id").collect()))


def sentence(words, n=None):
    """Items of blank-separated words."""
    out, at = [], 0
    for w in words.split():
        out.append({"item": w, "startOffSet": at, "endOffSet": at + len(w), "pos": w[:1], "lemma": w.lower(), "isMinimumToken": True, "ner": ""})
        at += len(w) + 1
    return {"query": words, "gold": out}


def test_two_corpora(spark, tmp_path):
    texts = ["é b c", "d e", "f", "g h i j", "k"]
    for name, part in (("z1", texts[:1]), ("z2", texts[1:4]), ("z3", texts[4:])):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"{name}.json").write_text(json.dumps([sentence(t) for t in part], ensure_ascii=False) + " " * {"z1": 9, "z2": 999, "z3": 99}[name])
    (tmp_path / "one.json").write_text(json.dumps([sentence(t) for t in texts[:3]], ensure_ascii=False))
    a, b = corpus.load_json(spark, str(tmp_path / "many")), corpus.load_json(spark, str(tmp_path / "one.json"))
    assert [r["query"] for r in a.orderBy("sent_id").collect()] == texts and [r[0] for r in a.select("sent_id").orderBy("sent_id").collect()] == list(range(5))
    assert corpus.pair(a, b).count() == corpus.pair(b, a).count() == 3
    assert Evaluator(["token", "pos", "lemma"]).evaluate(a, b) == {"token": {"precision": 1, "recall": 1, "fscore": 1}, "pos": {"precision": 1, "recall": 1, "fscore": 1}, "lemma": {"accuracy": 1}}
    corpus.save_json_array(a, str(tmp_path / "out.json"))
    kept = json.loads((tmp_path / "out.json").read_text(encoding="utf-8"))
    assert [x["query"] for x in kept] == texts and "é" in (tmp_path / "out.json").read_text(encoding="utf-8") and kept[1]["gold"][0]["ner"] == ""
    corpus.save_json_array(a.limit(0), str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == [] and not (tmp_path / "out.json._parts").exists()


def test_options_and_registry(spark, capsys):
    t = table(spark, ([(0, 2, "N", "n"), (2, 4, "V", "v")], [(0, 2, "N", "n"), (2, 4, "N", "v")]), ([(0, 2, "N", "n"), (2, 4, "V", "v")], [(0, 4, "N", "n")]))
    assert Evaluator(["pos", "lemma"], options=Options(average=None), verbose=True).evaluate(t) == {"pos": {"precision": {"N": 0.5, "V": 0.0}, "recall": {"N": 1.0, "V": 0.0}, "fscore": {"N": pytest.approx(2 / 3), "V": 0.0}}, "lemma": {"accuracy": 1.0}}
    assert "lemma: {'accuracy': 1.0}" in capsys.readouterr().out
    with pytest.raises(Exception, match="no pairs"):
        Evaluator(["lemma"], options=Options(strict=True)).evaluate(t)
    with pytest.raises(Exception, match="no sentences|minimum tokens"):
        Evaluator(["token"], "agreement", Options(strict=True)).evaluate(t.limit(0))
    far = table(spark, (bounds("100010000"), bounds("001000000")))
    assert Evaluator(["token"], "agreement", Options(winlen=2)).evaluate(far) != Evaluator(["token"], "agreement").evaluate(far)
    none = Evaluator(["pos", "lemma"]).evaluate(t.limit(0))
    assert none == {"pos": {"precision": 0, "recall": 0, "fscore": 0}, "lemma": {"accuracy": None}}
    over = table(spark, ([(0, 4, "N"), (2, 6, "V")], [(0, 6, "N")]), ([(0, 4, "N")], [(0, 4, "N")]))
    assert Evaluator(["pos"], options=Options(folded=True)).evaluate(over)["pos"]["precision"] == 1

    from glossmeter.plans import evaluate as plans

    class Items(plans.Metric):
        def figures(self, mode):
            return ["items"]

        def scores(self, items, mode, options, by):
            return [items.groupBy(*by).agg(F.count("*").alias("items"))]

    plans.METRICS["size"] = Items()
    assert Evaluator(["size"]).evaluate(far)["size"] == {"items": 5.0}
    del plans.METRICS["size"]


def test_errors(spark):
    for bad in (lambda: Evaluator(["x"]), lambda: Evaluator(["ner"], "agreement"), lambda: Evaluator(["pos"], "other"), lambda: evaluate(spark, "x", "y")):
        with pytest.raises(ValueError):
            bad()
    broken = corpus.from_lists(spark, [{"query": "a", "gold": [{"item": "a", "startOffSet": 0, "endOffSet": 1, "pos": "X", "lemma": "a", "isMinimumToken": True, "ner": []}], "pred": []}])
    with pytest.raises(Exception, match="malformed"):
        corpus.itemize(broken, strict=True).collect()


def test_length_policy_and_label_set(spark):
    t = tag_table(spark, ["O B-A I-A O O"], ["O B-SUB-X O O"])
    assert entities.same_length(t).count() == 8 and entities.same_length(t, skip=True).count() == 0
    assert sorted(x[0] for x in entities.label_set(t).collect()) == ["A", "O", "SUX"]
    with pytest.raises(Exception, match="differ in length"):
        entities.same_length(t, strict=True).collect()


def test_text(spark):
    df = spark.createDataFrame([("éàç", " ÉÑ\t"), (None, None), ("", "  ")], "a string, b string")
    rows = df.select(text.strip_accents("a"), text.relax_str("b")).collect()
    assert [tuple(r) for r in rows] == [("eac", "en"), (None, None), ("", "")]


def test_relax_whole_texts(spark, tmp_path):
    import hashlib
    import unicodedata

    from glossmeter.plans.queries import QUERIES

    texts = [None, "", " \n\u00a0", "Éa " * 40 + "ÀÉÎ Õü\u2003\t\x1c", "x" * 40 + "É", "\n" + "wörd\n\n WÖRD " * 500 + "\u3000 Ñ\n \n", " " * 300_000 + "a" + " " * 300_000 + "b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower().strip()
    want = {i: t if t is None else hashlib.md5(plain(t).encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["plain"] for r in QUERIES["relax_str"](spark, str(tmp_path)).collect()} == want


def test_compose(spark):
    from glossmeter.plans.queries import _Upper

    s = corpus.from_lists(spark, [{"query": "a b", "expanded_query": "x y z"}, {"query": "a b"}])
    assert sorted(len(r["pred"]) for r in corpus.compose(s, _Upper).collect()) == [2, 3]
    assert corpus.compose(s, None) is s


def test_options_reach_tasks(spark):
    t = table(spark, ([(0, 2, "N", "n"), (2, 4, "V", "v")], [(0, 4, "N", "n")]))
    assert Evaluator(["pos"], options=Options(skip_unaligned=False)).evaluate(t)["pos"]["precision"] == 0.5
    by = Evaluator(["token"]).table(t, ["sent_id"]).where(F.col("metric") == "recall").first()
    assert by["value"] == 0


def test_stream(spark, tmp_path):
    from glossmeter.streaming.counters import stream_confusion

    pairs = spark.createDataFrame([("N", "N"), ("N", "V")] * 3, "a string, b string")
    pairs.write.parquet(str(tmp_path / "in"))
    q = stream_confusion(spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM seen").collect()) == [("N", "N", 3), ("N", "V", 3)]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "token_prf_corpus" in e.queries()


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_lives_without_corpus_operators(tmp_path, also):
    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", *also))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith(('op1_', 'pipeline')) for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    n, m, others = out.stdout.split()
    assert int(n) >= int(m) >= 40 and others == "False", out.stderr
    seen = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert seen.returncode == 0, seen.stdout


def old_path(a, b):
    """A cheapest way from a to b by the whole table."""
    cost = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row, up = [i], cost[-1]
        for j, y in enumerate(b, 1):
            row.append(up[j - 1] if x == y else 1 + min(up[j], row[j - 1], up[j - 1]))
        cost.append(row)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            step = (1, 1)
        elif not j:
            step = (1, 0)
        elif not i:
            step = (0, 1)
        else:
            step = min(((1, 0), (0, 1), (1, 1)), key=lambda s: cost[i - s[0]][j - s[1]])
        out.append((a[i - 1] if step[0] else None, b[j - 1] if step[1] else None))
        i, j = i - step[0], j - step[1]
    return out[::-1]


def test_edit_path_is_the_whole_tables():
    r = random.Random(1)
    for _ in range(3000):
        abc = [*"abcdefghi", None][: r.choice([1, 2, 3, 5, 10])]
        a, b = ([r.choice(abc) for _ in range(r.randrange(25))] for _ in range(2))
        assert align.edit_path(a, b) == old_path(a, b)


def test_edit_path_memory():
    """Lists of 30,000: some MB instead of a table of 900 million costs."""
    import tracemalloc

    r = random.Random(2)
    for kinds in (40, 30_000):
        a = [r.randrange(kinds) for _ in range(30_000)]
        b = [r.randrange(kinds) if r.random() < 0.1 else x for x in a if r.random() < 0.9]
        tracemalloc.start()
        path = align.edit_path(a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [x for x, _ in path if x is not None] == a and [y for _, y in path if y is not None] == b and peak < 60e6


def sides(r, n):
    """Tokens without overlap and with gaps, on two sides with many ends in common."""
    cuts = sorted(r.sample(range(1, 6 * n), n))
    out = []
    for _ in range(2):
        at, side = 0, []
        for c in cuts:
            if r.random() < 0.7 or c == cuts[-1]:
                side.append((at + (r.random() < 0.2 and c - at > 1), c, r.choice("NV")))
                at = c
        side[0] = (0, *side[0][1:])
        out.append(side)
    return out


@pytest.mark.parametrize("span", [1, 3, 7, 64])
def test_align_by_ranges(spark, span):
    r = random.Random(span)
    odd = [([(0, 2), (1, 4)], [(0, 4)]), ([(0, 3)], [(0, 2)]), ([(0, 3)], []), ([(0, 2), (2, 2), (2, 5)], [(0, 5)]), ([(0, 3), (0, 3)], [(0, 3)]), ([(0, 9), (2, 4), (9, 30)], [(0, 9), (9, 30)]), ([(1, 3)], [(0, 3)])]
    t = table(spark, *[sides(r, r.randint(2, 30)) for _ in range(25)], *odd)
    rows = lambda df: sorted(tuple(x) for x in df.select("sent_id", "side", "ord", "start", "end", "group").collect())
    assert rows(align.align(t)) == rows(align.align_ranged(t, span)) != []
    pairs = lambda **o: sorted(map(str, align.label_pairs(t, "pos", **o).collect()))
    assert pairs() == pairs(span=span)
    with pytest.raises(Exception, match="same total span"):
        align.align_ranged(t, span, strict=True).collect()
    with pytest.raises(ValueError, match="exclude"):
        align.align_groups(t, folded=True, span=span)


def test_ranges_share_a_sentence(spark):
    """One sentence of 60,000 tokens: no task has more than its ranges' ends, and options bring the ranges to all tasks."""
    rows = spark.range(30_000).selectExpr("0L AS sent_id", "explode(array(struct('a' AS side, int(id) AS ord, int(2 * id) AS start, int(2 * id + 2) AS end), struct('b' AS side, int(id) AS ord, int(2 * id) AS start, int(2 * id + 2) AS end))) AS x")
    t = rows.selectExpr("sent_id", "x.*", "CAST(x.ord % 3 AS STRING) AS pos", "'l' AS lemma", "true AS is_min", "false AS is_stop", "CAST(null AS STRING) AS ner_label")
    out = align.align_ranged(t, 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [x["count"] for x in out.where("group = end").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 60_000 and len(sizes) == 4 and max(sizes) < 20_000
    assert Evaluator(["pos", "lemma"], options=Options(span=500)).evaluate(t) == {"pos": {"precision": 1, "recall": 1, "fscore": 1}, "lemma": {"accuracy": 1}}


@pytest.mark.parametrize("winlen", [1, 2, 3])
def test_long_runs_of_transpositions(spark, winlen):
    """Boundaries that alternate for thousands of places, over the edges of all ranges of the tree."""
    r = random.Random(winlen)
    sentences = []
    for n in (70, 1100, 5000):
        kinds = [r.choice("ab") if r.random() < 0.1 else "ab"[k % 2] for k in range(n)]
        kinds = [k if r.random() < 0.95 else r.choice(["", "ab"]) for k in kinds]
        sentences.append(tuple(bounds("".join("1" if s in k else "0" for k in kinds)) for s in "ab"))
    got = {x["sent_id"]: x for x in boundary.boundary_counts(table(spark, *sentences), winlen).collect()}
    for i, both in enumerate(sentences):
        a, b = ({e - 1 for _, e in side[:-1]} for side in both)
        n = far = 0
        k, end = 0, both[0][-1][1] - 1
        while k < end:
            here = "a" if k in a - b else "b" if k in b - a else None
            opp = next((j for j in range(k + 1, k + winlen + 1) if here and j in ((b - a) if here == "a" else (a - b))), None)
            if opp is not None:
                n, far, k = n + 1, far + opp - k, opp + 1
            k += 1
        x = got[i]
        assert (x["n_trans"], x["n_ad"]) == (n, len(a ^ b) - 2 * n) and x["w_trans"] == pytest.approx(n - far / (winlen + 1)) and n > 15


def test_first_overlap_in_any_order(spark):
    """Truths that overlap, nest, repeat, have no length and are listed in any order, and long ones: against all pairs."""
    r = random.Random(4)
    rows = []
    for sent in range(60):
        for side in "ab":
            spans = [(s := r.randrange(40), s + r.choice([0, 0, 1, 2, 5, 30, 4000])) for _ in range(r.randrange(14))]
            rows += [(sent, side, k, r.choice("XYZ"), s, e) for k, (s, e) in enumerate(spans)]
    t = spark.createDataFrame(rows, "sent_id long, side string, ord long, e_type string, s long, e long")
    known = spark.createDataFrame([("X",), ("Y",), ("Z",)], "label string")
    want = []
    for sent in range(60):
        truths, preds = ([x[3:] for x in rows if x[0] == sent and x[1] == s] for s in "ab")
        met = set()
        for p in preds:
            if p in truths:
                want.append((sent, "same", p[0]))
                met.add(p)
                continue
            hit = next((x for x in truths if x[1:] == p[1:] or max(x[1], p[1]) < min(x[2], p[2])), None)
            if hit is None:
                want.append((sent, "spurious", None))
                continue
            met.add(hit)
            want.append((sent, "type" if hit[1:] == p[1:] else "bounds" if hit[0] == p[0] else "both", hit[0]))
        want += [(sent, "missed", x[0]) for x in truths if x not in met]
    assert sorted(map(str, map(tuple, entities.classify(t, known).collect()))) == sorted(map(str, want))


def test_sweep_forgets():
    """One prediction over a million truths, and one truth under as many predictions: what is kept does not grow with what has passed."""
    sweep, most = entities._Sweep(), 0
    sweep.prediction(0, 10**7, ("long",))
    for k in range(100_000):
        list(sweep.to(10 * k + 1))
        sweep.truth((k, "X", 10 * k + 1, 10 * k + 3))
        sweep.prediction(10 * k + 2, 10 * k + 4, (k,))
        most = max(most, len(sweep.open_), len(sweep.waiting))
    assert most < 200 and [(p, t and t[0]) for p, t in sweep.to(None)][-1] == (("long",), 0)


def test_one_array_over_many_tasks(spark, tmp_path):
    """Files cut at every place by small ranges: strings with braces, quotes and escapes, nested objects, empty arrays, JSON lines, no end of line."""
    from glossmeter.sources.json_split import json_objects

    r = random.Random(6)

    def value(depth=0):
        kind = r.randrange(6 if depth < 3 else 3)
        if kind < 2:
            return "".join(r.choice(["a", "é", "}", "{", '"', "\\", "]", "[", ",", "\n", "😀", "\\\\"]) for _ in range(r.randrange(12)))
        return r.randrange(99) if kind == 2 else [value(depth + 1) for _ in range(r.randrange(4))] if kind == 3 else {f"k{i}": value(depth + 1) for i in range(r.randrange(4))}

    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for run, size in enumerate((7, 40, 300, 100_000)):
            where, want = tmp_path / f"r{run}", []
            where.mkdir()
            for f in range(3):
                rows = [{"n": value(), "m": value()} if r.random() < 0.9 else {} for _ in range(r.choice([0, 1, 25]))]
                style = r.randrange(4)
                text = json.dumps(rows, ensure_ascii=bool(f % 2), indent=[None, 1, 2, None][style]) if style < 3 else "\n".join(json.dumps(x) for x in rows)
                (where / f"f{f}.json").write_text(text + r.choice(["", "\n", "  \n\n"]), encoding="utf-8")
                want += rows
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = json_objects(spark, str(where)).orderBy("n").collect()
            assert [x["n"] for x in got] == list(range(len(want))) and [json.loads(x["text"], strict=False) for x in got] == want
        (tmp_path / "cut.json").write_text('[{"a": {"b": 1}, "c": "')
        with pytest.raises(Exception, match="not whole JSON"):
            json_objects(spark, str(tmp_path / "cut.json")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_array_is_written_by_all_tasks(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id * 7 % 2000 AS sent_id", "concat('é ', id) AS query", "CAST(null AS STRING) AS expanded_query", "CAST(null AS array<struct<ner:string>>) AS gold", "CAST(null AS array<struct<ner:string>>) AS pred").repartition(5)
    path = tmp_path / "all.json"
    corpus.save_json_array(rows, str(path))
    kept = json.loads(path.read_text(encoding="utf-8"))
    assert [x["query"] for x in kept] == [f"é {k}" for k, _ in sorted(((k, k * 7 % 2000) for k in range(2000)), key=lambda x: x[1])]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["all.json"]
    again = corpus.load_json(spark, str(path)).select("sent_id", "query").collect()
    assert sorted(map(tuple, again)) == sorted((k * 7 % 2000, f"é {k}") for k in range(2000))


def test_accents_of_all_characters(spark):
    import sys
    import unicodedata

    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chars[k : k + 500]) for k in range(0, len(chars), 500)]
    texts = ["a" + "a".join(t) for t in texts] + ["각 한글 é ẫ Å", "", None, "plain", "̈́xཱི"]
    plain = lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("p", text.strip_accents("t"))
    bad = [(x["t"][:20], k) for x in df.collect() if x["p"] != plain(x["t"]) for k in [next((i for i, (u, v) in enumerate(zip(x["p"], plain(x["t"]))) if u != v), -1)]]
    assert not bad and "Arrow" not in df._jdf.queryExecution().toString() and "Python" not in df._jdf.queryExecution().toString()


def test_any_order_without_python(spark):
    plan = tokens.token_counts_any_order(table(spark, ([(0, 1)], [(0, 1)])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_bio_under_unlabelled_items(spark, levels):
    """Items that nest and cross under unlabelled ones, several deep, against reading them one by one."""
    r = random.Random(levels)
    sentences = []
    for _ in range(120):
        spans = [(0, 60, None)] * r.randrange(3) + [(k, 60 - k, None) for k in range(r.randrange(8))]
        spans += [(s := r.randrange(50), s + r.randint(1, 14), r.choice([None, None, "A", "B"])) for _ in range(r.randrange(16))]
        sentences.append(([(s, e, "X", "l", True, n) for s, e, n in spans], []))
    want = []
    for i, (spans, _) in enumerate(sentences):
        open_, n = None, 0
        for s, e, *_, label in sorted(spans, key=lambda x: (x[0], -x[1])):
            if open_ and e <= open_[1]:
                tag = f"I-{open_[2]}" if s != open_[0] else None
            else:
                open_ = (s, e, label) if label else None
                tag = f"B-{label}" if label else "O"
            if tag:
                want.append((i, "a", n, tag))
                n += 1
    assert sorted(map(tuple, entities.bio_from_items(table(spark, *sentences), levels).collect())) == want


def exchanges(df):
    """Keys of the exchanges of a plan, as Spark would run it."""
    import re

    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_texts_move_whole(spark, tmp_path):
    """Texts are dealt before they are cut into words, to tasks by their characters, and nothing that is made of them moves again."""
    from glossmeter.plans import fixtures as fx

    spark.createDataFrame([(i, "ab cde  fghijklmno pq rs tuv wxyz " * 9) for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("doc_id", "sent_id")
    assert fx.dealt(texts, 500).rdd.getNumPartitions() >= 40 * 9 * 34 // 500
    items = fx.items(spark, str(tmp_path), compounds=True)
    for df in (tokens.token_counts(items), align.label_pairs(items, "pos"), align.align(items), boundary.boundary_counts(items), entities.bio_from_items(items)):
        assert len(exchanges(df)) == 1


def test_first_labels_in_order(spark):
    """The same as by groups, for groups of any sizes; no row is exchanged or sorted again."""
    r = random.Random(5)

    def side(n):
        cuts = sorted({0, n, *r.sample(range(1, n), r.randrange(n - 1))})
        return [(s, e, r.choice("XYZ"), r.choice("kl")) for s, e in zip(cuts, cuts[1:])]

    aligned = align.align(table(spark, *[(side(n), side(n)) for n in (r.randint(2, 12) for _ in range(80))]))
    key = lambda df: sorted(map(tuple, df.collect()))
    fast = align.first_labels_in_order(aligned, ["pos", "lemma"])
    assert key(fast) == key(align.first_labels(aligned, ["pos", "lemma"]))
    plan = fast._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and "SortAggregate" not in plan


def test_lookup_moves_once(spark):
    """Gold and wanted rows that are dealt by sentence alike do not move again; of repeated gold items the first is found, and null finds nothing."""
    rows = [(0, "a", 1, "x", 5, 6), (0, "a", 0, "x", 5, 7), (0, "b", 0, "x", 5, 9), (0, "b", 1, "y", 5, 9), (1, "a", 0, None, 5, 9), (1, "b", 0, None, 5, 9)]
    t = spark.createDataFrame([(*x, "P", "l") for x in rows], "sent_id long, side string, ord int, item string, start int, end int, pos string, lemma string").repartition(5, "sent_id")
    found = align.find_gold_term(t, t.where("side = 'b'").select("sent_id", "item", "start", F.col("ord").alias("mine")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan
    assert sorted((r["sent_id"], r["mine"], r["gold_ord"], r["gold_end"]) for r in found.collect() if r["item"]) == [(0, 0, 0, 7), (0, 1, None, None)]
    assert [r["gold_ord"] for r in found.collect() if not r["item"]] == [None]


def test_compose_hands_on_pieces(spark, monkeypatch):
    """A batch of Spark's goes back in pieces, so what a worker holds does not grow with the batch."""
    got = []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, schema, **_: got.append(f) or self.selectExpr("*", "'[]' AS pred"))
    corpus.compose(spark.createDataFrame([(0, "a")], "sent_id long, query string"), lambda: type("S", (), {"segment": staticmethod(lambda text: text)})())
    import pandas as pd

    pieces = list(got[0](iter([pd.DataFrame({"sent_id": range(1000), "query": ["ab", None] * 500}), pd.DataFrame({"sent_id": range(3), "query": ["x" * (1 << 18)] * 3})])))
    assert [len(p) for p in pieces] == [256, 256, 256, 232, 1, 1, 1] and list(pieces[0]["pred"][:2]) == ["ab", None]


def random_sides(r, longest):
    """Two cuts of one text, with parts of speech and lemmas."""
    n = r.randint(2, longest)
    cut = lambda: sorted({0, n, *r.sample(range(1, n), r.randrange(n - 1))}) if n > 2 else [0, n]
    return tuple([(s, e, r.choice("XYZ"), r.choice("kl")) for s, e in zip(c, c[1:])] for c in (cut(), cut()))


@pytest.mark.parametrize("batch", [3, 10000])
def test_edit_steps_in_one_pass(spark, batch):
    """Groups of any sizes over the borders of batches, against edit_path; the input is read once, and no group is gathered by an aggregate or moved."""
    r = random.Random(batch)
    sentences = [random_sides(r, 14) for _ in range(80)]
    t = table(spark, *sentences)
    groups = {(g["sent_id"], g["group"]): (g["a"], g["b"]) for g in align.align_groups(t).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for label, one in (("pos", True), ("lemma", False)):
            want = []
            for (sent, _), sides in groups.items():
                x, y = ([v[label] for v in side] for side in sides)
                path = [(x[0], y[0])] if len(x) == len(y) and not one else align.edit_path(x, y)
                want += [(sent, p or "MISALIGNED", q or "MISALIGNED") for p, q in path]
            for options in ({}, {"folded": True}, {"span": 4}):
                got = align.label_pairs(t, label, skip_unaligned=False, one_to_one=one, **options)
                assert sorted(map(tuple, got.collect())) == sorted(want)
            plan = align.label_pairs(t, label, skip_unaligned=False, one_to_one=one)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "Union" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_edit_ops_hold_labels_as_numbers():
    """Lists of whole sentences in one batch: a path's steps are numbers in two arrays, not an object a step."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(2)
    a, b = (pa.array([[r.choice(["NOUN", "VERB", "ADP"]) for _ in range(400)] for _ in range(100)]) for _ in "ab")
    tracemalloc.start()
    paths = align.edit_ops.__globals__["_paths"].func(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(x["a"], x["b"]) for x in paths[7].as_py()] == align.edit_path(a[7].as_py(), b[7].as_py())
    assert most < 4_000_000


@pytest.mark.parametrize("batch", [2, 10000])
def test_only_odd_sentences_are_folded(spark, batch, monkeypatch):
    """Sentences with overlaps, tokens without length and neither, beside each other and over the borders of batches, against fold(); no group of Python's a sentence."""
    r = random.Random(batch)
    odd = lambda: [(s := r.randrange(9), s + r.randrange(5)) for _ in range(r.randrange(6))] + [(0, 3), (6, 14)]
    sentences = [(odd(), odd()) if r.random() < 0.5 else random_sides(r, 9) for _ in range(90)]
    want = []
    for i, (a, b) in enumerate(sentences):
        a, b = ([x[:2] for x in s] for s in (a, b))
        if (min(a)[0], max(e for _, e in a)) == (min(b)[0], max(e for _, e in b)):
            want += [(i, "ab"[k], m, g) for g, members in enumerate(align.fold(a, b)) for k in (0, 1) for m in members[k]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = align.align_folded(table(spark, *sentences))
        assert sorted((x["sent_id"], x["side"], x["ord"], x["group"]) for x in got.collect()) == sorted(want)
        assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_tags_stream_by(spark, batch):
    """Tags over the borders of batches are those of one batch; one window and one sort, however many levels."""
    r = random.Random(batch)
    side = lambda: [(s := r.randrange(30), s + r.randint(1, 12), "X", "l", True, r.choice([None, None, "A", "B"])) for _ in range(r.randrange(14))] + [(0, 40, "X", "l", True, None)] * r.randrange(2)
    sentences = [(side(), side()) for _ in range(60)]
    want = []
    for i, sides in enumerate(sentences):
        for name, items in zip("ab", sides):
            open_, n = None, 0
            for s, e, *_, label in sorted(items, key=lambda x: (x[0], -x[1])):
                inside = open_ and e <= open_[1]
                tag = (f"I-{open_[2]}" if s != open_[0] else None) if inside else (f"B-{label}" if label else "O")
                open_ = open_ if inside else ((s, e, label) if label else None)
                if tag:
                    want.append((i, name, n, tag))
                    n += 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = entities.bio_from_items(table(spark, *sentences))
        assert sorted(map(tuple, got.collect())) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Window [") == 1 and plan.count("Sort [") == 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_micro_scores_make_no_confusion_table(spark):
    """Micro averages and accuracies of pairs, null labels too, are those of the confusion table; no label is a key of the query's aggregates."""
    r = random.Random(31)
    pairs = spark.createDataFrame([(r.choice("tu"), r.choice(["N", "V", "A", None]), r.choice(["N", "V", None])) for _ in range(200)], "task string, a string, b string")
    columns = ["task", "precision", "recall", "fscore", "accuracy"]
    want = labels.scores(labels.confusion(pairs, ["task"]), "micro", ["task"]).select(*columns)
    for got, due in zip(sorted(map(tuple, labels.micro_scores(pairs, ["task"]).collect())), sorted(map(tuple, want.collect())), strict=True):
        assert got[0] == due[0] and got[1:] == pytest.approx(due[1:])
    assert tuple(labels.micro_scores(pairs.limit(0)).first()) == (0, 0, 0, None)
    t = table(spark, *[random_sides(r, 14) for _ in range(30)])
    lazy = Evaluator(["token", "pos", "lemma"]).table(t)
    aggregates = [x for x in lazy._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert aggregates and not any(re.search(r"\b(a|b|label)#", x.split("Aggregate [", 1)[1].split("]", 1)[0]) for x in aggregates)
    macro = Evaluator(["pos", "lemma"], options=Options(average="macro")).evaluate(t)
    assert Evaluator(["lemma"]).evaluate(t)["lemma"] == pytest.approx(macro["lemma"])


@pytest.mark.parametrize("span", [1, 7, 59, 60, 61, 200])
def test_ranged_groups_come_from_blocks(spark, span):
    """Sizes and single pairs from blocks are those of align(); tokens do not move, and their input is made once."""
    r = random.Random(span)
    cut = lambda n, k: sorted({0, n, *r.sample(range(1, n), r.randrange(k))})
    whole = [tuple([(s, e, r.choice("XYZ")) for s, e in zip(c, c[1:])] for c in (cut(n, min(n, 90)), cut(n, min(n, 90)))) for n in (r.choice([2, 30, 120, 121, 400]) for _ in range(40))]
    odd = [([(0, 70), (70, 130)], [(0, 65), (64, 130)]), ([(0, 130)], [(0, 61), (0, 130)]), ([(0, 60), (60, 61)], [(0, 61)]), ([(0, 130)], [(0, 130), (5, 62)]), ([(0, 61), (61, 61), (61, 99)], [(0, 99)]), ([(0, 50), (3, 70)], [(0, 70)]), ([(0, 99)], [(0, 20), (20, 40), (20, 99)])]
    t = table(spark, *whole, *[sides(r, 60) for _ in range(20)], *odd).repartition(3)
    key = lambda df: sorted(map(str, df.collect()))
    aligned = align.align(t)
    sizes = aligned.groupBy("sent_id", "group").agg(F.count(F.when(F.col("side") == "a", 1)).alias("n_a"), F.count(F.when(F.col("side") == "b", 1)).alias("n_b"))
    found, pairs = align.group_sizes_ranged(t, span), align.label_pairs(t, "pos", span=span)
    assert key(found) == key(sizes) != []
    assert key(pairs) == key(align.label_pairs(t, "pos")) != []
    assert key(align.align_ranged(t, span).select(*aligned.columns)) == key(aligned)
    for df in (align.group_sizes_ranged(t.repartition("sent_id"), span), align.label_pairs(t.repartition("sent_id"), "pos", span=span)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("ExistingRDD") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_boundaries_stream_by(spark, batch, monkeypatch):
    """Counts over the borders of batches, with one side ahead of the other, gaps, tokens without length, with a negative one and sides that are absent, are those of sets of
    places; tokens are sorted once, nothing else moves, and of an open sentence only one side's lead is held."""
    r = random.Random(batch)
    sentences = []
    for k in range(40):
        sides = []
        for _ in "ab":
            at, side = 0, []
            for _ in range(r.choice([0, 1, 4, 30])):
                at += r.choice([0, 0, 0, 2])
                side.append((at, at := at + r.choice([1, 1, 2, 3, 0, -1 if k % 4 == 3 else 1])))
            sides.append(side)
        sentences.append(tuple(sides))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = boundary.boundary_counts(table(spark, *sentences), 2)
        got = {x["sent_id"]: tuple(x)[1:] for x in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for i, both in enumerate(sentences):
        places, total = [set(), set()], [None, None]
        for s, side in enumerate(both):
            last = upto = 0
            for start, end in side:
                gap = max(start - last, 0)
                places[s] |= {upto + gap - 1} if gap else set()
                last, upto = end, upto + gap + end - start
                places[s].add(upto - 1)
                total[s] = upto
            places[s] = {p for p in places[s] if p < upto - 1}
        a, b = places
        n = far = upto = 0
        for p in sorted(a ^ b):
            opp = min((q for q in (b - a if p in a else a - b) if p < q <= p + 2), default=None)
            if opp is not None and (not n or p >= upto):
                n, far, upto = n + 1, far + opp - p, opp + 2
        if total == [None, None]:
            assert i not in got
            continue
        want = (total[0] is not None and total[0] == total[1], len(a & b), len(a ^ b) - 2 * n, n, n - far / 3, None if total[0] is None else total[0] - 1, len(a), len(b))
        assert got[i] == pytest.approx(want)
    assert plan.count("Window [") == 1 and plan.count("Sort [") == 1 and "Aggregate" not in plan
    held = []
    walked = boundary._walked
    monkeypatch.setattr(boundary, "_walked", lambda open_, *x: (walked(open_, *x), held.append(sum(map(len, open_.held))))[0])
    columns = [[0] * 40_000, [k % 2 for k in range(40_000)], [(k // 2 << 32) + k // 2 + 1 for k in range(40_000)]]
    rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int8(), pa.int64()))], names=list("abc"))
    out = list(boundary._counted((rows.slice(k, 1000) for k in range(0, 40_000, 1000)), 2, list("abcdefghi")))
    assert sum(x.num_rows for x in out) == 1 and out[-1].to_pylist()[0]["d"] == 19_999 and max(held) < 20


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_pairs_stream_by(spark, batch):
    """Pairs, their shares and token matches over the borders of batches are those of align() and token_counts(), compounds, null labels and sentences that do not fit
    among them; items are sorted once, for all tasks, and an open sentence's pairs are held as counts."""
    r = random.Random(batch)

    def cut(n):
        c = sorted({0, n, *r.sample(range(1, n), r.randrange(n))})
        return [(s, e, r.choice(["N", "V", None]), r.choice("xyz")) for s, e in zip(c, c[1:])]

    whole = [(cut(n), cut(n) + [(0, 2, "N", "x", False)]) for n in (r.choice([2, 5, 12]) for _ in range(25))]
    odd = [tuple([(s := r.randrange(9), s + r.randrange(5), "N", "x") for _ in range(r.randrange(4))] for _ in "ab") for _ in range(25)]
    gaps = [([(0, 3), (4, 6), (7, 9)], [(0, 3), (5, 6), (7, 8), (8, 9)]), ([], [(0, 2)]), ([(0, 2)], [(0, 2), (2, 2)]), ([(0, 1), (1, 2)], [(0, 2)]), ([(0, 3, "N", "x", False)], [])]
    sentences = [*whole, *odd, *gaps]
    r.shuffle(sentences)
    t, tasks = table(spark, *sentences).repartition(3, "sent_id"), {"p": ("pos", True), "l": ("lemma", False)}
    want = {}
    for task, (label, one) in tasks.items():
        for x in align.label_pairs(t, label, one_to_one=one).collect():
            key = (x["sent_id"], task, x["a"], x["b"])
            want[key] = want.get(key, 0) + 1
    key = lambda rows: sorted(map(str, rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        by = paired.pair_counts(t, tasks, by=True)
        got = by.groupBy("sent_id", "task", "a", "b").agg(F.sum("n"), F.sum("tp")).collect()
        assert key(got and [tuple(x) for x in got]) == key([(*k, n, n if k[2] == k[3] and k[2] else 0) for k, n in want.items()])
        plan = by._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Window [") == 1 and plan.count("Sort [") == 1 and plan.count("Exchange") == 1
        total = {tuple(x)[:3]: x["n"] for x in paired.pair_counts(t, tasks).groupBy("task", "a", "b").agg(F.sum("n").alias("n")).collect()}
        assert total == {k: sum(n for (_, *x), n in want.items() if tuple(x) == k) for k in {k[1:] for k in want}}
        shares = {x["task"]: (x["tp"], x["n"], x["m"]) for x in paired.pair_counts(t, tasks, shares=True, tokens="t").groupBy("task").agg(*[F.sum(c).alias(c) for c in ("tp", "n", "m")]).collect()}
        c = tokens.token_counts(t).agg(F.sum("correct"), F.sum("n_gold"), F.sum("n_pred")).first()
        assert shares.pop("t") == tuple(c)
        for task in tasks:
            n = sum(v for k, v in want.items() if k[1] == task)
            assert shares[task] == (sum(v for k, v in want.items() if k[1] == task and k[2] == k[3] and k[2]), n, n)
        with pytest.raises(Exception, match="same total span"):
            paired.pair_counts(t, tasks, strict=True).collect()
        lazy = Evaluator(["token", "pos", "lemma"]).table(t)
        assert lazy._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = paired.Pairs(tasks, False, False, False, False)
    at = pa.array(["N", "V"] * 500)
    for k in range(200):
        start = (pa.array(range(k * 500, k * 500 + 500)).to_numpy()).repeat(2)
        assert not list(pairs(start * 0 + (1 if not k else 0), 2 if not k else 1, start, start + 1, start * 0 + [0, 1] * 500 == 1, {"pos": at, "lemma": at}))
        assert all(len(x) <= paired.PIECES for x in pairs.held.values())
    none = start[:0]
    done = [x.to_pylist() for _, x in pairs(none, 2, none, none, none == 1, {"pos": at[:0], "lemma": at[:0]})]
    assert sum(y["n"] for x in done for y in x) == 200_000


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_folded_sizes_stream_by(spark, batch):
    """Sizes and ends of folded groups, of sentences with and without overlaps over the borders of batches, against fold(); tokens are sorted once and none comes back."""
    r = random.Random(batch)
    odd = lambda: [(s := r.randrange(9), s + r.randrange(5)) for _ in range(r.randrange(6))] + [(0, 3), (6, 14)]
    sentences = [(odd(), odd()) if r.random() < 0.5 else random_sides(r, 9) for _ in range(90)] + [([(0, 2)], []), ([(0, 2)], [(0, 1)]), ([(0, 2), (2, 2)], [(0, 1), (1, 2)])]
    want = []
    for i, sides in enumerate(sentences):
        a, b = ([x[:2] for x in s] for s in sides)
        if a and b and (min(a)[0], max(e for _, e in a)) == (min(b)[0], max(e for _, e in b)):
            want += [(i, g, max([a[k][1] for k in x] + [b[k][1] for k in y]), len(x), len(y)) for g, (x, y) in enumerate(align.fold(a, b))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = paired.folded_sizes(table(spark, *sentences))
        assert sorted(map(tuple, got.collect())) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Window [") == 1 and plan.count("Sort [") == 1 and plan.count("Exchange") == 1 and "Aggregate" not in plan
        with pytest.raises(Exception, match="same total span"):
            paired.folded_sizes(table(spark, *sentences), strict=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_entities_leave_without_tags(spark, batch):
    """Entities and labels of items over the borders of batches are those of their tags, cut to the shorter side or left out; items are tagged in one pass."""
    r = random.Random(batch)
    side = lambda: sorted([(s := r.randrange(30), s + r.randint(1, 6), "X", "l", True, r.choice([None, "A", "B", "B-I-x", ""])) for _ in range(r.randrange(12))], key=lambda x: x[:2])
    t = table(spark, *[(side(), side()) for _ in range(60)], *[(x, x) for x in (side(), side())])
    key = lambda df: sorted(map(str, df.select("sent_id", "side", F.col("ord").cast("long"), "e_type", F.col("s").cast("long"), F.col("e").cast("long")).collect()))
    want = [entities.same_length(entities.bio_from_items(t), skip) for skip in (False, True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for skip, tags in zip((False, True), want):
            found, known = entities.entities_of_items(t, skip)
            assert key(found) == key(entities.entities_from_tags(tags)) != []
            assert {x[0] for x in known.collect()} == {x[0] for x in entities.label_set(tags).collect()}
        both = entities.classify(*entities.entities_of_items(t))
        both.collect()
        assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
