"""Repeated strings, lexical search, fill in the middle: against brute force, SQL and odd rows."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmeter.llm import fill_middle as X
from glossmeter.llm import lexical_search as L
from glossmeter.llm import suffix_dedup as S

ODD_TEXTS = ["", None, " ", "\n\n", "é", "漢字 漢字", "😀" * 70, "a" * 900, "ab" * 500, "<S>", "x <P> y", "\x00\x00 \x85\xa0", "Wörter und WÖRTER\tund\x0bmehr "]


def in_sql(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register("t", df.toArrow())
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM t")
        c.unregister("t")
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def same_as_sql(df, sql, **tables):
    want = collections.Counter(tuple(r[c] for c in df.columns) for r in in_sql(sql, **tables))
    assert collections.Counter(map(tuple, df.collect())) == want
    return want


# -- fill in the middle ------------------------------------------------------------------------

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_checkpoints_find_every_cut():
    r = random.Random(1)
    for _ in range(1500):
        t = "".join(r.choice(["a", "bb", " ", "  ", "\n", "é", "漢", "😀", "\x85", "\xa0", "word"]) for _ in range(r.randrange(60)))
        units = UNITS.findall(t)
        index = X.Checkpoints(np.frombuffer(t.encode(), np.uint8), r.choice([1, 2, 3, 7]), r.choice([1, 2, 5, 11, 1000]))
        assert index.n == len(units) and index.chars == len(t)
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.end(k) == (len(before.encode()), len(before))


def test_checkpoints_are_sparse():
    raw = np.frombuffer(b"word " * 1_000_000, np.uint8)
    index = X.Checkpoints(raw)
    assert index.n == 1_000_001 and len(index.at) == 1 + 1_000_000 // X.EVERY
    assert [index.end(u) for u in (0, 1, 777_777, 1_000_000, 1_000_001)] == [(0, 0), (4, 4), (777_777 * 5 - 1,) * 2, (4_999_999,) * 2, (5_000_000,) * 2]


def test_fill_middle_matches_sql(docs, odd):
    r = random.Random(2)
    table = docs(*[(i, "".join(r.choice(["a", " ", "bc ", "\n", "é", "<P>", "<", "😀 "]) for _ in range(r.randrange(40))), "s") for i in range(400)], *[(1000 + i, t, "s") for i, t in enumerate(ODD_TEXTS)]).unionByName(odd)
    rows = X.fill_in_middle(table)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    got = rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(X.restore("output", "form")).alias("restored_sha256"))
    want = same_as_sql(got, X.ORACLE, documents=table)
    assert {k[2] for k in want} == set(X.FORMS)
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in table.collect())
    assert collections.Counter((r["doc_id"], r["t"]) for r in rows.withColumn("t", X.restore("output", "form")).collect()) == texts
    for x in rows.where("form <> 'plain'").collect():
        part = dict(re.findall(r"(?s)<([PSM])>(.*?)(?=<[PSM]>|\Z)", x["output"]))
        assert (len(part["P"]), len(part["M"])) == (x["prefix_chars"], x["middle_chars"])
    assert X.fill_in_middle(table.limit(0)).count() == 0


def test_rates(docs):
    table = docs(*[(i, f"text number {i} of some", "s") for i in range(2000)])
    by = {x["form"]: x["count"] for x in X.fill_in_middle(table, seed=7, rate=90, spm=30).groupBy("form").count().collect()}
    assert 1700 < by["spm"] + by["psm"] < 1900 and 0.2 < by["spm"] / (by["spm"] + by["psm"]) < 0.4
    assert {x["form"] for x in X.fill_in_middle(table, rate=0).collect()} == {"plain"}


# -- lexical search ----------------------------------------------------------------------------


def items_of(spark, *texts):
    return spark.createDataFrame([(i, t, "z") for i, t in texts], "item_id long, text string, score string")


@pytest.mark.parametrize("run_docs", [1, 2, 40, 16_384])
def test_search_matches_sql(spark, docs, odd, monkeypatch, run_docs):
    monkeypatch.setattr(L, "RUN_DOCS", run_docs)
    monkeypatch.setattr(L, "FAN", 3)
    r = random.Random(run_docs)
    words = ["the", "The", "a", "x1", "été", "ÉTÉ", "漢字", "zebra", "w-w", "and\n", "rare" + str(run_docs)]
    weights = [30, 10, 30, 3, 3, 2, 1, 1, 4, 9, 1]
    table = docs(*[(i, " ".join(r.choices(words, weights, k=r.randrange(30))), "s") for i in range(160)], *[(1000 + i, t, "s") for i, t in enumerate(ODD_TEXTS)], *[(5000 - i, "the zebra", "s") for i in range(70)]).unionByName(odd)
    items = items_of(spark, (1, "The zebra, the zebra!"), (2, "x1 été 漢字"), (3, None), (4, "..."), (5, "nothing of this kind"), (1, "the a and"), (None, "zebra"), (7, "zebra"), (7, "zebra"), (8, " ".join(words)))
    got = same_as_sql(L.lexical_search(table, items), L.ORACLE, documents=table, benchmark=items)
    assert len([k for k in got.elements() if k[0] == 7]) == 2 * L.TOP
    assert L.lexical_search(table.limit(0), items).count() == L.lexical_search(table, items.limit(0)).count() == 0


def test_search_in_blocks(spark, docs, monkeypatch):
    r = random.Random(9)
    table = docs(*[(i, " ".join(f"w{int(r.expovariate(0.1))}" for _ in range(30)), "s") for i in range(120)])
    items = items_of(spark, *[(i, " ".join(f"w{r.randrange(40)}" for _ in range(6))) for i in range(30)])
    whole = collections.Counter(map(tuple, L.lexical_search(table, items, k=5).collect()))
    monkeypatch.setattr(L, "BLOCK_TERMS", 20)
    assert collections.Counter(map(tuple, L.lexical_search(table, items, k=5).collect())) == whole


def test_tree_prunes_and_bounds():
    """Bounds are never below what they bound, and a document that stands out is found by opening one range a level."""
    r = np.random.default_rng(4)
    term, doc = np.divmod(np.sort(r.choice(20 * 4000, 30_000, replace=False)), 4000)
    value = r.integers(1, 100, len(term))
    value[(doc == 1234)] = 10_000
    tree = L.MaxTree(term, doc, value, 4000)
    for level in range(1, tree.top + 1):
        at = tree.below[level]
        assert all(tree.value[level][k] == tree.value[level - 1][at[k] : at[k + 1]].max() for k in range(0, len(at) - 1, 97))
    asked = np.arange(0, 20, 2)
    own = np.zeros(4000, np.int64)
    np.add.at(own, doc[np.isin(term, asked)], value[np.isin(term, asked)])
    for k in (1, 50):
        best = L.Best(k)
        opened = L.search(tree, asked, best, np.arange(4000), np.zeros(4000, bool))
        assert best.id.tolist() == sorted(np.flatnonzero(own).tolist(), key=lambda d: (-own[d], d))[:k]
        assert opened == tree.top if k == 1 else opened <= 125 + 4 + 1


def test_norms_beyond_64_bits():
    n = np.array([3, 10**8], np.int64)
    assert L.norms(n, 10**11, 7 * 10**13).tolist() == [50 + 50 * x * 10**11 // (7 * 10**13) for x in (3, 10**8)]


def test_occurrences_of_a_long_text():
    t = "Ab1 cé-" * 400_000 + "q" * 3_000_000
    got = L.occurrences(t)
    assert got == collections.Counter({b"ab1": 400_000, "cé".encode(): 400_000, b"q" * 3_000_000: 1}) and L.occurrences(None) == {}


# -- repeated strings --------------------------------------------------------------------------


def runs_by_hand(contexts, times, least):
    c = collections.Counter()
    for x, t in zip(contexts, times):
        for i in range(len(x) - least + 1):
            c[x[i : i + least]] += int(t)
    out = []
    for x in contexts:
        runs = []
        for i in range(len(x) - least + 1):
            if c[x[i : i + least]] > 1:
                if runs and runs[-1][1] == i - 1:
                    runs[-1] = (runs[-1][0], i)
                else:
                    runs.append((i, i))
        out.append(runs)
    return out


def test_intervals_are_exact():
    r = random.Random(3)
    for _ in range(400):
        least = r.choice([1, 2, 3, 5, 9, 17])
        abc = bytes(r.sample(range(1, 250), r.choice([1, 2, 3, 6])))
        pool = [bytes(r.choice(abc) for _ in range(r.randint(least, 40))) for _ in range(4)]
        contexts = [x for x in (b"".join(r.choice(pool)[r.randrange(5) :] if r.random() < 0.6 else bytes(r.choice(abc) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))) if len(x) >= least]
        if contexts:
            times = np.array([r.choice([1, 1, 1, 2, 3]) for _ in contexts])
            assert S.repeated(contexts, times, least) == runs_by_hand(contexts, times, least)


def test_walk_gives_common_prefixes():
    """What the walk finds to be below `least` is what comparing neighbours finds, for every `least`."""
    r = random.Random(5)
    text = np.frombuffer(b"".join(bytes(r.choice(b"abc") for _ in range(r.randint(1, 60))) + bytes([S.END]) for _ in range(30)), np.uint8)
    raw, order = text.tobytes(), S.suffixes(text, 64)
    assert all(raw[a : a + 64] <= raw[b : b + 64] for a, b in zip(order[:-1], order[1:]))
    for least in (1, 2, 4, 9, 30):
        known = S.shared_prefixes(text, order, least)
        for i in range(1, len(order)):
            a, b = raw[order[i - 1] :][:least], raw[order[i] :][:least]
            if S.END not in a and S.END not in b:
                assert known[i] == (a != b)


def test_windows_have_one_context():
    r = random.Random(6)
    for _ in range(100):
        least, abc = r.choice([40, 50, 200]), r.choice([b"a", b"ab", b"abcdefgh "])
        texts = [bytes(r.choice(abc) for _ in range(r.randint(0, 500))) for _ in range(5)]
        texts += [texts[1] + texts[0][:300] + texts[2], texts[0][:300]]
        raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        seen, of = collections.Counter(), {}
        for t, first, n, lead, h, _ in zip(*S.anchors(raw, off, least)):
            for j in range(n):
                seen[t, first + j] += 1
                w = texts[t][first + j : first + j + least]
                assert len(w) == least and of.setdefault(w, (h, lead - j)) == (h, lead - j)
        assert seen == collections.Counter((i, j) for i, x in enumerate(texts) for j in range(len(x) - least + 1))


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(n))


def removed_by_hand(texts, least):
    c = collections.Counter(x[i : i + least] for x in texts for i in range(len(x) - least + 1))
    out = []
    for x in texts:
        on = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - least + 1):
            if c[x[i : i + least]] > 1:
                on[i : i + least] = True
        edge = np.flatnonzero(np.diff(on, prepend=False)).tolist()
        out.append((list(zip(edge[::2], edge[1::2])), bytes(b for b, o in zip(x, on) if not o)))
    return out


@pytest.mark.parametrize("most, batch, piece", [(1024, 1 << 19, 1 << 20), (1, 64, 1 << 20), (2, 3000, 700)])
def test_dedup_by_hand(docs, odd, monkeypatch, most, batch, piece):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "BATCH", batch)
    monkeypatch.setattr(S, "PIECE", piece)
    r = random.Random(most)
    passage, other = prose(r, 60), prose(r, 45) + " é漢😀 " * 9
    rows = [(i, prose(r, r.randint(0, 60)) + (r.choice([passage, passage[: r.randint(190, 320)], other, ""]) + prose(r, r.randint(0, 30))) * r.randint(0, 2), "s") for i in range(60)]
    rows += [(100, "a" * 900, "s"), (101, "a" * 230, "s"), (102, "ab" * 300, "s"), (103, passage, "s"), (104, passage, "s"), (104, passage, "s"), (105, "x" + "b" * 200, "s"), (106, "b" * 199 + "y", "s")]
    rows += [(200 + i, t, "s") for i, t in enumerate(ODD_TEXTS)]
    table = docs(*rows).unionByName(odd)
    out = S.dedup_substrings(table).collect()
    texts = [(x["doc_id"], (x["text"] or "").encode()) for x in table.collect()]
    want = collections.Counter((d, len(t), tuple(spans), kept) for (d, t), (spans, kept) in zip(texts, removed_by_hand([t for _, t in texts], S.LEAST)))
    assert collections.Counter((x["doc_id"], x["n_bytes"], tuple((s["start"], s["end"]) for s in x["spans"]), bytes(x["kept"])) for x in out) == want
    assert all(x["n_removed"] == x["n_bytes"] - len(x["kept"]) for x in out) and sum(x["n_removed"] > 0 for x in out) > 20
    assert S.dedup_substrings(table.limit(0)).count() == 0


def test_dedup_matches_sql(docs, odd):
    r = random.Random(12)
    shared = [prose(r, 80) for _ in range(4)]
    table = docs(*[(i // 2, prose(r, 20) + r.choice(shared)[r.randrange(200) :] + prose(r, 20), "s") for i in range(50)]).unionByName(odd.where("doc_id <> 6 OR doc_id IS NULL"))
    out = S.dedup_substrings(table)
    same_as_sql(out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), S.ORACLE, documents=table)


def test_a_passage_in_ever_other_surroundings_is_split(docs, monkeypatch):
    """No transform holds more than a bounded number of contexts of one hash, however many documents quote the passage."""
    monkeypatch.setattr(S, "MOST", 40)
    r = random.Random(8)
    passage = prose(r, 50)[:270]
    table = docs(*[(i, prose(r, 40) + passage + prose(r, 40), "s") for i in range(300)])
    seen = []
    real = S.cut

    def watched(df):
        seen.append(real(df))
        return seen[-1]

    monkeypatch.setattr(S, "cut", watched)
    monkeypatch.setattr(S, "drop", lambda *tables: None)
    out = S.dedup_substrings(table).collect()
    assert all(x["n_removed"] >= 270 for x in out)
    splits = [t for t in seen if "shift" in t.columns]
    assert splits and all(t.groupBy("g").agg(F.countDistinct("c").alias("m"), F.max(F.col("hi") - F.col("lo")).alias("w")).where("w = 1 AND m > 1").count() == 0 for t in splits)


def test_long_text_in_pieces():
    r = random.Random(10)
    t = bytes(r.choice(b"abcdefg hijk") for _ in range(5000))
    raw = np.frombuffer(t, np.uint8)
    assert hashlib.sha256(raw.tobytes()).digest() == hashlib.sha256(t).digest()
    whole = {(int(f) + j, int(h), int(lead) - j) for _, f, n, lead, h, _ in zip(*S.anchors(raw, np.array([0, 5000]), 200)) for j in range(n)}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([t.decode()])], names=["k1", "k2", "text"])
    found, S.PIECE = S.PIECE, 300
    try:
        rows = [x for b in S._anchor_rows(200)(iter([batch])) for x in b.to_pylist()]
    finally:
        S.PIECE = found
    parts = {(x["first"] + j, x["h"] % 2**64, x["lead"] - j) for x in rows for j in range(x["n"])}
    assert parts == whole and math.ceil(4801 / 300) <= len(rows)
