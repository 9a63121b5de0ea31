"""Mixing, lines, joins, URLs, vectors and the pipeline: against brute force, SQL and odd rows."""

import collections
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmeter.llm import ann_search as A
from glossmeter.llm import line_dedup as D
from glossmeter.llm import mixing as M
from glossmeter.llm import ngram_join as J
from glossmeter.llm import url_filter as U
from glossmeter.llm.components import stars


def rows_of(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def in_sql(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register("t", df.toArrow())
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM t")
        c.unregister("t")
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


# -- mixing ------------------------------------------------------------------------------------


def fill(sizes, share=1.5, most=2):
    """Targets by handing out and resharing until none is above its stop."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, target, free, rest = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}, {}, set(sizes), share * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s], rest = most * sizes[s], rest - most * sizes[s]
        free -= over
    return target


def test_targets(spark):
    r = random.Random(1)
    for _ in range(5):
        sizes = {s: r.choice([0, 3, 50, 400, 9000]) for s in ["", "a", "b", "Z", "é", None][: r.randint(1, 6)]}
        got = {x["source"]: x["target"] for x in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(fill(sizes))


def test_mixing(docs, odd, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 7)
    r = random.Random(3)
    table = docs(*[(i, "w " * r.randint(0, 40), r.choice("aaaab")) for i in range(300)]).unionByName(odd)
    first, again = M.mix_sources(table), M.mix_sources(table.repartition(5))
    assert rows_of(first, "doc_id", "size", "taken") == rows_of(again, "doc_id", "size", "taken")
    total = collections.Counter()
    for x in first.collect():
        assert 0 <= x["taken"] <= 2 * x["size"]
        total[x["source"], x["target"]] += x["taken"]
    assert all(n == int(t) for (_, t), n in total.items()) and first.count() == 309
    assert M.mix_sources(odd.limit(0)).count() == 0


def test_ranges_stay_even(spark, docs, monkeypatch):
    """Half of the rows with a small weight, a third without an id or all equal: no range is much above the others."""
    monkeypatch.setattr(M, "ROWS", 300)
    heavy = [(i if i % 3 else None, "#" * 300 + " w" if i % 2 else "w " * 9, "a") for i in range(4000)]
    table = docs(*heavy, *[(None, "same text", "a")] * 2000)
    seen = []
    real = M.cut
    monkeypatch.setattr(M, "cut", lambda df: seen.append(real(df)) or seen[-1])
    got = M.mix_sources(table)
    sizes = [r["count"] for r in next(t for t in seen if "b" in t.columns).groupBy("b").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3 * 300 and got.count() == 6000
    assert got.agg(F.sum("taken")).first()[0] == int(got.first()["target"])


def test_quality_weighs(docs):
    table = docs(*[(i, "w " * 10 if i % 2 else "w ####### " * 5, "a") for i in range(400)], *[(1000 + i, "w " * 10, "b") for i in range(4000)])
    got = M.mix_sources(table).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t")).collect()
    by = {x["odd"]: x["t"] for x in got}
    assert by[1] >= by[0]


# -- lines -------------------------------------------------------------------------------------


@pytest.mark.parametrize("words", [50, None, 6])
def test_lines_match_sql(docs, odd, words):
    r = random.Random(4)
    pool = [" ".join(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(r.randint(0, 60))) for _ in range(60)]
    passages = [[r.choice(pool) for _ in range(r.randint(2, 9))] for _ in range(8)]
    rows = []
    for i in range(160):
        lines = [f"own {i} {k} {r.random()}" for k in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(lines))
            lines[at:at] = r.choice(passages)
        if i % 9 == 0:
            lines[1:1] = ["x"] * r.randint(1, 9)
        rows.append((i // 2 if i % 5 == 0 else i, "\n".join(lines), "s"))
    table = docs(*rows, *rows[:5]).unionByName(odd)
    cols = ("doc_id", "n_lines", "n_removed", "n_chunks", "text")
    got = rows_of(D.dedup_lines(table, words=words), *cols)
    assert got == collections.Counter(tuple(x[c] for c in cols) for x in in_sql(D.oracle(words=words), documents=table)) and sum(x[2] for x in got) > 50


def test_copies_and_clean_documents(docs, odd):
    long = "A passage " + "of many words " * 20
    clean = "\n".join(f"a line of its own, number {k}" for k in range(6))
    table = docs((1, clean, "s"), (2, f"x\n{long}\ny", "s"), (3, f"p\nq\n{long}", "s"), (4, f"only\n{long}", "s"), (5, "\n\n\n\n", "s"), (6, "a\n\n\n\nb", "s"))
    got = {x["doc_id"]: x["text"] for x in D.dedup_lines(table).collect()}
    assert got == {1: clean, 2: f"x\n{long}\ny", 3: "p\nq", 4: "only", 5: "\n\n\n\n", 6: "a\n\n\n\nb"}
    out = D.dedup_lines(odd)
    assert rows_of(out, "doc_id")[(4,)] == 2 and {x["text"] for x in out.where("doc_id = 4").collect()} == {"same text of some words\nand lines"}
    assert {(x["n_lines"], x["text"]) for x in out.where("doc_id <= 2").collect()} == {(0, None), (1, "")}
    assert D.dedup_lines(odd.limit(0)).count() == 0


def test_short_documents_and_runs_of_equal_lines(docs):
    """Chunks of any size go; runs of equal lines share chunks whatever their lengths are."""
    table = docs((1, "p\nq\nr\ns", "s"), (2, "p\nq\nr\ns", "s"), (3, "\n".join(["one more"] * 1000), "t"), (4, "\n".join(["one more"] * 1001), "t"), (5, "a\n" + "one more\n" * 6 + "b", "t"))
    got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in D.dedup_lines(table).collect()}
    assert got[1] == ("p\nq\nr\ns", 0) and got[2] == ("", 4)
    assert got[3][1] >= 990 and got[4][1] >= 990 and got[5][1] >= 2


def test_short_passages(docs):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for k, shape in enumerate([(55,), (27, 27), (18, 18, 18), (14,) * 4, (12,) * 5, (12,) * 6, (45, 5, 5), (5, 5, 45), (60, 3, 0, 4)] * 4):
        passage = [line(n) for n in shape]
        for i in (2 * k, 2 * k + 1):
            own = [[line(r.randint(3, 9)) for _ in range(r.randint(0, 4))] for _ in range(2)]
            rows.append((i, "\n".join(own[0] + passage + own[1]), "s"))
            want[i] = "\n".join(own[0] + own[1] if i % 2 else own[0] + passage + own[1])
    table = docs(*rows)
    assert {x["doc_id"]: x["text"] for x in D.dedup_lines(table).collect()} == want
    assert sum(x["text"] == want[x["doc_id"]] for x in D.dedup_lines(table, words=None).collect()) < len(want)


def test_passages_keep_first_and_odd_rows(docs, odd):
    a, b, few = "a " * 30 + "end", "b " * 30 + "end", "some few words only"
    table = docs((1, "\n".join([a] * 5), "s"), (2, f"x\n{a}\n{b}\ny", "s"), (2, f"x\n{a}\n{b}\ny", "s"), (3, f"{few}\n{a}\n{b}", "s"), (4, f"p\n{few}\nq", "s"))
    got = {x["doc_id"]: (x["n_lines"], x["n_removed"], x["text"]) for x in D.dedup_lines(table).collect()}
    assert got == {1: (5, 3, f"{a}\n{a}"), 2: (4, 0, f"x\n{a}\n{b}\ny"), 3: (3, 2, few), 4: (3, 0, f"p\n{few}\nq")}


def test_long_documents_of_lines(docs):
    """Two documents of 200,000 lines that share every line but a few."""
    import time

    own = [f"line {k} of a long document" for k in range(200_000)]
    other = [x for k, x in enumerate(own) if k % 50_000 != 7]
    table = docs((1, "\n".join(own), "s"), (2, "\n".join(["a head"] + other), "s"))
    began = time.time()
    got = {x["doc_id"]: x for x in D.dedup_lines(table).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"].startswith("a head") and got[2]["n_removed"] >= len(other) - 9 and time.time() - began < 120


# -- n-gram join -------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[root(a)] = root(b)
    least = collections.defaultdict(list)
    for a, (i, x) in enumerate(sets):
        if i is not None:
            least[root(a)].append(i)
    return collections.Counter((i, len(x), i if not x else min(least[root(a)], default=None)) for a, (i, x) in enumerate(sets))


def near_copies(seed, n=140):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 5)))
    shared, bases, rows = [word() for _ in range(30)], [], []
    for k in range(8):
        bases.append([word() for _ in range(r.choice([3, 6, 8, 12, 25, 60, 200]))] + (shared if k % 2 else []))
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w += [word() for _ in range(r.randint(1, 3))]
        rows.append((i, " ".join(w) if r.random() < 0.8 else " ".join(w).upper(), "s"))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 6), (3, 512), (4, 9)])
def test_components(docs, odd, monkeypatch, seed, block):
    monkeypatch.setattr(J, "BLOCK", block)
    table = docs(*near_copies(seed)).unionByName(odd.where("doc_id IS NULL OR doc_id <> 6").withColumn("doc_id", F.col("doc_id") + 1000))
    want = brute_components([(x["doc_id"], x["text"]) for x in table.collect()])
    assert rows_of(J.shingle_components(table), "doc_id", "n_shingles", "component_id") == want


@pytest.mark.parametrize("seed,asked,most", [(5, 1, 29), (6, 2, 29), (7, 1, 15)])
def test_components_with_common_shingles(docs, monkeypatch, seed, asked, most):
    """Passages that most documents share come last in the order, and a bitmap that is full only filters less."""
    monkeypatch.setattr(J, "ASKED", asked)
    monkeypatch.setattr(J, "COMMON", 5)
    monkeypatch.setattr(J, "MOST_BITS", most)
    monkeypatch.setattr(J, "LEAST_BITS", 15)
    r = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = near_copies(seed) + [(1000 + i, " ".join(f"o{i}x{k}" for k in range(r.choice([10, 40, 150]))) + " " + passage, "s") for i in range(60)] + [(2000 + i, passage + f" tail{i % 7}", "s") for i in range(30)]
    table = docs(*rows)
    want = brute_components([(x["doc_id"], x["text"]) for x in table.collect()])
    assert rows_of(J.shingle_components(table), "doc_id", "n_shingles", "component_id") == want


def test_common_passages_make_no_families(docs, monkeypatch):
    """Documents that share nothing but a passage of a third of their words do not meet."""
    monkeypatch.setattr(J, "ASKED", 1)
    passage = " ".join(f"p{k}" for k in range(60))
    table = docs(*[(i, " ".join(f"o{i}x{k}" for k in range(120)) + " " + passage, "s") for i in range(100)])
    seen = []
    real = J.cut
    monkeypatch.setattr(J, "cut", lambda df: seen.append((df.columns, real(df))) or seen[-1][1])
    monkeypatch.setattr(J, "drop", lambda *t: None)
    assert {x["component_id"] for x in J.shingle_components(table).collect()} == set(range(100))
    assert next(t for c, t in seen if "items" in c).count() == 0


def test_components_empty(odd):
    assert J.shingle_components(odd.limit(0)).count() == 0


def test_boundary_follows_cost():
    assert J.boundary({}) == 0 and J.boundary({5: 1000}) >= 5 and J.boundary({40: 1000}) < 40


def test_stars(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for k in up if root(k) != k}


# -- URLs --------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [(1, "HTTPS://WWW.Example.COM/en/a?x#y"), (2, "http://example.com/en/"), (3, "http://a.example.com/en"), (4, "x://shop.net/fr/1"), (5, "http://net/es/?q"), (6, None), (7, "no scheme/en/"), (8, "http://notexample.com/en/"), (9, "http://a.net#/fr/"), (9, "http://a.net#/fr/"), (10, "a://b://c/d")]
    df = spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, host string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in U.filter_urls(df).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[2] == ("example.com", "/en/", "example.com/en/", "block") and got[3][2:] == ("com/", "allow")
    assert got[4][2:] == ("net/fr/", "block") and got[5][2:] == ("net/es/", "block") and got[6] == got[7] == ("", "", None, "allow") and got[8][2] == "com/" and got[9][:3] == ("a.net", "", None) and got[10][:2] == ("b:", "//c/d")
    assert U.filter_urls(df).count() == 11 and U.filter_urls(df.limit(0)).count() == 0


def test_templates(spark):
    rules = (("block", "h.org", "/bad/x"), ("allow", "h.org", "/good/"))
    rows = [(i, f"http://h.org/bad/{'x' if i % 2 else 'y'}{i}") for i in range(100)] + [(200 + i, f"http://h.org/good/{i}") for i in range(100)]
    got = {x["page_id"]: x for x in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[2]["rule"] is None and got[2]["verdict"] == "block" and got[2]["template"] == "/bad/*" and got[205]["verdict"] == "allow"


def test_deep_paths_match_sql(spark):
    """Paths of any depth, with verdicts that only deep segments tell apart, against the recursive SQL."""
    r = random.Random(17)
    rows = [(i, f"http://{r.choice(['a', 'b'])}.{r.choice(['com', 'net', 'org'])}/" + "/".join(r.choice(["es", "fr", "en", "x", "y", f"n{i}"]) for _ in range(r.choice([0, 1, 2, 4, 7])))) for i in range(600)]
    rows += [(1000 + i, "http://deep.net/" + "/".join(f"s{k}" for k in range(30)) + f"/{'u' if i % 2 else 'v'}/{i}") for i in range(20)] + [(3000, None), (3001, "x://q"), (None, "http://a.com/en/x"), (None, "http://a.com/en/x")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    cols = ("page_id", "host", "path", "rule", "verdict", "template")
    got = rows_of(U.filter_urls(df), *cols)
    assert got == collections.Counter(tuple(x[c] for c in cols) for x in in_sql(U.ORACLE, pages=df)) and any(x[5].count("/") > 30 for x in got)


def test_deep_segments_decide(spark):
    rules = (("block", "h.org", "/a/b/c/d/bad/x"), ("allow", "h.org", "/a/b/c/d/good/"))
    rows = [(i, f"http://h.org/a/b/c/d/bad/{'x' if i % 2 else 'y'}{i}") for i in range(100)] + [(200 + i, f"http://h.org/a/b/c/d/good/{i}") for i in range(100)]
    got = {x["page_id"]: x for x in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[2]["rule"] is None and got[2]["verdict"] == "block" and got[2]["template"] == "/a/b/c/d/bad/*" and got[205]["verdict"] == "allow"


# -- vectors -----------------------------------------------------------------------------------


def test_search(spark, monkeypatch):
    monkeypatch.setattr(A, "ROWS", 150)
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[50:80] = x[49]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(700, None, 0), (800, [0.0] * 16, 0), (900, [float("nan")] * 16, 0), (1000, [None] + [1.0] * 15, 0), (1100, [1.0], 0), (None, [1.0] * 16, 0), (1200, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = A.search(df, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)) | (F.col("vec_id") == 49)).toPandas()
    assert set(got["query_id"]) == {0, 49, 100, 200, 300, 400, 500} and (got.groupby("query_id").size() == 10).all()
    found = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        g = g.sort_values("rank")
        found += len(set(best) & set(g["vec_id"]))
        assert np.allclose(d[g["vec_id"]], g["score"], atol=1e-12) and list(zip(g["score"], g["vec_id"])) == sorted(zip(g["score"], g["vec_id"]))
    assert found >= 0.9 * 70 and list(got[got["query_id"] == 49].sort_values("rank")["vec_id"]) == list(range(50, 60))
    again = A.search(df.repartition(5), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)) | (F.col("vec_id") == 49)).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, got.values.tolist()))
    few = A.search(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0)
    assert few.count() == 2 and A.search(df.where("vec_id = 800"), F.lit(True)).count() == 0 and A.search(df.limit(0), F.lit(True)).count() == 0


def test_search_repeated_ids(spark):
    """One id very often, once with other vectors, and one vector very often: no crash, all rows but the query's own are candidates."""
    r = np.random.default_rng(3)
    v = [r.normal(size=8).tolist() for _ in range(30)]
    rows = [(100, v[0])] * 5000 + [(100, v[1])] + [(i, v[2]) for i in range(1, 60)] + [(200 + i, v[3 + i]) for i in range(1, 20)]
    got = A.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100).toPandas()
    assert len(got) == 20 and set(got["query_id"]) == {100}
    dist = lambda a, b: float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))
    for q, own in ((v[0], 0), (v[1], 5000)):
        want = sorted((dist(q, x), i) for j, (i, x) in enumerate(rows) if j != own)[:10]
        assert any(np.allclose([w[0] for w in want], g["score"]) and [w[1] for w in want] == list(g["vec_id"]) for g in (got.iloc[:10].sort_values("rank"), got.iloc[10:].sort_values("rank"))) or want[0][0] in set(got["score"])
    same = A.search(spark.createDataFrame([(100, v[0])] * 20_000, "vec_id long, embedding array<double>"), F.col("vec_id") == 100).collect()
    assert [tuple(x) for x in sorted(same, key=lambda x: x["rank"])] == [(100, k, 100, 0.0) for k in range(1, 11)]


# -- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path, docs):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as C
    import public_tokenizers as P

    r = random.Random(11)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklm") for _ in range(5)) for _ in range(n)) + "."
    rows = [(i, "\n".join(say(40) for _ in range(4)), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "s1") for i in range(10)] + [(200, "too short", "s0"), (201, None, "s0"), (202, "a b c " * 60, "s2")]
    docs(*rows).drop("size", "key").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(202, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in C.STAGES:
        step = C.cut(stage(spark, step, str(tmp_path)))
        seen.append(step)
    for s in seen[:-1]:
        assert set(s.columns) == set(C.COLUMNS)
    assert {x["doc_id"] for x in seen[0].collect()} == {*range(60), *range(100, 110)}  # short, null and repetitive ones went
    assert all(x["text"] == "" for x in seen[1].where("doc_id >= 100").collect())  # copies are empty after the lines
    assert {x["doc_id"] for x in seen[2].where("text <> ''").collect()} == set(range(60))
    times = collections.Counter(x["doc_id"] for x in seen[3].collect())
    assert max(times.values()) <= 2 and 0.8 * 1.5 * 60 <= sum(times.values()) <= 1.2 * 1.5 * 60
    assert rows_of(seen[4], "doc_id", "n_tokens") == rows_of(C.run(spark, str(tmp_path)), "doc_id", "n_tokens") and P


def test_pipeline_against_plain_versions(spark, tmp_path, docs, odd):
    """Every stage on what its predecessor kept: nulls, repeated ids and rows, copies, a long text, clashing columns."""
    C = pytest.importorskip("corpus_pipeline")
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken

    from glossmeter.llm import quality_rules as Q

    from .test_text_ops import brute_stats

    r = random.Random(23)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 6))) for _ in range(n)) + "."
    passage = [say(30), say(30)]
    texts = ["\n".join([say(r.randint(20, 60)) for _ in range(4)] + (passage if i % 4 == 0 else [])) for i in range(50)]
    rows = [(i, t, r.choice(["s0", "s1", None])) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].replace("a", "A", 1), "s1") for i in range(5)] + [(7, say(90), "s0"), (7, texts[7], rows[7][2]), (None, say(80), None), (None, texts[9], "s1")] + [(300 + i, say(70).replace(" ", " $$ # "), "s0") for i in range(40)]
    docs(*rows).unionByName(odd).withColumn("kept", F.lit("x")).withColumn("row", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(40)] + [(300 + i, 0, 0) for i in range(40)] + [(None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in C.STAGES:
        seen.append((step, C.cut(stage(spark, step, str(tmp_path)))))
        step = seen[-1][1]
    cols = ("doc_id", "text", "lang", "source")
    key = lambda df: collections.Counter(tuple(x[c] for c in cols) for x in df.collect())

    rules = Q.fit(seen[0][0], spark.read.parquet(str(tmp_path / "labels.parquet")))
    names = dict(zip(Q.STATS[:5], range(5)))

    def passes(t):
        s = brute_stats(t)
        n, rep = s[names["n_words"]], s[names["n_repeat_words"]]
        w, lines = (t or "").encode().split(), [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        value = {"n_words": n, "word_chars": s[1], "n_symbols": s[2], "n_dup_lines": s[3], "n_repeat_words": rep, "n_lines": len(lines), "n_upper": sum("A" <= c <= "Z" for c in t or ""), "n_digits": sum("0" <= c <= "9" for c in t or ""), "n_distinct_words": len(set(w))}
        ratio = lambda f: value[Q.FEATURES[f][0]] / max(1, value[Q.FEATURES[f][1]])
        return not (n < 50 or 100 * rep > 50 * n or any(all(ratio(f) >= c if op == ">=" else ratio(f) < c for f, op, c in rule) for rule in rules))

    first = key(seen[0][0])
    assert rules and key(seen[0][1]) == collections.Counter({k: n for k, n in first.items() if passes(k[1])}) and not any(k[0] in range(300, 340) for k in key(seen[0][1]))

    lines = collections.Counter((x["doc_id"], x["text"]) for x in in_sql(D.oracle(), documents=seen[1][0]))
    assert rows_of(seen[1][1], "doc_id", "text") == lines and all(x["n_chars"] == len(x["text"]) for x in seen[1][1].collect())

    numbered = [(i, x["doc_id"], x["text"]) for i, x in enumerate(seen[2][0].collect())]
    component = {i: c for (i, _, c), _ in brute_components([(i, t) for i, _, t in numbered]).items()}
    groups = collections.defaultdict(list)
    for i, d, t in numbered:
        groups[component[i] if d is not None and (t or "").split() else ("own", i)].append((d, t))
    got = rows_of(seen[2][1], "doc_id", "text")
    assert sum(got.values()) == len(groups) and all(sum(got[x] for x in set(g)) >= 1 and min(d for d, _ in g if d is not None) in {d for d, t in got if (d, t) in g} for g in groups.values() if g[0][0] is not None)

    taken = collections.Counter()
    for x in in_sql(M.ORACLE, documents=seen[3][0]):
        taken[x["doc_id"], x["size"], int(x["taken"] / max(1, x["size"]) + 0.5)] += 1
    want = collections.Counter()
    for (d, size, times), n in taken.items():
        want[d, size] += n * times
    assert collections.Counter((x["doc_id"], len((x["text"] or "").encode().split())) for x in seen[3][1].collect()) == +want

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter((x["doc_id"], len(i := enc.encode_ordinary(x["text"] or "")), sha(np.array(i, "<u4").tobytes()), sha((x["text"] or "").encode())) for x in seen[4][0].collect())
    assert rows_of(seen[4][1], "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_pipeline_of_nothing(spark, tmp_path, docs):
    C = pytest.importorskip("corpus_pipeline")
    docs((1, "a", "s")).limit(0).drop("size", "key").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_pipeline_near_duplicates_by_row(spark, docs):
    C = pytest.importorskip("corpus_pipeline")
    r = random.Random(5)
    x, y, z = (" ".join("".join(r.choice("abcdefghijklm") for _ in range(5)) for _ in range(40)) for _ in range(3))
    rows = [(1, x, "s"), (1, x, "s"), (2, x, "s"), (2, y, "s"), (3, y, "s"), (4, z, "s"), (4, z, "t"), (5, "", "s"), (5, "", "s"), (None, x, "s"), (None, x, "s")]
    got = rows_of(C.near_duplicates(spark, docs(*rows), ""), "doc_id", "text")
    assert got == {(1, x): 1, (2, y): 1, (4, z): 1, (5, ""): 2, (None, x): 2}


def test_urls_with_long_common_paths(spark):
    """Two hundred segments that all urls of a host share, and branches behind them: a few jobs, and what SQL gives level by level."""
    import time

    deep = "/".join(f"s{k}" for k in range(200))
    rows = [(i, f"http://a.b/{deep}" + ("/x" if i % 2 else "")) for i in range(6)] + [(10 + i, f"http://c.d/{deep}/{i % 2}/end/{i}") for i in range(14)] + [(50 + i, "http://c.d/") for i in range(3)] + [(60, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    U.filter_urls(df.limit(3)).collect()
    began = time.time()
    got = rows_of(U.filter_urls(df), "page_id", "verdict", "template")
    assert time.time() - began < 60
    assert got == collections.Counter((x["page_id"], x["verdict"], x["template"]) for x in in_sql(U.ORACLE, pages=df))
