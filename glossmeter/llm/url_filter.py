"""URL filters by a tree of path templates.

A host's paths are a tree of segments.  Level by level, a segment that takes a good share of its parent's urls stays
literal, any other becomes a wildcard; siblings whose labelled purity does not differ significantly are merged into one
branch, each compared with the pooled purity of the branch that it would join.  Levels go on until no segment is left that
enough urls share.  Each template at the leaves gets the share of blocked labels among its urls, smoothed by a prior; labels
are the verdicts of the rules.  Everything is SQL over one row a url with its counts; hot hosts are pre-aggregated before they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, read

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Urls and share of the parent's urls that keep a segment literal; standard errors within which siblings merge; weight and value
#: of the prior; purity from which a template is blocked.
SUPPORT, SHARE, ALIKE, PRIOR, PRIOR_BAD, BLOCKED = 5, 0.02, 1.96, 4.0, 0.2, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _double(x: float) -> str:
    """A literal that neither dialect takes for a decimal."""
    return f"CAST({x!r} AS DOUBLE)"


def _smooth(bad: str, seen: str) -> str:
    return f"(({bad} + {_double(PRIOR * PRIOR_BAD)}) / ({seen} + {_double(PRIOR)}))"


def _apart(s: str, x: str) -> str:
    """Whether branch x (q, seen, bad) does not join the group s, pooled so far: a branch without labels is no evidence, so it joins only others without."""
    q = _smooth(f"{s}.bad", f"{s}.seen")
    var = lambda p, n: f"{p} * (1 - {p}) / ({n} + {_double(PRIOR)})"
    return f"(({x}.seen = 0) <> ({s}.seen = 0) OR abs({x}.q - {q}) > {_double(ALIKE)} * sqrt({var(q, f'{s}.seen')} + {var(f'{x}.q', f'{x}.seen')}))"


#: A parent's literal branches (at most 1 / SHARE), by purity, as an array of (s, grp): a fold, as each group's pool decides.
_FOLD = {
    "STRING": "aggregate(array_sort(collect_list(named_struct('q', q, 's', s, 'seen', seen, 'bad', bad))), named_struct('seen', -1L, 'bad', 0L, 'grp', 0, 'out', CAST(array() AS ARRAY<STRUCT<s: STRING, grp: INT>>)), "
    "(g, x) -> CASE WHEN g.seen < 0 OR {apart} THEN named_struct('seen', x.seen, 'bad', x.bad, 'grp', g.grp + 1, 'out', array_append(g.out, named_struct('s', x.s, 'grp', g.grp + 1))) "
    "ELSE named_struct('seen', g.seen + x.seen, 'bad', g.bad + x.bad, 'grp', g.grp, 'out', array_append(g.out, named_struct('s', x.s, 'grp', g.grp))) END, g -> g.out)",
    "VARCHAR": "list_reduce(list({{'q': q, 's': s, 'seen': seen, 'bad': bad, 'grp': 0, 'out': CAST([] AS STRUCT(s VARCHAR, grp INTEGER)[])}} ORDER BY q, s), lambda g, x: CASE WHEN g.seen < 0 OR {apart} "
    "THEN {{'q': x.q, 's': x.s, 'seen': x.seen, 'bad': x.bad, 'grp': g.grp + 1, 'out': list_append(g.out, {{'s': x.s, 'grp': g.grp + 1}})}} "
    "ELSE {{'q': x.q, 's': x.s, 'seen': g.seen + x.seen, 'bad': g.bad + x.bad, 'grp': g.grp, 'out': list_append(g.out, {{'s': x.s, 'grp': g.grp}})}} END, "
    "{{'q': CAST(0 AS DOUBLE), 's': '', 'seen': CAST(-1 AS BIGINT), 'bad': CAST(0 AS BIGINT), 'grp': 0, 'out': CAST([] AS STRUCT(s VARCHAR, grp INTEGER)[])}}).out",
}


def _level(u: str, text: str, each: str) -> list[tuple[str, str]]:
    """Queries that name the branches of one level, in SQL that Spark and DuckDB share; u has urls with their template t and next segment s ('' if there is none).

    The last one has host, t, s, name (the branch's first segment) and members of each literal segment.
    """
    return [
        ("c", f"SELECT host, t, s, count(*) AS n, CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(bad) AS BIGINT) AS bad FROM {u} GROUP BY host, t, s"),
        ("p", "SELECT host, t, sum(n) AS n FROM c GROUP BY host, t"),
        ("l", f"SELECT c.host, c.t, c.s, c.seen, c.bad, {_smooth('c.bad', 'c.seen')} AS q FROM (SELECT * FROM c WHERE n >= {SUPPORT} AND s <> '') c JOIN p ON c.host = p.host AND c.t = p.t WHERE c.n >= {_double(SHARE)} * p.n"),
        ("g", f"SELECT host, t, {_FOLD[text].format(apart=_apart('g', 'x'))} AS f FROM l GROUP BY host, t"),
        ("h", f"SELECT host, t, {each} AS x FROM g"),
        ("b", "SELECT host, t, x.s AS s, min(x.s) OVER (PARTITION BY host, t, x.grp) AS name, count(*) OVER (PARTITION BY host, t, x.grp) AS members FROM h"),
    ]


def _grown(text: str) -> str:
    """A url's template, grown by its next segment."""
    return f"CASE WHEN u.s = '' THEN u.t WHEN b.s IS NULL THEN concat(u.t, '/*') WHEN b.members = 1 THEN concat(u.t, '/', b.name) ELSE concat(u.t, '/(', b.name, '+', CAST(b.members AS {text}), ')') END"


def _with(steps: list[tuple[str, str]]) -> str:
    return ",\n".join(f"{n} AS ({q})" for n, q in steps)


_LEAF = f"SELECT host, t, {_smooth('sum(bad)', 'sum(seen)')} AS purity FROM {{u}} GROUP BY host, t"
_RESULT = f"SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.said, CASE WHEN leaf.purity >= {_double(BLOCKED)} THEN 'block' ELSE 'allow' END) AS verdict, u.t AS template, CAST(leaf.purity AS DOUBLE) AS purity FROM {{u}} u JOIN leaf ON u.host = leaf.host AND u.t = leaf.t"


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Returns page_id, host, path, rule, verdict, template, purity for every row.

    A null url, or one without ://, has empty host and path and falls under no rule; such urls share one template.  Repeated
    rows each count and each get the verdict; other columns are not read.  With no rules nothing is labelled and all is allowed.
    Every segment of a path counts, however many there are.  A level is a job over the urls whose template enough others share; all segments that
    a template's urls have in common are taken at once, and where fewer than SUPPORT urls share a template the others are put aside, all their further
    segments wildcards.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    df = pages.select(F.col(id_col).alias("page_id"), F.translate(F.regexp_extract(url, form, 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(url, form, 2).alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, said = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    df = df.withColumn("rule", rule).withColumn("said", said).withColumn("seg", F.filter(F.split("path", "/"), lambda x: x != ""))
    df = df.withColumn("t", F.lit("")).withColumn("seen", F.col("said").isNotNull().cast("int")).withColumn("bad", F.coalesce(F.col("said") == "block", F.lit(False)).cast("int"))
    spark, finished = df.sparkSession, []
    active = cut(df.withColumn("k", F.lit(0)))
    rest = F.slice("seg", F.col("k") + 1, F.greatest(F.size("seg") - F.col("k"), F.lit(0)))
    while True:
        # templates that enough urls share, and how many segments all of their urls have in common: those of the least and the greatest rest
        nodes = active.groupBy("host", "t").agg(F.count("*").alias("n"), F.min(rest).alias("lo"), F.max(rest).alias("hi")).where((F.col("n") >= SUPPORT) & (F.size("hi") > 0))
        pairs = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False)))
        jump = F.coalesce(F.array_position(pairs, False), F.lit(0))
        nodes = cut(nodes.select("host", "t", F.when(jump > 0, jump - 1).otherwise(F.size("lo")).cast("int").alias("jump")))
        if nodes.isEmpty():
            finished.append(active)
            drop(nodes)
            break
        finished.append(cut(active.join(nodes, ["host", "t"], "left_anti")))
        ahead = F.slice("seg", F.col("k") + 1, F.col("jump"))
        u = active.join(nodes, ["host", "t"]).withColumn("t", F.concat("t", F.array_join(F.transform(ahead, lambda x: F.concat(F.lit("/"), x)), ""))).withColumn("k", F.col("k") + F.col("jump")).drop("jump")
        u = u.withColumn("s", F.coalesce(F.get("seg", F.col("k")), F.lit("")))
        grown = cut(spark.sql(f"WITH {_with(_level('{u}', 'STRING', 'explode(f)'))} SELECT u.* EXCEPT (t, s, k), CAST(u.k + 1 AS INT) AS k, {_grown('STRING')} AS t FROM {{u}} u LEFT JOIN b ON u.host = b.host AND u.t = b.t AND u.s = b.s", u=u))
        drop(active, nodes)
        active = grown
    done = finished[0]
    for part in finished[1:]:
        done = done.unionByName(part)
    stars = F.repeat(F.lit("/*"), F.greatest(F.size("seg") - F.col("k"), F.lit(0)))
    return spark.sql("WITH leaf AS (" + _LEAF.format(u="{u}") + ") " + _RESULT.format(u="{u}"), u=done.withColumn("t", F.concat("t", stars)))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def _oracle() -> str:
    """One recursive step a level; urls without a further segment come along, as they count among their parent's."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    first = [
        ("a0", f"SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{form}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{form}', 2) AS path FROM pages"),
        ("b0", f"SELECT *, {rule} AS rule, {said} AS said, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM a0"),
        ("v", "SELECT *, CASE WHEN said IS NULL THEN 0 ELSE 1 END AS seen, CASE WHEN said = 'block' THEN 1 ELSE 0 END AS bad FROM b0"),
        ("deepest", "SELECT coalesce(max(len(seg)), 0) AS k FROM v"),
    ]
    step = f"WITH u AS (SELECT *, coalesce(seg[k + 1], '') AS s FROM tree WHERE k < (SELECT k FROM deepest)),\n{_with(_level('u', 'VARCHAR', 'unnest(f)'))} SELECT u.page_id, u.host, u.path, u.rule, u.said, u.seg, u.seen, u.bad, u.k + 1, {_grown('VARCHAR')} FROM u LEFT JOIN b ON u.host = b.host AND u.t = b.t AND u.s = b.s"
    tree = f"tree(page_id, host, path, rule, said, seg, seen, bad, k, t) AS (SELECT page_id, host, path, rule, said, seg, seen, bad, CAST(0 AS BIGINT), '' FROM v UNION ALL ({step}))"
    return f"WITH RECURSIVE {_with(first)},\n{tree},\nfull_grown AS (SELECT * FROM tree WHERE k = (SELECT k FROM deepest)),\nleaf AS ({_LEAF.format(u='full_grown')}) {_RESULT.format(u='full_grown')}"


ORACLE = _oracle()
