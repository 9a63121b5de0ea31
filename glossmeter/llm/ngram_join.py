"""Jaccard join of documents on word shingles, size-aware.

Equal sets are one node.  Sets are ordered by rarity, then hash: shingles that many documents share come last, so that common
passages stay out of prefixes; any order that is the same for all sets is right, and this one only saves work.  Two sets that
link share at least k shingles of their first n - ceil(0.8 n) + k.  Small sets enumerate the subsets of two shingles of that prefix, large ones are entered under each of
its shingles in inverted lists; the boundary between them is chosen by the cost of both.  A set survives only if enough of
its prefix occurs in another set; a bitmap that grows with the number of such shingles says so.  All sets that meet in a list belong to the family of the
list's smallest node, so any two that link are in one family.  A family is cut into blocks; in a block inverted lists are
scanned to count overlaps exactly: first from the family's head, then from every set that is not yet in the head's
component, also against the family's other blocks.  Links already implied by components are not looked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, blocks, cut, drop, mix, read
from .components import stars

#: Words of a shingle; link from NUM / DEN; share of a set that a prefix is longer by; sets of a block; largest set for which
#: subsets may be enumerated; cost of scanning a list against emitting a row.
WORDS, NUM, DEN, EXTRA, BLOCK, MOST_SMALL, SCAN = 5, 80, 100, 0.1, 512, 48, 3.0
#: Bits of a bitmap for each key, how many of them a key sets, and the bitmap's logarithm at least and at most (128 MB, for some
#: 90 million keys); beyond that it only filters less.
PER_KEY, SETS_BITS, LEAST_BITS, MOST_BITS = 12, 4, 20, 30
#: One of so many documents is asked which shingles are common, and in so many of those a common one is. Only the order of sets
#: depends on it, not what is found.
ASKED, COMMON = 32, 4


def least_overlap(n):
    """The least overlap of a set of n with any set that it links with: ceil(NUM n / DEN)."""
    return -(-NUM * n // DEN)


def more(n):
    """Shingles that a large set shares at least within prefixes, as it counts them itself."""
    return np.maximum(1, np.floor(EXTRA * n)).astype(np.int64)


def prefix(n):
    return np.minimum(n, n - least_overlap(n) + more(n))


def needed(n):
    """The same for its smallest possible partner: so many of its prefix must occur elsewhere."""
    return more(least_overlap(n))


def small_prefix(n: int) -> int:
    return min(n, n - least_overlap(n) + 2)


def boundary(sizes: dict[int, int]) -> int:
    """The size up to which enumerating subsets of two costs least in all; sets over 0.8 of it are in lists too."""

    def cost(b: int) -> float:
        subsets = sum(c * math.comb(small_prefix(n), 2) for n, c in sizes.items() if n <= b)
        return subsets + sum(c * int(prefix(np.int64(n))) * (1 + SCAN) for n, c in sizes.items() if DEN * n > NUM * b)

    return min(range(0, MOST_SMALL + 1), key=lambda b: (cost(b), b))


# -- sets of many texts ------------------------------------------------------------------------


class Sets:
    """The shingle sets of texts: hash (within a text common ones last, else ascending), start (offset of each text's first), n, node."""

    def __init__(self, texts: pa.Array, common: Bitmap | None = None):
        h, row = Words(texts).shingles(WORDS)
        order = np.lexsort((h, row) if common is None else (h, common.has(h), row))
        h, row = h[order], row[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.hash, self.row = h[keep], row[keep]
        self.n = np.bincount(self.row, minlength=len(texts)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        with np.errstate(over="ignore"):
            total = lambda v: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])[self.start])
            size = self.n.astype(np.uint64)
            self.node = mix(total(mix(self.hash + np.uint64(0x51ED27))) + size).view(np.int64)
        self.place = np.arange(len(self.hash)) - self.start[self.row]

    def keys(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, text) of every key: prefix shingles of large sets, subsets of two of small ones."""
        n = self.n[self.row]
        listed = (self.place < prefix(n)) & (DEN * n > NUM * bound)
        key, row = [self.hash[listed]], [self.row[listed]]
        for i in np.flatnonzero((self.n > 1) & (self.n <= bound)):
            a = self.hash[self.start[i] : self.start[i] + small_prefix(int(self.n[i]))]
            x, y = np.triu_indices(len(a), 1)
            key.append(pair_key(a[x], a[y]))
            row.append(np.full(len(x), i))
        return np.concatenate(key), np.concatenate(row)


def pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(x + np.uint64(0x2545F4914F6CDD1D)) + y)


class Bitmap:
    """A Bloom filter: a key sets a few bits, taken from the key turned by 16 bits each time; a key that is not in it rarely seems to be."""

    def __init__(self, raw: bytes):
        self.map = np.frombuffer(raw, np.uint8)
        self.shift = np.uint64(64 - (len(raw).bit_length() + 2))

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for i in range(SETS_BITS):
            turned = key if not i else (key << np.uint64(16 * i)) | (key >> np.uint64(64 - 16 * i))
            bit = (turned >> self.shift).astype(np.int64)
            out &= (self.map[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return out

    @staticmethod
    def of(keys: DataFrame):
        """Broadcast bytes of the bitmap of a table of keys."""
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(PER_KEY * max(1, keys.count())))))
        turned = [F.col("key")] + [F.shiftleft("key", 16 * i).bitwiseOR(F.shiftrightunsigned("key", 64 - 16 * i)) for i in range(1, SETS_BITS)]
        rows = keys.select(F.explode(F.array(*[F.shiftrightunsigned(t, 64 - bits) + 1 for t in turned])).alias("v"))
        rows = rows.groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m")).collect()
        out = np.zeros((1 << bits) // 8, np.uint8)
        for r in rows:
            m = np.frombuffer(r["m"], np.uint8)
            out[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(m)] = m
        return keys.sparkSession.sparkContext.broadcast(out.tobytes())


def _map(docs: DataFrame, schema: str, rows, id_col: str, text_col: str, common=None) -> DataFrame:
    """rows(ids, Sets) -> arrow arrays in the order of the schema, for each block of texts."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None if common is None else Bitmap(common.value)
        for batch in batches:
            for a, part in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(rows(batch.column(0).slice(a, len(part)), Sets(part, last)), names=names)

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


# -- a block -----------------------------------------------------------------------------------


def links_in_block(nodes: np.ndarray, sets: list[np.ndarray], head: int, ask: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(edges, members outside the head's component) of one block, by scans of its inverted lists.

    head: which member is scanned first. ask: only these members are scanned (against all), with no head.
    Edges are those that unite two components, so there are fewer of them than members.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    member = np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    value, holder = flat[order], member[order]
    new = np.flatnonzero(np.diff(value, prepend=value[0]) != 0) if len(value) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], new])
    length = np.diff(np.concatenate([begin, [len(value)]]))
    number = np.empty(len(flat), np.int64)  # the list that each shingle of each member is in
    number[order] = np.repeat(np.arange(len(begin)), length)
    at = np.concatenate([[0], np.cumsum(n)])
    up = np.arange(m)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    edges: list[tuple[int, int]] = []

    def scan(i: int) -> None:
        own = number[at[i] : at[i + 1]]
        k = length[own]
        where = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        overlap = np.bincount(holder[where], minlength=m)
        for j in np.flatnonzero(DEN * overlap >= NUM * (n[i] + n - overlap)):
            a, b = root(i), root(int(j))
            if a != b:
                up[max(a, b)] = min(a, b)
                edges.append((int(nodes[i]), int(nodes[j])))

    if ask is None:
        scan(head)
        for i in range(m):
            if root(i) != root(head):
                scan(i)
        return edges, np.array([root(i) != root(head) for i in range(m)], bool)
    for i in ask:
        scan(int(i))
    return edges, np.zeros(0, bool)


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles (distinct shingles), node (of the equal sets), component_id (the smallest id that links reach).

    Documents without words have 0 shingles and are their own component.  A null id is nobody's component: a row without id
    passes links on and gets its component's smallest id, or null.  Rows that repeat an id count as documents of their own;
    equal sets are one node however many copies there are.  Texts of any length are whole.  Other columns are not read.
    Sets are of 64-bit hashes of shingles, and nodes are 64-bit hashes of sets.
    """
    signed = lambda a: pa.array(a.view(np.int64))
    every = cut(_map(docs, "id long, n long, node long", lambda ids, s: [ids, pa.array(s.n), pa.array(s.node)], id_col, text_col))
    bound = boundary({r["n"]: r["c"] for r in every.where(F.col("n").between(1, 2 * MOST_SMALL)).groupBy("n").agg(F.count("*").alias("c")).collect()})

    asked = docs.where(F.pmod(F.xxhash64(docs[id_col], docs[text_col], F.lit(5)), F.lit(ASKED)) == 0)
    often = cut(_map(asked, "key long", lambda ids, s: [signed(s.hash)], id_col, text_col).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON).select("key"))
    common = Bitmap.of(often)

    def keys(ids, s: Sets):
        key, row = s.keys(bound)
        return [signed(key), pa.array(s.node[row])]

    shared = cut(_map(docs, "key long, node long", keys, id_col, text_col, common).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"))
    seen = Bitmap.of(shared)
    drop(often, shared)

    def survivors(ids, s: Sets):
        key, row = s.keys(bound)
        hits = Bitmap(seen.value).has(key)
        key, row = key[hits], row[hits]
        order = np.argsort(row, kind="stable")
        key, at = key[order].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(s.n)))])
        rows = np.flatnonzero((s.n > 1) & (np.diff(at) >= np.where(s.n <= bound, 1, needed(s.n))))
        arrays = lambda v, edges: pa.array([v[edges[i] : edges[i + 1]] for i in rows], pa.list_(pa.int64()))
        return [pa.array(s.node[rows]), arrays(s.hash.view(np.int64), s.start), arrays(key, at)]

    found = _map(docs, "node long, items array<long>, keys array<long>", survivors, id_col, text_col, common)
    sets = all_sets = cut(found.groupBy("node").agg(F.first(F.struct("items", "keys")).alias("x")).select("node", F.size("x.items").alias("n"), "x.items", "x.keys"))

    # families: every list's members go by the smallest of them
    n = F.col("n")
    entries = sets.select(F.explode("keys").alias("key"), "node")
    heads = cut(entries.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("hi")).where("head <> hi").select("key", "head"))
    members = cut(entries.join(heads, "key").groupBy("head", "node").agg(F.count("*").alias("c"))).join(sets.select("node", "n"), "node")
    # two sets that link share at least `due` keys, however small the other is; each may leave its weakest families, as long
    # as both together leave fewer keys than that
    due = F.when(n <= bound, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.ceil(n * NUM / DEN) * EXTRA).cast("int")))
    by_node = W.partitionBy("node")
    weakest = by_node.orderBy("c", "head").rowsBetween(W.unboundedPreceding, W.currentRow)
    members = members.withColumn("all", F.sum("c").over(by_node)).withColumn("left", F.sum("c").over(weakest))
    members = all_members = cut(members.where((F.col("all") >= due) & (F.col("left") > F.floor((due - 1) / 2))).select("head", "node"))
    sizes = members.groupBy("head").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1").withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("long"))
    sizes = cut(sizes)
    members = members.join(sizes, "head").withColumn("b", F.pmod(F.xxhash64("node"), "nb"))
    sets = sets.drop("keys", "n")

    # families of two are one comparison
    pair = sizes.where("size = 2").join(members.select("head", "node"), "head").groupBy("head").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b").distinct()
    two = pair.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    pairs = two.withColumn("o", both).where(DEN * F.col("o") >= NUM * (F.size("x") + F.size("y") - F.col("o"))).select("a", "b")

    larger = members.where("size > 2")
    heads_too = sizes.where("nb > 1").select("head", "first", "nb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b")).where(F.col("b") != F.pmod(F.xxhash64("first"), "nb"))
    of_block = larger.select("head", "first", "b", "nb", "node").unionByName(heads_too.select("head", "first", "b", "nb", F.col("first").alias("node")))

    def one_block(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("node", kind="stable")
        nodes, head = p["node"].to_numpy(np.int64), int(p["first"].iloc[0])
        edges, out = links_in_block(nodes, [np.asarray(x, np.int64) for x in p["items"]], int(np.flatnonzero(nodes == head)[0]))
        left = nodes[out] if int(p["nb"].iloc[0]) > 1 else nodes[:0]
        return pd.DataFrame({"head": int(p["head"].iloc[0]), "a": [e[0] for e in edges] + left.tolist(), "b": pd.array([e[1] for e in edges] + [None] * len(left), "Int64")}).astype({"a": "int64"})

    found = cut(of_block.join(sets, "node").groupBy("head", "b").applyInPandas(one_block, "head long, a long, b long"))
    # what is outside its head's component meets the other blocks of the family
    pending = found.where("b IS NULL").select("head", F.col("a").alias("node"))
    chunks = pending.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("np"))
    asks = pending.join(chunks, "head").join(sizes.select("head", "nb"), "head").select("head", "node", F.pmod(F.xxhash64("node", F.lit(3)), "np").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"), F.lit(True).alias("asks"))
    told = larger.select("head", "b", "node").join(chunks, "head").select("head", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("np") - 1)).alias("c"), "b", F.lit(False).alias("asks"))

    def two_blocks(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["node", "asks"], kind="stable").drop_duplicates("node", keep="last")
        edges, _ = links_in_block(p["node"].to_numpy(np.int64), [np.asarray(x, np.int64) for x in p["items"]], 0, np.flatnonzero(p["asks"].to_numpy(bool)))
        return pd.DataFrame({"a": [e[0] for e in edges], "b": [e[1] for e in edges]}).astype("int64")

    crossing = asks.unionByName(told).join(sets, "node").groupBy("head", "b", "c").applyInPandas(two_blocks, "a long, b long")
    roots = cut(stars(pairs.unionByName(found.where("b IS NOT NULL").select("a", "b")).unionByName(crossing)))

    # ids: of equal sets, then of components
    first = every.where("n > 0").groupBy("node").agg(F.min("id").alias("first"))
    root = first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least_id = root.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = cut(root.join(least_id, "root").select("node", "component_id"))
    drop(all_sets, heads, all_members, sizes, found, roots)
    out = every.join(of_node, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(read(spark, sf_dir, "documents")).drop("node")
