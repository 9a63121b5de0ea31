"""What several operators share: reading tables, cutting lineage, hashing the words of many texts at once."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass handles; bounds a Python worker's memory however long the Arrow batch is.
BLOCK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master, whose executors are the driver, gets one of our own; any other is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.gettempdir() + "/glossmeter-shared"
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation.

    The table goes when the session's JVM ends, or before that with drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# -- words of many texts at once ---------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(BLOCK_BYTES, _P, np.uint64))])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def blocks(texts: pa.Array, most: int = BLOCK_BYTES):
    """Slices of a string array of about `most` bytes each: (first row, slice). A longer text is a slice by itself."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
    if not len(sizes):
        return
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        yield a, texts.slice(a, b - a)


def raw_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of texts; a null has none. No copy, but for nulls with bytes under them."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_null()), 0, np.diff(off))
        if lengths.sum() != len(raw):
            keep = np.repeat(~np.asarray(texts.is_null()), np.diff(off))
            raw, off = raw[keep], np.concatenate([[0], np.cumsum(lengths)])
    return raw, off


def runs(raw: np.ndarray, off: np.ndarray, inside: np.ndarray, table: np.ndarray, piece: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each maximal run of bytes for which `inside` holds, that no text's end cuts; table maps bytes first.

    A run's hash is a sum over its bytes and their places, so pieces of a bounded size give its parts, however long it is.
    """
    starts, sums = [], []
    edge = np.zeros(len(raw) + 1, bool)  # where a text begins
    edge[off[:-1]] = True
    began, power = 0, np.uint64(1)  # of the run that a piece's first byte belongs to
    for a in range(0, len(raw), piece):
        b = min(len(raw), a + piece)
        own = inside[a:b]
        begin = own & edge[a:b]
        begin[1:] |= own[1:] & ~own[:-1]
        begin[0] |= bool(own[0] and not (a and inside[a - 1]))
        at = np.flatnonzero(own)
        if not len(at):
            continue
        first = np.flatnonzero(begin)
        goes_on = bool(own[0] and not begin[0])
        index = np.cumsum(begin)[at] - (0 if goes_on else 1)
        from_here = np.concatenate([[0], first]) if goes_on else first
        place = at - from_here[index]
        value = table[raw[a:b][at]].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            whole = place.astype(np.uint64)
            if goes_on:
                whole[index == 0] += np.uint64(a - began)
            value = mix(value + np.uint64(0x100) * (whole + np.uint64(1))) * _POWERS[place]
            if goes_on:
                value[index == 0] *= power
            total = np.add.reduceat(value, np.flatnonzero(np.diff(index, prepend=-1)))
            if goes_on:
                sums[-1][-1] += total[0]
                total = total[1:]
            if len(first):
                starts.append(a + first)
                sums.append(total)
                began, power = a + int(first[-1]), _POWERS[b - a - int(first[-1])]
            else:
                power = power * _POWERS[b - a]
    if not sums:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts).astype(np.int64), mix(np.concatenate(sums))


_SAME = np.arange(256, dtype=np.uint8)


def counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask holds for."""
    return np.array([np.count_nonzero(mask[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.int64)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of an array of texts as 64-bit hashes, in numpy.

    hash: one value for each word; row: the text that it is in; n: words of each text.
    lower: lower-case A-Z first.  Null texts have no words.  Beside about a byte for a byte of text, memory goes by words.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.raw, self.off = raw_texts(texts)
        self.rows = len(texts)
        self.word = ~_SPACE[self.raw]
        self.start, self.hash = runs(self.raw, self.off, self.word, _LOWER if lower else _SAME)
        self.row = np.searchsorted(self.off, self.start, "right") - 1
        self.n = np.bincount(self.row, minlength=self.rows).astype(np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of the \\n-split lines that hold a word."""
        start, value = runs(self.raw, self.off, self.raw != 10, _SAME)
        if not len(start):
            return value, start
        holds = np.zeros(len(start), bool)
        holds[np.searchsorted(start, self.start, "right") - 1] = True
        return value[holds], np.searchsorted(self.off, start[holds], "right") - 1

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of each window of k words; a text with fewer has its whole sequence as one."""
        if not len(self.hash):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            padded = np.concatenate([self.hash, np.zeros(k - 1, np.uint64)])
            left = np.cumsum(self.n)[self.row] - np.arange(len(self.hash))  # words from here to the text's end
            out = np.zeros(len(self.hash), np.uint64)
            for j in range(k):
                out = mix(out * _P + np.where(left > j, padded[j : j + len(self.hash)], np.uint64(0)) + np.uint64(j))
        keep = (left >= k) | (left == self.n[self.row])
        return out[keep], self.row[keep]
