"""Fill-in-the-middle transformation with a sparse index of checkpoints.

A text's units are words with the white space before them, and white space at its end.  They are counted once, in pieces of a
bounded size; every EVERY units the byte and code-point offsets at which a unit ends are recorded.  A cut behind unit u is then
found by binary search among the checkpoints and by reading on from the one before it, at most EVERY units far.  So a text of
any length is never split into a list of its units, and memory beside the text goes by units / EVERY.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, raw_texts, read

#: Units from one checkpoint to the next; bytes that are counted or read on at once.
EVERY, PIECE = 64, 1 << 18
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
FORMS = ("plain", "psm", "spm")

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


class Checkpoints:
    """The units of a text given as UTF-8 bytes: n of them, chars code points; ends(u) gives where unit u ends, counted from 1."""

    def __init__(self, raw: np.ndarray, every: int = EVERY, piece: int = PIECE):
        self.raw, self.piece = raw, piece
        units, chars, at = 0, 0, [(0, 0, 0)]  # (units, bytes, code points) up to a unit's end
        for a in range(0, len(raw), piece):
            ends = self._word_ends(a, a + piece)
            lead = np.cumsum(_LEAD[raw[a : a + piece]])
            pick = np.arange(every - units % every - 1, len(ends), every)  # units whose number `every` divides
            at += [(units + int(i) + 1, int(ends[i]), chars + int(lead[ends[i] - a - 1])) for i in pick]
            units, chars = units + len(ends), chars + int(lead[-1])
        self.words, self.chars = units, chars
        self.n = units + bool(len(raw) and _BLANK[raw[-1]])
        self.at = np.array(at, np.int64)

    def _word_ends(self, a: int, b: int) -> np.ndarray:
        """Offsets behind the last byte of each word that ends in raw[a:b]."""
        word = ~_BLANK[self.raw[a : b + 1]]
        last = word[: b - a].copy()
        last[: len(word) - 1] &= ~word[1 : len(last) + 1]
        return np.flatnonzero(last) + a + 1

    def end(self, u: int) -> tuple[int, int]:
        """(byte, code point) at which unit u ends; the text's start for 0."""
        if u > self.words or u == self.n:
            return len(self.raw), self.chars
        units, byte, chars = self.at[np.searchsorted(self.at[:, 0], u, "right") - 1].tolist()
        while units < u:
            to = min(len(self.raw), byte + self.piece)
            ends = self._word_ends(byte, to)
            stop = int(ends[u - units - 1]) if len(ends) >= u - units else to
            chars += int(np.count_nonzero(_LEAD[self.raw[byte:stop]]))
            units, byte = units + min(len(ends), u - units), stop
        return byte, chars


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four groups of eight hex digits of sha256(seed:id); a null id is written as nothing."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[4 * k : 4 * k + 4], "big") for k in range(4))


def transform(text: str, raw: np.ndarray, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of one text; raw are its bytes."""
    index = Checkpoints(raw)
    if not text or any(m in text for m in MARKS.values()) or h[2] % 100 >= rate:
        return index.n, "plain", None, None, text
    cuts = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (b1, c1), (b2, c2) = (index.end(u) for u in cuts)
    data = raw.tobytes()
    part = {"prefix": data[:b1].decode(), "middle": data[b1:b2].decode(), "suffix": data[b2:].decode()}
    form, order = ("spm", ("suffix", "prefix", "middle")) if h[3] % 100 < spm else ("psm", ("prefix", "suffix", "middle"))
    return index.n, form, c1, c2 - c1, "".join(MARKS[k] + part[k] for k in order)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    rate: per cent of texts that are cut; spm: per cent of those that get their suffix first.  Null counts as an empty text, which stays plain with
    0 units; so does, with its units, a text that holds a mark.  The id alone decides: rows that repeat an id get the same draws, and rows without one
    share theirs.  A middle may be empty, and prefix or suffix too.  Rows pass one by one, whole, whatever their length; columns that
    are not named are not read, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in blocks(batch.column(1)):
                ids = batch.column(0).slice(a, len(part))
                raw, off = raw_texts(part)
                rows = [transform(t or "", raw[off[i] : off[i + 1]], draws(seed, d), rate, spm) for i, (t, d) in enumerate(zip(part.to_pylist(), ids.to_pylist()))]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], names=names)

    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    slim = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    return slim.mapInArrow(run, f"`{id_col}` long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column | str, form: Column | str) -> Column:
    """The text that an output and its form were made from. A text that was cut holds no mark, so each mark stands once in its output."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, "<[PSM]>", -1)
    piece = lambda k: F.get(part, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(1), piece(3), piece(2))).otherwise(F.concat(piece(2), piece(3), piece(1)))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = fill_in_middle(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore("output", "form")).alias("restored_sha256"))


#: Units as a list, cut by their numbers.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS x, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:x], '') AS p, array_to_string(u[x + 1:y], '') AS m, array_to_string(u[y + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
