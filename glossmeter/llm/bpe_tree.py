"""Byte-level BPE as a reduction over a tree.

Encoded spans form a monoid: a span is cut in halves, each half is encoded by itself, and two neighbours are joined by
encoding a window around the seam again.  A join is right when each pair of tokens that meets at the window's edges is the
encoding of its own bytes: a sequence whose neighbours are all such pairs is the one encoding of its bytes.  Otherwise the
window grows, twice as far each time, and long windows merge all places of a pair at once.  Between two matches of the split pattern nothing merges, so there the join is mere concatenation.
Decoding concatenates the bytes of the tokens up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .merging import NONE, merge_long

#: Spans of at most so many bytes are leaves; bytes from which a window is merged in arrays; entries that a worker remembers:
#: of spans in each of two generations, of each kind of their parts.
LEAF_BYTES, LONG, REMEMBERED, PARTS = 6, 256, 200_000, 250_000


class TreeBPE:
    """ranks: token bytes -> id; pattern: splits a text into pieces that are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.seams: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}  # what was known until known was full
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.seam_split = regex.compile(r"(?<=\S)(?= \S)").split
        self.two_blanks = re.compile(r"\s\s").search

    @classmethod
    def from_file(cls, path: str, pattern: str) -> TreeBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}, pattern)

    # -- one piece -----------------------------------------------------------------------------

    def leaf(self, piece: bytes) -> list[int]:
        """Merge the neighbours whose union has the lowest rank, leftmost first, until none is a token."""
        got = self.leaves.get(piece)
        if got is None:
            got = self.merged(piece)
            if len(piece) <= 2 * LEAF_BYTES:
                if len(self.leaves) > PARTS:
                    self.leaves.clear()
                self.leaves[piece] = got
        return got

    def merged(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > LONG:
            return self.merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, token) of every two tokens whose bytes together are a token; the key orders by both."""
        rows = sorted((a << 32 | b, i) for t, i in self.ranks.items() for c in range(1, len(t)) if (a := self.ranks.get(t[:c])) is not None and (b := self.ranks.get(t[c:])) is not None)
        return np.array([k for k, _ in rows], np.int64), np.array([i for _, i in rows], np.int64)

    def merged_long(self, piece: bytes) -> list[int]:
        keys, tokens = self.pairs

        def lookup(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = a << 32 | b
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[i] == key, tokens[i], NONE), tokens[i]

        of_byte = np.array([self.ranks[bytes([x])] for x in range(256)], np.int64)
        return merge_long(of_byte[np.frombuffer(piece, np.uint8)], lookup)[0].tolist()

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode as a, b: no merge crosses this seam."""
        k = (a, b)
        if k not in self.seams:
            if len(self.seams) > PARTS:
                self.seams.clear()
            self.seams[k] = self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.seams[k]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both spans' bytes together."""
        if not left or not right:
            return left + right
        quiet = self.seams.get((left[-1], right[0]))
        if quiet or quiet is None and self.stable(left[-1], right[0]):
            return left + right
        i, j, grow = len(left) - 1, 1, 2  # the window is left[i:] and right[:j]
        while True:
            window = self.leaf(b"".join([self.bytes_of[x] for x in chain(left[i:], right[:j])]))
            before, after = i == 0 or self.stable(left[i - 1], window[0]), j == len(right) or self.stable(window[-1], right[j])
            if before and after:
                return left[:i] + window + right[j:]
            i, j, grow = i if before else max(0, i - grow), j if after else min(len(right), j + grow), 2 * grow

    def piece(self, b: bytes) -> list[int]:
        if len(b) <= LEAF_BYTES:
            return self.leaves.get(b) or self.leaf(b)
        x, y = b[: len(b) // 2], b[len(b) // 2 :]
        left = self.piece(x)
        return self.join(left, left if x == y else self.piece(y))

    def forget(self) -> None:
        """Give the memories back: a worker lives on after a task, and the next stage needs its space."""
        for memory in (self.known, self.before, self.pieces, self.leaves, self.seams):
            memory.clear()

    # -- whole texts ---------------------------------------------------------------------------

    def coded(self, p: str) -> tuple[bytes, bytes]:
        """A match of the pattern: its ids and their bytes decoded."""
        ids = self.piece(p.encode())
        return array("I", ids).tobytes(), b"".join([self.bytes_of[i] for i in ids])

    def whole(self, p: str) -> tuple[bytes, bytes]:
        got = self.coded(p)
        if len(p) < 100:
            if len(self.pieces) > PARTS:
                self.pieces.clear()
            self.pieces[p] = got
        return got

    def chunk(self, text: str) -> tuple[bytes, bytes]:
        """A span that begins and ends at matches of the pattern: ids as little-endian 32-bit integers, and their bytes decoded."""
        got = self.known.get(text) or self.before.get(text)
        if got is None:
            matches = self.find(text)
            if len(matches) == 1:
                got = self.coded(text)
            else:
                pairs = [self.pieces.get(p) or self.whole(p) for p in matches]
                got = b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])
        if len(text) < 100:
            if len(self.known) > REMEMBERED:
                self.known, self.before = {}, self.known
            self.known[text] = got
        return got

    def spans(self, text: str) -> list[str]:
        """Cut before each blank that stands alone between other characters: a match of the pattern begins there in any text."""
        if self.two_blanks(text) or text[:1] == " " or text[-1:] == " ":
            return self.seam_split(text)
        first, *rest = text.split(" ")  # every blank is such a one
        return [first, *[" " + x for x in rest]]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids, decoded bytes) of a text; spans meet where matches meet, so each level of the tree concatenates."""
        known = self.known.get
        pairs = [known(s) or self.chunk(s) for s in self.spans(text)]
        return b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> TreeBPE:
    return TreeBPE.from_file(path, pattern)


def bpe_encode_decode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text, then decode the ids.

    Returns id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256, and with
    with_ids the ids themselves (array<int>).  A null text counts as empty: no tokens.  Rows pass one by one, so repeated
    rows, an empty table and extra columns are nothing special; only the two columns named are read.
    """
    import public_tokenizers

    path, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                done = [(len(i) // 4, sha(i), sha(d), i) for i, d in (codec.encode(t.as_py() or "") for t in part.column(1))]
                cols = [part.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string()), pa.array([x[2] for x in done], pa.string())]
                if with_ids:
                    cols.append(pa.array([memoryview(x[3]).cast("I").tolist() for x in done], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)
        codec.forget()

    slim = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias(text_col))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode_decode(read(spark, sf_dir, "documents"))
