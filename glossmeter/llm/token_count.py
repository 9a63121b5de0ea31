"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens that a worker has not met yet are laid end to end in numpy arrays.  In each round every pre-token finds its
neighbouring pair of lowest rank and applies it, all pre-tokens at the same time; what survives is counted.  A pre-token of
more than LONG characters would need many rounds for few merges, so it applies all places of its lowest pair in a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .merging import NONE, merge_long

REMEMBERED, LIMIT, LONG = 400_000, 4096, 128
_NONE = np.int64(1) << 30
#: Bits of a place in a batch, below its rank; batches of pre-tokens of LONG characters at most are far smaller.
PLACE = 32


class RaggedCounter:
    """Counts as a sentencepiece BPE model does: identity normalisation, dummy prefix, blanks as U+2581, byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto  # the file's format

        m = ModelProto()
        m.ParseFromString(SentencePieceProcessor(model_file=model_file).serialized_model_proto())
        spec = m.normalizer_spec
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and m.trainer_spec.byte_fallback) or m.trainer_spec.model_type != 2 or any(p.type in (4, 5) for p in m.pieces):
            raise ValueError("only identity-normalised BPE models with byte fallback are counted here")
        normal = [p for p in m.pieces if p.type == 1]
        if any("▁" in p.piece.lstrip("▁") for p in normal):
            raise ValueError("a piece goes over a blank; pre-tokens would not be independent")
        order = sorted(range(len(normal)), key=lambda i: -normal[i].score)
        # a symbol is a number; pair (a, b) -> (rank, symbol of the union). Equal scores: leftmost first, so they share a rank
        self.symbol: dict[str, int] = {}
        rank_of, last, r = {}, None, -1
        for i in order:
            if normal[i].score != last:
                last, r = normal[i].score, r + 1
            rank_of[normal[i].piece] = r
        for p in rank_of:
            self.symbol.setdefault(p, len(self.symbol))
        self.other = len(self.symbol)  # a character without a piece: merges with nothing
        keys, ranks, unions = [], [], []
        for p, rk in rank_of.items():
            for c in range(1, len(p)):
                a, b = self.symbol.get(p[:c]), self.symbol.get(p[c:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b), ranks.append(rk), unions.append(self.symbol[p])
        o = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.unions = np.array(keys, np.int64)[o], np.array(ranks, np.int64)[o], np.array(unions, np.int64)[o]
        # within a pre-token nothing merges over a letter's end either, if no piece goes on after a letter with another kind
        apart = not any(regex.search(r"[^\P{L}][^\p{L}\p{M}]", p) or "\n" in p for p in rank_of)
        self.split = regex.compile(r"\n|▁*[^▁\n\p{L}\p{M}]*[\p{L}\p{M}]+|▁*[^▁\n\p{L}\p{M}]+|▁+" if apart else "▁*[^▁]+|▁+").findall
        self.apart = apart
        self.known: dict[str, int] = {}

    def count_long(self, pretoken: str) -> int:
        """Tokens of one pre-token of any length."""
        get, other, sym = self.symbol.get, self.other, []
        of = {c: get(c, other) for c in set(pretoken)}
        bare = {c: len(c.encode()) for c in of if of[c] == other}
        sym = np.fromiter(map(of.__getitem__, pretoken), np.int64, len(pretoken))
        left, _ = merge_long(sym, self.lookup)
        extra = sum((size - 1) * pretoken.count(c) for c, size in bare.items())  # bytes of characters without a piece
        return len(left) + extra

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        if any(len(p) > LONG for p in pretokens):
            out = np.array([self.count_long(p) if len(p) > LONG else 0 for p in pretokens], np.int64)
            short = [i for i, p in enumerate(pretokens) if len(p) <= LONG]
            out[short] = self.counts([pretokens[i] for i in short])
            return out
        n = len(pretokens)
        get, other = self.symbol.get, self.other
        sym = np.fromiter((get(c, other) for p in pretokens for c in p), np.int64)
        cost = np.fromiter((1 if c in self.symbol else len(c.encode()) for p in pretokens for c in p), np.int64)
        row = np.repeat(np.arange(n), [len(p) for p in pretokens])
        out = np.zeros(n, np.int64)
        rank, union = self.pairs(sym, row, np.arange(len(sym)))
        while len(sym):
            # of each row the pair of lowest rank, leftmost on ties; a round applies one in every row
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            place = np.arange(len(sym))
            lowest = np.minimum.reduceat(rank << PLACE | place, begin)
            ends = lowest >= _NONE << PLACE
            if ends.any():
                over = np.repeat(ends, np.diff(begin, append=len(sym)))
                np.add.at(out, row[over], cost[over])
                sym, cost, row, rank, union = sym[~over], cost[~over], row[~over], rank[~over], union[~over]
                continue
            merge = lowest & (1 << PLACE) - 1
            sym[merge], cost[merge] = union[merge], 1
            stay = np.ones(len(sym), bool)
            stay[merge + 1] = False
            at = merge - np.arange(len(merge))  # where the unions are afterwards
            sym, cost, row, rank, union = sym[stay], cost[stay], row[stay], rank[stay], union[stay]
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[changed], union[changed] = self.pairs(sym, row, changed)
        return out

    def pairs(self, sym: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and union of the pairs that begin at the places `at`; the last symbol of a row begins none."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] << 20 | sym[after]
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[i] == key) & (row[at] == row[after]) & (after > at)
        return np.where(hit, self.ranks[i], _NONE), self.unions[i]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and union of pairs of symbols."""
        key = a << 20 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], NONE), self.unions[i]

    def learn(self, pretokens: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        batch, size = [], 0
        for p in pretokens:
            batch.append(p)
            size += len(p)
            if size > 1 << 20:
                self.known.update(zip(batch, self.counts(batch).tolist()))
                batch, size = [], 0
        if batch:
            self.known.update(zip(batch, self.counts(batch).tolist()))

    def pretokens(self, text: str) -> list[str]:
        """Spans between which nothing merges: cut where a blank follows another character, and around characters in no piece."""
        if not text:
            return []
        if "  " in text or "▁" in text or text[0] == " " or text[-1] == " ":
            return self.split("▁" + text.replace(" ", "▁"))
        if not self.apart:
            return ["▁" + w for w in text.split(" ")]
        return self.split("▁" + text.replace(" ", "▁"))

    def texts(self, texts: list[str | None]) -> list[int]:
        split = [self.pretokens(t or "") for t in texts]
        if missing := {p for ps in split for p in ps} - self.known.keys():
            self.learn(sorted(missing))
            if missing := {p for ps in split for p in ps} - self.known.keys():
                self.learn_more(missing)
        get = self.known.__getitem__
        return [sum(map(get, ps)) for ps in split]

    def learn_more(self, missing: set[str]) -> None:
        """After the memory was cleared: also what it had held of this batch."""
        kept = self.known
        self.known = {}
        self.learn(sorted(missing))
        self.known.update(kept)


@lru_cache(maxsize=2)
def _counter(path: str) -> RaggedCounter:
    return RaggedCounter(path)


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty: 0, 0, false.  Rows pass one by one: repeated rows stay, an empty table gives an empty one,
    other columns are not read.
    """
    import public_tokenizers

    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                n = counter.texts(part.column(1).to_pylist())
                size = pa.compute.fill_null(pa.compute.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias(text_col))
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
