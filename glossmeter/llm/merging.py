"""Merging one long sequence by ranked pairs, in numpy.

Pairs are taken rank by rank, the lowest first.  All places of a rank that do not overlap merge at once, from the left, up to
the first whose union makes a pair that has to go before the rest.  Places live in a linked list, so the work goes by merges,
not by rounds times length.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

#: The rank of a pair that does not merge.
NONE = np.int64(1) << 40


def merge_long(sym: np.ndarray, pairs: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols that survive, place of each one's first symbol); pairs(a, b) gives (rank, union), NONE where a, b do not merge.

    The same as to merge, over and over, the pair of lowest rank, the leftmost of several.
    """
    n = len(sym)
    sym = sym.astype(np.int64)
    if n < 2:
        return sym, np.arange(n)
    after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    rank, union = np.full(n, NONE), np.zeros(n, np.int64)
    rank[:-1], union[:-1] = pairs(sym[:-1], sym[1:])
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def wait(at: np.ndarray) -> None:
        at = at[rank[at] < NONE]
        if not len(at):
            return
        at = at[np.argsort(rank[at], kind="stable")]
        r = rank[at]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            key = int(r[a])
            if key not in waiting:
                waiting[key] = []
                heapq.heappush(ranks, key)
            waiting[key].append(at[a:b])

    wait(np.arange(n - 1))
    while ranks:
        r = heapq.heappop(ranks)
        found = waiting.pop(r)
        p = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        p = p[alive[p] & (rank[p] == r)]
        if not len(p):
            continue
        # every second place of a chain that overlaps
        chained = np.concatenate([[False], after[p[:-1]] == p[1:]])
        head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(p))))
        take = p[(np.arange(len(p)) - head) % 2 == 0]
        gone = after[take]
        right, left = after[gone], before[take]
        # what each union would pair with when it is made: a union just made on its left, nothing merged yet on its right
        joined = np.concatenate([[False], gone[:-1] == left[1:]])
        left_sym = np.where(joined, np.concatenate([[0], union[take][:-1]]), sym[np.maximum(left, 0)])
        first = np.where(left >= 0, pairs(left_sym, union[take])[0], NONE)
        second = np.where(right < n, pairs(union[take], sym[np.minimum(right, n - 1)])[0], NONE)
        early = np.flatnonzero((first <= r) | (second <= r))
        if len(early):
            stop = int(early[0]) + 1
            rest = p[p > take[stop - 1]]
            take, gone, right = take[:stop], gone[:stop], right[:stop]
            waiting[r] = [rest]
            heapq.heappush(ranks, r)
        sym[take] = union[take]
        alive[gone] = False
        after[take] = right
        inside = right < n
        before[right[inside]] = take[inside]
        rank[gone] = NONE
        changed = np.unique(np.concatenate([take, before[take][before[take] >= 0]]))
        follow = after[changed]
        some = follow < n
        rank[changed] = NONE
        if some.any():
            at = changed[some]
            rank[at], union[at] = pairs(sym[at], sym[follow[some]])
            wait(at)
    kept = np.flatnonzero(alive)
    return sym[kept], kept
