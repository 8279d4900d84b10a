"""Byte-pair merging with a heap of adjacent pairs over a linked list of symbols, and of many short words at once."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np


def merge(symbols: list[str], rank: Callable[[tuple[str, str]], float | None]) -> tuple[list[str], int]:
    """Merge until no adjacent pair has a rank: the lowest rank first, the leftmost on ties.

    Returns the remaining symbols and the number of merges. O(n log n) for any length.
    """
    n = len(symbols)
    if n < 2:
        return list(symbols), 0
    sym: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if (r := rank(pair)) is not None:
            heap.append((r, i, pair))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        if sym[i] != left or (j := after[i]) >= n or sym[j] != right:
            continue  # one of the two has been merged since
        sym[i] = left + right
        sym[j] = None
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            pair = sym[i], sym[k]
            if (r := rank(pair)) is not None:
                heapq.heappush(heap, (r, i, pair))
        h = before[i]
        if h >= 0:
            pair = sym[h], sym[i]
            if (r := rank(pair)) is not None:
                heapq.heappush(heap, (r, h, pair))
    return [s for s in sym if s is not None], merges


#: Rank of a pair that isn't merged.
NONE = np.iinfo(np.int32).max
#: Rows and cells of one step of ``merge_many``, and symbols of a word beyond which the heap is faster.
ROWS, MOST = 8192, 64


class Ranks:
    """Ranks of pairs of token numbers (under 2 ** 20), and the token that each rank makes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        keys = left.astype(np.int64) * (1 << 20) + right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], rank[order].astype(np.int32)
        self.made = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.made[rank] = made

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE for others and where a number is -1."""
        if not len(self.keys):
            return np.full(left.shape, NONE, np.int32)
        key = left.astype(np.int64) * (1 << 20) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)


def merge_many(symbols: np.ndarray, size: np.ndarray, ranks: Ranks) -> np.ndarray:
    """What ``merge`` makes of each word: its tokens where their first symbols stood, -1 elsewhere.

    Each round merges in every word one pair, of the lowest rank and the leftmost on ties. Words go
    in the order of their sizes, so that rows of a step are about as wide.
    """
    out = symbols.astype(np.int32)
    start = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    for a in range(int(np.searchsorted(size[order], 2)), len(order), ROWS):
        words = order[a : a + ROWS]
        width = int(size[words[-1]])
        at = start[words, None] + np.arange(width)
        inside = np.arange(width) < size[words, None]
        sym = np.full((len(words), width + 1), -1, np.int32)  # the last column stands before the first and after the last
        sym[:, :-1][inside] = out[at[inside]]
        _merge_rows(sym, ranks)
        out[at[inside]] = sym[:, :-1][inside]
    return out


def _merge_rows(table: np.ndarray, ranks: Ranks) -> None:
    n, w = table.shape
    after = np.tile(np.minimum(np.arange(1, w + 1), w - 1).astype(np.int32), n)
    before = np.tile(np.where(np.arange(w) > 0, np.arange(w) - 1, w - 1).astype(np.int32), n)
    rank = np.full((n, w), NONE, np.int32)
    rank[:, :-1] = ranks.of(table[:, :-1], table[:, 1:])
    sym, flat = table.reshape(-1), rank.reshape(-1)
    rows = np.arange(n)
    while len(rows):
        place = rank[rows].argmin(1)
        i = rows * w + place
        best = flat[i]
        more = best < NONE
        rows, place, i, best = rows[more], place[more], i[more], best[more]
        j = rows * w + after[i]
        k, h = rows * w + after[j], rows * w + before[i]
        sym[i], sym[j], flat[j] = ranks.made[best], -1, NONE
        after[i], before[k] = after[j], place
        found = ranks.of(np.concatenate((sym[i], sym[h])), np.concatenate((sym[k], sym[i])))
        flat[i], flat[h] = found[: len(i)], found[len(i) :]
