"""Merging of adjacent symbols by an agenda, for many short sequences at once.

The agenda orders adjacent pairs by rank, lowest first and leftmost among equals. Sequences of
one length share a matrix: each round takes every row's first agenda entry. A long sequence
has an agenda of its own, a heap over a linked list."""

from __future__ import annotations

import heapq

import numpy as np

_NONE = np.int64(2**40)
LONGEST_ROW = 48
ROWS = 1 << 14


class Merges:
    """``left``, ``right``: symbol ids of a pair; ``rank``: its place; ``merged``: what it makes."""

    def __init__(self, left, right, rank, merged):
        key = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        order = np.lexsort((np.asarray(rank), key))
        key, first = np.unique(key[order], return_index=True)
        self.key = key
        self.rank = np.asarray(rank, np.int64)[order][first]
        self.merged = np.asarray(merged, np.int64)[order][first]
        self.table = None

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = (a << 32) | b
        at = np.minimum(np.searchsorted(self.key, q), len(self.key) - 1)
        hit = (self.key[at] == q) & (b >= 0)
        return np.where(hit, self.rank[at], _NONE), np.where(hit, self.merged[at], -1)

    def alone(self, symbols: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        s = symbols.tolist()
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if found := self.table.get(s[i] << 32 | s[j]):
                heapq.heappush(heap, (found[0], i, s[i], s[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if s[i] == a else n
            if j >= n or s[j] != b:
                continue
            s[i], s[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([x for x in s if x >= 0], np.int64)

    def matrix(self, s: np.ndarray) -> np.ndarray:
        """Rows of one length, merged; -1 fills up what became shorter. ``s`` is used up."""
        done = np.full(s.shape, -1, np.int64)
        where = np.arange(len(s))
        rank, new = self.look(s[:, :-1], s[:, 1:])
        while s.shape[1] > 1:
            at = rank.argmin(axis=1)
            over = rank[np.arange(len(s)), at] >= _NONE
            if over.any():
                done[where[over], : s.shape[1]] = s[over]
                s, rank, new, where, at = (x[~over] for x in (s, rank, new, where, at))
                if not len(s):
                    return done
            row, width = np.arange(len(s)), s.shape[1]
            s[row, at] = new[row, at]
            cols = np.arange(width - 1)[None, :]
            s = np.take_along_axis(s, cols + (cols > at[:, None]), 1)
            if width == 2:
                break
            cols = cols[:, :-1]
            step = cols + (cols >= at[:, None])
            rank, new = np.take_along_axis(rank, step, 1), np.take_along_axis(new, step, 1)
            for i, has in ((at - 1, at > 0), (at, at < width - 2)):
                r, i = row[has], i[has]
                rank[r, i], new[r, i] = self.look(s[r, i], s[r, i + 1])
        done[where, : s.shape[1]] = s
        return done

    def encode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        out: list = [None] * len(sequences)
        sizes = np.array([len(x) for x in sequences], np.int64)
        for n in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == n).tolist()
            if n < 2 or n > LONGEST_ROW:
                for k in which:
                    out[k] = self.alone(sequences[k]) if n else np.empty(0, np.int64)
                continue
            for a in range(0, len(which), ROWS):
                part = which[a : a + ROWS]
                rows = self.matrix(np.stack([sequences[k] for k in part]).astype(np.int64))
                for k, row, m in zip(part, rows, (rows >= 0).sum(1).tolist(), strict=True):
                    out[k] = row[:m]
        return out
