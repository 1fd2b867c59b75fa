"""A run-length index over small, repetitive collections, and the matching statistics it gives.

``RunIndex`` sorts the suffixes of a collection of strings (each string belongs to a group; groups
don't see each other), forms the Burrows-Wheeler transform and keeps its runs. The suffix positions
and the common prefixes are sampled at run heads and run tails only: at any other row the longest
common prefix with the row above (below) is one less than that of the text position before, so a
stream over the text fills in all of them from the samples. In a repetitive collection the samples
are few.
"""

from __future__ import annotations

import numpy as np

#: Suffixes of one index at most; three fields of this width share a sort key.
MAX_BITS = 20
MAX_TEXT = 1 << MAX_BITS
_LOW = np.uint64(MAX_TEXT - 1)
_U = np.uint64


class RunIndex:
    def __init__(self, strings: list[bytes], groups: np.ndarray):
        """``groups``: one small integer per string, under 4096."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.lengths = lengths
        n = int((lengths + 1).sum())
        if n > MAX_TEXT - 1:
            raise ValueError("collection too large for one index")
        self.n = n
        self.text = np.frombuffer(b"\0".join(strings) + b"\0" + bytes(16), np.uint8)
        owner = np.repeat(np.arange(len(strings)), lengths + 1)
        self.left = self.starts[owner] + lengths[owner] - np.arange(n)  # bytes up to the end of the string
        self.group = np.asarray(groups, np.int64)[owner]
        self.order = self._sort()
        self._sample()

    def _sort(self) -> np.ndarray:
        """Suffix order by group, then bytes (an end before any byte), then position."""
        n, left = self.n, self.left
        at = np.arange(n, dtype=np.uint64)
        code = np.zeros(n + 4, np.uint64)
        code[:n] = np.where(left > 0, self.text[:n].astype(np.int64) + 1, 0)
        key = self.group.astype(np.uint64)
        for i in range(3):
            key = (key << _U(9)) | np.where(left >= i, code[i : n + i], _U(0))
        key = np.sort((key << _U(MAX_BITS)) | at)
        sa = (key & _LOW).astype(np.int64)
        rank = np.zeros(n, np.int64)
        new = np.ones(n, bool)
        new[1:] = (key[1:] >> _U(MAX_BITS)) != (key[:-1] >> _U(MAX_BITS))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        rank[sa] = np.repeat(first, size)
        # Only classes of several suffixes that go on beyond the sorted depth are sorted further.
        depth = 3
        active = sa[np.repeat(size > 1, size)]
        active = active[left[active] >= depth]
        while len(active):
            mine = rank[active]
            other = np.where(left[active] >= depth, rank[np.minimum(active + depth, n - 1)] + 1, 0)
            key = np.sort((mine.astype(np.uint64) << _U(2 * MAX_BITS)) | (other.astype(np.uint64) << _U(MAX_BITS)) | active.astype(np.uint64))
            active = (key & _LOW).astype(np.int64)
            both = key >> _U(MAX_BITS)
            mine = (key >> _U(2 * MAX_BITS)).astype(np.int64)
            head, sub = np.ones(len(key), bool), np.ones(len(key), bool)
            head[1:] = mine[1:] != mine[:-1]
            sub[1:] = both[1:] != both[:-1]
            first = np.flatnonzero(sub)
            size = np.diff(np.append(first, len(key)))
            class_start = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
            rank[active] = np.repeat(mine[first] + first - class_start[first], size)
            # Members that end inside the compared depth keep their class's head: they stay equal for good.
            active = active[np.repeat(size > 1, size)]
            depth *= 2
            active = active[left[active] >= depth]
        return (np.sort((rank.astype(np.uint64) << _U(MAX_BITS)) | at) & _LOW).astype(np.int64)

    def _sample(self) -> None:
        sa, n = self.order, self.n
        before = self.text[sa - 1].astype(np.int64)
        starts = np.zeros(n, bool)
        starts[self.starts] = True
        own = starts[sa]  # no byte stands before the start of a string
        before[own] = 256 + np.arange(int(own.sum()))
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (self.group[sa[1:]] != self.group[sa[:-1]])
        self.runs = int(head.sum())
        up = np.flatnonzero(head)
        tail = np.append(up[1:] - 1, n - 1)
        self.above = self._stream(sa[up], self._common(up - 1, up))
        self.below = self._stream(sa[tail], self._common(tail, tail + 1))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes in rows a and b, compared byte words at a time."""
        out = np.zeros(len(a), np.int64)
        real = np.flatnonzero((a >= 0) & (b < self.n))
        p, q = self.order[a[real]], self.order[b[real]]
        same = self.group[p] == self.group[q]
        real, p, q = real[same], p[same], q[same]
        words = np.lib.stride_tricks.as_strided(self.text, (self.n + 1, 8), (1, 1)).copy().view("<u8").ravel()
        limit = np.minimum(self.left[p], self.left[q])
        at, live = 0, np.arange(len(p))
        got = np.zeros(len(p), np.int64)
        while len(live):
            diff = words[np.minimum(p[live] + at, self.n)] ^ words[np.minimum(q[live] + at, self.n)]
            low = diff & (~diff + _U(1))
            tail = np.where(diff == 0, 8, np.log2(np.maximum(low, _U(1)).astype(np.float64)).astype(np.int64) // 8)
            got[live] += tail
            at += 8
            live = live[(tail == 8) & (limit[live] > at)]
        out[real] = np.minimum(got, limit)
        return out

    def _stream(self, positions: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values at all text positions from those at sampled ones: one less for each step on."""
        seed = np.full(self.n, -1, np.int64)
        seed[positions] = values + positions
        at = np.maximum.accumulate(np.where(seed >= 0, np.arange(self.n), -1))
        return np.maximum(seed[at] - np.arange(self.n), 0)

    def statistics(self) -> np.ndarray:
        """For each text position the length of the longest match that starts elsewhere in its group."""
        return np.minimum(np.maximum(self.above, self.below), self.left)


def long_matches(strings: list[bytes], groups: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(string, start, end) of the maximal runs covered by matches of at least ``length`` bytes."""
    index = RunIndex(strings, groups)
    hit = index.statistics() >= length
    if not hit.any():
        return []
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    owner = np.searchsorted(index.starts, first, side="right") - 1
    base = index.starts[owner]
    return list(zip(owner.tolist(), (first - base).tolist(), (last - base + length).tolist()))
