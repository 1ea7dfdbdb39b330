"""Signature trees: sets under nodes that hold OR-combined bitmaps and size ranges, joined by dual traversal.

A set of n elements has a bitmap of the next power of two from 2 n bits, or fewer if a bound is given. A node holds its sets' combined bitmap,
their range of sizes, and the most elements that a set has beyond its bits. Two nodes are descended only if some
pair below them can be similar enough: by sizes, and by the elements that the common bits can hold at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF, FANOUT = 32, 8


def bitmap(u: np.ndarray, widest: int = 1 << 62) -> bytes:
    """Bitmap of a set of hashes, of at most `widest` bits (a power of two): a narrow one rules out fewer pairs, never a similar one."""
    width = max(64, min(widest, 1 << (2 * len(u) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(u & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class Node:
    """A run of sets in order of size: leaves hold sets of one bitmap width."""

    __slots__ = ("children", "high", "items", "low", "one", "slack", "union")

    def __init__(self, low, high, union, slack, items=None, children=()):
        self.low, self.high, self.union, self.slack, self.items, self.children, self.one = low, high, union, slack, items, children, False


class Forest:
    """The sets of one group and their components so far; join() links all pairs that verify accepts."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[bytes], percent: int, verify: Callable[[int, int], bool] | None):
        order = np.argsort(sizes, kind="stable")
        self.n = sizes[order].astype(np.int64)
        self.bits = [np.frombuffer(bitmaps[i], np.uint64) for i in order]
        self.order, self.percent, self.verify = order, percent, verify
        self.root = list(range(len(order)))
        widths = np.array([len(b) for b in self.bits])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(widths)) + 1, [len(order)]])
        level = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for i in range(s, e, LEAF):
                items = range(i, min(i + LEAF, e))
                m = np.stack([self.bits[k] for k in items])
                slack = int((self.n[items.start : items.stop] - np.bitwise_count(m).sum(axis=1, dtype=np.int64)).max())
                level.append(Node(int(self.n[items.start]), int(self.n[items.stop - 1]), np.bitwise_or.reduce(m, axis=0), slack, (items, m)))
        while len(level) > 1:
            level = [self._over(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self.top = level[0]

    def _over(self, nodes: list[Node]) -> Node:
        words = {len(x.union) for x in nodes}
        union = np.bitwise_or.reduce([_fold(x.union, min(words)) for x in nodes], axis=0)
        slack = max(x.slack for x in nodes) if len(words) == 1 and all(x.slack is not None for x in nodes) else None
        return Node(nodes[0].low, nodes[-1].high, union, slack, None, nodes)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def _one(self, x: Node) -> int:
        """The component of all sets below x, or -1 if they are not known to be one."""
        if not x.one:
            if x.items is not None:
                x.one = len({self.find(i) for i in x.items[0]}) == 1
            else:
                found = {self._one(c) if c.one or c.items is not None else -1 for c in x.children}
                x.one = len(found) == 1 and -1 not in found
            if not x.one:
                return -1
        while x.items is None:
            x = x.children[0]
        return self.find(x.items[0].start)

    def possible(self, x: Node, y: Node) -> bool:
        """Whether sets below x and y can reach the similarity by sizes and greatest possible overlap."""
        p = self.percent
        if 100 * x.high < p * y.low or 100 * y.high < p * x.low:
            return False
        if x.slack is None or y.slack is None or len(x.union) != len(y.union):
            return True
        overlap = min(x.slack, y.slack) + int(np.bitwise_count(x.union & y.union).sum(dtype=np.int64))
        return (100 + p) * overlap >= p * (x.low + y.low)

    def join(self) -> list[tuple[int, int]]:
        """Pairs (member, representative) by the sets' given places: one for each set that joined a component."""
        self._self(self.top)
        return [(int(self.order[i]), int(self.order[r])) for i in range(len(self.root)) if (r := self.find(i)) != i]

    def _self(self, x: Node) -> None:
        if x.items is not None:
            if len(x.items[0]) > 1:
                self._leaves(x, x)
            return
        for c in x.children:
            self._self(c)
        for i, c in enumerate(x.children):
            for d in x.children[i + 1 :]:
                self._cross(c, d)

    def _cross(self, x: Node, y: Node) -> None:
        if not self.possible(x, y) or (r := self._one(x)) >= 0 and r == self._one(y):
            return
        if x.items is not None and y.items is not None:
            self._leaves(x, y)
        elif y.items is not None or x.items is None and len(x.children) >= len(y.children):
            for c in x.children:
                self._cross(c, y)
        else:
            for c in y.children:
                self._cross(x, c)

    def _leaves(self, x: Node, y: Node) -> None:
        """Test the pairs of two leaves by their own bitmaps, then exactly."""
        p, (xs, a), (ys, b) = self.percent, x.items, y.items
        if x is y and len(xs) > 1 and self._one(x) >= 0:
            return
        words = min(a.shape[1], b.shape[1])
        a, b = _fold(a, words), _fold(b, words)
        nx, ny = self.n[xs.start : xs.stop], self.n[ys.start : ys.stop]
        common = np.stack([np.bitwise_count(row & b).sum(axis=1, dtype=np.int64) for row in a])
        ca, cb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
        most = np.minimum((nx - ca)[:, None] + common, (ny - cb)[None, :] + common)
        good = (100 + p) * most >= p * (nx[:, None] + ny[None, :])
        good &= (100 * nx[:, None] >= p * ny[None, :]) & (100 * ny[None, :] >= p * nx[:, None])
        if x is y:
            good = np.triu(good, 1)
        for i, j in zip(*(k.tolist() for k in np.nonzero(good)), strict=True):
            i, j = xs.start + i, ys.start + j
            r, s = self.find(i), self.find(j)
            if r != s and (self.verify is None or self.verify(int(self.order[i]), int(self.order[j]))):
                self.root[max(r, s)] = min(r, s)
