"""Links between sets of 64-bit elements by a signature tree, within one group that fits in memory.

Leaves hold a few sets of like size; every node has the OR of its sets' bitmaps, the range of their sizes and the
largest number of elements that share a bit with another of the same set (``spare``). Two sets have at most
``|bits of both| + spare`` elements in common, so for two nodes ``popcount(OR1 & OR2) + min(spare1, spare2)`` bounds
every pair below them. The traversal goes down both sides at once and leaves pairs of nodes whose bound or size
ranges are below what a link needs, or whose sets are all in one component already.
"""

from __future__ import annotations

import numpy as np

LEAF = 8


def windowed_links(sets: list[np.ndarray], percent: int, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that is connected beyond equal ``labels``, by one tree for each doubling of the size.

    Two sets that link have sizes a <= b with 100 a >= percent b, so both are in the window that begins at the power
    of two below a. A window's bitmaps are as wide as its largest set needs, whatever other sizes there are.
    """
    sizes, labels, found = np.array([len(s) for s in sets], np.int64), np.asarray(labels).copy(), []
    for k in np.unique(np.floor(np.log2(sizes)).astype(np.int64)).tolist():
        at = np.flatnonzero((sizes >= 1 << k) & (percent * sizes <= 100 * (2 << k)))
        if len(at) > 1:
            for x, y in SignatureTree([sets[i] for i in at], percent).links(labels[at]):
                x, y = int(at[x]), int(at[y])
                labels[labels == labels[y]] = labels[x]
                found.append((x, y))
    return found


class SignatureTree:
    """``sets``: sorted uint64 arrays without repeats, none empty; a link: 100 * both >= percent * either."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        sizes = np.array([len(s) for s in sets], np.int64)
        klass = np.floor(np.log(sizes) / np.log(1.15)).astype(np.int64)
        self.order = np.lexsort((sizes, [int(s[0]) for s in sets], klass))
        self.sets, self.sizes = [sets[i] for i in self.order], sizes[self.order]
        bits = 1 << max(8, min(16, int(4 * sizes.max() - 1).bit_length()))
        self.bits = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(self.bits, self.sets):
            at = s % np.uint64(bits)
            np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.spare = self.sizes - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.label = np.arange(len(sets))
        # levels from the leaves up; a node covers two of the level below
        starts = np.arange(0, len(sets), LEAF)
        level = {"bits": np.bitwise_or.reduceat(self.bits, starts, axis=0), "least": np.minimum.reduceat(self.sizes, starts), "most": np.maximum.reduceat(self.sizes, starts), "spare": np.maximum.reduceat(self.spare, starts)}
        self.levels = [level]
        while len(level["least"]) > 1:
            pairs = np.arange(0, len(level["least"]), 2)
            level = {"bits": np.bitwise_or.reduceat(level["bits"], pairs, axis=0), "least": np.minimum.reduceat(level["least"], pairs), "most": np.maximum.reduceat(level["most"], pairs), "spare": np.maximum.reduceat(level["spare"], pairs)}
            self.levels.append(level)

    def _span(self, level: int, i: int) -> slice:
        step = LEAF << level
        return slice(i * step, min((i + 1) * step, len(self.sets)))

    def _may_link(self, level: int, i: int, j: int) -> bool:
        x = self.levels[level]
        p = self.percent
        if 100 * x["most"][i] < p * x["least"][j] or 100 * x["most"][j] < p * x["least"][i]:
            return False
        both = int(np.bitwise_count(x["bits"][i] & x["bits"][j]).sum()) + min(x["spare"][i], x["spare"][j])
        return (100 + p) * both >= p * (x["least"][i] + x["least"][j])

    def links(self, seeds: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect all that is connected (a spanning forest), as indices into the sets given.

        ``seeds``: labels of sets known to be connected; only what they don't connect yet is sought.
        """
        if seeds is not None:
            self.label = np.asarray(seeds)[self.order].copy()
        found: list[tuple[int, int]] = []
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            a, b = self.label[self._span(level, i)], self.label[self._span(level, j)]
            if (a == a[0]).all() and (b == a[0]).all() or i != j and not self._may_link(level, i, j):
                continue
            if level == 0:
                self._leaves(self._span(0, i), self._span(0, j), found)
                continue
            n = len(self.levels[level - 1]["least"])
            left, right = [k for k in (2 * i, 2 * i + 1) if k < n], [k for k in (2 * j, 2 * j + 1) if k < n]
            pairs = [(x, y) for x in left for y in right if i != j or x <= y]
            todo += sorted(((level - 1, x, y) for x, y in pairs), key=lambda t: -(t[1] == t[2]))[::-1]  # a node with itself first
        return found

    def _leaves(self, left: slice, right: slice, found: list[tuple[int, int]]) -> None:
        p, size = self.percent, self.sizes
        both = np.bitwise_count(self.bits[left, None] & self.bits[None, right]).sum(axis=2, dtype=np.int64) + np.minimum(self.spare[left, None], self.spare[None, right])
        need = p * (size[left, None] + size[None, right])
        for x, y in zip(*np.nonzero((100 + p) * both >= need)):
            x, y = x + left.start, y + right.start
            if (left != right or x < y) and self.label[x] != self.label[y]:
                common = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
                if (100 + p) * common >= p * (size[x] + size[y]):
                    self.label[self.label == self.label[y]] = self.label[x]
                    found.append((int(self.order[x]), int(self.order[y])))
