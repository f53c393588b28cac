"""Signature trees over token sets, joined by dual traversal.

A tree's leaves hold up to ``LEAF`` sets; every node knows the OR of its sets' bitmaps, the least number of bits of any
of them, and its range of set sizes. Two nodes are left alone when no pair of their sets can reach the similarity: the
sizes are too far apart, or so many bits of one side's sets must lie outside the other side's bitmap that the rest is too small an
overlap. Where only components are asked for (``links``), they are also left alone when all their sets are one component
already; where each set's links are counted (``degrees``), every similar pair is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF, FAN = 32, 4


class Union:
    def __init__(self, labels: np.ndarray):
        _, self.up = np.unique(labels, return_inverse=True)  # equal labels start as one
        first = {}
        self.up = np.array([first.setdefault(x, i) for i, x in enumerate(self.up.tolist())], dtype=np.int64)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def tops(self, which: np.ndarray) -> np.ndarray:
        top = self.up[which]
        while True:
            nxt = self.up[top]
            if np.array_equal(nxt, top):
                return top
            top = nxt


class Node:
    __slots__ = ("children", "high", "items", "least_bits", "low", "mask")

    def __init__(self, items: np.ndarray, sizes: np.ndarray, maps: np.ndarray, bits: np.ndarray):
        self.items, self.children = items, []
        self.low, self.high = int(sizes[items].min()), int(sizes[items].max())
        self.mask = np.bitwise_or.reduce(maps[items], axis=0)
        self.least_bits = int(bits[items].min())


#: Cells of the table of single bits that are held before they are packed.
CELLS = 1 << 22


def bitmaps(sets: list[np.ndarray], n_bits: int) -> np.ndarray:
    maps = np.empty((len(sets), n_bits // 64), dtype=np.uint64)
    step = max(1, CELLS // n_bits)
    for lo in range(0, len(sets), step):
        own = sets[lo : lo + step]
        flat = np.zeros((len(own), n_bits), dtype=bool)
        rows = np.repeat(np.arange(len(own)), [len(s) for s in own])
        flat[rows, (np.concatenate(own).view(np.uint64) & np.uint64(n_bits - 1)).astype(np.int64)] = True
        maps[lo : lo + step] = np.packbits(flat, axis=1).view(np.uint64)
    return maps


def build(items: np.ndarray, sizes: np.ndarray, maps: np.ndarray, bits: np.ndarray) -> Node:
    node = Node(items, sizes, maps, bits)
    if len(items) > LEAF:
        node.children = [build(x, sizes, maps, bits) for x in np.array_split(items, min(FAN, -(-len(items) // LEAF)))]
    return node


def too_far(x: Node, y: Node, num: int, den: int) -> bool:
    """Whether no pair of sets from x and y can be similar: overlap * (num + den) >= num * (size + size) is out of reach."""
    if den * x.high < num * y.low or den * y.high < num * x.low:
        return True
    common = int(np.bitwise_count(x.mask & y.mask).sum())
    # a set of x has least_bits bits, of which `common` at most lie in y; each other bit is a token that no set of y has
    out_x, out_y = max(0, x.least_bits - common), max(0, y.least_bits - common)
    return den * x.high - num * y.low < (num + den) * out_x or den * y.high - num * x.low < (num + den) * out_y


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, num: int, den: int, union: Union | None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) with den * intersection >= num * union, by dual traversal; with a ``union`` only those of different components.

    side: 0, 1, or 2 for both; pairs are sought between rows of side 0 or 2 and rows of side 1 or 2. Sets are sorted.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    n_bits = 64
    while n_bits < min(8192, 4 * int(sizes.max(initial=1))):
        n_bits *= 2
    maps = bitmaps(sets, n_bits)
    bits = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
    least = np.array([int(s.view(np.uint64)[0]) if len(s) else 0 for s in sets], dtype=np.uint64)
    order = np.lexsort((least, sizes))
    left, right = order[side[order] != 1], order[side[order] != 0]
    if not len(left) or not len(right):
        return
    x = build(left, sizes, maps, bits)
    y = x if np.array_equal(left, right) else build(right, sizes, maps, bits)
    stack = [(x, y)]
    while stack:
        x, y = stack.pop()
        if union is not None:
            tops = union.tops(np.concatenate([x.items, y.items]))
            if (tops == tops[0]).all():
                continue
        if too_far(x, y, num, den):
            continue
        if x.children or y.children:
            if x is y:
                stack += [(a, b) for i, a in enumerate(x.children) for b in x.children[i:]]
            elif x.children and (not y.children or len(x.items) >= len(y.items)):
                stack += [(a, y) for a in x.children]
            else:
                stack += [(x, b) for b in y.children]
            continue
        a, b = sizes[x.items][:, None], sizes[y.items][None, :]
        outside_a = np.bitwise_count(maps[x.items][:, None, :] & ~maps[y.items][None, :, :]).sum(axis=2).astype(np.int64)
        outside_b = np.bitwise_count(maps[y.items][None, :, :] & ~maps[x.items][:, None, :]).sum(axis=2).astype(np.int64)
        most = np.minimum(a - outside_a, b - outside_b) * (num + den) >= num * (a + b)
        if x is y:
            most = np.triu(most, 1)
        for i, j in zip(*np.nonzero(most), strict=True):
            i, j = int(x.items[i]), int(y.items[j])
            if i == j or (union is not None and union.find(i) == union.find(j)):
                continue
            both = overlap(sets[i], sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                yield i, j


def links(sets: list[np.ndarray], side: np.ndarray, labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Similar pairs that join different components; with labels, they span all components."""
    union, out = Union(labels), []
    for i, j in similar_pairs(sets, side, num, den, union):
        union.up[union.find(i)] = union.find(j)
        out.append((i, j))
    return out


def degrees(sets: list[np.ndarray], side: np.ndarray, weights: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set the summed weights of all sets similar to it across the sides."""
    out = np.zeros(len(sets), dtype=np.int64)
    for i, j in similar_pairs(sets, side, num, den, None):
        out[i] += weights[j]
        out[j] += weights[i]
    return out
