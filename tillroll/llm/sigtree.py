"""Signature trees: OR-combined token bitmaps and size ranges over sets.

A member is a set of tokens seen only through a bitmap (token hash -> bit) and
its size. For two members

    overlap <= popcount(bits_a & bits_b) + min(spare_a, spare_b),

where spare = size - popcount(bits) counts the tokens that share a bit with
another token of the same set. For two nodes the OR of the members' bitmaps and
the largest spare give the same bound for every pair below them, so a pair of
nodes whose bound is under the overlap that the smallest sizes need is dropped
with all its pairs. No pair that can link is ever dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FANOUT = 8
#: 64-bit words compared at once (bounds the working arrays).
CHUNK = 1 << 20
U64 = np.uint64


@dataclass(frozen=True)
class Threshold:
    """Jaccard >= num / den, in whole numbers."""

    num: int
    den: int

    def overlap(self, total):
        """Smallest overlap of two sets whose sizes add up to ``total``."""
        return -(-total * self.num // (self.num + self.den))

    def own(self, size):
        """Smallest overlap that a set of ``size`` has with any partner."""
        return -(-size * self.num // self.den)

    def holds(self, overlap: int, total: int) -> bool:
        return self.den * overlap >= self.num * (total - overlap)

    def sizes(self, small, large):
        return self.den * small >= self.num * large


def width_of(n: int) -> int:
    """Bitmap words for a set of n tokens: one to two bits a token, a power of two."""
    return max(4, 1 << max(0, (n - 1).bit_length() - 6))


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    at = tokens >> U64(64 - (width * 64).bit_length() + 1)
    out = np.zeros(width, U64)
    # The word index is the low part, so halving the width is an OR of neighbours.
    np.bitwise_or.at(out, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    return out


def fold(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of twice the width as those of half: bit b of 2w becomes bit b // 2."""
    pairs = bits.reshape(len(bits), -1, 2)
    return _squeeze(pairs[:, :, 0]) | (_squeeze(pairs[:, :, 1]) << U64(32))


def _squeeze(x: np.ndarray) -> np.ndarray:
    """OR of each two neighbouring bits, packed into the low 32 bits."""
    x = (x | (x >> U64(1))) & U64(0x5555555555555555)
    for shift, keep in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> U64(shift))) & U64(keep)
    return x


def count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


class Tree:
    """Levels from the members (0) up to one root; rows of a level are nodes."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray) -> None:
        # Similar members are close in this order: size, then the first words.
        self.order = np.lexsort((bits[:, 1], bits[:, 0], sizes))
        bits, sizes = bits[self.order], sizes[self.order]
        level = (bits, sizes, sizes, sizes - count(bits))
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FANOUT)
            level = (
                np.bitwise_or.reduceat(level[0], at, axis=0),
                np.minimum.reduceat(level[1], at),
                np.maximum.reduceat(level[2], at),
                np.maximum.reduceat(level[3], at),
            )
            self.levels.append(level)

    def at(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def _possible(x, y, i: np.ndarray, j: np.ndarray, t: Threshold) -> np.ndarray:
    """Which node pairs (i of level x, j of level y) may hold a linked pair."""
    keep = t.sizes(x[2][i], y[1][j]) & t.sizes(y[2][j], x[1][i])
    i, j = i[keep], j[keep]
    found = np.zeros(len(i), bool)
    step = max(1, CHUNK // x[0].shape[1])
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        most = count(x[0][a] & y[0][b]) + np.minimum(x[3][a], y[3][b])
        found[k : k + step] = most >= t.overlap(x[1][a] + y[1][b])
    keep[np.flatnonzero(keep)] = found
    return keep


def traverse(left: Tree, right: Tree, t: Threshold, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Member pairs that the bounds leave, as indexes into each tree's input."""
    top = max(len(left.levels), len(right.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for k in range(top, -1, -1):
        x, y = left.at(k), right.at(k)
        keep = _possible(x, y, i, j, t)
        i, j = i[keep], j[keep]
        if k == 0 or not len(i):
            break
        i, j = _below(i, j, k, len(left.levels), len(left.at(k - 1)[0]), len(right.levels), len(right.at(k - 1)[0]))
        if same:
            ordered = i < j if k == 1 else i <= j
            i, j = i[ordered], j[ordered]
    if top == 0 and same:
        i = j = np.empty(0, np.int64)
    return left.order[i], right.order[j]


def _below(i, j, k, left_levels, left_n, right_levels, right_n):
    """The children of each node pair; a tree that is less high stays at its root."""
    f = FANOUT if k < left_levels else 1
    g = FANOUT if k < right_levels else 1
    a = (i[:, None, None] * f + np.arange(f)[None, :, None]) + np.zeros((1, 1, g), np.int64)
    b = (j[:, None, None] * g + np.arange(g)[None, None, :]) + np.zeros((1, f, 1), np.int64)
    a, b = a.ravel(), b.ravel()
    real = (a < left_n) & (b < right_n)
    return a[real], b[real]


def _one_node(bits, sizes, side, t: Threshold):
    """The pairs of a tree that is one node: sizes first, then the bitmap bound."""
    n = sizes.tolist()
    for i in range(len(n)):
        for j in range(i + 1, len(n)):
            if (side is not None and side[i] == side[j]) or not t.sizes(min(n[i], n[j]), max(n[i], n[j])):
                continue
            a, b = bits[i], bits[j]
            while len(a) != len(b):
                a, b = (fold(a[None])[0], b) if len(a) > len(b) else (a, fold(b[None])[0])
            spare = min(n[i] - int(count(a)), n[j] - int(count(b)))
            if int(count(a & b)) + spare >= t.overlap(n[i] + n[j]):
                yield np.array([i]), np.array([j])


def candidate_pairs(bits: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, t: Threshold):
    """Pairs of members that may link, through one tree for each bitmap width.

    ``side`` (boolean) asks only for pairs of a False and a True member. Yields
    index arrays; widths differ by the power of two that the sizes allow, and
    the wider bitmaps are folded.
    """
    if len(bits) <= FANOUT:
        yield from _one_node(bits, sizes, side, t)
        return
    widths = np.array([len(b) for b in bits])
    groups = {}
    for w in np.unique(widths):
        for s in (False, True) if side is not None else (None,):
            at = np.flatnonzero((widths == w) if s is None else (widths == w) & (side == s))
            if len(at):
                groups[int(w), s] = at
    trees: dict[tuple, Tree] = {}

    def tree(key, w):
        if (key, w) not in trees:
            at = groups[key]
            b = np.stack([bits[i] for i in at])
            while b.shape[1] > w:
                b = fold(b)
            trees[key, w] = Tree(b, sizes[at])
        return trees[key, w]

    keys = sorted(groups, key=lambda x: (x[0], x[1] or False))
    for n, p in enumerate(keys):
        for q in keys[n:]:
            if (side is not None) and p[1] == q[1]:
                continue
            if p != q and not t.sizes(sizes[groups[p]].max(), sizes[groups[q]].min()):
                continue
            w = min(p[0], q[0])
            i, j = traverse(tree(p, w), tree(q, w), t, p == q)
            if len(i):
                yield groups[p][i], groups[q][j]
