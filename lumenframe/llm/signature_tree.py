"""A signature tree over token sets, and the dual traversal that joins it with itself.

Sets are sorted by their smallest token, so that similar sets stand together, and grouped eight
by eight.  A node holds the OR of its sets' bitmaps, the range of their sizes, and how many
tokens the bitmaps may hide.  Two nodes are traversed together only if some pair below them can
still reach the threshold: no pair shares more tokens than the common bits of the two bitmaps and the
hidden tokens allow.  Pairs that are linked already, directly or by a chain, are not compared again.
"""

from __future__ import annotations

import numpy as np

FAN, NARROW, WIDE = 8, 512, 8192


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A set's bitmap as 64-bit words: a power of two of bits, at least two a token within NARROW and WIDE."""
    bits = min(max(NARROW, 1 << int(2 * len(tokens) - 1).bit_length()), WIDE)
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of the given width, from those of that width or a wider one."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] | maps[..., half:]
    return maps


def hidden_by(maps: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """How many tokens each bitmap may hide: of folded ones, but not of repeated ones, which have each bit several times."""
    return sizes - np.array([np.bitwise_count(m).sum(dtype=np.int64) for m in maps], np.int64)


class Tree:
    def __init__(self, maps: np.ndarray, sizes: np.ndarray, hidden: np.ndarray):
        self.levels = [(maps, sizes, sizes, hidden)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))

    def possible(self, level: int, xs: np.ndarray, ys: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which pairs of nodes can hold a pair of sets with den * |a & b| >= num * |a | b|."""
        maps, low, high, hidden = self.levels[level]
        common = np.bitwise_count(maps[xs][:, None] & maps[ys][None]).sum(2, dtype=np.int64)
        most = np.minimum(common + np.minimum(hidden[xs][:, None], hidden[ys][None]), np.minimum(high[xs][:, None], high[ys][None]))
        least = low[xs][:, None] + low[ys][None]  # |a & b| >= num / (num + den) * (|a| + |b|)
        sized = (den * high[xs][:, None] >= num * low[ys][None]) & (den * high[ys][None] >= num * low[xs][:, None])
        return sized & (most * (num + den) >= num * least)


def possible_links(maps: list[np.ndarray], sizes: np.ndarray, smallest: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that connect all that could be linked, as far as bitmaps and sizes tell.

    Sets of one width meet each other and those of twice the width, folded: no linked set is wider than that.
    """
    widths = np.array([len(m) for m in maps])
    found: list[tuple[int, int]] = []
    for w in np.unique(widths):
        at = np.flatnonzero((widths == w) | (widths == 2 * w))
        if len(at) > 1:
            tree = np.stack([fold(maps[i], int(w)) for i in at])
            found += [(int(at[i]), int(at[j])) for i, j in _traverse(tree, sizes[at], hidden_by(tree, sizes[at]), smallest[at], num, den, widths[at] == w, None)]
    return found


def links(sets: list[np.ndarray], num: int, den: int, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of linked sets that connect all that links connect, and no more than that takes.

    wanted: only pairs with at least one set so marked are compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    maps = [bitmap(s) for s in sets]
    width = int(np.median([len(m) for m in maps]))  # bitmaps of one width, that of the median
    width = 1 << (width.bit_length() - 1)
    maps = [fold(m, width) for m in maps]
    hidden = hidden_by(maps, sizes)  # a repeated bitmap tells tokens apart no better than its own width does
    maps = [np.tile(m, width // len(m)) for m in maps]
    tokens, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    _, dense = np.unique(tokens, return_inverse=True)
    mask = np.zeros(dense.max() + 1, bool)

    def linked(a: int, bs: np.ndarray, still):
        own = dense[offsets[a] : offsets[a + 1]]
        mask[own] = True
        for b in bs:
            if still(b):
                both = int(mask[dense[offsets[b] : offsets[b + 1]]].sum())
                if den * both >= num * (sizes[a] + sizes[b] - both):
                    yield b
        mask[own] = False

    return _traverse(np.stack(maps), sizes, hidden, np.array([s.min() for s in sets], np.uint64), num, den, wanted, linked)


def _traverse(maps, sizes, hidden, smallest, num, den, wanted, linked) -> list[tuple[int, int]]:
    """The dual traversal; `linked` yields those of some sets that are linked with one, None takes all that are possible."""
    order = np.argsort(smallest, kind="stable")
    tree, part = Tree(maps[order], sizes[order], hidden[order]), np.arange(len(sizes))
    marked = None if wanted is None else wanted[order]
    found: list[tuple[int, int]] = []

    def compare(a: int, bs: np.ndarray) -> None:
        still = lambda b: part[where[b]] != part[a]
        of = order[bs]
        for b in linked(order[a], of, still) if linked else of:
            if still(b):
                found.append((int(order[a]), int(b)))
                part[part == part[where[b]]] = part[a]

    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, x, y = stack.pop()
        if level == 0:
            continue
        span = FAN**level
        px, py = part[x * span : (x + 1) * span], part[y * span : (y + 1) * span]
        if px[0] == py[0] and (px == px[0]).all() and (py == py[0]).all():
            continue
        below = len(tree.levels[level - 1][1])
        xs, ys = np.arange(x * FAN, min(below, (x + 1) * FAN)), np.arange(y * FAN, min(below, (y + 1) * FAN))
        can = tree.possible(level - 1, xs, ys, num, den)
        if level == 1:
            if marked is not None:
                can &= marked[xs][:, None] | marked[ys][None]
            can &= xs[:, None] < ys[None]
            can &= part[xs][:, None] != part[ys][None]
            for i in np.flatnonzero(can.any(1)):
                compare(int(xs[i]), ys[can[i]])
        else:
            if x == y:
                can &= xs[:, None] <= ys[None]
            i, j = np.nonzero(can)
            own = xs[i] == ys[j]
            for k in [*np.flatnonzero(~own), *np.flatnonzero(own)]:  # a node with itself comes first
                stack.append((level - 1, int(xs[i[k]]), int(ys[j[k]])))
    return found
