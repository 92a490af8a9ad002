"""Links of families whose bitmaps have several widths, against brute force."""

from itertools import combinations

import numpy as np
import pytest

from lumenframe.llm.signature_tree import bitmap, links, possible_links


def parts_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


FAMILIES = [[256, 257, 257], [512, 513, 513], [500, 530, 530, 530], [200, 200, 600, 600, 600], [200, 230, 255, 257, 290, 320, 500, 512, 513, 560, 1030, 2049]]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sizes", FAMILIES)
def test_links_across_widths_by_brute_force(sizes, seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(6):
        pool = rng.integers(0, 1 << 63, 4096).astype(np.uint64)
        for n in sizes:
            own = rng.integers(0, 1 << 63, rng.integers(0, n // 12)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([pool[: n - len(own)], own])))
    num, den = 85, 100
    linked = lambda a, b: den * len(c := np.intersect1d(a, b, True)) >= num * (len(a) + len(b) - len(c))
    want = parts_of(len(sets), [(i, j) for i, j in combinations(range(len(sets)), 2) if linked(sets[i], sets[j])])
    assert len(set(want)) < len(sets)
    assert parts_of(len(sets), links(sets, num, den)) == want
    least = np.array([s.min() for s in sets])
    possible = parts_of(len(sets), possible_links([bitmap(s) for s in sets], np.array([len(s) for s in sets]), least, num, den))
    assert all(possible[i] == possible[j] for i, j in combinations(range(len(sets)), 2) if want[i] == want[j])
