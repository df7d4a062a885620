"""Capacities are chosen together, and a plan places every piece."""

import random
from functools import cache

from tracksieve.llm import packing

LENGTHS = (256, 512, 1024, 2048)


def _bins(counts, runs):
    seen, bins = {s: set() for s in counts}, {}
    for size, first, rows, bin_, each, start in runs:
        assert rows % each == 0
        for i in range(rows):
            assert first + i not in seen[size]
            seen[size].add(first + i)
            bins.setdefault(bin_ + i // each, []).append((start + i % each * size, size))
    assert all(seen[s] == set(range(n)) for s, n in counts.items() if s)
    for inside in bins.values():
        end = 0
        for start, size in sorted(inside):
            assert start == end
            end += size
    return [sum(s for _, s in inside) for inside in bins.values()]


def _least(sizes, lengths):
    """Least capacity of all packings, by trying every one."""
    @cache
    def go(left):
        if not left:
            return 0
        best, rest = None, left[1:]
        for mask in range(1 << len(rest)):
            fill = left[0] + sum(x for i, x in enumerate(rest) if mask >> i & 1)
            if fill <= lengths[-1]:
                cost = next(c for c in lengths if c >= fill) + go(tuple(x for i, x in enumerate(rest) if not mask >> i & 1))
                best = cost if best is None else min(best, cost)
        return best
    return go(tuple(sorted(sizes, reverse=True)))


def test_three_of_600_and_three_of_400_take_three_bins_of_1024():
    filled = _bins({600: 3, 400: 3}, packing.best_plan({600: 3, 400: 3}, LENGTHS))
    assert filled == [1000] * 3


def test_cost_is_that_of_the_bins_never_above_the_largest_alone_and_near_the_least():
    rng = random.Random(5)
    ratios = []
    for _ in range(60):
        sizes = [rng.randrange(1, 1400) for _ in range(rng.randrange(1, 8))]
        counts = {s: sizes.count(s) for s in sizes}
        runs, alone = packing.best_plan(counts, LENGTHS), packing.plan(counts, 2048)
        filled = _bins(counts, runs)
        total = sum(next(c for c in LENGTHS if c >= x) for x in filled)
        assert packing.shrunk(runs, LENGTHS) == (total, len(filled))
        assert total <= packing.shrunk(alone, LENGTHS)[0]
        ratios.append(total / _least(sizes, LENGTHS))
    assert min(ratios) >= 1 and sum(ratios) / len(ratios) <= 1.1
