import itertools
import random

import numpy as np
import pytest

from effectspark.llm import decontaminate as D


def brute(document, item):
    """Words of the longest stretch with 80 % equal words, at any shift; None if it is too short."""
    best = None
    for shift in range(-len(item) + 1, len(document)):
        lo, hi = max(0, -shift), min(len(item), len(document) - shift)
        equal = [int(document[k + shift] == item[k]) for k in range(lo, hi)]
        total = [0, *itertools.accumulate(equal)]
        for a in range(len(equal)):
            for b in range(a + min(D.OVERLAP, len(item)), len(equal) + 1):
                if 5 * (total[b] - total[a]) >= 4 * (b - a) and (best is None or b - a > best):
                    best = b - a
    return best


def changed(item, places):
    out = item.copy()
    out[list(places)] = np.arange(10**6, 10**6 + len(places), dtype=np.uint64)
    return out


def around(words, r, n=6):
    side = lambda: np.array([r.randrange(2 * 10**6, 10**9) for _ in range(n)], np.uint64)
    return np.concatenate([side(), words, side()])


@pytest.mark.parametrize("words, n", [(13, 1), (13, 2), (14, 2), (15, 3), (16, 2), (18, 2), (20, 3), (20, 4), (25, 5), (30, 5), (30, 6)])
def test_items_with_substitutions_at_any_places(words, n):
    r = random.Random(words * 10 + n)
    item = np.arange(1, words + 1, dtype=np.uint64)
    index = D.SeedIndex([(1, item)])
    places = list(itertools.combinations(range(words), n))
    for p in places if len(places) < 500 else r.sample(places, 500):
        got = index.overlaps(around(changed(item, p), r))
        assert got == {0: (words, 6)}, p


@pytest.mark.parametrize("words", range(5, 13))
def test_short_items_with_substitutions(words):
    r = random.Random(words)
    item = np.arange(1, words + 1, dtype=np.uint64)
    index = D.SeedIndex([(1, item)])
    for n in range(4):
        for p in itertools.combinations(range(words), n):
            assert bool(index.overlaps(around(changed(item, p), r))) == (5 * n <= words), p


@pytest.mark.parametrize("words, n", [(13, 2), (15, 3), (20, 4), (25, 5)])
def test_the_masks_hit_every_allowed_pattern(words, n):
    patterns = np.array([sum(1 << k for k in p) for p in itertools.combinations(range(words), n)])
    hit = np.zeros(len(patterns), bool)
    for mask in D.MASKS:
        for shift in range(words - len(mask) + 1):
            hit |= (patterns & (int(mask, 2) << shift)) == 0
    assert hit.all()


def test_parts_of_items_like_brute_force():
    r = random.Random(4)
    for k in range(150):
        item = np.array([r.randrange(1, 60) for _ in range(r.randint(5, 45))], np.uint64)
        a = r.randrange(len(item))
        part = item[a : a + r.randint(5, 40)]
        document = around(changed(part, sorted(r.sample(range(len(part)), int(len(part) * r.random() * 0.3)))), r, 4)
        got = D.SeedIndex([(1, item)]).overlaps(document)
        assert (got[0][0] if got else None) == brute(document, item)
