import itertools

import numpy as np
import pytest

from effectspark.llm.crf import Chain


def brute(chain, emission):
    """Marginals and pair probabilities by summing over all labellings."""
    n, total = len(emission), 0.0
    marginal, pairs = np.zeros(n), np.zeros((2, 2, n))
    for y in itertools.product((0, 1), repeat=n):
        s = chain.start[y[0]] + sum(chain.move[a, b] for a, b in zip(y, y[1:])) + sum(e for e, l in zip(emission, y) if l)
        w = np.exp(s)
        total += w
        marginal += w * np.array(y)
        for t in range(1, n):
            pairs[y[t - 1], y[t], t] += w
    return marginal / total, pairs / total


@pytest.mark.parametrize("sizes", [(1,), (5, 1, 7), (2, 9, 3, 3, 1, 1, 6), (10,)])
def test_marginals_of_many_sequences_at_once(sizes):
    r = np.random.default_rng(sum(sizes))
    chain = Chain(r.normal(size=2), r.normal(size=(2, 2)))
    emission = r.normal(scale=3, size=sum(sizes))
    first = np.zeros(len(emission), bool)
    first[np.cumsum(sizes) - sizes] = True
    p, pairs = chain.expectations(emission, first)
    assert np.allclose(p, chain.marginals(emission, first))
    for start, n in zip(np.cumsum(sizes) - sizes, sizes):
        want, want_pairs = brute(chain, emission[start : start + n])
        assert np.allclose(p[start : start + n], want)
        assert np.allclose(pairs[:, :, start + 1 : start + n], want_pairs[:, :, 1:])


def test_long_sequences_and_extreme_potentials():
    chain = Chain(np.zeros(2), np.array([[5.0, -5.0], [-5.0, 5.0]]))
    emission = np.tile([-40.0, 40.0, 0.0], 40_000)
    first = np.zeros(len(emission), bool)
    first[0] = True
    p = chain.marginals(emission, first)
    assert np.isfinite(p).all() and p[::3].max() < 1e-4 and p[1::3].min() > 1 - 1e-4


def test_nothing():
    assert len(Chain(np.zeros(2), np.zeros((2, 2))).marginals(np.zeros(0), np.zeros(0, bool))) == 0
