"""Numpy kernels against brute force."""

import itertools

import numpy as np
import pytest

from chronoloom.functions import kernels as K


@pytest.fixture
def rng():
    return np.random.default_rng(5)


def _graph(rng, n=6, p=0.4):
    a = np.triu((rng.random((n, n)) < p).astype(float), 1)
    return a + a.T


def test_heat_kernels_agree_with_series(rng):
    a = _graph(rng)
    lap = np.diag(a.sum(axis=1)) - a
    assert np.allclose(K.heat_kernels(lap[None], np.array([0.7]))[0], K.general_exponential(-0.7 * lap))
    walk = K.normalize_rows(np.where(a.sum(axis=1, keepdims=True) > 0, a, np.eye(6)))
    kernel = K.walk_heat_kernels(a[None], np.array([0.7]))[0]
    assert np.allclose(kernel, K.general_exponential(-0.7 * (np.eye(6) - walk)))
    assert np.allclose(kernel.sum(axis=1), 1)


def test_range_products(rng):
    mats = K.normalize_rows(rng.random((37, 4, 4)))
    tree = K.RangeProducts(mats)
    for _ in range(100):
        a, b = sorted(rng.integers(0, 37, 2).tolist())
        assert np.allclose(tree.query(a, b), K.direct_product(mats, a, b))
    with pytest.raises(IndexError):
        tree.query(3, 37)
    left = np.sort(rng.integers(0, 37, 40))
    right = np.maximum.accumulate(np.maximum(left, np.sort(rng.integers(0, 37, 40))))
    for a, b, got in zip(left, right, K.sliding_products(mats, left, right)(), strict=True):
        assert np.allclose(got, K.direct_product(mats, a, b))


def _all_cuts(x, n, least=2):
    cost, best = K._segment_costs(x), (np.inf, [])
    for cut in itertools.combinations(range(1, len(x)), n):
        bounds = [0, *cut, len(x)]
        if min(np.diff(bounds)) >= least:
            best = min(best, (sum(cost(np.array([a]), b)[0] for a, b in itertools.pairwise(bounds)), list(cut)))
    return best


@pytest.mark.parametrize("seed", range(5))
def test_change_points(seed):
    x = np.random.default_rng(seed).normal(size=12)
    assert K.change_points(x, 2) == _all_cuts(x, 2)[1]
    penalized = min((c + 0.5 * (n + 1), cut) for n in range(6) for c, cut in [_all_cuts(x, n)])
    assert K.penalized_change_points(x, 0.5) == penalized[1]


def test_equal_costs_give_the_last_cuts():
    """As the SQL on one thread: of equally good cuts the last, by the last cut, then the one before."""
    assert K.change_points(np.zeros(10), 3) == [4, 6, 8] and K.change_points(np.append(np.zeros(9), 1.0), 3) == [4, 6, 8]
    # one cut is free: before, within or after the step
    step = np.repeat([0.0, 1.0, 0.0], 4)
    assert K.change_points(step, 3) == [4, 8, 10] and K.change_points(step, 2) == [4, 8]


def test_change_points_of_short_signals():
    assert K.change_points(np.zeros(3), 3) == [] and K.change_points(np.zeros(0), 1) == [] and K.change_points(np.arange(9.0), 0) == []


@pytest.mark.parametrize("seed", range(10))
def test_assignment(seed):
    rng = np.random.default_rng(seed)
    cost = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
    small = cost if cost.shape[0] <= cost.shape[1] else cost.T
    best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
    assert sum(cost[i, j] for i, j in K.assignment(cost)) == pytest.approx(best)


def test_louvain_and_variation():
    s = np.kron(np.eye(3), np.ones((4, 4))) - 0.2
    label = K.louvain(s, 1)
    assert K.variation(label, np.repeat([0, 1, 2], 4)) == 0
    assert K.variation(np.array([0, 0, 1, 1]), np.array([0, 1, 2, 2])) == pytest.approx(0.25)
    assert K.variation(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) == pytest.approx(1.0)


def test_flow_integral_is_symmetric(rng):
    mats = K.heat_kernels(np.stack([np.diag(a.sum(axis=1)) - a for a in (_graph(rng) for _ in range(5))]), np.ones(5))
    total = K.flow_integral(mats, np.ones(5), np.full(6, 1 / 6))
    assert np.allclose(total, total.T) and total.sum() == pytest.approx(1)


def test_top_positions_prefers_later():
    assert K.top_positions(np.array([1.0, 3.0, 3.0, 2.0]), 1) == [2]
    assert K.top_positions(np.array([1.0]), 5) == [0]
