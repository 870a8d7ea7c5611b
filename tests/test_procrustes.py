"""Greedy matching of axes, by correlation and by residual sums of squares."""

import numpy as np

from lodestat.operators.linalg import procrustes_match


def test_both_ways_find_a_planted_match():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 4)) * [4, 3, 2, 1]
    order, sign = np.array([2, 0, 3, 1]), np.array([1, -1, -1, 1])
    b = np.empty_like(a)
    b[:, order] = a * sign + 0.05 * rng.normal(size=a.shape)
    for by_corr in (True, False):
        index, flip = procrustes_match(a, b, by_corr)
        assert list(index) == list(order) and list(flip) == list(sign)


def test_residuals_count_length_and_offset():
    a = np.array([[1.0], [2.0], [3.0]])
    b = np.array([[10.0, 1.2], [20.0, 2.0], [30.0, 2.7]])
    assert procrustes_match(a, b, False)[0][0] == 1 and procrustes_match(a, b)[0][0] == 0
    assert procrustes_match(a, -b, False) [1][0] == -1.0
    # The widest reference chooses first.
    index, _ = procrustes_match(np.column_stack([a, 5 * a]), np.column_stack([4 * a, 100 * a]), False)
    assert list(index) == [1, 0]
