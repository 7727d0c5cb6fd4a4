"""The sign-flip test against a plain loop."""

import math

import pytest

from marlstone.functions.significance import permutation_test


def plain(d, rounds, x):
    hits, mean = 0, sum(d) / len(d)
    for _ in range(rounds):
        total = 0.0
        for v in d:
            x = (x ^ (x << 13)) % 2**32
            x ^= x >> 17
            x = (x ^ (x << 5)) % 2**32
            total += -v if x / 2**32 < 0.5 else v
        hits += abs(total / len(d)) >= abs(mean)
    return mean, (hits + 1) / (rounds + 1)


def test_against_a_loop():
    a, b = [0.5, 0.25, 0.0, 1.0, math.nan, 0.5], [0.75, 0.5, 0.5, 1.0, 1.0, 0.25]
    assert permutation_test(a, b, 300) == plain([0.25, 0.25, 0.5, 0.0, -0.25], 300, 12345)


def test_edges():
    assert permutation_test([1, 1], [1, 1])[1] == 1.0
    assert all(math.isnan(x) for x in permutation_test([math.nan], [1.0]))
    with pytest.raises(ValueError):
        permutation_test([1], [1, 2])
