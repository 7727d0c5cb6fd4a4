"""The paired sign-flip test of two evaluation runs."""

from __future__ import annotations

import math

import numpy as np

# Rounds, the generator's seed and its three shifts.
ROUNDS, SEED = 10_000, 12345
SHIFTS = (13, 17, 5)


def _flips(count: int, seed: int) -> np.ndarray:
    """Whether each of the next ``count`` numbers of a 32-bit xorshift generator is in the lower half."""
    left, right, last = SHIFTS
    low, x = np.empty(count, bool), (seed & 0xFFFFFFFF) or 1
    for k in range(count):
        x ^= x << left & 0xFFFFFFFF
        x ^= x >> right
        x ^= x << last & 0xFFFFFFFF
        low[k] = x < 0x80000000
    return low


def permutation_test(a, b, rounds: int = ROUNDS, seed: int = SEED) -> tuple[float, float]:
    """(mean of b - a, p) over the queries that both runs score; NaN for both if there are none.

    A run's scores are one number a query, so the vectors fit the driver. Sums
    run from left to right, so that equal magnitudes compare as equal.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape != b.shape:
        raise ValueError("the runs differ in length")
    apart = (b - a)[~(np.isnan(a) | np.isnan(b))]
    n = len(apart)
    if not n:
        return math.nan, math.nan
    mean = np.cumsum(apart)[-1] / n
    signed = np.where(_flips(rounds * n, seed).reshape(rounds, n), -apart, apart)
    extreme = np.abs(np.cumsum(signed, axis=1)[:, -1] / n) >= abs(mean)
    return float(mean), float((extreme.sum() + 1) / (rounds + 1))
