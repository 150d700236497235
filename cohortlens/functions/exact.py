"""Exact p-values of two-sample tests by counting arrangements, for one result row at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Rank sums: the smaller group of at most so many, and at most so many places of the statistic.
RANK_SMALLER, RANK_PLACES = 8, 1_000_000
# Distances: groups of at most so many.
KS_LARGEST = 10_000


@lru_cache(maxsize=256)
def rank_sum_shares(n1: int, n2: int) -> np.ndarray:
    """The share of all arrangements of n1 and n2 distinct values with each U from 0 to n1 * n2."""
    small, large = sorted((n1, n2))
    # The counts are the coefficients of a product of (1 - q^(large + i)) / (1 - q^i), here as shares.
    shares = np.zeros(small * large + 1)
    shares[0] = 1.0
    for i in range(1, small + 1):
        top = i * large
        # With one value more, each of the values of the other group lies above 0 to i of them.
        run = shares[: top + 1].copy()
        run[large + i :] -= shares[: max(0, top + 1 - large - i)]
        for first in range(i):
            run[first::i] = np.cumsum(run[first::i])
        shares[: top + 1] = run * (i / (large + i))
    return np.maximum(shares, 0.0)


def rank_sum_exact(u1: float, n1: int, n2: int, alternative: str = "two-sided") -> float:
    """P-value of a rank sum without ties."""
    shares = rank_sum_shares(int(n1), int(n2))
    if alternative == "two-sided":
        u = max(u1, n1 * n2 - u1)
    elif alternative == "greater":
        u = u1
    elif alternative == "less":
        u = n1 * n2 - u1
    else:
        raise ValueError(f"unknown alternative {alternative!r}")
    tail = float(shares[int(round(u)) :].sum())
    return min(1.0, 2 * tail if alternative == "two-sided" else tail)


def ks_exact(d: float, n1: int, n2: int) -> float:
    """P(D >= d) over all arrangements: lattice paths from (0, 0) to (n1, n2) that leave the strip around the diagonal.

    Goes along the antidiagonals; an entry is the chance that a path through the point stayed inside.
    """
    n1, n2 = int(n1), int(n2)
    bound = round(d * n1 * n2)
    if bound <= 0:
        return 1.0
    inside = np.zeros(n1 + 1)
    inside[0] = 1.0
    for s in range(1, n1 + n2 + 1):
        i = np.arange(max(0, s - n2), min(s, n1) + 1)
        j = s - i
        # The last step of a random path to (i, j) was along the first axis with chance i / s.
        along = np.where(i > 0, inside[np.maximum(i - 1, 0)], 0.0)
        across = np.where(j > 0, inside[i], 0.0)
        new = along * (i / s) + across * (j / s)
        new[np.abs(i * n2 - j * n1) >= bound] = 0.0
        inside[:] = 0.0
        inside[i] = new
    return float(min(1.0, max(0.0, 1.0 - inside[n1])))
