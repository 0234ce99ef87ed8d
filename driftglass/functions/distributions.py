"""Tails and bounds of distributions as columns and small numeric helpers; checked against closed forms."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    return min(1.0, sum(exp(log_choose(n, i) + i * log(p) + (n - i) * log(1 - p)) for i in range(k, n + 1)))


def poisson_tail(k: int, mean: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    return max(0.0, 1 - sum(exp(i * log(mean) - mean - lgamma(i + 1)) for i in range(k))) if mean > 0 else 0.0


def _root(f, lo: float = 0.0, hi: float = 1.0) -> float:
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact two-sided bounds of a binomial share, by bisection on the tails."""
    a = (1 - confidence) / 2
    low = 0.0 if k == 0 else _root(lambda p: binomial_tail(k, n, p) - a)
    high = 1.0 if k == n else _root(lambda p: a - (1 - binomial_tail(k + 1, n, p)))
    return low, high


def one_sided_lower(k: int, n: int, confidence: float = 0.95) -> float:
    return 0.0 if k == 0 else _root(lambda p: binomial_tail(k, n, p) - (1 - confidence))


def needed(share: float, confidence: float = 0.95) -> int:
    """Trials without a miss until the lower bound reaches the share."""
    n = 1
    while one_sided_lower(n, n, confidence) < share:
        n += 1
    return n


def poisson_binomial(ps: Column) -> Column:
    """The distribution of the number of hits with these chances, by convolution over the array."""
    start = F.array(F.lit(1.0))

    def step(d: Column, p: Column) -> Column:
        stay = F.concat(F.transform(d, lambda x: x * (1 - p)), F.array(F.lit(0.0)))
        move = F.concat(F.array(F.lit(0.0)), F.transform(d, lambda x: x * p))
        return F.zip_with(stay, move, lambda a, b: a + b)

    return F.aggregate(ps, start, step)
