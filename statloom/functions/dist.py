"""Quantiles and tail probabilities of the t, F, chi-square and normal laws, from incomplete beta and gamma functions."""

from __future__ import annotations

from math import exp, inf, lgamma, log, log1p, sqrt
from statistics import NormalDist

_TINY = 1e-300


def _lentz(term, first: float) -> float:
    """Value of a continued fraction whose k-th (numerator, denominator) is term(k)."""
    f = first or _TINY
    c, d = f, 0.0
    for k in range(1, 100_000):
        a, b = term(k)
        d = b + a * d or _TINY
        c = b + a / c or _TINY
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return f


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)

    def term(k: int) -> tuple[float, float]:
        m = k // 2
        if k % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    return front / (a * _lentz(term, 1.0))


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        total = piece = 1 / a
        for k in range(1, 100_000):
            piece *= x / (a + k)
            total += piece
            if piece < total * 1e-17:
                break
        return front * total
    return 1 - front / _lentz(lambda k: (-k * (k - a), x + 2 * k + 1 - a), x + 1 - a)


def _solve(cdf, p: float, low: float, high: float) -> float:
    while high < 1e300 and cdf(high) < p:
        low, high = high, high * 2
    for _ in range(400):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|)."""
    return beta_cdf(dof / (dof + t * t), dof / 2, 0.5)


def t_quantile(p: float, dof: float) -> float:
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    return _solve(lambda t: 1 - t_two_sided(t, dof) / 2, p, 0.0, 1.0)


def f_cdf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2) if f > 0 else 0.0


def f_quantile(p: float, d1: float, d2: float) -> float:
    return _solve(lambda f: f_cdf(f, d1, d2), p, 0.0, 1.0)


def chi2_cdf(x: float, dof: float) -> float:
    return gamma_cdf(x / 2, dof / 2)


def chi2_quantile(p: float, dof: float) -> float:
    return _solve(lambda x: chi2_cdf(x, dof), p, 0.0, 1.0)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p) if 0 < p < 1 else (inf if p >= 1 else -inf)


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a Pearson or Spearman coefficient from n pairs."""
    if r is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else t_two_sided(r * sqrt((n - 2) / (1 - r * r)), n - 2)
