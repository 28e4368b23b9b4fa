"""Tail probabilities and log-factorials.

The normal and one-degree chi-squared tails are Column expressions, so they stay in generated
code; t, F and small-sample rank tails are vectorised Arrow UDFs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Coefficients of a published rational fit of erfc (relative error under 1.2e-7), constant term first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0."""
    t = 1.0 / (1.0 + 0.5 * z)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = F.lit(c) + t * series
    return t * F.exp(-z * z + series)


def erfc_sql(z: str) -> str:
    """The same as SQL text; z is a column name."""
    t = f"(1.0 / (1.0 + 0.5 * {z}))"
    series = f"{ERFC[-1]}::DOUBLE"
    for c in reversed(ERFC[:-1]):
        series = f"({c}::DOUBLE + {t} * {series})"
    return f"({t} * exp(-{z} * {z} + {series}))"


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|)."""
    return F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2.0)))


def chi2_1_sf(x: Column) -> Column:
    """P(X >= x) for chi-squared with one degree of freedom."""
    return F.least(F.lit(1.0), erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2.0)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method, elementwise."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return h


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(a, b, x))
    lg = np.vectorize(math.lgamma, otypes=[float])
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(inner) + b * np.log1p(-inner))
    direct = inner < (a + 1) / (a + b + 2)
    lower = front * _beta_fraction(np.where(direct, a, b), np.where(direct, b, a), np.where(direct, inner, 1 - inner)) / np.where(direct, a, b)
    out = np.where(direct, lower, 1 - lower)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) with df degrees of freedom; null or no freedom gives 1."""
    tt, d = t.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(tt) & np.isfinite(d) & (d > 0)
    out = np.ones(len(tt))
    if ok.any():
        out[ok] = beta_inc(d[ok] / 2, 0.5, d[ok] / (d[ok] + tt[ok] ** 2))
    return pd.Series(out)


#: log(n!) less Stirling's formula, by its asymptotic series from here on.
SERIES_FROM = 16


def _stirling_error(n: float) -> float:
    """log(n!) - log(sqrt(2 pi n) (n / e)^n)."""
    if n < SERIES_FROM:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    n2 = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / n2) / n2) / n2) / n2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where they are close."""
    d = x - mean
    if abs(d) > 0.1 * (x + mean):
        return x * math.log(x / mean) - d
    v = d / (x + mean)
    total, term, k = d * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        if total + term / k == total:
            return total
        total += term / k


def log_binomial(x: int, n: int, p: float) -> float:
    """log P(X = x) of n draws, by the saddle point: accurate for any n."""
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    errors = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    return errors - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_hypergeometric(x: int, marked: int, others: int, drawn: int) -> float:
    """log P(X = x) when `drawn` of marked + others are taken."""
    if drawn == 0 or drawn == marked + others or marked == 0 or others == 0:
        return 0.0
    p = drawn / (marked + others)
    return log_binomial(x, marked, p) + log_binomial(drawn - x, others, p) - log_binomial(drawn, marked + others, p)


def _outward(first: float, ratio: Callable[[np.ndarray], np.ndarray], count: int) -> float:
    """Sum of `count` terms, the log of the first and each one's ratio to the one before; ends where terms vanish."""
    total, term, at, block = 1.0, 1.0, 1, 256
    while at < count and term > 1e-18 * total:
        terms = term * np.cumprod(ratio(np.arange(at, min(at + block, count), dtype=float)))
        total, term, at, block = total + float(terms.sum()), float(terms[-1]), at + block, min(2 * block, 65_536)
    return math.exp(first) * total


def _two_sided(x: int, low: int, high: int, mode: int, log_p: Callable[[int], float], up: Callable[[np.ndarray], np.ndarray], down: Callable[[np.ndarray], np.ndarray]) -> float:
    """Sum over the outcomes in low..high that are no likelier than x; up(i) is P(i) / P(i - 1), down(i) is P(i) / P(i + 1)."""
    limit = log_p(x) + 1e-7
    if log_p(mode) <= limit:
        return 1.0

    def edge(likely: int, step: int, end: int) -> int | None:
        """The first outcome from `likely` on to `end` that counts."""
        if log_p(end) > limit:
            return None
        near, far = 0, abs(end - likely)
        while far - near > 1:
            mid = (near + far) // 2
            near, far = (near, mid) if log_p(likely + step * mid) <= limit else (mid, far)
        return likely + step * far

    total = 0.0
    if (a := edge(mode, 1, high)) is not None:
        total += _outward(log_p(a), lambda i: up(a + i), high - a + 1)
    if (b := edge(mode, -1, low)) is not None:
        total += _outward(log_p(b), lambda i: down(b - i), b - low + 1)
    return min(1.0, total)


def binomial_test(x: int, n: int, p: float) -> float:
    if n <= 0 or not 0 < p < 1:
        return 1.0
    odds = p / (1 - p)
    return _two_sided(x, 0, n, min(n, int((n + 1) * p)), lambda i: log_binomial(i, n, p), lambda i: (n - i + 1) / i * odds, lambda i: (i + 1) / (n - i) / odds)


@F.pandas_udf(DoubleType())
def binomial_two_sided(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Exact two-sided binomial test: outcomes no likelier than the one seen."""
    return pd.Series([binomial_test(int(x), int(m), float(q)) for x, m, q in zip(k, n, p, strict=True)], dtype=float)


@lru_cache(maxsize=16)
def _partitions(m: int) -> tuple[int, list[list[int]]]:
    """Period, and for each remainder of x the differences from which the number of partitions of 0..x into parts up to m follows.

    That number is a polynomial of degree m in the quotient of x by the least common multiple of the parts.
    """
    period = math.lcm(*range(1, m + 1))
    ways = [1] * (period * (m + 1))  # one part that takes what is left, as all totals up to x count
    for part in range(1, m + 1):
        for i in range(part, len(ways)):
            ways[i] += ways[i - part]
    rows = []
    for r in range(period):
        column, row = ways[r::period], []
        while column:
            row.append(column[0])
            column = [b - a for a, b in pairwise(column)]
        rows.append(row)
    return period, rows


def rank_sum_tail(u: float, n1: int, n2: int) -> float:
    """Exact two-sided P of a Mann-Whitney U without ties, where the smaller group is small; the larger one may be of any size.

    Counts the rank sums of the smaller group by inclusion and exclusion of ranks beyond the larger one.
    """
    m, n = sorted((n1, n2))
    if m == 0:
        return 1.0
    period, rows = _partitions(m)
    top = int(math.floor(min(u, n1 * n2 - u)))
    low = 0
    for size in range(m + 1):
        for taken in combinations(range(1, m + 1), size):
            x = top - size * n - sum(taken)
            if x >= 0:
                quotient, r = divmod(x, period)
                low += (-1) ** size * sum(d * math.comb(quotient, i) for i, d in enumerate(rows[r]))
    return min(1.0, 2 * low / math.comb(m + n, m))


@F.pandas_udf(DoubleType())
def rank_sum_exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_tail(float(x), int(a), int(b)) for x, a, b in zip(u, n1, n2, strict=True)], dtype=float)


def hypergeometric_tail(x: int, population: int, marked: int, drawn: int) -> float:
    """P(X >= x)."""
    low, high = max(0, marked + drawn - population), min(marked, drawn)
    if x > high:
        return 0.0
    if x <= low or marked > population or drawn > population:
        return 1.0
    others = population - marked
    up = lambda i: (marked - i + 1) * (drawn - i + 1) / (i * (others - drawn + i))
    down = lambda i: (i + 1) * (others - drawn + i + 1) / ((marked - i) * (drawn - i))
    if x * (population + 2) >= (marked + 1) * (drawn + 1):  # beyond the mode terms fall
        return min(1.0, _outward(log_hypergeometric(x, marked, others, drawn), lambda i: up(x + i), high - x + 1))
    return max(0.0, 1.0 - _outward(log_hypergeometric(x - 1, marked, others, drawn), lambda i: down(x - 1 - i), x - low))


@F.pandas_udf(DoubleType())
def hypergeometric_sf(k: pd.Series, population: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(X >= k) when `drawn` of `population` are taken and `marked` are marked."""
    return pd.Series([hypergeometric_tail(*map(int, row)) for row in zip(k, population, marked, drawn, strict=True)], dtype=float)


def fisher_test(a: int, b: int, c: int, d: int) -> float:
    marked, others, drawn = a + b, c + d, a + c
    low, high = max(0, drawn - others), min(marked, drawn)
    mode = min(high, max(low, (marked + 1) * (drawn + 1) // (marked + others + 2)))
    up = lambda i: (marked - i + 1) * (drawn - i + 1) / (i * (others - drawn + i))
    down = lambda i: (i + 1) * (others - drawn + i + 1) / ((marked - i) * (drawn - i))
    return _two_sided(a, low, high, mode, lambda i: log_hypergeometric(i, marked, others, drawn), up, down)


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Fisher's exact test of a 2 x 2 table: tables no likelier than the one seen."""
    return pd.Series([fisher_test(*map(int, row)) for row in zip(a, b, c, d, strict=True)], dtype=float)
