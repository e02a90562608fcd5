"""Special functions and tests that SQL lacks, in numpy and as pandas UDFs; and closed forms as column expressions."""

from __future__ import annotations

import ctypes
import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

lgamma = np.vectorize(math.lgamma, otypes=[float])
erfc = np.vectorize(math.erfc, otypes=[float])


def log_choose(n, k):
    return lgamma(np.asarray(n) + 1.0) - lgamma(np.asarray(k) + 1.0) - lgamma(np.asarray(n) - np.asarray(k) + 1.0)


def log_sum(x: np.ndarray) -> float:
    m = x.max() if len(x) else -np.inf
    return float(m + np.log(np.exp(x - m).sum())) if np.isfinite(m) else -np.inf


def log_fisher(hits: int, total: int, control_hits: int, control_total: int) -> float:
    """Natural log of the chance of at least ``hits`` of the hits among the ``total`` positives (hypergeometric upper tail).
    0 when a margin is empty, or when hits are rarer among positives than among controls."""
    n, k = total + control_total, hits + control_hits
    if not total or not control_total or not k or k == n or hits * control_total < control_hits * total:
        return 0.0
    i = np.arange(hits, min(total, k) + 1)
    return min(0.0, log_sum(log_choose(k, i) + log_choose(n - k, total - i)) - float(log_choose(n, total)))


@cache
def c_lgamma():
    """lgamma of the C library, the one that SQL engines call, as a function of an array; math's own differs in the last digits."""
    try:
        f = ctypes.CDLL(None).lgamma
        f.restype, f.argtypes = ctypes.c_double, [ctypes.c_double]
    except (AttributeError, OSError, TypeError):  # no such library
        f = math.lgamma
    return np.vectorize(f, otypes=[float])


def log_fisher_sum(hits: int, total: int, control_hits: int, control_total: int, step: int = 1024) -> float:
    """As ``log_fisher``, in the steps in which SQL takes it: chances themselves are added up, in order, in double precision. Below
    about -708 digits are lost, and a chance below the least double is 0, with log -inf.

    Terms fall from the first one or the next on; once one is too small to change the sum, none of the later ones would."""
    n, k = total + control_total, hits + control_hits
    if k == n or hits * control_total < control_hits * total:
        return 0.0
    lg, last, chance = c_lgamma(), min(total, k), 0.0
    ends = [float(lg(x + 1)) for x in (k, n - k, n, total, n - total)]
    for a in range(hits, last + 1, step):
        i = np.arange(a, min(a + step, last + 1))
        logs = ends[0] - lg(i + 1) - lg(k - i + 1) + ends[1] - lg(total - i + 1) - lg(n - k - total + i + 1) - ends[2] + ends[3] + ends[4]
        terms = np.array([math.exp(x) for x in logs])
        chance = float(np.cumsum(np.append(chance, terms))[-1])
        if terms[-1] <= chance * 2.0**-60:
            break
    return min(0.0, math.log(chance)) if chance > 0 else -math.inf


def log_betai(a: float, b: float, x: float) -> float:
    """Log of the regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return -math.inf if x <= 0 else 0.0
    if x > (a + 1) / (a + b + 2):
        rest = log_betai(b, a, 1 - x)
        return math.log1p(-math.exp(rest)) if rest < 0 else -math.inf
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x) - math.log(a)
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front + math.log(f)


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """Log of the chance of at least ``k`` successes in ``n`` trials."""
    return 0.0 if k <= 0 else log_betai(k, n - k + 1, p)


def ranksum(n: int, na: int, ta: float) -> dict[str, float]:
    """Mann-Whitney by normal approximation: rank sum ``ta`` of ``na`` out of ``n``. U, z with continuity, tails."""
    nb, mean = n - na, na * (n + 1) / 2
    sigma = math.sqrt(na * nb * (n + 1) / 12)
    u = ta - na * (na + 1) / 2
    if sigma == 0:
        return {"u": u, "left": 1.0, "right": 1.0, "two": 1.0}
    left = 0.5 * math.erfc(-(ta - mean + 0.5) / sigma / math.sqrt(2))
    right = 0.5 * math.erfc((ta - mean - 0.5) / sigma / math.sqrt(2))
    return {"u": u, "left": left, "right": right, "two": min(1.0, 2 * min(left, right))}


def log_multihg(classes: list[int], drawn: list[int]) -> float:
    """Log of the chance that a draw of ``sum(drawn)`` out of ``sum(classes)`` holds at least as many of each class but the
    first as it does: multi-hypergeometric upper tail."""
    n, m = sum(classes), sum(drawn)
    ranges = [range(d, min(c, m) + 1) for c, d in zip(classes[1:], drawn[1:], strict=True)]
    terms: list[float] = []

    def walk(i: int, left: int, acc: float) -> None:
        if i == len(ranges):
            if left <= classes[0]:
                terms.append(acc + float(log_choose(classes[0], left)))
            return
        for k in ranges[i]:
            if k > left:
                break
            walk(i + 1, left - k, acc + float(log_choose(classes[i + 1], k)))

    walk(0, m, 0.0)
    return min(0.0, log_sum(np.array(terms)) - float(log_choose(n, m))) if terms else -math.inf


def _by_counts(test, *counts: pd.Series) -> pd.Series:
    """``test`` of each row of counts, once for equal ones."""
    seen: dict = {}
    out = []
    for key in zip(*counts, strict=True):
        if key not in seen:
            seen[key] = test(*map(int, key))
        out.append(seen[key])
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def log_fisher_udf(hits: pd.Series, total: pd.Series, control_hits: pd.Series, control_total: pd.Series) -> pd.Series:
    return _by_counts(log_fisher, hits, total, control_hits, control_total)


@F.pandas_udf(DoubleType())
def log_fisher_sum_udf(hits: pd.Series, total: pd.Series, control_hits: pd.Series, control_total: pd.Series) -> pd.Series:
    return _by_counts(log_fisher_sum, hits, total, control_hits, control_total)


@F.pandas_udf(DoubleType())
def log_binomial_udf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([log_binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)])


@F.pandas_udf(DoubleType())
def erfc_udf(x: pd.Series) -> pd.Series:
    return pd.Series(erfc(x.to_numpy()))


@F.pandas_udf(DoubleType())
def lgamma_udf(x: pd.Series) -> pd.Series:
    return pd.Series(lgamma(x.to_numpy()))


def sidak(p: Column, n: Column) -> Column:
    """Chance that the least of ``n`` p-values is ``p`` or less; the product where it is small."""
    return F.when(p * n <= 1e-3, p * n).otherwise(-F.expm1(n * F.log1p(-p)))


def qfast(k: Column, n: Column) -> Column:
    """P-value of a product ``k`` of ``n`` p-values: k sum (-ln k)^i / i!, i < n."""
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    step = lambda s, i: F.struct((s["term"] * -F.log(k) / i).alias("term"), (s["total"] + s["term"] * -F.log(k) / i).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), state, step)["total"]
    return F.when(n <= 0, 1.0).when(k <= 0, 0.0).when(n == 1, k).otherwise(k * total)


def log_add(a: Column, b: Column) -> Column:
    m = F.greatest(a, b)
    return m + F.log(F.exp(a - m) + F.exp(b - m))


def safe_log2(x: Column) -> Column:
    """log2 with a floor for what has none."""
    return F.when(x > 0, F.log2(x)).otherwise(F.lit(-1e10))
