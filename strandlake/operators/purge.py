"""Pairwise alignment: trimming sites to what aligns without gaps, and purging sequences that align too well."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.redundancy import keep_first, similar_pairs


def global_align(a: str, b: str, match: float = 1.0, mismatch: float = -1.0, start: float = -2.0, longer: float = -1.0) -> tuple[str, str]:
    """The best alignment of two whole strings, gaps costing ``start`` for their first symbol and ``longer`` for each further one."""
    n, m = len(a), len(b)
    best = np.full((3, n + 1, m + 1), -np.inf)  # last column: a pair, a gap in b, a gap in a
    came = np.zeros((3, n + 1, m + 1), int)
    best[0, 0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                k = int(best[:, i - 1, j - 1].argmax())
                best[0, i, j], came[0, i, j] = best[k, i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), k
            for own, (x, y) in ((1, (i - 1, j)), (2, (i, j - 1))):
                if x >= 0 and y >= 0:
                    from_ = best[:, x, y] + np.where(np.arange(3) == own, longer, start)
                    k = int(from_.argmax())
                    best[own, i, j], came[own, i, j] = from_[k], k
    top, low, i, j, k = [], [], n, m, int(best[:, n, m].argmax())
    while i or j:
        before = came[k, i, j]
        top.append(a[i - 1] if k != 2 else "-")
        low.append(b[j - 1] if k != 1 else "-")
        i, j, k = i - (k != 2), j - (k != 1), before
    return "".join(reversed(top)), "".join(reversed(low))


def gapless_span(sites: list[str], centre: int = 0, **costs) -> tuple[int, int]:
    """First and last + 1 of the longest run of columns of ``sites[centre]`` in which no other site, aligned with it, opens a gap on
    either side; the earliest of equal runs."""
    best = sites[centre]
    cut, lost = np.zeros(len(best) + 1, bool), np.zeros(len(best), bool)  # a gap before a column; a column against a gap
    for i, site in enumerate(sites):
        if i == centre:
            continue
        at = 0
        for x, y in zip(*global_align(best, site, **costs), strict=True):
            if x == "-":
                cut[at] = True
            else:
                lost[at] |= y == "-"
                at += 1
    spans, first = [(0, 0)], 0
    for at in range(len(best) + 1):
        if at == len(best) or lost[at] or cut[at]:
            spans.append((first, at))
            first = at + 1 if at < len(best) and lost[at] else at
    return max(spans, key=lambda s: (s[1] - s[0], -s[0]))


def segment_score(a: str, b: str, match: int = 5, mismatch: int = -4) -> int:
    """The best score of two stretches of equal length, one of each string, laid side by side."""
    x, y = np.frombuffer(a.encode("utf-32-le"), "<u4"), np.frombuffer(b.encode("utf-32-le"), "<u4")
    if not len(x) or not len(y):
        return 0
    best = 0
    for shift in range(-len(y) + 1, len(x)):
        u, v = x[max(0, shift) :], y[max(0, -shift) :]
        n = min(len(u), len(v))
        run = np.cumsum(np.where(u[:n] == v[:n], match, mismatch))
        best = max(best, int((run - np.minimum.accumulate(np.concatenate([[0], run[:-1]]))).max()))
    return best


def purge(df: DataFrame, name: str, cutoff: int, seq: str = "seq", k: int = 6, least: float = 0.1, match: int = 5, mismatch: int = -4) -> DataFrame:
    """Rows that remain if names are gone through in order and each is kept whose best segment with every kept one scores
    less than ``cutoff``. Those that share a tenth of their words of ``k`` symbols are compared; of copies the first stays."""
    firsts = df.groupBy(F.col(seq)).agg(F.min(name).alias(name))

    @F.pandas_udf("int")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([segment_score(x, y, match, mismatch) for x, y in zip(a, b, strict=True)])

    pairs = similar_pairs(firsts, name, seq, k, least)
    both = pairs.join(firsts.select(F.col(name).alias("a"), F.col(seq).alias("x")), "a").join(firsts.select(F.col(name).alias("b"), F.col(seq).alias("y")), "b")
    near = both.where(score("x", "y") >= cutoff).select("a", "b")
    return df.join(keep_first(firsts, near, name), name, "left_semi")
