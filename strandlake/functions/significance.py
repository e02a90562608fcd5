"""Significance of scores and alignments, and substitution models: small tables made on the driver."""

from __future__ import annotations

from functools import cache
from math import gcd, lgamma

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.operators.pssm import Pssm, distribution, tail


def karlin(low: int, probs: np.ndarray) -> tuple[float, float, float]:
    """lambda, K and H (bits) of local alignment scores without gaps (Karlin and Altschul 1990): ``probs[i]`` is the chance of score
    ``low + i``. The mean must be below 0 and some score above 0."""
    p = np.asarray(probs, float) / np.sum(probs)
    s = np.arange(low, low + len(p))
    if low >= 0 or (p * s).sum() >= 0 or not (p[s > 0] > 0).any():
        raise ValueError("scores need a negative mean and a chance to be positive")
    lo, hi = 0.0, 1.0
    while (p * np.exp(hi * s)).sum() < 1:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(mid * s)).sum() > 1 else (mid, hi)
    lam = (lo + hi) / 2
    mean = (p * s * np.exp(lam * s)).sum()
    # K by the sums of k scores: sum over k of (E[exp(lambda S); S < 0] + P(S >= 0)) / k.
    total, walk, first = 0.0, np.ones(1), 0
    for k in range(1, 400):
        walk, first = np.convolve(walk, p), first + low
        at = np.arange(first, first + len(walk))
        part = (walk[at < 0] * np.exp(lam * at[at < 0])).sum() + walk[at >= 0].sum()
        total += part / k
        if part < 1e-9:
            break
    step = 0
    for x in s[p > 0]:
        step = gcd(step, int(abs(x)))
    return lam, step * np.exp(-2 * total) / (mean * -np.expm1(-lam * step)), lam * mean / np.log(2)


def log_upper_gamma(a: float, x: float) -> float:
    """Log of the regularised upper incomplete gamma function: by its series below a + 1, by continued fraction beyond."""
    if x <= 0:
        return 0.0
    head = a * np.log(x) - x - lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return float(np.log1p(-min(np.exp(head + np.log(total)), 1 - 1e-16)))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return float(head + np.log(h))


def log_product(log_p: float, n: int) -> float:
    """Log of the chance that a product of ``n`` uniform numbers has a log of ``log_p`` or less."""
    if log_p >= 0 or n == 0:
        return 0.0
    i = np.arange(n)
    terms = i * np.log(-log_p) - np.array([lgamma(k + 1) for k in i])
    return float(min(0.0, log_p + terms.max() + np.log(np.exp(terms - terms.max()).sum())))


def log_placements(n_seqs: int, places: float, n: int) -> float:
    """Log of the number of ways to choose ``n`` of so many sequences and one of so many places in each."""
    return lgamma(n_seqs + 1) - lgamma(n + 1) - lgamma(n_seqs - n + 1) + n * float(np.log(places)) if n <= n_seqs else -np.inf


class LlrTable:
    """P-values of the log likelihood ratio of an alignment of ``n`` sites, by columns: the exact distribution of one column's,
    on a grid of 1 / ``grain``, summed over columns."""

    EXACT = 40

    def __init__(self, bg: np.ndarray, grain: int = 100):
        self.bg, self.grain = np.asarray(bg, float) / np.sum(bg), grain
        self._column = cache(self._one_column)
        self._tail = cache(self._width)

    def _one_column(self, n: int) -> tuple[int, np.ndarray]:
        """Offset and chances of sum over symbols of k ln(k / (n bg)), k sites each."""
        rows: list[np.ndarray] = []
        top = 0
        for b in self.bg:
            k = np.arange(n + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(k > 0, k * np.log(k / (n * b)), 0.0)
            rows.append(np.rint(score * self.grain).astype(int))
            top += int(rows[-1].max())
        base = sum(int(r.min()) for r in rows)
        size = top - base + 1
        table = np.zeros((n + 1, size))
        table[0, 0] = 1.0
        for b, r in zip(self.bg, rows, strict=True):
            new, least = np.zeros_like(table), int(r.min())
            for used in range(n + 1):
                row = table[used]
                end = int(np.flatnonzero(row)[-1]) + 1 if row.any() else 0
                for k in range(n - used + 1 if end else 0):
                    weight = np.exp(k * np.log(b) - lgamma(k + 1))
                    shift = int(r[k]) - least
                    new[used + k, shift : shift + end] += row[:end] * weight
            table = new
        pdf = table[n] * np.exp(lgamma(n + 1))
        return base, pdf / pdf.sum()

    def _width(self, n: int, w: int) -> tuple[int, np.ndarray]:
        base, pdf = self._column(n)
        out = pdf
        for _ in range(w - 1):
            out = np.convolve(out, pdf)
        return base * w, tail(out)

    def log_p(self, llr: float, n: float, w: int) -> float:
        """Log p-value of ``llr`` (in nats) or more; between whole numbers of sites, the geometric mean. Beyond EXACT sites twice the
        ratio is taken to be chi-squared."""
        if n <= 1 or w == 0:
            return 0.0
        if n > self.EXACT:
            return log_upper_gamma(w * (len(self.bg) - 1) / 2, max(llr, 0.0))
        if n != int(n):
            low = int(n)
            return (low + 1 - n) * self.log_p(llr, low, w) + (n - low) * self.log_p(llr, low + 1, w)
        base, upper = self._tail(int(n), w)
        # Each symbol's part is off by half a step at most: so much is taken off, lest a score lie beyond the largest possible one.
        at = int(np.floor(self.grain * llr - len(self.bg) * w / 2)) - base
        return float(np.log(max(upper[min(max(at, 0), len(upper) - 1)], 1e-300)))


def log_alignments(lengths: list[int], width: int, n: int, model: str = "zoops") -> float:
    """Log of the number of ways to place ``n`` sites in sequences of these lengths. One to a sequence at most: all choices of
    sequences, by the elementary symmetric sums of their places; any number (anr): of all places."""
    places = np.array([max(0, m - width + 1) for m in lengths], float)
    if model == "anr":
        total = places.sum()
        return lgamma(total + 1) - lgamma(n + 1) - lgamma(total - n + 1) if n <= total else -np.inf
    logs = np.full(n + 1, -np.inf)
    logs[0] = 0.0
    for m in places[places > 0]:
        logs[1:] = np.logaddexp(logs[1:], logs[:-1] + np.log(m))
    return float(logs[n])


def log_evalue(table: LlrTable, freqs: np.ndarray, n: int, lengths: list[int], model: str = "zoops") -> float:
    """Log of the number of alignments of as many sites and columns that are expected to have as large a log likelihood ratio."""
    f = np.where(freqs > 0, freqs, 1.0)
    llr = n * float((freqs * np.log(f / table.bg)).sum())
    return table.log_p(llr, n, len(freqs)) + log_alignments(lengths, len(freqs), n, model)


def dirichlet_posterior(counts: np.ndarray, weights: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Expected frequencies of a column of counts under a mixture of Dirichlet distributions (``weights``; a row of ``alphas``
    each)."""
    counts, alphas = np.asarray(counts, float), np.asarray(alphas, float)
    gamma = np.vectorize(lgamma)
    total, sums = counts.sum(), alphas.sum(axis=1)
    log = np.log(weights) + gamma(sums) - gamma(sums + total) + (gamma(alphas + counts) - gamma(alphas)).sum(axis=1)
    share = np.exp(log - log.max())
    return (share / share.sum()) @ ((alphas + counts) / (sums + total)[:, None])


def substitution(one: np.ndarray, freqs: np.ndarray, distance: int, odds: bool = True) -> np.ndarray:
    """A unit mutation matrix (``one[i, j]``: chance that j becomes i) at a distance, as joint chances or as rounded log odds, in
    half bits below 170 and third bits from there on."""
    joint = (one * freqs + (one * freqs).T) / 2
    m = np.linalg.matrix_power(joint / freqs, distance)
    unit = 2 if distance < 170 else 3
    return np.rint(unit * np.log2((m + 1e-200) / freqs[:, None])) if odds else m * freqs


def nucleotide_unit(transition: float = 0.006, transversion: float = 0.002, freqs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A unit mutation matrix of A, C, G, T, in which transitions are more frequent, and its frequencies."""
    m = np.full((4, 4), transversion)
    m[[0, 2, 1, 3], [2, 0, 3, 1]] = transition
    np.fill_diagonal(m, 0)
    return m + np.diag(1 - m.sum(axis=0)), np.full(4, 0.25) if freqs is None else freqs


def gc_tables(pssm: Pssm, bins: int = 21) -> np.ndarray:
    """P-values by score, a row for each share of G and C from 0 to 1 (symbols ACGT), strands alike."""
    out = []
    for gc in np.linspace(0, 1, bins):
        pv = tail(distribution(pssm.scores, np.array([1 - gc, gc, gc, 1 - gc]) / 2))
        out.append(pv)
    return np.array(out)


def affinity_pvalue(average_odds: float, windows: int, gc: float, pssm: Pssm, tables: np.ndarray) -> float:
    """P-value of the average of ``windows`` likelihood ratios in a sequence of this share of G and C: that of the average as a
    single score, between neighbouring scores and shares in proportion, corrected for the number of windows."""
    top = tables.shape[1] - 1
    score = min(max((np.log2(max(average_odds, 1e-300)) - pssm.width * pssm.offset) * pssm.scale, 0.0), top)
    place = min(max(gc, 0.0), 1.0) * (len(tables) - 1)
    s, b = min(int(score), max(top - 1, 0)), min(int(place), len(tables) - 2)
    x, y = score - s, place - b
    p = sum(wx * wy * tables[b + j, min(s + i, top)] for i, wx in ((0, 1 - x), (1, x)) for j, wy in ((0, 1 - y), (1, y)))
    return float(-np.expm1(windows * np.log1p(-min(p, 1 - 1e-16))))


def spacing_pvalue(nominal: Column, observed: Column, width: Column, length: Column) -> Column:
    """Chance that two motifs' starts, placed anywhere in a sequence of ``length`` symbols, are as close to ``nominal`` apart as
    ``observed``; ``width``: the mean of theirs, rounded down. Null where no spacing is possible."""
    err, places = F.abs(nominal - observed), length - width + 1
    low, high = F.greatest(nominal - err, width - length), F.least(nominal + err, length - width)
    ahead = (high - low + 1) * (places - (high + low) / 2.0)
    around = -low * (places - (1 - low) / 2.0) + (high + 1) * (places - high / 2.0)
    return F.when(high >= low, F.when(low >= 0, ahead).otherwise(around) / (places * places))
