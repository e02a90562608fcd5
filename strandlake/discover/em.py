"""Discovery by expectation maximisation: seeds from frequent words, E-steps over distributed sequences, small models on the
driver. A model goes out with each step's tasks and comes back as one sum of expected counts for each partition."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.significance import LlrTable, dirichlet_posterior, log_placements, log_product
from strandlake.functions.symbols import DNA, words
from strandlake.operators.motifs import Motif
from strandlake.operators.scan import encode


@dataclass
class Model:
    theta: np.ndarray  # width x symbols
    bg: np.ndarray
    gamma: float = 1.0  # share of sequences with a site, or sites per sequence for ``anr``
    loglik: float = -math.inf


def seeds(df: DataFrame, width: int, n: int, seq: str = "seq") -> list[str]:
    """The ``n`` words in most sequences."""
    found = df.select(F.explode(F.array_distinct(words(seq, width))).alias("w")).where(~F.col("w").rlike("[^ACGT]"))
    return [r["w"] for r in found.groupBy("w").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "w").limit(n).collect()]


def seed_theta(word: str, strength: float = 0.5) -> np.ndarray:
    out = np.full((len(word), 4), (1 - strength) / 4)
    out[np.arange(len(word)), [DNA.core.index(c) for c in word]] += strength
    return out


def score_words(df: DataFrame, candidates: list[str], bg: np.ndarray, seq: str = "seq") -> dict[str, float]:
    """For each of a bounded list of words, the sum over sequences of its best window's log odds, where positive: all words
    in one pass."""
    tables = [np.concatenate([np.log(seed_theta(w) / bg), np.full((len(w), 1), -1e9)], axis=1) for w in candidates]

    def run(frames):
        total = np.zeros(len(tables))
        for f in frames:
            for text in f[seq]:
                c = encode(text or "", "ACGT")
                for k, t in enumerate(tables):
                    n = len(c) - len(t) + 1
                    if n > 0:
                        total[k] += max(0.0, float(sum(t[j][c[j : j + n]] for j in range(len(t))).max()))
        yield pd.DataFrame({"k": np.arange(len(tables)), "v": total})

    return {candidates[r["k"]]: r["v"] for r in df.select(seq).mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}


def branch(df: DataFrame, start: list[str], bg: np.ndarray, rounds: int = 2, beam: int = 3, seq: str = "seq") -> list[str]:
    """The ``beam`` best words that single-letter changes lead to, round after round, best first."""
    best = score_words(df, start, bg, seq)
    for _ in range(rounds):
        top = sorted(best, key=lambda w: (-best[w], w))[:beam]
        new = sorted({w[:i] + c + w[i + 1 :] for w in top for i in range(len(w)) for c in DNA.core} - set(best))
        if not new:
            break
        best |= score_words(df, new, bg, seq)
        if sorted(best, key=lambda w: (-best[w], w))[:beam] == top:
            break
    return sorted(best, key=lambda w: (-best[w], w))[:beam]


def smooth(z: np.ndarray, w: int) -> np.ndarray:
    """Posteriors in which no ``w`` overlapping windows sum to more than 1: the largest of a window stays, others shrink."""
    z = z.copy()
    for s in range(len(z) - w + 1):
        part = z[s : s + w]
        total = part.sum()
        if total > 1:
            i = int(part.argmax())
            top = part[i]
            rest = total - top
            part *= (1 - top) / rest if rest > 0 else 1
            part[i] = top
    return z


def turned(codes: np.ndarray) -> np.ndarray:
    """The reverse complement of core indexes; ambiguous ones stay."""
    return np.where(codes < 4, 3 - codes, 4)[::-1]


def posterior(codes: np.ndarray, weight: np.ndarray, m: Model, kind: str, both: bool = False) -> tuple[np.ndarray, float]:
    """Chance of a site at each window (a row for each strand, places as the plus strand counts them), and the sequence's log
    likelihood ratio. Erased and ambiguous windows have none."""
    w, n = len(m.theta), len(codes) - len(m.theta) + 1
    if n < 1:
        return np.zeros((1 + both, 0)), 0.0
    ratio = np.concatenate([np.log(m.theta / m.bg), np.full((w, 1), -np.inf)], axis=1)
    sides = []
    for c in (codes, turned(codes)) if both else (codes,):
        s = np.zeros(n)
        for j in range(w):
            s += ratio[j][c[j : j + n]]
        sides.append(s if c is codes else s[::-1])
    s = np.array(sides) + np.log(np.maximum(weight[:n], 1e-300))
    if kind == "anr":
        lam = min(0.5, m.gamma / s.size)
        on, off = s + math.log(lam), math.log1p(-lam)
        top = np.maximum(on, off)
        whole = top + np.log(np.exp(on - top) + np.exp(off - top))
        return np.array([smooth(z, w) for z in np.exp(on - whole)]), float(whole.sum())
    prior = math.log((1.0 if kind == "oops" else max(m.gamma, 1e-9)) / s.size)
    none = -math.inf if kind == "oops" else math.log(max(1e-300, 1 - m.gamma))
    top = max(float(s.max()) + prior, none)
    if top == -math.inf:
        return np.zeros_like(s), 0.0
    whole = top + math.log(np.exp(s + prior - top).sum() + math.exp(none - top))
    return np.exp(s + prior - whole), whole


def expect(df: DataFrame, m: Model, kind: str, seq: str = "seq", weights: str | None = None, both: bool = False) -> tuple[np.ndarray, float, float, int]:
    """Expected counts (width x symbols), expected sites, log likelihood ratio and number of sequences."""
    w = len(m.theta)

    def run(frames):
        counts, sites, ll, n = np.zeros((w, 4)), 0.0, 0.0, 0
        for f in frames:
            for i, text in enumerate(f[seq]):
                c = encode(text or "", "ACGT")
                z, own = posterior(c, np.asarray(f[weights].iloc[i]) if weights else np.ones(len(c)), m, kind, both)
                for side, codes in zip(z, (c, turned(c)) if both else (c,), strict=True):
                    side = side if codes is c else side[::-1]
                    for j in range(w):
                        counts[j] += np.bincount(codes[j : j + len(side)], weights=side, minlength=5)[:4]
                sites, ll, n = sites + z.sum(), ll + own, n + 1
        yield pd.DataFrame({"i": np.arange(4 * w + 3), "v": [*counts.ravel(), sites, ll, n]})

    cols = [seq] + ([weights] if weights else [])
    total = df.select(*cols).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    v = np.array([r["v"] for r in total]) if total else np.zeros(4 * w + 3)
    return v[: 4 * w].reshape(w, 4), float(v[-3]), float(v[-2]), int(v[-1])


def maximise(counts: np.ndarray, bg: np.ndarray, pseudo: float, mixture: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Frequencies from expected counts: with ``pseudo`` counts of the background, or expected under a Dirichlet mixture (weights
    and alphas)."""
    if mixture is not None:
        return np.array([dirichlet_posterior(row, *mixture) for row in counts])
    c = counts + pseudo * bg
    return c / c.sum(axis=1, keepdims=True)


def run_em(df: DataFrame, start: Model, kind: str = "zoops", seq: str = "seq", pseudo: float = 0.01, iterations: int = 50, distance: float = 1e-3, weights: str | None = None, both: bool = False, mixture: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    m = start
    for _ in range(iterations):
        counts, sites, ll, n = expect(df, m, kind, seq, weights, both)
        theta = maximise(counts, m.bg, pseudo, mixture)
        moved = float(np.sqrt(((theta - m.theta) ** 2).sum()))
        m = Model(theta, m.bg, min(0.999, sites / max(1, n)) if kind == "zoops" else sites / max(1, n), ll)
        if moved < distance:
            break
    return m


def erase(df: DataFrame, m: Model, kind: str, seq: str = "seq", weights: str = "weights", both: bool = False) -> DataFrame:
    """Adds (or lowers) position weights by one less the chance of the sites that cover them."""
    w, has = len(m.theta), weights in df.columns
    cols = [c for c in df.columns if c != weights]

    def run(frames):
        for f in frames:
            out = []
            for i, text in enumerate(f[seq]):
                c = encode(text or "", "ACGT")
                old = np.asarray(f[weights].iloc[i]) if has else np.ones(len(c))
                z = posterior(c, old, m, kind, both)[0].sum(axis=0)
                cover = np.zeros(len(c))
                for j in range(w):
                    cover[j : j + len(z)] = np.maximum(cover[j : j + len(z)], z)
                out.append(old * (1 - np.minimum(cover, 1)))
            yield f[cols].assign(**{weights: out})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != weights)
    return df.mapInPandas(run, f"{fields}, {weights} array<double>")


def best_words(df: DataFrame, m: Model, limit: int, seq: str = "seq", weights: str | None = None, both: bool = False) -> list[str]:
    """The best window of each sequence, as the motif reads it: those of the ``limit`` best scores, best first."""
    w = len(m.theta)

    def run(frames):
        for f in frames:
            out = []
            for i, text in enumerate(f[seq]):
                c = encode(text or "", "ACGT")
                keep = np.asarray(f[weights].iloc[i]) if weights else np.ones(len(c))
                ratio = np.concatenate([np.log(m.theta / m.bg), np.full((w, 1), -np.inf)], axis=1)
                for strand, codes in enumerate((c, turned(c)) if both else (c,)):
                    n = len(c) - w + 1
                    if n > 0:
                        s = sum(ratio[j][codes[j : j + n]] for j in range(w)) + np.log(np.maximum(keep[:n] if not strand else keep[:n][::-1], 1e-300))
                        k = int(s.argmax())
                        if np.isfinite(s[k]):
                            out.append((i, float(s[k]), "".join("ACGT"[x] for x in codes[k : k + w])))
            top: dict[int, tuple] = {}
            for i, s, word in out:
                if i not in top or s > top[i][0]:
                    top[i] = (s, word)
            yield pd.DataFrame(list(top.values()), columns=["score", "word"])

    cols = [seq] + ([weights] if weights else [])
    return [r["word"] for r in df.select(*cols).mapInPandas(run, "score double, word string").orderBy(F.desc("score"), "word").limit(limit).collect()]


def choose(words_: list[str], bg: np.ndarray, n_seqs: int, places: float, least: int, table: LlrTable, min_sites: int = 2) -> tuple[float, int, int, int]:
    """Log E-value, first column, width and number of sites of the most significant part of an alignment whose rows come best
    first: the product of its columns' p-values, referred to that of uniform ones, times the ways to place the sites."""
    code = np.array([["ACGT".index(c) for c in w] for w in words_]).reshape(len(words_), -1)
    counts = np.cumsum(np.eye(4)[code], axis=0)
    sizes = sorted({n for n in (int(round(min_sites * 1.25**k)) for k in range(60)) if n <= len(words_)} | ({len(words_)} if len(words_) >= min_sites else set()))
    best = (math.inf, 0, code.shape[1], 0)
    for n in sizes:
        f = counts[n - 1] / n
        llr = n * (f * np.log(np.where(f > 0, f, 1.0) / bg)).sum(axis=1)
        logs = np.array([table.log_p(x, n, 1) for x in llr])
        ways = log_placements(n_seqs, places, n)
        for w in range(least, code.shape[1] + 1):
            for first in range(code.shape[1] - w + 1):
                e = log_product(float(logs[first : first + w].sum()), w) + ways
                if e < best[0] - 1e-9:
                    best = (e, first, w, n)
    return best


def discover_significant(df: DataFrame, least: int = 6, most: int = 12, kind: str = "zoops", motifs: int = 1, max_log_e: float = 0.0, n_seeds: int = 3, seq: str = "seq", bg: np.ndarray | None = None, both: bool = False, max_sites: int = 1000) -> list[Motif]:
    """Up to ``motifs`` motifs whose width, from ``least`` to ``most``, and number of sites, ``max_sites`` at most, are the most
    significant; ends at the first of a log E-value above ``max_log_e``. Widths go up by factors of the square root of two; each
    starts from the best of many frequent words, and its outcome may be cut to a part."""
    bg = np.full(4, 0.25) if bg is None else bg
    table, weights, out = LlrTable(bg), None, []
    stats = df.agg(F.count("*").alias("n"), F.avg(F.length(seq)).alias("l")).first()
    widths = sorted({min(most, int(round(least * 2 ** (k / 2)))) for k in range(2 + int(2 * math.log2(max(1.0, most / least))))} | {most})
    for k in range(motifs):
        best: tuple[float, Model, list[str]] | None = None
        for w in widths:
            words_ = seeds(df, w, 50, seq)
            scored = score_words(df, words_, bg, seq) if words_ else {}
            starts = [Model(seed_theta(s), bg, 0.5) for s in sorted(scored, key=lambda s: (-scored[s], s))[:n_seeds]]
            first = sorted((run_em(df, s, kind, seq, iterations=2, weights=weights, both=both) for s in starts), key=lambda m: -m.loglik)
            if not first:
                continue
            m = run_em(df, first[0], kind, seq, iterations=20, weights=weights, both=both)
            found = best_words(df, m, max_sites, seq, weights, both)
            if len(found) < 2:
                continue
            e, at, wide, n = choose(found, bg, stats["n"], (1 + both) * max(1.0, stats["l"] - w + 1), least, table)
            if best is None or e < best[0]:
                best = (e, Model(m.theta[at : at + wide], bg, m.gamma, m.loglik), [x[at : at + wide] for x in found[:n]])
        if best is None or best[0] > max_log_e:
            break
        e, m, sites = best
        f = maximise(np.array([[sum(s[i] == c for s in sites) for c in "ACGT"] for i in range(len(sites[0]))], float), bg, 0.01)
        out.append(Motif(f"EM-{k + 1}", f, nsites=float(len(sites)), evalue=math.exp(min(e, 700.0))))
        if k + 1 < motifs:
            df, weights = erase(df, m, kind, seq, both=both).checkpoint(), "weights"
    return out


def discover(df: DataFrame, width: int, kind: str = "zoops", motifs: int = 1, n_seeds: int = 3, seq: str = "seq", bg: np.ndarray | None = None, branching: int = 0) -> list[Motif]:
    """``motifs`` motifs, each the most likely outcome of EM from several seeds, improved by ``branching`` rounds of changes; sites are erased before the next. Erased
    sequences are checkpointed, so that steps don't run again."""
    bg = np.full(4, 0.25) if bg is None else bg
    out, weights = [], None
    for k in range(motifs):
        words_ = seeds(df, width, n_seeds, seq)
        if branching and words_:
            words_ = branch(df, words_, bg, branching, n_seeds, seq)
        starts = [Model(seed_theta(s), bg, 0.5) for s in words_]
        first = sorted((run_em(df, s, kind, seq, iterations=2, weights=weights) for s in starts), key=lambda m: -m.loglik)
        if not first:
            break
        best = run_em(df, first[0], kind, seq, weights=weights)
        out.append(Motif(f"EM-{k + 1}", best.theta, nsites=best.gamma, evalue=best.loglik))
        if k + 1 < motifs:
            df, weights = erase(df, best, kind, seq).checkpoint(), "weights"
    return out
