"""Hidden Markov models built from motifs: Viterbi, forward and repeated-match scanning, a sequence at a time."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.motifs import Motif
from strandlake.operators.scan import encode

OUT = -1e10


@dataclass(frozen=True)
class Hmm:
    """``trans``: states x states; ``emit``: states x symbols; state 0 starts, the last ends, both silent. ``motif[i]``: the
    motif and column of a state, (-1, -1) for spacers."""

    trans: np.ndarray
    emit: np.ndarray
    motif: list[tuple[int, int]]
    names: list[str]


def _spacer(bg: np.ndarray) -> np.ndarray:
    return bg


def build(motifs: list[Motif], bg: np.ndarray, topology: str = "linear", spacer: float = 10.0) -> Hmm:
    """``linear``: motifs in order with a spacer before, between and after; ``complete``: a spacer between any two;
    ``star``: one spacer that every motif leaves and returns to. Spacers last ``spacer`` symbols on average."""
    stay = spacer / (spacer + 1)
    emit, where, spans = [np.zeros(len(bg))], [(-1, -1)], []
    for k, m in enumerate(motifs):
        spans.append((len(emit), len(emit) + m.width - 1))
        emit += list(m.freqs)
        where += [(k, j) for j in range(m.width)]
    n_motifs = len(motifs)
    pairs: list[tuple[int | None, int | None]]
    if topology == "linear":
        pairs = [(None if i == 0 else i - 1, i if i < n_motifs else None) for i in range(n_motifs + 1)]
    elif topology == "complete":
        pairs = [(None, i) for i in range(n_motifs)] + [(i, None) for i in range(n_motifs)] + [(i, j) for i in range(n_motifs) for j in range(n_motifs)]
    else:
        pairs = []
    extra = len(pairs) if topology != "star" else 1
    first = len(emit)
    emit += [_spacer(bg)] * extra + [np.zeros(len(bg))]
    where += [(-1, -1)] * (extra + 1)
    n = len(emit)
    t = np.zeros((n, n))
    for a, b in spans:
        for i in range(a, b):
            t[i, i + 1] = 1
    if topology == "star":
        t[0, first], t[first, first] = 1, stay
        for a, b in spans:
            t[first, a] += (1 - stay) * 0.9 / n_motifs
            t[b, first] = 1
        t[first, n - 1] = (1 - stay) * 0.1
    else:
        out: dict[int, list[int]] = {}
        for i, (u, v) in enumerate(pairs):
            out.setdefault(0 if u is None else spans[u][1], []).append(first + i)
            t[first + i, first + i] = stay
            t[first + i, n - 1 if v is None else spans[v][0]] = 1 - stay
        for a, to in out.items():
            t[a, to] = 1 / len(to)
    return Hmm(t, np.array(emit), where, [m.id for m in motifs])


def _logs(m: Hmm, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        t, e = np.maximum(np.log(m.trans), OUT), np.maximum(np.log(np.concatenate([m.emit, m.emit.mean(axis=1, keepdims=True)], axis=1)), OUT)
    return t, e[:, codes]


def viterbi(m: Hmm, codes: np.ndarray) -> tuple[float, list[int]]:
    """Log probability of the likeliest path, and its emitting states."""
    t, e = _logs(m, codes)
    v, back = t[0] + e[:, 0] if len(codes) else t[0], []
    for i in range(1, len(codes)):
        s = v[:, None] + t
        back.append(s.argmax(axis=0))
        v = s.max(axis=0) + e[:, i]
    last = v + t[:, -1]
    path = [int(last.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return float(last.max()), path[::-1]


def forward(m: Hmm, codes: np.ndarray) -> float:
    t, e = _logs(m, codes)
    f = t[0] + (e[:, 0] if len(codes) else 0)
    for i in range(1, len(codes)):
        s = f[:, None] + t
        top = s.max(axis=0)
        f = top + np.log(np.exp(s - top).sum(axis=0)) + e[:, i]
    s = f + t[:, -1]
    return float(s.max() + math.log(np.exp(s - s.max()).sum()))


def backward(m: Hmm, codes: np.ndarray) -> float:
    t, e = _logs(m, codes)
    b = t[:, -1]
    for i in range(len(codes) - 1, -1, -1):
        s = t + (e[:, i] + b)[None]
        top = s.max(axis=1)
        b = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    return float(b[0])


def motif_sites(m: Hmm, path: list[int]) -> list[tuple[str, int, int]]:
    """Motif occurrences along a path: name, start and stop from 1."""
    out = []
    for i, s in enumerate(path):
        k, j = m.motif[s]
        if j == 0:
            out.append([m.names[k], i + 1, i + 1])
        elif k >= 0 and out:
            out[-1][2] = i + 1
    return [tuple(x) for x in out]


def emit_sequence(m: Hmm, rng: np.random.Generator, most: int = 10_000, symbols: str = "ACGT") -> str:
    s, out = 0, []
    while len(out) < most:
        s = int(rng.choice(len(m.trans), p=m.trans[s] / m.trans[s].sum()))
        if s == len(m.trans) - 1:
            break
        out.append(symbols[int(rng.choice(len(symbols), p=m.emit[s] / m.emit[s].sum()))])
    return "".join(out)


SCORED = "seq_name string, length int, viterbi double, forward double, score double, sites array<struct<motif_id:string,start:int,stop:int>>"


def score_sequences(df: DataFrame, m: Hmm, bg: np.ndarray, name: str = "seq_name", seq: str = "seq") -> DataFrame:
    """One row for each sequence of at least one symbol: log probabilities, log odds of the best path against the background
    in bits, and the motifs on it."""
    def run(frames):
        for f in frames:
            out = []
            for who, text in zip(f[name], f[seq], strict=True):
                c = encode(text or "", "ACGT")
                if not len(c):
                    continue
                v, path = viterbi(m, c)
                null = float(np.log(np.append(bg, bg.mean()))[c].sum())
                out.append((str(who), len(c), v, forward(m, c), (v - null) / math.log(2), [{"motif_id": a, "start": b, "stop": d} for a, b, d in motif_sites(m, path)]))
            yield pd.DataFrame(out, columns=["seq_name", "length", "viterbi", "forward", "score", "sites"])

    return df.select(name, seq).mapInPandas(run, SCORED)


def fit_exponential(scores: np.ndarray, x: np.ndarray | None = None) -> tuple[float, float]:
    """Rate of scores above their least; with ``x`` (such as GC content), slope of log rate by a weighted regression over its
    halves."""
    s = scores - scores.min()
    if x is None or len(s) < 20:
        return 1 / max(float(s.mean()), 1e-12), 0.0
    mid = np.median(x)
    lo, hi = s[x <= mid], s[x > mid]
    if not len(lo) or not len(hi):
        return 1 / max(float(s.mean()), 1e-12), 0.0
    a, b = -math.log(max(lo.mean(), 1e-12)), -math.log(max(hi.mean(), 1e-12))
    slope = (b - a) / max(1e-12, float(x[x > mid].mean() - x[x <= mid].mean()))
    return math.exp(a - slope * float(x[x <= mid].mean())), slope


def fit_gumbel(scores: np.ndarray) -> tuple[float, float]:
    """Location and rate of an extreme-value distribution by maximum likelihood (Newton on the rate)."""
    s = scores.astype(float)
    lam = math.pi / max(1e-9, float(s.std()) * math.sqrt(6))
    for _ in range(100):
        e = np.exp(-lam * (s - s.min()))
        m1, m2 = (s * e).sum() / e.sum(), (s * s * e).sum() / e.sum()
        f, d = 1 / lam - s.mean() + m1, -1 / lam**2 - (m2 - m1**2)
        new = lam - f / d
        lam, old = (new if new > 0 else lam / 2), lam
        if abs(lam - old) < 1e-10:
            break
    return float(s.min() - math.log(np.exp(-lam * (s - s.min())).mean()) / lam), lam


def fit_mixture(scores: np.ndarray, rounds: int = 200) -> dict[str, float]:
    """Exponential background and normal foreground by EM."""
    s = scores - scores.min()
    lam, mu, sd, w = 1 / max(1e-9, np.median(s)), float(np.quantile(s, 0.95)), float(s.std()) or 1.0, 0.1
    for _ in range(rounds):
        a, b = (1 - w) * lam * np.exp(-lam * s), w * np.exp(-((s - mu) ** 2) / (2 * sd**2)) / (sd * math.sqrt(2 * math.pi))
        z = b / np.maximum(a + b, 1e-300)
        w = float(z.mean())
        lam = float((1 - z).sum() / max(1e-12, ((1 - z) * s).sum()))
        if z.sum() > 1e-9:
            mu = float((z * s).sum() / z.sum())
            sd = max(1e-6, math.sqrt(float((z * (s - mu) ** 2).sum() / z.sum())))
    return {"rate": lam, "mean": mu, "sd": sd, "weight": w}


def evalues(scored: DataFrame, score: str = "score") -> DataFrame:
    """Adds pvalue and evalue from an extreme-value fit to the scores' first two moments."""
    s = scored.agg(F.avg(score).alias("m"), F.stddev(score).alias("d"), F.count("*").alias("n"))
    lam = math.pi / (F.greatest("d", F.lit(1e-9)) * math.sqrt(6))
    p = -F.expm1(-F.exp(-lam * (F.col(score) - (F.col("m") - 0.5772156649 / lam))))
    return scored.crossJoin(F.broadcast(s)).withColumn("pvalue", p).withColumn("evalue", F.col("pvalue") * F.col("n")).drop("m", "d", "n")


CLUSTER = "seq_name string, start int, stop int, n_hits int, score double"


def cluster_scan(hits: DataFrame, max_gap: int = 50, gap_cost: float = 0.02, p_thresh: float = 5e-4) -> DataFrame:
    """Clusters of hits by dynamic programming: a hit adds -log2(p / p_thresh), a gap costs by its length and ends the
    cluster beyond ``max_gap``; the best-scoring run from each start is kept, none overlapping another."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f[f["pvalue"] <= p_thresh].sort_values(["start", "stop", "motif_id", "strand"])
        start, stop, own = f["start"].to_numpy(), f["stop"].to_numpy(), -np.log2(f["pvalue"].to_numpy() / p_thresh) + 1e-9
        best, prev = own.copy(), np.full(len(f), -1)
        for i in range(len(f)):
            j = i - 1
            while j >= 0 and start[i] - start[j] <= max_gap + 200:
                gap = start[i] - stop[j] - 1
                if 0 <= gap <= max_gap and best[j] - gap_cost * gap + own[i] > best[i]:
                    best[i], prev[i] = best[j] - gap_cost * gap + own[i], j
                j -= 1
        out, used = [], np.zeros(len(f), bool)
        for i in np.argsort(-best, kind="stable"):
            path, j = [], int(i)
            while j >= 0 and not used[j]:
                path.append(j)
                j = int(prev[j])
            if j >= 0 or not path:
                continue
            used[path] = True
            out.append((f["seq_name"].iloc[0], int(start[path[-1]]), int(stop[i]), len(path), float(best[i])))
        return pd.DataFrame(out, columns=["seq_name", "start", "stop", "n_hits", "score"])

    return hits.groupBy("seq_name").applyInPandas(run, CLUSTER)


def write_hmm(m: Hmm) -> str:
    import json

    return json.dumps({"names": m.names, "motif": m.motif, "emit": m.emit.tolist(), "trans": m.trans.tolist()})


def read_hmm(text: str) -> Hmm:
    import json

    d = json.loads(text)
    return Hmm(np.array(d["trans"]), np.array(d["emit"]), [tuple(x) for x in d["motif"]], d["names"])
