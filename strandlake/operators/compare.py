"""Comparing motifs: column metrics, and the significance of the best alignment under a null of target columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.motifs import Motif
from strandlake.operators.ranking import qvalues

BINS = 100


def euclid(x: Column, y: Column) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def sandelin(x: Column, y: Column) -> Column:
    return 2 - F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def kullback(x: Column, y: Column) -> Column:
    return -F.aggregate(F.zip_with(x, y, lambda a, b: a * F.log10(a / b) + b * F.log10(b / a)), F.lit(0.0), lambda s, v: s + v) / 2


def pearson(x: Column, y: Column) -> Column:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    n = F.size(x)
    sx, sy = total(x), total(y)
    sxy, sxx, syy = total(F.zip_with(x, y, lambda a, b: a * b)), total(F.transform(x, lambda a: a * a)), total(F.transform(y, lambda a: a * a))
    return (n * sxy - sx * sy) / (F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy))


def column_scores(q: np.ndarray, t: np.ndarray, metric: str = "pearson", bg: np.ndarray | None = None, nq: float = 20, nt: float = 20) -> np.ndarray:
    """Scores of every query column against every target column; larger is more alike."""
    if metric == "pearson":
        a, b = q - q.mean(axis=1, keepdims=True), t - t.mean(axis=1, keepdims=True)
        d = np.sqrt((a**2).sum(axis=1))[:, None] * np.sqrt((b**2).sum(axis=1))
        return np.where(d > 0, a @ b.T / np.where(d > 0, d, 1), 0)
    diff = ((q[:, None] - t[None]) ** 2).sum(axis=2)
    if metric == "ed":
        return -np.sqrt(diff)
    if metric == "sandelin":
        return 2 - diff
    q, t, bg = np.maximum(q, 1e-10), np.maximum(t, 1e-10), np.full(q.shape[1], 1 / q.shape[1]) if bg is None else bg
    if metric == "kullback":
        return -((q[:, None] * np.log10(q[:, None] / t)).sum(axis=2) + (t * np.log10(t / q[:, None])).sum(axis=2)) / 2
    if metric == "allr":
        return ((nq * q) @ np.log(t / bg).T + np.log(q / bg) @ (nt * t).T) / (nq + nt)
    if metric in ("llr1", "llr5", "blic1", "blic5"):
        both = (nq * q[:, None] + nt * t) / (nq + nt)
        like = nq * (q[:, None] * np.log(both / bg)).sum(axis=2) + nt * (t * np.log(both / bg)).sum(axis=2)
        apart = nq * (q * np.log(q / bg)).sum(axis=1)[:, None] + nt * (t * np.log(t / bg)).sum(axis=1)
        return 2 * like - apart if metric.startswith("blic") else like - apart
    raise ValueError(metric)


def _compare(query: Motif, targets: list[Motif], metric: str, min_overlap: int) -> list[tuple]:
    """Best alignment of each target, both strands: p-value from the convolved distribution of column scores, the chance
    that the best of all offsets and strands is as good."""
    sides = [(t.id, o, m) for t in targets for o, m in (("+", t), ("-", t.reverse_complement()))]
    pool = np.concatenate([m.freqs for _, o, m in sides if o == "+"])
    raw = column_scores(query.freqs, pool, metric)
    shift = np.sort(raw, axis=1)[:, raw.shape[1] // 2 : raw.shape[1] // 2 + 1]
    low, high = float((raw - shift).min()), float((raw - shift).max())
    scale = BINS / max(high - low, 1e-12)
    grid = lambda x: np.rint((x - low) * scale).astype(int)
    whole, zero = grid(raw - shift), grid(np.zeros(1))[0]
    w = query.width
    pv: dict[tuple[int, int], np.ndarray] = {}
    for a in range(w):
        pdf = np.ones(1)
        for b in range(a, w):
            own = np.bincount(whole[b], minlength=BINS + 1) / whole.shape[1]
            pdf = np.convolve(pdf, own)
            full = np.concatenate([np.zeros(zero * (w - (b - a + 1))), pdf])  # columns without a partner score zero
            pv[a, b] = np.minimum(1, np.cumsum(full[::-1])[::-1])
    out: dict[str, tuple] = {}
    for name, strand, m in sides:
        s = grid(column_scores(query.freqs, m.freqs, metric) - shift)
        best, tests = (-1, 0, 0, 1.0), 0
        spans = []
        for off in range(min_overlap - m.width, w - min_overlap + 1):
            a, b = max(0, off), min(w, off + m.width)
            total = int(s[np.arange(a, b), np.arange(a, b) - off].sum()) + zero * (w - (b - a))
            spans.append((a, b - 1))
            tests += 1
            best = max(best, (total, b - a, -off, 1.0))
        below = np.prod([1 - (pv[x][best[0]] if best[0] < len(pv[x]) else 0.0) for x in spans])
        p = 1 - below**2
        if name not in out or p < out[name][3]:
            out[name] = (query.id, name, -best[2], float(p), float(p) * len(targets), best[1], query.consensus(), m.consensus(), strand)
    return list(out.values())


FIELDS = "query_id string, target_id string, offset int, pvalue double, evalue double, overlap int, query_consensus string, target_consensus string, orientation string"


def compare(spark, queries: list[Motif], targets: list[Motif], metric: str = "pearson", min_overlap: int = 1, max_q: float | None = None) -> DataFrame:
    """Every query against every target; queries are spread over tasks, targets go with them."""
    def run(frames):
        for f in frames:
            for i in f["id"]:
                yield pd.DataFrame(_compare(queries[i], targets, metric, min_overlap), columns=[c.split()[0] for c in FIELDS.split(", ")])

    out = qvalues(spark.range(len(queries)).repartition(max(1, min(len(queries), 200))).mapInPandas(run, FIELDS), "pvalue")
    return out.where(F.col("qvalue") <= max_q) if max_q is not None else out


def group_motifs(compared: DataFrame, order: list[str], max_e: float = 0.05) -> list[tuple[str, str, int, str]]:
    """(motif, first of its group, offset, orientation): motifs are gone through in ``order``, the best first; each that is in no
    group opens one and takes in all ungrouped ones of which it is as alike as ``max_e``. ``compared``: the motifs against themselves,
    as ``compare`` leaves them, of which only the rows up to ``max_e`` come to the driver."""
    near: dict[str, list] = {}
    for r in compared.where(F.col("evalue") <= max_e).select("query_id", "target_id", "offset", "orientation", "evalue").collect():
        near.setdefault(r.query_id, []).append(r)
    out, done = [], set()
    for first in order:
        if first in done:
            continue
        done.add(first)
        out.append((first, first, 0, "+"))
        for r in sorted(near.get(first, []), key=lambda r: (r.evalue, order.index(r.target_id) if r.target_id in order else len(order))):
            if r.target_id in order and r.target_id not in done:
                done.add(r.target_id)
                out.append((r.target_id, first, r.offset, r.orientation))
    return out


def column_pairs(df: DataFrame, group: str, vector: str, metrics: dict) -> DataFrame:
    """Metrics between the vectors of a small table, each pair of keys once."""
    a, b = df.select(F.col(group).alias("a"), F.col(vector).alias("x")), df.select(F.col(group).alias("b"), F.col(vector).alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", *[f(F.col("x"), F.col("y")).alias(n) for n, f in metrics.items()])
