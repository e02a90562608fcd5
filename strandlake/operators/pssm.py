"""Integer position-specific scoring matrices with exact p-value tables, built on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandlake.operators.motifs import Motif

RANGE = 1000


def nint(x: np.ndarray) -> np.ndarray:
    """Nearest whole number, halves away from zero."""
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


@dataclass(frozen=True)
class Pssm:
    """``scores``: width x symbols, from 0 to about RANGE; ``pv[s]``: chance that a background word scores ``s`` or more."""

    motif_id: str
    scores: np.ndarray
    offset: float
    scale: float
    pv: np.ndarray
    symbols: str = "ACGT"

    @property
    def width(self) -> int:
        return len(self.scores)

    def raw(self, score):
        return score / self.scale + self.width * self.offset


def distribution(scores: np.ndarray, bg: np.ndarray) -> np.ndarray:
    """Chance of each total score, column after column."""
    pdf = np.ones(1)
    for col in scores:
        out = np.zeros(len(pdf) + int(col.max()))
        for s, b in zip(col, bg, strict=True):
            out[s : s + len(pdf)] += b * pdf
        pdf = out
    return pdf


def tail(pdf: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, np.cumsum(pdf[::-1])[::-1])


def scaled(raw: np.ndarray, size: int = RANGE) -> tuple[np.ndarray, float, float]:
    """Whole scores, offset and scale: offset floor(min), scale floor(size / (max - min))."""
    low, high = float(raw.min()), float(raw.max())
    if low == high:
        low = high - 1
    offset = float(np.floor(low))
    scale = float(np.floor(size / (high - low)))
    return nint((raw - offset) * scale), offset, scale


def build(motif: Motif, bg: np.ndarray, pseudo: float = 0.1, size: int = RANGE) -> Pssm:
    odds = np.log2(motif.with_pseudocount(bg, pseudo).freqs / bg)
    scores, offset, scale = scaled(odds, size)
    return Pssm(motif.id, scores, offset, scale, tail(distribution(scores, bg)), motif.alphabet.core)


def from_integers(motif_id: str, scores: list[list[int]], bg: np.ndarray, symbols: str = "ACGT") -> Pssm:
    s = np.array(scores, dtype=np.int64)
    return Pssm(motif_id, s, 0.0, 1.0, tail(distribution(s, bg)), symbols)


def sequence_pv(pssm: Pssm, freqs: np.ndarray) -> np.ndarray:
    """P-values under a sequence's own composition."""
    return tail(distribution(pssm.scores, freqs))


def prior_log_odds(prior: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log2(alpha p / (1 - alpha p))."""
    return np.log2(alpha * prior / (1 - alpha * prior))


def with_prior_distribution(pssm: Pssm, bins: np.ndarray, low: float, high: float, alpha: float = 1.0) -> np.ndarray:
    """P-values by score of a matrix to which the log odds of a prior are added, as of one more column: ``bins`` says how priors
    are distributed between ``low`` and ``high`` (at the middles of so many parts; all at ``low`` if they are the same)."""
    middle = low + (np.arange(len(bins)) + 0.5) * ((high - low) / len(bins)) if high > low else np.full(len(bins), low)
    at = nint((prior_log_odds(middle, alpha) - pssm.offset) * pssm.scale)
    column = np.zeros(max(0, int(at.max())) + 1)
    np.add.at(column, np.maximum(at, 0), bins / bins.sum())
    pdf = -np.diff(np.append(pssm.pv, 0.0))
    return tail(np.convolve(pdf, column))
