"""Motifs: as rows (motif_id, pos, sym, freq) for DataFrame work, as small matrices on the driver for tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.symbols import DNA, Alphabet


@dataclass(frozen=True)
class Motif:
    """``freqs``: width x core symbols."""

    id: str
    freqs: np.ndarray
    alt_id: str = ""
    nsites: float = 0.0
    evalue: float = 0.0
    url: str = ""
    alphabet: Alphabet = field(default=DNA, repr=False)

    @property
    def width(self) -> int:
        return len(self.freqs)

    def reverse_complement(self) -> Motif:
        order = [self.alphabet.core.index(self.alphabet.complement[s]) for s in self.alphabet.core]
        return replace(self, freqs=self.freqs[::-1][:, order])

    def with_pseudocount(self, bg: np.ndarray, c: float, default_sites: float = 20.0) -> Motif:
        """(f n + c bg) / (n + c)."""
        n = self.nsites if self.nsites > 0 else default_sites
        return replace(self, freqs=(self.freqs * n + c * bg) / (n + c))

    def scores(self, bg: np.ndarray) -> np.ndarray:
        """100 x log2 odds."""
        with np.errstate(divide="ignore"):
            return 100 * np.log2(self.freqs / bg)

    @classmethod
    def from_scores(cls, name: str, scores: np.ndarray, bg: np.ndarray) -> Motif:
        f = bg * np.exp2(scores / 100)
        return cls(name, f / f.sum(axis=1, keepdims=True))

    def information(self) -> np.ndarray:
        """Bits of each column: log2 k + sum f log2 f."""
        f = np.where(self.freqs > 0, self.freqs, 1.0)
        return np.log2(self.freqs.shape[1]) + (self.freqs * np.log2(f)).sum(axis=1)

    def trimmed(self, bits: float) -> Motif:
        """Without the leading and trailing columns of less than ``bits``."""
        keep = np.flatnonzero(self.information() >= bits)
        return replace(self, freqs=self.freqs[keep[0] : keep[-1] + 1] if len(keep) else self.freqs[:0])

    def consensus(self) -> str:
        return "".join(self.alphabet.core[i] for i in self.freqs.argmax(axis=1))

    def iupac(self) -> str:
        """Each column's code for the symbols of at least half the column's largest frequency."""
        out = []
        for row in self.freqs:
            own = "".join(s for s, f in zip(self.alphabet.core, row, strict=True) if f >= row.max() / 2)
            out.append(own if len(own) == 1 else next((c for c, m in self.alphabet.comprises.items() if set(m) == set(own)), "N"))
        return "".join(out)

    def shuffled_columns(self, seed: int) -> Motif:
        return replace(self, freqs=self.freqs[np.random.default_rng(seed).permutation(self.width)])


def motif_rows(spark: SparkSession, motifs: list[Motif]) -> DataFrame:
    rows = [(m.id, p + 1, s, float(m.freqs[p, j])) for m in motifs for p in range(m.width) for j, s in enumerate(m.alphabet.core)]
    return spark.createDataFrame(rows, "motif_id string, pos int, sym string, freq double")


def from_rows(df: DataFrame, alphabet: Alphabet = DNA) -> list[Motif]:
    """Motifs of a small table of rows."""
    cells: dict[str, dict[tuple[int, str], float]] = {}
    for r in df.select("motif_id", "pos", "sym", "freq").collect():
        cells.setdefault(r.motif_id, {})[r.pos, r.sym] = r.freq
    return [Motif(k, np.array([[c.get((p, s), 0.0) for s in alphabet.core] for p in range(1, max(p for p, _ in c) + 1)]), alphabet=alphabet) for k, c in sorted(cells.items())]


def normalise(df: DataFrame, value: str = "n", by: tuple[str, ...] = ("motif_id", "pos")) -> DataFrame:
    return df.withColumn("freq", F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def pseudocount(df: DataFrame, nsites: float, c: float, bg: dict[str, float]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in bg.items() for x in kv])
    return df.withColumn("freq", (F.col("freq") * nsites + c * table[F.col("sym")]) / (nsites + c))


def log_odds(df: DataFrame, bg: dict[str, float]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in bg.items() for x in kv])
    return df.withColumn("score", 100 * F.log2(F.col("freq") / table[F.col("sym")]))


def information(df: DataFrame, size: int, by: tuple[str, ...] = ("motif_id",)) -> DataFrame:
    """Bits of each column."""
    f = F.col("freq")
    return df.groupBy(*by, "pos").agg((F.log2(F.lit(float(size))) + F.sum(F.when(f > 0, f * F.log2(f)).otherwise(0.0))).alias("bits"))


def trim_bounds(df: DataFrame, size: int, least: float) -> DataFrame:
    """First and last column of at least ``least`` bits."""
    return information(df, size).where(F.col("bits") >= least).groupBy("motif_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def consensus(df: DataFrame) -> DataFrame:
    """Each motif's most frequent symbols, ties to the lesser symbol."""
    top = df.groupBy("motif_id", "pos").agg(F.max_by("sym", F.struct("freq", (-F.ascii("sym")).alias("s"))).alias("sym"))
    return top.groupBy("motif_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]), "").alias("consensus"))


def reverse_complement_rows(df: DataFrame, alphabet: Alphabet = DNA) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in alphabet.complement.items() for x in kv])
    return df.select("motif_id", (F.max("pos").over(Window.partitionBy("motif_id")) + 1 - F.col("pos")).alias("pos"), pairs[F.col("sym")].alias("sym"), "freq")


def remap_rows(df: DataFrame, symbols: str, by: tuple[str, ...] = ("motif_id",)) -> DataFrame:
    """Motif rows over another alphabet's core ``symbols``: what it lacks goes, what it adds has frequency 0."""
    every = df.select(*by, "pos").distinct().withColumn("sym", F.explode(F.array(*[F.lit(s) for s in symbols])))
    return every.join(df.select(*by, "pos", "sym", "freq"), [*by, "pos", "sym"], "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))


def renamed(df: DataFrame, numbers: bool = False) -> DataFrame:
    """motif_id, new_id: motifs numbered in order of their ids, or named by their consensus."""
    if not numbers:
        return consensus(df).select("motif_id", F.col("consensus").alias("new_id"))
    ids = df.select("motif_id").distinct()  # a row for each motif
    return ids.select("motif_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("motif_id")).cast("string").alias("new_id"))


def union_rows(**databases: DataFrame) -> DataFrame:
    """Motif rows of several databases, ``db`` before each."""
    out = None
    for name, rows in databases.items():
        own = rows.select(F.lit(name).alias("db"), "motif_id", "pos", "sym", "freq")
        out = own if out is None else out.unionByName(own)
    return out


def correlation(a: Motif, b: Motif) -> float:
    """Largest mean column correlation over alignments of the shorter within the longer."""
    if a.width > b.width:
        a, b = b, a
    best = -1.0
    for s in range(b.width - a.width + 1):
        x, y = a.freqs - a.freqs.mean(axis=1, keepdims=True), b.freqs[s : s + a.width] - b.freqs[s : s + a.width].mean(axis=1, keepdims=True)
        d = np.sqrt((x**2).sum(axis=1) * (y**2).sum(axis=1))
        best = max(best, float((np.where(d > 0, (x * y).sum(axis=1) / np.where(d > 0, d, 1), 0)).mean()))
    return best


def drop_correlated(motifs: list[Motif], most: float = 0.6) -> list[Motif]:
    """Greedy, in order: a motif stays unless it correlates with one that stays."""
    kept: list[Motif] = []
    for m in motifs:
        if all(correlation(m, k) <= most for k in kept):
            kept.append(m)
    return kept


def select(motifs: list[Motif], ids: list[str] | None = None, max_evalue: float | None = None, include: str | None = None, exclude: str | None = None, first: int | None = None) -> list[Motif]:
    from fnmatch import fnmatch

    out = [m for m in motifs if (ids is None or m.id in ids) and (max_evalue is None or m.evalue <= max_evalue) and (include is None or fnmatch(m.id, include)) and not (exclude and fnmatch(m.id, exclude))]
    return out[:first] if first is not None else out
