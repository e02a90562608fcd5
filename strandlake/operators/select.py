"""Filters and samples: of hits by q-value, E-value or number; of sequences by length, symbols or chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.ranking import _running, top_k
from strandlake.operators.sequences import modal_length

#: Chances that a Poisson variable of mean 1 is at most 0, 1, 2 ... (beyond the last, 2e-9).
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745216, 0.9999999899522336, 0.9999999991683892]


def below_q(hits: DataFrame, most: float, q: str = "qvalue") -> DataFrame:
    return hits.where(F.col(q) <= most)


def gate(scored: DataFrame, sequences: DataFrame, max_e: float, p: str = "pvalue") -> DataFrame:
    """Adds evalue, the p-value times the number of ``sequences``, and keeps what is below ``max_e``. A running count of
    sequences, as a reader of a stream has it, lets more through at first and ends with these."""
    n = sequences.agg(F.count("*").alias("__n"))  # one row
    return scored.crossJoin(F.broadcast(n)).withColumn("evalue", F.col(p) * F.col("__n")).drop("__n").where(F.col("evalue") < max_e)


def equal_length(df: DataFrame, seq: str = "seq", length: int | None = None) -> DataFrame:
    """Sequences of one length: ``length``, or the most frequent one (the lesser of several)."""
    if length is not None:
        return df.where(F.length(seq) == length)
    one = modal_length(df, seq).select(F.col("len").alias("__len"))
    return df.join(F.broadcast(one), F.length(seq) == F.col("__len"), "left_semi")


def long_enough(df: DataFrame, width: int, seq: str = "seq") -> DataFrame:
    return df.where(F.length(seq) >= width)


def passing(df: DataFrame, column: str, op: str, value: float) -> DataFrame:
    """Rows whose column stands to ``value`` as ``op`` says: lt, le, eq, ge or gt. Nulls don't pass."""
    c = F.col(column)
    return df.where({"lt": c < value, "le": c <= value, "eq": c == value, "ge": c >= value, "gt": c > value}[op])


def known_only(df: DataFrame, seq: str = "seq", unknown: str = "X") -> DataFrame:
    """Sequences without any of the symbols ``unknown``."""
    return df.where(~F.coalesce(F.upper(seq).rlike(f"[{unknown}]"), F.lit(False)))


def bounded(hits: DataFrame, most: int, p: str = "pvalue", by: list[str] | None = None) -> DataFrame:
    """The best hits, ``most`` of each group at most: those whose p-value, all that tie with it included, is within the number.
    Counts are made by p-value, so no group is sorted in one task."""
    by = by or []
    counts = hits.groupBy(*by, p).agg(F.count("*").alias("n"))
    within = _running(counts, p, by).where(F.col("before") + F.col("n") <= most).select(*by, p)
    return hits.join(within, [*by, p], "left_semi")


def chance(key: str, seed: int | str) -> Column:
    """A number from 0 to below 1, by hash of key and seed, that any engine with md5 can make."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def reservoir(df: DataFrame, k: int, key: str, seed: int = 1) -> DataFrame:
    """``k`` rows, each as likely as any other: those of least hash. A top-k in every partition, then of these."""
    return df.orderBy(chance(key, seed), key).limit(k)


def bootstrap(df: DataFrame, key: str, seed: int = 1, out: str = "weight") -> DataFrame:
    """Adds how often a row is drawn when as many rows are drawn with replacement: Poisson with mean 1, row by row, without
    a shuffle."""
    return df.withColumn(out, sum((chance(key, seed) >= t).cast("int") for t in POISSON))


def groups(df: DataFrame, key: str, n: int, seed: int = 1, out: str = "group") -> DataFrame:
    """Cross-validation groups by hash, without a shuffle."""
    return df.withColumn(out, F.floor(chance(key, seed) * n).cast("int"))


def best_seeds(scored: DataFrame, size: int, score: str, by: list[str], name: str) -> DataFrame:
    """The ``size`` best seeds of each group, ties by name."""
    return top_k(scored, size, [F.desc(score), F.col(name)], by)


def merged(order: list[str], *frames: DataFrame) -> DataFrame:
    """Sorted frames as one, in order: a range partitioning merges any number of them."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(*order)
