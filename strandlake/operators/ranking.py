"""Ranks, false discovery rates and empirical p-values, without sorting a table in one task.

Values are first counted by distinct value and spread over buckets of their range; running figures over buckets and over
the values of a bucket add up to global ones. Rows meet their figures again by an equi-join on the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def _one(by: list[str]) -> list[Column]:
    return [F.col(c) for c in by] or [F.lit(0)]


def _running(df: DataFrame, value: str, by: list[str], n: str = "n") -> DataFrame:
    """Adds before (sum of ``n`` over lesser values) and total, for a table of distinct values."""
    edge = df.groupBy(*by).agg(F.min(F.col(value).cast("double")).alias("__lo"), F.max(F.col(value).cast("double")).alias("__hi"), F.sum(n).alias("total"))
    df = df.join(edge, by) if by else df.crossJoin(F.broadcast(edge))  # one row
    spread = F.when(F.col("__hi") > F.col("__lo"), (F.col(value).cast("double") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    df = df.withColumn("__b", F.floor(spread * (BUCKETS - 1)))
    sums = df.groupBy(*by, "__b").agg(F.sum(n).alias("__n"))
    ahead = Window.partitionBy(*_one(by)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__b", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    own = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(sums, [*by, "__b"]).withColumn("before", F.col("__base") + F.coalesce(F.sum(n).over(own), F.lit(0)))
    return df.drop("__lo", "__hi", "__base")


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Adds ranks from 1, the mean rank where values tie. Null values have none."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranks = _running(counts, value, by).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value], "left").select(*df.columns, out)


def qvalues(df: DataFrame, p: str, by: list[str] | None = None, pi0: float = 1.0, total: Column | None = None, out: str = "qvalue") -> DataFrame:
    """Adds min over p' >= p of min(1, pi0 p' N / #{p <= p'}), N the number of p-values or ``total``. Ties share a value."""
    by = by or []
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("n"), *([F.max(total).alias("__all")] if total is not None else []))
    run = _running(counts, p, by)
    every = F.col("__all") if total is not None else F.col("total")
    run = run.withColumn("fdr", F.least(F.lit(1.0), pi0 * F.col(p) * every / (F.col("before") + F.col("n"))))
    least = run.groupBy(*by, "__b").agg(F.min("fdr").alias("__least"))
    later = Window.partitionBy(*_one(by)).orderBy("__b").rowsBetween(1, Window.unboundedFollowing)
    least = least.select(*by, "__b", F.min("__least").over(later).alias("__later"))
    here = Window.partitionBy(*by, "__b").orderBy(p).rowsBetween(0, Window.unboundedFollowing)
    q = run.join(least, [*by, "__b"]).select(*by, p, F.least(F.min("fdr").over(here), F.coalesce("__later", F.lit(1.0))).alias(out))
    return df.join(q, [*by, p], "left").select(*df.columns, out)


def raw_fdr(df: DataFrame, p: str, out: str = "fdr") -> DataFrame:
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("n"))
    run = _running(counts, p, [])
    return df.join(run.select(p, F.least(F.lit(1.0), F.col(p) * F.col("total") / (F.col("before") + F.col("n"))).alias(out)), p, "left")


def estimate_pi0(df: DataFrame, p: str, points: int = 100, top: float = 0.5) -> DataFrame:
    """lambda, pi0: the share of p-values at or above lambda, over 1 - lambda, on a grid up to ``top``."""
    grid = df.sparkSession.range(points).select(((F.col("id") + 1) / points * top).alias("lambda"))
    at = F.least(F.lit(points), F.floor(F.col(p) / (top / points) + 1e-12))
    counts = df.where(F.col(p).isNotNull()).groupBy(at.alias("b")).agg(F.count("*").alias("n"))  # at most points + 1 rows
    total = counts.agg(F.sum("n").alias("m"))
    above = grid.crossJoin(F.broadcast(counts)).where(F.col("b") >= F.round(F.col("lambda") * points / top)).groupBy("lambda").agg(F.sum("n").alias("k"))
    return grid.join(above, "lambda", "left").crossJoin(F.broadcast(total)).select("lambda", (F.coalesce("k", F.lit(0)) / ((1 - F.col("lambda")) * F.col("m"))).alias("pi0"))


def empirical_pvalues(observed: DataFrame, null: DataFrame, score: str, out: str = "pvalue") -> DataFrame:
    """Adds (null scores as good or better + 1) / (null scores + 1)."""
    both = observed.select(score, F.lit(0).alias("k")).unionByName(null.select(score, F.lit(1).alias("k"))).where(F.col(score).isNotNull())
    counts = both.groupBy(score).agg(F.sum("k").alias("n"))
    run = _running(counts, score, []).select(score, ((F.col("total") - F.col("before") + 1) / (F.col("total") + 1)).alias(out))
    return observed.join(run, score, "left")


def empirical_qvalues(observed: DataFrame, null: DataFrame, score: str, out: str = "qvalue") -> DataFrame:
    """Adds the least, over thresholds up to the score, of (share of null scores at or above) / (share of observed)."""
    both = observed.select(score, F.lit(0).alias("k")).unionByName(null.select(score, F.lit(1).alias("k"))).where(F.col(score).isNotNull())
    counts = both.groupBy(score).agg(F.sum("k").alias("n"), F.sum(1 - F.col("k")).alias("o"))
    nulls = _running(counts.select(score, "n"), score, []).select(score, (F.col("total") - F.col("before")).alias("null_up"), F.col("total").alias("nulls"))
    seen = _running(counts.select(score, F.col("o").alias("n")), score, []).select(score, (F.col("total") - F.col("before")).alias("obs_up"), F.col("total").alias("obs"), "__b")
    ratio = nulls.join(seen, score).withColumn("fdr", F.least(F.lit(1.0), F.when(F.col("obs_up") > 0, (F.col("null_up") / F.greatest(F.col("nulls"), F.lit(1))) / (F.col("obs_up") / F.col("obs"))).otherwise(1.0)))
    least = ratio.groupBy("__b").agg(F.min("fdr").alias("__least"))
    least = least.select("__b", F.min("__least").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"))
    here = Window.partitionBy("__b").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    q = ratio.join(least, "__b").select(score, F.least(F.min("fdr").over(here), F.coalesce("__earlier", F.lit(1.0))).alias(out))
    return observed.join(q, score, "left")


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str]) -> DataFrame:
    """The first ``k`` of each group; Spark limits groups before it shuffles them."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= k).drop("__k")


def best_with_ties(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    return df.join(df.groupBy(*by).agg(F.max(score).alias(score)), [*by, score])


def ranksum_by(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """One row: n, na, ta (rank sum of the positives), u, z of the normal approximation."""
    r = average_ranks(df.withColumn("__pos", positive.cast("int")), value).where(F.col("rank").isNotNull())
    s = r.agg(F.count("*").alias("n"), F.sum("__pos").alias("na"), F.sum(F.when(F.col("__pos") == 1, F.col("rank")).otherwise(0.0)).alias("ta"))
    n, na, ta = F.col("n"), F.col("na"), F.col("ta")
    return s.select("n", "na", "ta", (ta - na * (na + 1) / 2).alias("u"), ((ta - na * (n + 1) / 2) / F.sqrt(na * (n - na) * (n + 1) / 12.0)).alias("z"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho: Pearson's correlation of mean ranks."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_ranks(average_ranks(rows, x, out="rx"), y, out="ry")
    return ranked.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def regress(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, err: the root of the squared residuals' sum, over n."""
    sse = F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (F.sqrt(F.greatest(sse, F.lit(0.0))) / F.regr_count(y, x)).alias("err"))
