"""Position-specific priors: intervals met by position, binned for equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, by: str, pos: str, start: str, span: str, bin_size: int, default: float, value: str = "value") -> DataFrame:
    """Points with the value of the interval [start, start + span) that holds them, else ``default``. Intervals are copied to
    the bins they touch, so the join is on equal bins."""
    last = F.floor((F.col(start) + F.col(span) - 1) / bin_size)
    right = intervals.select(by, start, span, value, F.explode(F.sequence(F.floor(F.col(start) / bin_size), last)).alias("__bin"))
    left = points.withColumn("__bin", F.floor(F.col(pos) / bin_size))
    held = left.join(right, (left[by] == right[by]) & (left["__bin"] == right["__bin"]) & (left[pos] >= right[start]) & (left[pos] < right[start] + right[span]), "left")
    return held.select(*[left[c] for c in points.columns], F.coalesce(right[value], F.lit(default)).alias(value))


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Left rows with the value of the last right row of the same group at or before them: both in one window, so neither
    side is joined row by row."""
    cols = [c for c in left.columns]
    both = left.select(*cols, F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side")).unionByName(
        right.select(by, at, F.col(value).alias("__v"), F.lit(0).alias("__side")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*cols, value)


def score_to_prior(y: Column, y_max: float | Column, n: float | Column, beta: float) -> Column:
    """a = (beta - 1) / (n - 1); prior = y (1 - a) / y_max + a, the least score counting as 0."""
    a = (F.lit(beta) - 1) / (n - 1)
    return y * (1 - a) / y_max + a


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n over the range of the values; the largest falls into the last."""
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def renormalise(df: DataFrame, by: str, pos: str, value: str, width: int) -> DataFrame:
    """Geometric mean over the ``width`` positions from each on, made to sum to 1 within a group."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(0, width - 1)
    df = df.withColumn("__g", F.when(F.count("*").over(w) == width, F.exp(F.avg(F.log(value)).over(w))))
    return df.withColumn(value, F.col("__g") / F.sum("__g").over(Window.partitionBy(by))).drop("__g")


def discriminative_prior(pos: DataFrame, neg: DataFrame, k: int, name: str, seq: str = "seq", low: float = 0.1, high: float = 0.9) -> DataFrame:
    """word, prior: the share of a word's occurrences that fall into positives, scaled to [low, high]."""
    from strandlake.operators.sequences import word_counts

    both = word_counts(pos, k, seq).withColumnRenamed("n", "p").join(word_counts(neg, k, seq).withColumnRenamed("n", "q"), "tuple", "full")
    share = both.select(F.col("tuple").alias("word"), (F.coalesce("p", F.lit(0)) / (F.coalesce("p", F.lit(0)) + F.coalesce("q", F.lit(0)))).alias("s"))
    edge = share.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), low + (F.col("s") - F.col("lo")) * (high - low) / (F.col("hi") - F.col("lo"))).otherwise(F.lit((low + high) / 2))
    return share.crossJoin(F.broadcast(edge)).select("word", scaled.alias("prior"))
