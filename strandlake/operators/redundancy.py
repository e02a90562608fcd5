"""Removing sequences that are too similar to ones that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.symbols import words


def similar_pairs(df: DataFrame, name: str, seq: str = "seq", k: int = 8, least: float = 0.5) -> DataFrame:
    """a < b whose distinct words of ``k`` symbols are shared by ``least`` of the smaller set. Of the smaller set's words, rarest first,
    so few that the rest can't be enough meet all words of the larger: frequent words bring nobody together. Whoever meets is
    compared whole."""
    sets = df.select(F.col(name).alias("n"), F.array_distinct(words(seq, k)).alias("w")).withColumn("size", F.size("w")).where("size > 0")
    each = sets.select("n", "size", F.explode("w").alias("w"))
    held = each.groupBy("w").agg(F.count("*").alias("held")).where("held > 1")
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.col("held").asc_nulls_first(), "w"))
    first = each.join(held, "w", "left").withColumn("place", place).where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1) & F.col("held").isNotNull())
    met = first.select(F.col("n").alias("x"), F.col("size").alias("sx"), "w").join(each.select(F.col("n").alias("y"), F.col("size").alias("sy"), "w"), "w")
    met = met.where("x <> y and sx <= sy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    both = met.join(sets.select(F.col("n").alias("a"), F.col("w").alias("wa"), F.col("size").alias("sa")), "a").join(sets.select(F.col("n").alias("b"), F.col("w").alias("wb"), F.col("size").alias("sb")), "b")
    return both.where(F.size(F.array_intersect("wa", "wb")) >= least * F.least("sa", "sb")).select("a", "b")


def keep_first(names: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """What going through the names in order and keeping each that pairs with none kept would leave, in rounds: a name is kept
    once all lesser ones it pairs with are gone, and gone once one of them is kept."""
    left, kept = pairs.distinct().checkpoint(), None
    open_ = names.select(name).distinct()
    while True:
        free = open_.join(left.select(F.col("b").alias(name)).distinct(), name, "left_anti").checkpoint()
        kept = free if kept is None else kept.unionByName(free)
        gone = left.join(free.select(F.col(name).alias("a")), "a", "left_semi").select(F.col("b").alias(name)).distinct()
        open_ = open_.join(free, name, "left_anti").join(gone, name, "left_anti").checkpoint()
        if open_.limit(1).count() == 0:
            return kept
        live = lambda c: open_.select(F.col(name).alias(c))  # noqa: B023, E731
        left = left.join(live("a"), "a", "left_semi").join(live("b"), "b", "left_semi").select("a", "b").checkpoint()


def non_redundant(df: DataFrame, name: str, seq: str = "seq", k: int = 8, least: float = 0.5) -> DataFrame:
    """Rows that remain if names are gone through in order and each is kept that is similar to none kept. Copies of a sequence
    stand or fall with the first of them, so only that one is compared."""
    firsts = df.groupBy(F.col(seq)).agg(F.min(name).alias(name))
    short = F.size(words(seq, k)) <= 0  # similar to nothing, not even to copies
    kept = keep_first(firsts, similar_pairs(firsts, name, seq, k, least), name)
    return df.where(short).unionByName(df.where(~short).join(kept, name, "left_semi"))
