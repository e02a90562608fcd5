"""Multiple alignments as rows (aln_id, species, col, base)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups of residues of which an alignment column that holds no others counts as strongly or weakly conserved.
STRONG = "STA NEQK NHQK NDEQ QHRK MILV MILF HY FYW".split()
WEAK = "CSA ATV SAG STNK STPA SGND SNDEQK NDEQHK NEQHRK FVLIM HFY".split()


def _gap(base: str = "base") -> Column:
    return F.col(base).isin("-", ".")


def cut(cols: DataFrame, start: int, width: int) -> DataFrame:
    """Columns ``start`` (from 1) to ``start`` + ``width`` - 1, numbered from 1."""
    return cols.where(F.col("col").between(start, start + width - 1)).withColumn("col", F.col("col") - (start - 1))


def conserved(cols: DataFrame) -> DataFrame:
    """aln_id, identical, strong, weak, other: columns of one residue, of one strong or weak group, and of neither, each column in
    the first that fits; columns with a gap are other."""
    sets = cols.groupBy("aln_id", "col").agg(F.collect_set(F.upper("base")).alias("set"), F.max(_gap()).alias("gap"))
    within = lambda groups: F.greatest(*[F.size(F.array_except("set", F.array(*[F.lit(c) for c in g]))) == 0 for g in groups])
    kind = F.when(F.col("gap"), "other").when(F.size("set") == 1, "identical").when(within(STRONG), "strong").when(within(WEAK), "weak").otherwise("other")
    kinds = ("identical", "strong", "weak", "other")
    return sets.groupBy("aln_id").agg(*[F.count(F.when(kind == k, 1)).alias(k) for k in kinds])


def column_tests(cols: DataFrame, core: str = "ACGT") -> DataFrame:
    """aln_id, col, gap, ambiguous: whether any species has a gap, or a symbol outside of the core that is none."""
    known = F.upper("base").isin(*core)
    return cols.groupBy("aln_id", "col").agg(F.max(_gap()).alias("gap"), F.max(~known & ~_gap()).alias("ambiguous"))


def relative_entropy(cols: DataFrame, bg: dict[str, float]) -> DataFrame:
    """aln_id, bits: sum over columns and core symbols of f log2(f / bg), f among the column's core symbols."""
    table = F.create_map(*[F.lit(x) for kv in bg.items() for x in kv])
    n = cols.where(F.upper("base").isin(*bg)).groupBy("aln_id", "col", F.upper("base").alias("sym")).agg(F.count("*").alias("n"))
    # sum f log2 (f / bg) with f = n / N is (sum n log2 (n / bg)) / N - log2 N, so one more aggregation does.
    c = n.groupBy("aln_id", "col").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2(F.col("n") / table[F.col("sym")])).alias("s"))
    return c.groupBy("aln_id").agg(F.sum(F.col("s") / F.col("all") - F.log2("all")).alias("bits"))


def mask_sites(df: DataFrame, sites: DataFrame, name: str, seq: str = "seq", symbol: str = "N") -> DataFrame:
    """Sequences with the symbols from start to stop of each site (``name``, start, stop) replaced."""
    spans = sites.groupBy(name).agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))  # the sites of one sequence
    whole = F.aggregate(
        "__spans", F.col(seq), lambda s, x: F.overlay(s, F.repeat(F.lit(symbol), x["stop"] - x["start"] + 1), x["start"])
    )
    return df.join(spans, name, "left").withColumn(seq, F.when(F.col("__spans").isNotNull(), whole).otherwise(F.col(seq))).drop("__spans")
