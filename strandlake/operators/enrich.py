"""Enrichment: of words in positives, of hits at the top of a ranking, of sites at positions and spacings, of annotations."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.special import log_binomial_tail, log_binomial_udf, log_fisher_udf, log_multihg, ranksum
from strandlake.functions.symbols import Alphabet
from strandlake.operators.ranking import average_ranks
from strandlake.operators.sequences import word_presence


def word_enrichment(pos: DataFrame, neg: DataFrame, k: int, name: str, seq: str = "seq", alphabet: Alphabet | None = None, test: Callable = log_fisher_udf) -> DataFrame:
    """word, pos_hits, pos_total, neg_hits, neg_total, log_p: Fisher's exact test of presence, one-sided."""
    p, n = (word_presence(d, k, name, seq, alphabet).withColumnRenamed("n_seqs", c) for d, c in ((pos, "pos_hits"), (neg, "neg_hits")))
    totals = pos.agg(F.countDistinct(name).alias("pos_total")).crossJoin(neg.agg(F.countDistinct(name).alias("neg_total")))  # one row
    both = p.join(n, "word", "left").withColumn("neg_hits", F.coalesce("neg_hits", F.lit(0).cast("bigint"))).crossJoin(F.broadcast(totals))
    return both.withColumn("log_p", test("pos_hits", "pos_total", "neg_hits", "neg_total"))


def partition_scan(ranked: DataFrame, by: str, rank: str, hit: Column) -> DataFrame:
    """by, rank, tp, fp, n, hits: for every prefix of each group's ranking, hits within and beyond, in one pass."""
    w = Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(by)
    h = hit.cast("bigint")
    out = ranked.select(by, rank, F.sum(h).over(w).alias("tp"), F.count("*").over(w).alias("top"), F.sum(h).over(every).alias("hits"), F.count("*").over(every).alias("n"))
    return out.withColumn("fp", F.col("hits") - F.col("tp"))


def best_threshold(pos: DataFrame, neg: DataFrame, by: str, score: str) -> DataFrame:
    """by, score, pos_hits, pos_total, neg_hits, neg_total, log_p: for each motif the threshold of ``score`` at which sequences of ``pos``
    (a row for each motif and sequence, its best score) stand out most against those of ``neg``, by Fisher's test; of equal ones the
    highest. Only counts of distinct scores are put in order."""
    n = pos.groupBy(by, score).agg(F.count("*").alias("p")).withColumn("q", F.lit(0).cast("bigint"))
    n = n.unionByName(neg.groupBy(by, score).agg(F.count("*").alias("q")).withColumn("p", F.lit(0).cast("bigint"))).groupBy(by, score).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    w, every = Window.partitionBy(by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    at = n.select(by, score, F.sum("p").over(w).alias("pos_hits"), F.sum("p").over(every).alias("pos_total"), F.sum("q").over(w).alias("neg_hits"), F.sum("q").over(every).alias("neg_total"))
    at = at.withColumn("log_p", log_fisher_udf("pos_hits", "pos_total", "neg_hits", "neg_total"))
    found = F.struct(score, "pos_hits", "pos_total", "neg_hits", "neg_total", "log_p")
    return at.groupBy(by).agg(F.min_by(found, F.struct(F.round("log_p", 9), -F.col(score))).alias("b")).select(by, "b.*")


def best_partition(scan: DataFrame, by: str, rank: str, tests: int = 1) -> DataFrame:
    """The prefix of least Fisher p-value, corrected for partitions and tests: 1 - (1 - p)^(n tests)."""
    p = scan.where(F.col("top") < F.col("n")).withColumn("log_p", log_fisher_udf("tp", "top", "fp", F.col("n") - F.col("top")))
    best = p.groupBy(by).agg(F.min_by(F.struct(rank, "tp", "top", "hits", "n", "log_p"), F.struct(F.round("log_p", 9), F.col(rank))).alias("b")).select(by, "b.*")
    return best.withColumn("corrected_p", -F.expm1(F.col("n") * tests * F.log1p(-F.least(F.exp("log_p"), F.lit(1 - 1e-16)))))


def set_enrichment(scored: DataFrame, by: str, score: str, positive: str, method: str = "ranksum") -> DataFrame:
    """by, pvalue: are the positives' scores larger? ``ranksum`` by mean ranks; ``multihg`` by classes 0, 1, 2 or more."""
    if method == "ranksum":
        r = average_ranks(scored, score, [by])
        s = r.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("int")).alias("na"), F.sum(F.when(F.col(positive), F.col("rank")).otherwise(0.0)).alias("ta"))

        @F.pandas_udf("double")
        def right(n: pd.Series, na: pd.Series, ta: pd.Series) -> pd.Series:
            return pd.Series([ranksum(int(a), int(b), float(c))["right"] for a, b, c in zip(n, na, ta, strict=True)])

        return s.select(by, right("n", "na", "ta").alias("pvalue"))
    level = F.least(F.col(score).cast("int"), F.lit(2))
    s = scored.groupBy(by).agg(*[F.count(F.when((level == k) & c, 1)).alias(f"{n}{k}") for k in range(3) for n, c in (("a", F.lit(True)), ("p", F.col(positive)))])

    @F.pandas_udf("double")
    def tail(a0: pd.Series, a1: pd.Series, a2: pd.Series, p0: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.Series:
        return pd.Series([math.exp(log_multihg([int(x) for x in r[:3]], [int(x) for x in r[3:]])) for r in zip(a0, a1, a2, p0, p1, p2, strict=True)])

    return s.select(by, tail("a0", "a1", "a2", "p0", "p1", "p2").alias("pvalue"))


def position_histogram(sites: DataFrame, by: str = "motif_id", seq: str = "seq_name", centre: str = "centre") -> DataFrame:
    """by, centre, weight: best sites, each of k that tie counting 1/k."""
    w = F.lit(1.0) / F.count("*").over(Window.partitionBy(by, seq))
    return sites.withColumn("w", w).groupBy(by, centre).agg(F.sum("w").alias("weight"))


def central_windows(hist: DataFrame, length: int, width: int, by: str = "motif_id") -> DataFrame:
    """``centre``: where a site starts, from 0. by, size, weight, log_p: for every window around the middle, the weight of sites within (from running sums over
    distances) and the binomial tail of so many among the bins it covers."""
    bins = length - width + 1
    off = F.abs(F.col("centre") - (length - width) / 2.0)
    d = hist.groupBy(by, F.floor(off).cast("int").alias("dist")).agg(F.sum("weight").alias("w"))
    run = Window.partitionBy(by).orderBy("dist").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(by)
    out = d.select(by, (2 * F.col("dist") + 1).alias("size"), F.sum("w").over(run).alias("weight"), F.sum("w").over(every).alias("total"))
    k, n = F.floor(F.col("weight") + 0.5).cast("int"), F.floor(F.col("total") + 0.5).cast("int")
    return out.withColumn("log_p", log_binomial_udf(k, n, F.least(F.col("size") / bins, F.lit(1.0))))


def middle_distances(sites: DataFrame, lengths: DataFrame, by: str = "motif_id", seq: str = "seq_name") -> DataFrame:
    """by, size, weight: as ``central_windows``, for sequences of any lengths (``lengths``: ``seq``, n): weights of best sites by the
    distance of a site's middle from that of its own sequence."""
    w = F.lit(1.0) / F.count("*").over(Window.partitionBy(by, seq))
    off = F.abs(F.col("start") - 1 - (F.col("n") - (F.col("stop") - F.col("start") + 1)) / 2.0)
    d = sites.withColumn("w", w).join(lengths, seq).groupBy(by, F.floor(off).cast("int").alias("dist")).agg(F.sum("w").alias("w"))
    run = Window.partitionBy(by).orderBy("dist").rowsBetween(Window.unboundedPreceding, 0)  # a row for each distance
    return d.select(by, (2 * F.col("dist") + 1).alias("size"), F.sum("w").over(run).alias("weight"))


def local_windows(hist: DataFrame, bins: int, least: int = 1, most: int | None = None, by: str = "motif_id", centre: str = "centre") -> DataFrame:
    """by, first, last, weight, total, log_p: for every window of ``least`` to ``most`` bins (from 0 on) the weight within, by running
    sums, and the binomial tail of so many. Rows are as many as windows, whatever the sequences."""
    every = hist.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    dense = every.join(hist.select(by, F.col(centre).cast("int").alias("bin"), "weight"), [by, "bin"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    run = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = dense.select(by, "bin", F.sum("weight").over(run).alias("upto"), F.sum("weight").over(Window.partitionBy(by)).alias("total"))
    ends = sums.select(by, F.col("bin").alias("last"), "upto", "total", F.explode(F.sequence(F.lit(least), F.lit(min(most or bins, bins)))).alias("size"))
    ends = ends.withColumn("first", F.col("last") - F.col("size") + 1).where("first >= 0")
    before = sums.select(by, (F.col("bin") + 1).alias("first"), F.col("upto").alias("before"))
    out = ends.join(before, [by, "first"], "left").withColumn("weight", F.col("upto") - F.coalesce("before", F.lit(0.0)))
    k, n = F.floor(F.col("weight") + 0.5).cast("int"), F.floor(F.col("total") + 0.5).cast("int")
    return out.select(by, "first", "last", "weight", "total", log_binomial_udf(k, n, F.col("size") / bins).alias("log_p"))


def against_controls(windows: DataFrame, controls: DataFrame, by: str = "motif_id") -> DataFrame:
    """Windows of primary and control sequences by their place: adds control weight and total, and Fisher's test of both."""
    other = controls.select(by, "first", "last", F.col("weight").alias("control_weight"), F.col("total").alias("control_total"))
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("bigint")
    both = windows.join(other, [by, "first", "last"], "left").fillna(0.0, ["control_weight", "control_total"])
    return both.withColumn("log_fisher", log_fisher_udf(whole("weight"), whole("total"), whole("control_weight"), whole("control_total")))


def regression_enrichment(scores: DataFrame, by: str, key: str, x: str, y: str, repeats: int = 10, seed: int = 1) -> DataFrame:
    """by, slope, intercept, r2, below, pvalue: regression of ``y`` on ``x`` in each group, and how often it fits as well when ``y`` is
    dealt anew among the group's rows. A turn's order is that of hashes; places are made by distributed ranks, and rows meet
    by place, so that no group is sorted in one task. ``key`` is unique in a group."""
    own = scores.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    placed = average_ranks(scores.select(by, key, y), key, [by]).select(by, F.col("rank").alias("place"), F.col(y).alias("dealt"))
    turns = scores.select(by, key, x, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("turn"))
    at = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("turn").cast("string"), F.col(key).cast("string")).cast("binary"))
    turns = turns.withColumn("h", F.conv(F.substring(at, 1, 13), 16, 10).cast("bigint"))
    turns = average_ranks(turns, "h", [by, "turn"]).withColumnRenamed("rank", "place")
    null = turns.join(placed, [by, "place"]).groupBy(by, "turn").agg(F.regr_r2("dealt", x).alias("null"))
    worse = null.join(own, by).groupBy(by).agg(F.sum((F.col("null") >= F.col("r2")).cast("bigint")).alias("below"))
    return own.join(worse, by).withColumn("pvalue", (F.col("below") + 1) / F.lit(repeats + 1.0))


def marked(terms: DataFrame, above: DataFrame, term: str, child: str, parent: str) -> DataFrame:
    """``term``, n_above, n_below, implied, for terms of a hierarchy whose closure is ``above`` (child, parent): how many of the listed
    terms stand above and below, and whether a more special one among them implies it."""
    listed = terms.select(F.col(term).alias("t")).distinct()
    pairs = above.join(listed.withColumnRenamed("t", child), child, "left_semi").join(listed.withColumnRenamed("t", parent), parent, "left_semi").distinct()
    up = pairs.groupBy(F.col(child).alias("t")).agg(F.count("*").alias("n_above"))
    down = pairs.groupBy(F.col(parent).alias("t")).agg(F.count("*").alias("n_below"))
    out = listed.join(up, "t", "left").join(down, "t", "left").fillna(0, ["n_above", "n_below"])
    return out.select(F.col("t").alias(term), "n_above", "n_below", (F.col("n_below") > 0).alias("implied"))


def spacings(primary: DataFrame, secondary: DataFrame, margin: int, seq: str = "seq_name") -> DataFrame:
    """seq, gap, quadrant: secondary sites within ``margin`` of the primary. Quadrants: same (0) or opposite (1) strand, plus
    2 if downstream as the primary's strand reads. Sites meet in equal bins of ``margin`` symbols, then by distance."""
    p = primary.select(seq, F.col("start").alias("ps"), F.col("stop").alias("pe"), F.col("strand").alias("pst"), F.explode(F.array(*[F.floor(F.col("start") / margin) + i for i in (-1, 0, 1)])).alias("bin"))
    s = secondary.select(seq, "start", "stop", "strand", F.floor(F.col("start") / margin).alias("bin"))
    both = p.join(s, [seq, "bin"])
    right, left = F.col("start") > F.col("pe"), F.col("stop") < F.col("ps")
    gap = F.when(right, F.col("start") - F.col("pe") - 1).when(left, F.col("ps") - F.col("stop") - 1)
    down = (right & (F.col("pst") == "+")) | (left & (F.col("pst") == "-"))
    quadrant = (F.col("pst") != F.col("strand")).cast("int") + 2 * down.cast("int")
    return both.withColumn("gap", gap).where(F.col("gap").between(0, margin - 1)).select(seq, "gap", quadrant.alias("quadrant"))


#: Each quadrant alone; strand or side alone; both strands of a side read as one palindrome; all.
ORIENTATIONS = [("same_up", [0]), ("opposite_up", [1]), ("same_down", [2]), ("opposite_down", [3]), ("same", [0, 2]), ("opposite", [1, 3]), ("up", [0, 1]), ("down", [2, 3]), ("any", [0, 1, 2, 3])]


def spacing_histogram(found: DataFrame, width: int = 1) -> DataFrame:
    """orientation, bin, n: counts by quadrant are made first, and summed into orientations."""
    q = found.groupBy("quadrant", F.floor(F.col("gap") / width).alias("bin")).agg(F.count("*").alias("n"))
    table = F.create_map(*[x for i in range(4) for x in (F.lit(i), F.array(*[F.lit(o) for o, qs in ORIENTATIONS if i in qs]))])
    return q.select(F.explode(table[F.col("quadrant")]).alias("orientation"), "bin", "n").groupBy("orientation", "bin").agg(F.sum("n").alias("n"))


def spacing_pvalues(hist: DataFrame, margin: int, width: int, bin_size: int = 1) -> DataFrame:
    """Adds pvalue: the binomial tail of a bin's count among all spacings of ``hist``, with the orientation's share of the
    places."""
    total = F.sum(F.when(F.col("orientation") == "any", F.col("n"))).over(Window.partitionBy(F.lit(0)))  # a row for each bin and orientation
    table = F.create_map(*[x for o, qs in ORIENTATIONS for x in (F.lit(o), F.lit(float(len(qs))))])
    share = table[F.col("orientation")] * bin_size / (4.0 * max(1, margin - width + 1))
    return hist.withColumn("__total", total).withColumn("pvalue", F.exp(log_binomial_udf("n", "__total", F.least(share, F.lit(1.0))))).drop("__total")


def redundant(a: set[str], b: set[str], joint: float = 0.5) -> bool:
    """Whether two sets of sequences share more than ``joint`` of the smaller."""
    return bool(a and b) and len(a & b) / min(len(a), len(b)) > joint


def term_ranksum(ranks: DataFrame, terms: DataFrame, gene: str, term: str, score: str) -> DataFrame:
    """term, n, na, ta: rank sum of each term's genes among all scored."""
    r = average_ranks(ranks, score)
    n = r.agg(F.count("*").alias("n"))
    s = terms.join(r, gene).groupBy(term).agg(F.count("*").alias("na"), F.sum("rank").alias("ta"))
    return s.crossJoin(F.broadcast(n))  # one row


def shuffled_nulls(ranks: DataFrame, terms: DataFrame, gene: str, term: str, score: str, times: int, seed: int = 1) -> DataFrame:
    """term, times, below: how often a shuffle of the scores gives a term a rank sum no larger than its own. Shuffles are
    orders by hash of gene and turn, each sorted apart."""
    own = term_ranksum(ranks, terms, gene, term, score).select(term, F.col("ta").alias("own"))
    turns = ranks.select(gene, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("turn"))
    at = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("turn").cast("string"), F.col(gene).cast("string")).cast("binary"))
    turns = turns.withColumn("h", F.conv(F.substring(at, 1, 13), 16, 10).cast("bigint"))
    turns = average_ranks(turns, "h", ["turn"])
    null = terms.join(turns, gene).groupBy(term, "turn").agg(F.sum("rank").alias("ta"))
    return null.join(own, term).groupBy(term).agg(F.count("*").alias("times"), F.sum((F.col("ta") <= F.col("own")).cast("bigint")).alias("below")).withColumn("pvalue", F.greatest("below", F.lit(1)) / (F.col("times") + 1))


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """child, parent for every ancestor: doubling, until nothing is new."""
    paths = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct()
    n = -1
    while n != (n := paths.count()):
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.p") == F.col("y.c")).select(F.col("x.c").alias("c"), F.col("y.p").alias("p"))
        paths = paths.unionByName(longer).distinct().checkpoint()
    return paths.select(F.col("c").alias(child), F.col("p").alias(parent))


def log_e_central(k: int, n: int, size: int, bins: int, tests: int) -> float:
    """Log of a window's p-value corrected for the windows tested."""
    p = log_binomial_tail(k, n, min(1.0, size / bins))
    return p + math.log(tests) if p < -20 else math.log(max(1e-300, -math.expm1(tests * math.log1p(-min(math.exp(p), 1 - 1e-16)))))
