"""Diagrams of motifs in order, such as ``4-[+1]-15-[-2]-8``, and models made of them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.significance import spacing_pvalue
from strandlake.functions.special import qfast
from strandlake.operators.hmm import Hmm, build
from strandlake.operators.motifs import Motif

_PART = re.compile(r"(?P<gap>\d+)|(?P<open>[\[<])(?P<strand>[+-]?)(?P<motif>[^\[\]<>]+?)(?:\([^)]*\))?(?P<close>[\]>])")


def parse_diagram(text: str) -> list[tuple[int, str, str]]:
    """(symbols before, motif, strand) of each occurrence, brackets for strong ones, angles for weak ones; a last entry without a
    motif holds the symbols that follow."""
    out, gap, at = [], 0, 0
    text = re.sub(r"\s", "", text)
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m["open"] and (m["open"] == "[") != (m["close"] == "]")):
            raise ValueError(f"no diagram: {text!r}, at {at}")
        if m["gap"]:
            gap += int(m["gap"])
        else:
            out.append((gap, m["motif"], m["strand"] or "+"))
            gap = 0
        at = m.end()
        if at < len(text):
            if text[at] != "-" or at + 1 == len(text):
                raise ValueError(f"no diagram: {text!r}, at {at}")
            at += 1
    return [*out, (gap, "", "")]


def diagram_pvalues(sites: DataFrame, lengths: DataFrame, diagram: str, widths: dict[str, int], seq: str = "seq_name") -> DataFrame:
    """seq, spacings, pvalue: how well a sequence's sites (seq, motif_id, start; one for each motif) keep the spacings of
    ``diagram``, whose motifs differ. The spacings' p-values are multiplied and the product's chance is taken. ``lengths``: seq, len.
    Sequences that lack a motif, or are too short for a spacing, are left out."""
    parts = [p for p in parse_diagram(diagram) if p[1]]
    names = [m for _, m, _ in parts]
    if len(set(names)) < len(names) or len(names) < 2:
        raise ValueError("a diagram of two or more different motifs is wanted")
    wide = sites.groupBy(seq).pivot("motif_id", names).agg(F.min("start")).dropna(subset=names).join(lengths.select(seq, "len"), seq)
    each: list[Column] = []
    for (_, a, _), (gap, b, _) in zip(parts, parts[1:], strict=False):
        each.append(spacing_pvalue(F.lit(widths[a] + gap), F.col(b) - F.col(a), F.lit((widths[a] + widths[b]) // 2), F.col("len")))
    product = reduce(lambda x, y: x * y, each)
    return wide.select(seq, F.lit(len(each)).alias("spacings"), product.alias("k")).where("k is not null").select(seq, "spacings", qfast(F.col("k"), F.col("spacings")).alias("pvalue"))


def bead_order(sites: DataFrame, seq: str = "seq_name") -> DataFrame:
    """motif_id, n, mean_start, place, gap: motifs in the order in which their sites (seq, motif_id, start, stop; one for each
    motif) stand on average, and the mean number of symbols between a site and the one before it in its sequence, null where there is none before."""
    w = Window.partitionBy(seq).orderBy("start", "motif_id")
    before = F.lag("stop").over(w)
    each = sites.withColumn("gap", F.when(before.isNotNull(), F.greatest(F.col("start") - before - 1, F.lit(0))))
    means = each.groupBy("motif_id").agg(F.count("*").alias("n"), F.avg("start").alias("mean_start"), F.avg("gap").alias("gap"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mean_start", "motif_id")))  # a row for each motif


def bead_model(sites: DataFrame, motifs: list[Motif], bg, seq: str = "seq_name") -> Hmm:
    """A linear model of the motifs in the order of their sites, with spacers as long as the sites' mean gap."""
    rows = bead_order(sites, seq).orderBy("place").collect()  # a row for each motif
    by_id = {m.id: m for m in motifs}
    gaps = [r.gap for r in rows if r.gap is not None]
    return build([by_id[r.motif_id] for r in rows if r.motif_id in by_id], bg, "linear", max(1.0, sum(gaps) / len(gaps)) if gaps else 10.0)
