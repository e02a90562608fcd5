"""Discovery of regular expressions that tell positives from controls: words by Fisher's test, the best ones generalised to
ambiguous symbols in a beam, the winner's sites turned into a motif and masked before the next round."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.special import log_fisher_udf
from strandlake.functions.symbols import DNA, iupac_regex, reverse_complement
from strandlake.operators.enrich import word_enrichment
from strandlake.operators.motifs import Motif
from strandlake.sources.readers import from_sites


def generalisations(word: str) -> list[str]:
    """One core symbol replaced by each ambiguous one that comprises it."""
    return [word[:i] + a + word[i + 1 :] for i, c in enumerate(word) for a, m in DNA.comprises.items() if c in m and c in DNA.core]


def reverse_pattern(word: str) -> str:
    return "".join(DNA.complement_of(c) for c in reversed(word))


def score_patterns(pos: DataFrame, neg: DataFrame, patterns: list[str], seq: str = "seq") -> DataFrame:
    """pattern, pos_hits, neg_hits, log_p for a bounded list of patterns: one pass over either set."""
    def hits(df: DataFrame, name: str) -> DataFrame:
        cols = [F.sum(F.col(seq).rlike(f"{iupac_regex(p)}|{iupac_regex(reverse_pattern(p))}").cast("bigint")).alias(f"p{i}") for i, p in enumerate(patterns)]
        one = df.agg(F.count("*").alias("n"), *cols)
        return one.select(F.col("n").alias(f"{name}_total"), F.posexplode(F.array(*[F.coalesce(F.col(f"p{i}"), F.lit(0).cast("bigint")) for i in range(len(patterns))])).alias("i", f"{name}_hits"))

    both = hits(pos, "pos").join(hits(neg, "neg"), "i")
    return both.select(F.get(F.array(*[F.lit(p) for p in patterns]), F.col("i")).alias("pattern"), "pos_hits", "pos_total", "neg_hits", "neg_total", log_fisher_udf("pos_hits", "pos_total", "neg_hits", "neg_total").alias("log_p"))


def to_motif(df: DataFrame, pattern: str, name: str, seq: str = "seq") -> Motif:
    """Counts of the pattern's sites, those of its reverse complement turned over."""
    sites = lambda col, p: F.regexp_extract_all(col, F.lit(f"(?=({iupac_regex(p)}))"), F.lit(1))
    both = F.concat(sites(F.col(seq), pattern), sites(reverse_complement(seq), pattern))
    counts = df.select(F.explode(both).alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()  # at most as many as words of the pattern
    c = np.zeros((len(pattern), 4))
    for r in counts:
        for i, x in enumerate(r["s"]):
            c[i, DNA.core.index(x)] += r["n"]
    return Motif(name, c / c.sum(axis=1, keepdims=True), pattern, float(sum(r["n"] for r in counts))) if counts else from_sites(name, [pattern])


def discover(pos: DataFrame, neg: DataFrame, name: str, seq: str = "seq", k: int = 5, beam: int = 20, motifs: int = 1, max_log_p: float = -3.0) -> list[Motif]:
    out = []
    for n in range(motifs):
        top = word_enrichment(pos, neg, k, name, seq, DNA).orderBy("log_p", "word").limit(beam).collect()
        best = [(r["log_p"], r["word"]) for r in top]
        if not best or best[0][0] > max_log_p:
            break
        front, seen = [w for _, w in best], {w for _, w in best}
        for _ in range(k):
            new = [g for g in dict.fromkeys(g for w in front for g in generalisations(w)) if g not in seen]
            if not new:
                break
            seen.update(new)
            scored = sorted((r["log_p"], r["pattern"]) for r in score_patterns(pos, neg, new, seq).collect())
            if scored[0][0] >= best[0][0]:
                break
            best = sorted([*best, *scored])[:beam]
            front = [w for _, w in best]
        pattern = best[0][1]
        out.append(to_motif(pos, pattern, f"RE-{n + 1}", seq))
        mask = lambda df: df.withColumn(seq, reduce(lambda c, p: F.regexp_replace(c, iupac_regex(p), "N" * k), [pattern, reverse_pattern(pattern)], F.col(seq)))  # noqa: B023, E731
        pos, neg = mask(pos), mask(neg)
    return out
