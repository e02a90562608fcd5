"""Scanning sequences with motifs: one pass over the sequences for all motifs, hits only leave the workers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.special import qfast, sidak
from strandlake.functions.symbols import DNA
from strandlake.operators.pssm import Pssm, nint, prior_log_odds, sequence_pv, with_prior_distribution
from strandlake.operators.ranking import empirical_pvalues, empirical_qvalues

HIT = "motif_id string, seq_name string, start int, stop int, strand string, score int, pvalue double, matched string"
DEAD = -(2**30)


def encode(seq: str, symbols: str) -> np.ndarray:
    """Core indexes of a sequence; the number of symbols for anything else."""
    table = np.full(256, len(symbols), np.int64)
    for i, s in enumerate(symbols):
        table[[ord(s), ord(s.lower())]] = i
    return table[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def window_scores(codes: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Score of each window; below zero where one holds an ambiguous symbol."""
    w, n = len(scores), len(codes) - len(scores) + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    wide = np.concatenate([scores, np.full((w, 1), DEAD // w)], axis=1).astype(np.int32)
    total = wide[0][codes[:n]]
    for j in range(1, w):
        total += wide[j][codes[j : j + n]]
    return total


def joined(texts: list[str | None], limit: int = 1 << 20):
    """Groups of (first, texts, one text of them all, starts): sequences one after the other, a blank after each, so that all windows
    of a group are scored at once and none that counts spans two. Groups have about ``limit`` symbols."""
    first, group, held = 0, [], 0
    for i, text in enumerate(texts):
        group.append(text or "")
        held += len(group[-1]) + 1
        if held >= limit or i + 1 == len(texts):
            yield first, group, " ".join(group) + " ", np.cumsum([0, *[len(t) + 1 for t in group[:-1]]])
            first, group, held = i + 1, [], 0


ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def _rows(df: DataFrame, name: str, seq: str, schema: str, make) -> DataFrame:
    """Rows made from groups of sequences: ``make`` takes names, texts, their one text and starts, and returns a list of dicts of
    equally long columns, as in ``schema``, or of single values that hold for all."""
    columns = dict(c.split() for c in schema.split(", "))

    def run(batches):
        for batch in batches:
            names = np.array(batch.column(name).cast(pa.string()).to_pylist(), dtype=object)
            for first, texts, whole, starts in joined(batch.column(seq).to_pylist()):
                parts = make(names[first : first + len(texts)], texts, whole, starts)
                sizes = [len(p["seq_name"]) for p in parts]
                whole_columns = [np.concatenate([p[c] if isinstance(p[c], np.ndarray) else np.full(n, p[c], dtype=object) for p, n in zip(parts, sizes, strict=True)]) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(v, ARROW[t], from_pandas=False) for v, t in zip(whole_columns, columns.values(), strict=True)], names=list(columns))

    return df.select(name, seq).mapInArrow(run, schema)


def sides(codes: np.ndarray, p: Pssm, both_strands: bool) -> list[tuple[str, np.ndarray]]:
    """Scores of all windows, as many as symbols; those that reach beyond the end are below zero."""
    out = []
    for strand in "+-" if both_strands else "+":
        s = window_scores(codes, p.scores if strand == "+" else minus(p.scores, p.symbols))
        out.append((strand, np.concatenate([s, np.full(len(codes) - len(s), -1, np.int32)])))
    return out


def minus(scores: np.ndarray, symbols: str) -> np.ndarray:
    order = [symbols.index(DNA.complement[s]) for s in symbols]
    return scores[::-1][:, order]


def scan(df: DataFrame, pssms: list[Pssm], name: str = "seq_name", seq: str = "seq", max_p: float | None = 1e-4, min_score: int | None = None, both_strands: bool = True) -> DataFrame:
    """Windows of p-value up to ``max_p`` (or of a score from ``min_score`` on), both strands, positions from 1 on the plus
    strand. Windows with ambiguous symbols are passed over. The threshold is applied where windows are scored; matrices and
    their p-value tables go to the workers with the task."""
    turn = str.maketrans("ACGT", "TGCA")

    def make(names, texts, whole, starts):
        upper, out = whole.upper(), []
        codes = {s: encode(whole, s) for s in {p.symbols for p in pssms}}
        for p in pssms:
            floor = min_score if min_score is not None else int(np.searchsorted(-p.pv, -(max_p if max_p is not None else 1.0)))
            for strand, s in sides(codes[p.symbols], p, both_strands):
                at = np.flatnonzero(s >= max(0, floor))
                of = np.searchsorted(starts, at, side="right") - 1
                start, own = at - starts[of] + 1, s[at]
                words = [upper[i : i + p.width] for i in at.tolist()]
                words = words if strand == "+" else [w[::-1].translate(turn) for w in words]
                out.append({"motif_id": p.motif_id, "seq_name": names[of], "start": start, "stop": start + p.width - 1, "strand": strand, "score": own, "pvalue": p.pv[np.minimum(own, len(p.pv) - 1)], "matched": np.array(words, dtype=object)})
        return out

    return _rows(df, name, seq, HIT, make)


def scan_with_priors(df: DataFrame, pssms: list[Pssm], priors: DataFrame, bins: np.ndarray, low: float, high: float, alpha: float = 1.0, name: str = "seq_name", seq: str = "seq", max_p: float = 1e-4, both_strands: bool = True) -> DataFrame:
    """As ``scan``, with the log odds of alpha x prior added to each window's score. ``priors`` has ``name``, pos (a window's start, from
    1) and prior; ``bins`` is the distribution of priors between ``low`` and ``high``, which widens each matrix's table of
    p-values. Sequences meet their priors by name, in any order; a window without one has the median prior."""
    tables = [with_prior_distribution(p, bins, low, high, alpha) for p in pssms]
    middle = float(np.interp(0.5, np.cumsum(bins) / bins.sum(), low + (np.arange(len(bins)) + 0.5) * ((high - low) / len(bins)))) if high > low else low
    each = priors.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("prior").cast("double").alias("prior")))).alias("__priors"))

    def run(frames):
        for f in frames:
            out = []
            for who, text, own in zip(f[name], f[seq], f["__priors"], strict=True):
                prior = np.full(len(text or ""), middle)
                for pos, v in dict(own or ()).items():
                    if 0 < pos <= len(prior):
                        prior[pos - 1] = v
                odds = prior_log_odds(prior, alpha)
                for p, pv in zip(pssms, tables, strict=True):
                    codes = encode(text or "", p.symbols)
                    for strand in "+-" if both_strands else "+":
                        s = window_scores(codes, p.scores if strand == "+" else minus(p.scores, p.symbols))
                        # A window's raw score and its prior's log odds, put on the scale of one more column.
                        total = np.clip(nint((p.raw(s) + odds[: len(s)] - (p.width + 1) * p.offset) * p.scale), 0, len(pv) - 1)
                        for i in np.flatnonzero((s >= 0) & (pv[total] <= max_p)):
                            word = text[i : i + p.width].upper()
                            word = word if strand == "+" else word[::-1].translate(str.maketrans("ACGT", "TGCA"))
                            out.append((p.motif_id, str(who), int(i) + 1, int(i) + p.width, strand, int(total[i]), float(pv[total[i]]), word))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HIT.split(", ")])

    return df.select(name, seq).join(each, name, "left").mapInPandas(run, HIT)


def scan_blocks(df: DataFrame, pssms: list[Pssm], name: str = "seq_name", seq: str = "seq", max_p: float = 1e-4, size: int = 1 << 20) -> DataFrame:
    """As ``scan``, for sequences of any length: they are scanned in blocks, which overlap by one less than the widest matrix; a hit
    counts in the block it starts in."""
    from strandlake.operators.lookup import blocks

    widest = max(p.width for p in pssms)
    cut = blocks(df.select(F.col(name).cast("string").alias("__name"), seq), "__name", seq, size, widest - 1)
    keyed = cut.select(F.to_json(F.struct(F.col("__name").alias("n"), F.col("offset").alias("o"))).alias("__at"), "seq")
    found = scan(keyed, pssms, "__at", "seq", max_p).where(F.col("start") <= size)
    at = F.from_json("seq_name", "n string, o int")
    return found.withColumn("__at", at).select("motif_id", F.col("__at.n").alias("seq_name"), *[(F.col(c) + F.col("__at.o")).alias(c) for c in ("start", "stop")], "strand", "score", "pvalue", "matched")


def best_sites(df: DataFrame, pssms: list[Pssm], name: str = "seq_name", seq: str = "seq", both_strands: bool = True) -> DataFrame:
    """Each motif's best-scoring windows of each sequence, all of those that tie; nothing else leaves the workers."""
    def make(names, texts, whole, starts):
        out = []
        for p in pssms:
            both = sides(encode(whole, p.symbols), p, both_strands)
            best = np.max([np.maximum.reduceat(s, starts) for _, s in both], axis=0)
            every = np.repeat(np.where(best >= 0, best, 2**31 - 1), np.diff([*starts, len(whole)]))
            for strand, s in both:
                at = np.flatnonzero(s == every)
                of = np.searchsorted(starts, at, side="right") - 1
                out.append({"motif_id": p.motif_id, "seq_name": names[of], "start": at - starts[of] + 1, "stop": at - starts[of] + p.width, "strand": strand, "score": s[at]})
        return out

    return _rows(df, name, seq, "motif_id string, seq_name string, start int, stop int, strand string, score int", make)


def with_qvalues(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Q-values by motif over all windows tested: ``windows`` has motif_id and n. A motif's distinct p-values are at most as many as
    its scores, so running figures over them are one small sort. Hits are read twice; write them first if they are dear."""
    from pyspark.sql import Window

    own = Window.partitionBy("motif_id").orderBy("pvalue")
    n = hits.groupBy("motif_id", "pvalue").agg(F.count("*").alias("__k")).join(F.broadcast(windows.select("motif_id", F.col("n").alias("__n"))), "motif_id")  # a row for each motif
    fdr = F.least(F.lit(1.0), F.col("pvalue") * F.col("__n") / F.sum("__k").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    q = n.withColumn("__fdr", fdr).select("motif_id", "pvalue", F.min("__fdr").over(own.rowsBetween(0, Window.unboundedFollowing)).alias("qvalue"))
    return hits.join(q, ["motif_id", "pvalue"]).select(*hits.columns, "qvalue")


def windows_tested(df: DataFrame, pssms: list[Pssm], seq: str = "seq", both_strands: bool = True) -> DataFrame:
    """motif_id, n: windows without ambiguous symbols, counted by motif width."""
    strands = 2 if both_strands else 1
    widths = sorted({p.width for p in pssms})
    runs = df.select(F.explode(F.regexp_extract_all(F.upper(F.col(seq)), F.lit(f"[{pssms[0].symbols}]+"), F.lit(0))).alias("r"))
    n = runs.agg(*[F.sum(F.greatest(F.length("r") - w + 1, F.lit(0)) * strands).alias(str(w)) for w in widths])
    pairs = F.array(*[F.struct(F.lit(p.motif_id).alias("motif_id"), F.coalesce(F.col(f"`{p.width}`"), F.lit(0)).cast("bigint").alias("n")) for p in pssms])
    return n.select(F.inline(pairs))


SCORED = "motif_id string, seq_name string, n_windows int, best int, best_p double, avg_odds double, max_odds double, sum_odds double, total_hits int"


def affinity(df: DataFrame, pssms: list[Pssm], name: str = "seq_name", seq: str = "seq", max_p: float = 1e-4, both_strands: bool = True, own: bool = False) -> DataFrame:
    """One row for each motif and sequence: windows scored, best score and its p-value, average, maximum and sum of the
    likelihood ratio over scorable windows and strands, windows of p-value up to ``max_p``. ``own``: p-values under the
    sequence's own composition, of both strands if both are scanned."""
    def table(p: Pssm, codes: np.ndarray) -> np.ndarray:
        n = np.bincount(codes, minlength=len(p.symbols) + 1)[: len(p.symbols)].astype(float)
        if both_strands:
            n = n + n[[p.symbols.index(DNA.complement[x]) for x in p.symbols]]
        return sequence_pv(p, n / n.sum()) if n.sum() else p.pv

    def make(names, texts, whole, starts):
        out = []
        for p in pssms:
            codes, ends = encode(whole, p.symbols), [*starts[1:], len(whole)]
            both = [s for _, s in sides(codes, p, both_strands)]
            best = np.max([np.maximum.reduceat(s, starts) for s in both], axis=0)
            n, total, odds = np.zeros(len(starts), int), np.zeros(len(starts)), np.zeros(len(starts))
            hits, least = np.zeros(len(starts), int), np.ones(len(starts))
            by_score = np.exp2(p.raw(np.arange(len(p.pv))))
            for s in both:
                ok, low = s >= 0, np.clip(s, 0, len(p.pv) - 1)
                worth = np.where(ok, by_score[low], 0.0)
                n += np.add.reduceat(ok, starts, dtype=int)
                total += np.add.reduceat(worth, starts)
                odds = np.maximum(odds, np.maximum.reduceat(worth, starts))
                if not own:
                    hits += np.add.reduceat(ok & (p.pv[low] <= max_p), starts, dtype=int)
            if own:
                for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    if n[i]:
                        pv = table(p, codes[a:b])
                        low = np.concatenate([s[a:b] for s in both])
                        each = pv[np.minimum(low[low >= 0], len(pv) - 1)]
                        hits[i], least[i] = (each <= max_p).sum(), each.min()
            else:
                least = np.where(n > 0, p.pv[np.clip(best, 0, len(p.pv) - 1)], 1.0)
            out.append({"motif_id": p.motif_id, "seq_name": names, "n_windows": n, "best": np.where(n > 0, best, -1), "best_p": least, "avg_odds": total / np.maximum(n, 1), "max_odds": odds, "sum_odds": total, "total_hits": hits})
        return out

    return _rows(df, name, seq, SCORED, make)


def sequence_evalues(scored: DataFrame, n_seqs: int) -> DataFrame:
    """seq_name, pvalue, evalue: each motif's best p-value corrected for its windows, the product over motifs referred to
    that of uniform ones."""
    ev = sidak(F.col("best_p"), F.col("n_windows").cast("double"))
    out = scored.where("n_windows > 0").groupBy("seq_name").agg(F.exp(F.sum(F.log(F.greatest(ev, F.lit(1e-300))))).alias("k"), F.count("*").cast("int").alias("n"))
    return out.select("seq_name", "n", qfast(F.col("k"), F.col("n")).alias("pvalue")).withColumn("evalue", F.col("pvalue") * n_seqs)


def tile(hits: DataFrame) -> DataFrame:
    """Hits of a sequence that don't overlap: from left to right, a hit replaces those it overlaps if its p-value is less
    than the product of theirs."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for h in f.sort_values(["start", "motif_id", "strand"]).itertuples(index=False):
            over = [k for k in kept if k.stop >= h.start]
            if not over or h.pvalue < np.prod([k.pvalue for k in over]):
                kept = [k for k in kept if k.stop < h.start] + [h]
        return pd.DataFrame(kept, columns=f.columns)

    return hits.groupBy("seq_name").applyInPandas(run, hits.schema)


def clusters(hits: DataFrame, max_gap: int = 50) -> DataFrame:
    """seq_name, cluster, start, stop, n_hits, score: runs of hits whose gaps are at most ``max_gap``."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq_name").orderBy("start", "stop", "motif_id", "strand")
    gap = F.col("start") - F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)) - 1
    h = hits.withColumn("new", F.coalesce((gap > max_gap).cast("int"), F.lit(1)))
    h = h.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return h.groupBy("seq_name", "cluster").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_hits"), F.sum(-F.log2("pvalue")).alias("score"))


def synthetic_like(df: DataFrame, name: str = "seq_name", seq: str = "seq", copies: int = 1, seed: int = 1) -> DataFrame:
    """name, seq: random sequences as long as the real ones, of each one's own letter frequencies (0 order), seeded by name."""
    @F.pandas_udf("string")
    def run(names: pd.Series, seqs: pd.Series, copy: pd.Series) -> pd.Series:
        import zlib

        out = []
        for n, s, c in zip(names, seqs, copy, strict=True):
            rng = np.random.default_rng([seed, int(c), zlib.crc32(str(n).encode())])
            raw = np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8)
            out.append(rng.choice(raw, len(raw)).tobytes().decode("latin-1") if len(raw) else "")
        return pd.Series(out)

    rows = df.select(F.col(name).cast("string").alias("n"), seq, F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    return rows.select(F.concat_ws("#", "n", F.col("copy").cast("string")).alias(name), run("n", seq, "copy").alias(seq))


def calibrated_clusters(df: DataFrame, pssms: list[Pssm], name: str = "seq_name", seq: str = "seq", max_p: float = 5e-4, max_gap: int = 50, copies: int = 1) -> DataFrame:
    """``clusters`` with pvalue, evalue and qvalue: scores are held against those of clusters in synthetic sequences of the same
    lengths and compositions, ``copies`` of each. E-values count the clusters found."""
    real = clusters(scan(df, pssms, name, seq, max_p), max_gap).checkpoint()
    null = clusters(scan(synthetic_like(df, name, seq, copies), pssms, name, seq, max_p), max_gap).select("score").checkpoint()
    found = real.agg(F.count("*").alias("__n"))  # one row
    keys = ["seq_name", "cluster"]
    scored = empirical_pvalues(real, null, "score").crossJoin(F.broadcast(found)).withColumn("evalue", F.col("pvalue") * F.col("__n")).drop("__n")
    return scored.join(empirical_qvalues(real, null, "score").select(*keys, "qvalue"), keys)


def affinity_pvalues(df: DataFrame, pssms: list[Pssm], name: str = "seq_name", seq: str = "seq", bins: int = 21) -> DataFrame:
    """``affinity`` with gc and pvalue: that of the average likelihood ratio, under a background of the sequence's share of G and C."""
    from strandlake.functions.significance import affinity_pvalue, gc_tables
    from strandlake.functions.symbols import gc_content

    tables = {p.motif_id: (p, gc_tables(p, bins)) for p in pssms}
    shares = df.select(F.col(name).cast("string").alias("seq_name"), F.coalesce(gc_content(seq), F.lit(0.5)).alias("gc"))
    scored = affinity(df, pssms, name, seq).where("n_windows > 0").join(shares, "seq_name")

    @F.pandas_udf("double")
    def run(motif: pd.Series, odds: pd.Series, n: pd.Series, gc: pd.Series) -> pd.Series:
        return pd.Series([affinity_pvalue(o, int(k), g, *tables[m]) for m, o, k, g in zip(motif, odds, n, gc, strict=True)])

    return scored.withColumn("pvalue", run("motif_id", "avg_odds", "n_windows", "gc"))
