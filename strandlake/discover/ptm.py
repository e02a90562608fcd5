"""Motifs around modified residues: greedy choice of the most significant position and residue by binomial tail, against a
background of all windows; and description lengths of sets of patterns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.special import log_binomial_udf
from strandlake.operators.sequences import count_matrix

MIN_COUNT, MAX_P = 20, 1e-5


def peptide_windows(proteins: DataFrame, residue: str, width: int, seq: str = "seq") -> DataFrame:
    """Windows of ``width`` centred on ``residue``, whole ones only."""
    half = width // 2
    return proteins.select(F.explode(F.regexp_extract_all(F.col(seq), F.lit(f"(?=(.{{{half}}}{residue}.{{{half}}}))"), F.lit(1))).alias("window"))


def matches(window: str, pattern: dict[int, str]) -> Column:
    out = F.lit(True)
    for pos, sym in pattern.items():
        out = out & (F.substring(window, pos, 1) == sym)
    return out


def step(fg: DataFrame, bg: DataFrame, centre: int, window: str = "window") -> DataFrame:
    """pos, sym, n, total, bg_p, log_p: every cell but the centre's."""
    f, b = count_matrix(fg, window), count_matrix(bg, window)
    tf, tb = f.groupBy("pos").agg(F.sum("n").alias("total")), b.groupBy("pos").agg(F.sum("n").alias("bg_total"))
    cells = f.join(b.withColumnRenamed("n", "bg_n"), ["pos", "sym"]).join(tf, "pos").join(tb, "pos").where(F.col("pos") != centre)
    p = F.col("bg_n") / F.col("bg_total")
    return cells.select("pos", "sym", "n", "total", p.alias("bg_p"), log_binomial_udf("n", "total", p).alias("log_p"))


def discover(fg: DataFrame, bg: DataFrame, width: int, residue: str, window: str = "window", min_count: int = MIN_COUNT, max_p: float = MAX_P, motifs: int = 10) -> list[dict]:
    """Patterns with scores (sum of -log10 p) and counts. A pattern's matches leave both sets before the next begins."""
    centre, out = width // 2 + 1, []
    for _ in range(motifs):
        pattern, score, f, b = {centre: residue}, 0.0, fg, bg
        while True:
            cells = step(f, b, centre, window).where((F.col("n") >= min_count) & (F.col("log_p") < math.log(max_p)))
            for pos in pattern:
                cells = cells.where(F.col("pos") != pos)
            best = cells.orderBy("log_p", "pos", "sym").first()
            if best is None:
                break
            pattern[best["pos"]] = best["sym"]
            score -= best["log_p"] / math.log(10)
            f, b = fg.where(matches(window, pattern)), bg.where(matches(window, pattern))
        if len(pattern) == 1:
            break
        text = "".join(pattern.get(i, ".") for i in range(1, width + 1))
        out.append({"pattern": text, "score": score, "n": f.count(), "bg_n": b.count()})
        fg, bg = fg.where(~matches(window, pattern)), bg.where(~matches(window, pattern))
    return out


def description_length(fg: DataFrame, patterns: list[list[str]], freqs: dict[str, float], window: str = "window") -> float:
    """Bits of a set of patterns (a class of residues, or '' for any, at each place) and of the windows given them: each
    takes the best pattern that matches, or none, and a residue costs log2 of its class, or -log2 of its frequency."""
    table = F.create_map(*[x for s, p in freqs.items() for x in (F.lit(s), F.lit(-math.log2(p)))])
    cost = lambda i: F.coalesce(F.try_element_at(table, F.substring(window, i + 1, 1)), F.lit(math.log2(20)))
    width = len(patterns[0]) if patterns else 0
    plain = sum((cost(i) for i in range(width)), F.lit(0.0)) if width else F.lit(0.0)
    bits = [1 + plain]
    for p in patterns:
        ok = F.lit(True)
        total = F.lit(1 + math.log2(len(patterns)))
        for i, c in enumerate(p):
            if c:
                ok = ok & F.col(window).substr(i + 1, 1).isin(*c)
                total = total + math.log2(len(c))
            else:
                total = total + cost(i)
        bits.append(F.when(ok, total))
    each = F.least(*bits) if len(bits) > 1 else bits[0]
    own = sum(sum(5 + 5 * len(c) for c in p if c) for p in patterns)
    return 7 + own + (fg.agg(F.sum(each).alias("s")).first()["s"] or 0.0)


def minimum_description(fg: DataFrame, width: int, freqs: dict[str, float], window: str = "window", rounds: int = 10, tries: int = 12) -> list[list[str]]:
    """Greedy set of patterns: each round adds, extends or removes what shortens the description most; stops when nothing
    does."""
    common = count_matrix(fg, window).orderBy(F.desc("n"), "pos", "sym").limit(tries).collect()
    best: list[list[str]] = []
    length = description_length(fg, best or [[""] * width], freqs, window)
    for _ in range(rounds):
        options = []
        for r in common:
            one = [""] * width
            one[r["pos"] - 1] = r["sym"]
            options.append([*best, one])
            for i, p in enumerate(best):
                wider = list(p)
                wider[r["pos"] - 1] = "".join(sorted(set(p[r["pos"] - 1]) | {r["sym"]}))
                options.append([*best[:i], wider, *best[i + 1 :]])
        options += [[*best[:i], *best[i + 1 :]] for i in range(len(best))]
        scored = [(description_length(fg, o, freqs, window), o) for o in options if o]
        if not scored or min(scored)[0] >= length - 1e-9:
            break
        length, best = min(scored)
    return best
