"""From sequences to annotated motifs: discover, compare with known motifs, test centrality and spacing, scan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.discover import em, regex
from strandlake.functions.symbols import centred
from strandlake.operators import compare, enrich, pssm, ranking
from strandlake.operators.motifs import Motif, drop_correlated
from strandlake.operators.scan import scan, windows_tested, with_qvalues


def analyse(pos: DataFrame, neg: DataFrame, known: list[Motif], name: str = "seq_name", seq: str = "seq", length: int = 100, width: int = 6, bg: np.ndarray | None = None) -> dict[str, DataFrame | list[Motif]]:
    """motifs (found, without near repeats), known (comparison with known ones), central (windows around the middle), spacing
    (of others about the first) and hits with q-values. Sequences are cut to their middle ``length`` for all but hits, which
    are those of whole sequences."""
    bg = np.full(4, 0.25) if bg is None else bg
    spark = pos.sparkSession
    middle = pos.select(name, centred(F.upper(F.col(seq)), length).alias(seq)).persist()
    control = neg.select(name, centred(F.upper(F.col(seq)), length).alias(seq))
    found = drop_correlated([*em.discover(middle, width, motifs=1, seq=seq, bg=bg), *regex.discover(middle, control, name, seq, k=min(5, width))], 0.95)
    tables = [pssm.build(m, bg) for m in found]
    hits = scan(middle, tables, name, seq, max_p=1e-2)
    best = ranking.best_with_ties(hits.select("motif_id", "seq_name", "start", "score"), "score", ["motif_id", "seq_name"])
    whole = pos.select(name, F.upper(F.col(seq)).alias(seq))
    found_in = scan(whole, tables, name, seq, max_p=1e-2)
    hist = enrich.position_histogram(best.withColumn("centre", F.col("start") - 1))
    return {
        "motifs": found,
        "known": compare.compare(spark, found, known, "pearson") if known and found else None,
        "central": enrich.central_windows(hist, length, width),
        "spacing": enrich.spacing_histogram(enrich.spacings(hits.where(F.col("motif_id") == found[0].id), hits.where(F.col("motif_id") != found[0].id), length)) if found else None,
        "hits": with_qvalues(found_in, windows_tested(whole, tables, seq)) if tables else found_in,
    }
