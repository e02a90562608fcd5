"""Queries of discovery, hidden Markov models, phylogeny, formats and the whole workflow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandlake.discover import em, ptm, regex
from strandlake.functions import symbols as S
from strandlake.operators import diagram as D
from strandlake.operators import hmm, phylo, workflow
from strandlake.operators import motifs as M
from strandlake.operators import scan as C
from strandlake.operators import sequences as Q
from strandlake.plans.registry import checkpointed, query
from strandlake.plans.sequences import DOCS, MAX_P, PSSMS, SCAN, TILED, docs, hits
from strandlake.plans.statistics import MOTIFS
from strandlake.sources import readers, writers

def _kept(t, df):
    """Written to the checkpoint folder, for loops that read it many times."""
    checkpointed(t.spark)
    return df.checkpoint()


PEPTIDES = "l AS (SELECT upper(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS s FROM conversations), p AS (SELECT substr(s, i, 7) AS w FROM (SELECT s, unnest(range(1, length(s) - 5)) AS i FROM l) WHERE substr(s, i + 3, 1) = 'S')"


def peptides(t):
    letters = t.conversations.select(F.upper(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("seq"))
    return ptm.peptide_windows(letters, "S", 7)


def letter_windows(t):
    letters = t.conversations.select(F.upper(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("seq"))
    return letters.select(F.explode(S.words("seq", 7)).alias("window"))


STEP = f"""WITH {PEPTIDES}, a AS (SELECT substr(s, i, 7) AS w FROM (SELECT s, unnest(range(1, length(s) - 5)) AS i FROM l)), i AS (SELECT unnest(range(1, 8)) AS pos),
f AS (SELECT pos::INTEGER AS pos, substr(w, pos, 1) AS sym, count(*) AS n FROM p, i GROUP BY ALL), b AS (SELECT pos::INTEGER AS pos, substr(w, pos, 1) AS sym, count(*) AS n FROM a, i GROUP BY ALL)
SELECT f.pos, f.sym, f.n, (SELECT count(*) FROM p) AS total, round(b.n / (SELECT count(*) FROM a), 9) AS bg_p FROM f JOIN b USING (pos, sym) WHERE f.pos <> 4"""


@query(STEP)
def motifx_step(t):
    """Cells of the first step around S, with background frequencies."""
    return ptm.step(peptides(t), letter_windows(t), 4).select("pos", "sym", "n", "total", F.round("bg_p", 9).alias("bg_p"))


@query()
def motifx_motifs(t):
    found = ptm.discover(_kept(t, peptides(t)), _kept(t, letter_windows(t)), 7, "S")
    return t.spark.createDataFrame([(d["pattern"], d["score"], d["n"], d["bg_n"]) for d in found], "pattern string, score double, n bigint, bg_n bigint")


@query()
def minimum_description(t):
    p = _kept(t, peptides(t))
    freqs = {r["sym"]: r["n"] for r in Q.count_matrix(p, "window").groupBy("sym").agg(F.sum("n").alias("n")).collect()}
    total = sum(freqs.values())
    found = ptm.minimum_description(p, 7, {s: n / total for s, n in freqs.items()})
    return t.spark.createDataFrame([("|".join(f"[{c}]" if c else "." for c in x),) for x in found], "pattern string")


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, seq, quality FROM d JOIN labels USING (doc_id)), w AS (SELECT DISTINCT doc_id, quality, substr(seq, i, 4) AS x FROM (SELECT *, unnest(range(1, length(seq) - 2)) AS i FROM l)),
c AS (SELECT DISTINCT doc_id, quality, least(x, translate(reverse(x), 'ACGT', 'TGCA')) AS word FROM w) SELECT word, count(*) FILTER (quality = 1) AS pos_hits, count(*) FILTER (quality = 0) AS neg_hits FROM c GROUP BY 1 HAVING count(*) FILTER (quality = 1) > 0""")
def regex_core_step(t):
    """Counts of the words that regular-expression discovery begins with."""
    d = docs(t).join(t.labels, "doc_id")
    p, n = (Q.word_presence(d.where(f"quality = {q}"), 4, "doc_id", alphabet=S.DNA).withColumnRenamed("n_seqs", c) for q, c in ((1, "pos_hits"), (0, "neg_hits")))
    return p.join(n, "word", "left").select("word", "pos_hits", F.coalesce("neg_hits", F.lit(0)).alias("neg_hits"))


@query()
def regex_discovery(t):
    d = _kept(t, docs(t).join(t.labels, "doc_id"))
    found = regex.discover(d.where("quality = 1"), d.where("quality = 0"), "doc_id", k=4, max_log_p=0.0)
    return M.motif_rows(t.spark, found)


@query()
def em_discovery(t):
    checkpointed(t.spark)
    return M.motif_rows(t.spark, em.discover(_kept(t, docs(t)), 6))


@query()
def significant_discovery(t):
    """A motif whose width and number of sites are chosen by significance, on both strands of the labelled documents."""
    checkpointed(t.spark)
    found = em.discover_significant(_kept(t, docs(t).join(t.labels, "doc_id")), 6, 8, both=True, max_log_e=float("inf"))
    return M.motif_rows(t.spark, found)


@query()
def linear_model_scores(t):
    """Scores under a linear model: the motifs in order, a spacer before, between and after."""
    bg = np.full(4, 0.25)
    return hmm.score_sequences(docs(t), hmm.build(MOTIFS, bg, "linear"), bg, "doc_id")


@query()
def hmm_scores(t):
    bg = np.full(4, 0.25)
    return hmm.score_sequences(docs(t), hmm.build(MOTIFS, bg, "star"), bg, "doc_id")


@query()
def hit_cluster_dp(t):
    return hmm.cluster_scan(hits(t), 50, p_thresh=MAX_P)


TREE = "((a:0.2,b:0.3):0.1,c:0.4);"
SPECIES = ["a", "b", "c"]


def alignment(t):
    """Conversations as alignments of three species: three turns' bases after the other, column by column."""
    species = F.get(F.array(*[F.lit(s) for s in SPECIES]), (F.col("turn") % 3).cast("int"))
    rows = t.conversations.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 3).cast("string")).alias("aln_id"), species.alias("species"), S.core_only("text").alias("seq"))
    return readers.alignment_columns(rows)


ALN = "s AS (SELECT conv_id || '/' || turn // 3 AS aln_id, turn % 3 AS turn, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM conversations), c AS (SELECT aln_id, turn, i, substr(seq, i, 1) AS base FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM s))"


@query(f"WITH {ALN}, k AS (SELECT aln_id, i, count(DISTINCT base) AS k FROM c GROUP BY ALL) SELECT aln_id, count(*) FILTER (k = 1) AS identical, count(*) AS columns FROM k GROUP BY 1")
def alignment_identity(t):
    return readers.identity(alignment(t))


@query(f"WITH {ALN} SELECT aln_id, i::INTEGER AS col, coalesce(max(base) FILTER (turn = 0), '-') || coalesce(max(base) FILTER (turn = 1), '-') || coalesce(max(base) FILTER (turn = 2), '-') AS key FROM c GROUP BY ALL")
def alignment_column_keys(t):
    return phylo.column_table(alignment(t), SPECIES)


def pruned(models: dict[str, tuple[list[float], float]]) -> str:
    """SQL for ``like``: each distinct column's probability under each model of equilibrium frequencies and speed, where a base
    changes at a rate 1 / (1 - sum of squared frequencies) times the speed to one drawn from the frequencies."""
    rows = ", ".join(f"('{m}', '{s}', {p!r}::DOUBLE, {speed / (1 - sum(x * x for x in pi))!r}::DOUBLE)" for m, (pi, speed) in models.items() for s, p in zip("ACGT", pi, strict=True))
    leaf = lambda c, length: f"CASE {c} WHEN '-' THEN 1.0 ELSE exp(-{length} * m.b) * ({c} = m.sym)::INTEGER + (1 - exp(-{length} * m.b)) * (SELECT pi FROM m o WHERE o.model = m.model AND o.sym = {c}) END"
    return f"""keys AS (SELECT aln_id, i::INTEGER AS col, coalesce(max(base) FILTER (turn = 0), '-') AS x, coalesce(max(base) FILTER (turn = 1), '-') AS y, coalesce(max(base) FILTER (turn = 2), '-') AS z FROM c GROUP BY ALL),
u AS (SELECT DISTINCT x, y, z FROM keys), m(model, sym, pi, b) AS (VALUES {rows}),
leaves AS (SELECT x, y, z, m.model, m.sym, pi, b, ({leaf('x', 0.2)}) * ({leaf('y', 0.3)}) AS ab, {leaf('z', 0.4)} AS c FROM u, m),
inner_ AS (SELECT *, sum(pi * ab) OVER (PARTITION BY x, y, z, model) AS mean FROM leaves),
likes AS (SELECT x, y, z, model, sum(pi * c * (exp(-0.1 * b) * ab + (1 - exp(-0.1 * b)) * mean)) AS p FROM inner_ GROUP BY ALL)"""


_COLUMNS = {str(i + 1): (MOTIFS[0].freqs[i].tolist(), 1.0) for i in range(MOTIFS[0].width)}


@query(f"""WITH {ALN}, {pruned({'bg': ([0.25] * 4, 1.0), **_COLUMNS})}, odds AS (SELECT aln_id, col, f.model::INTEGER AS pos, log2(f.p / n.p) AS s FROM keys JOIN likes f USING (x, y, z) JOIN likes n USING (x, y, z) WHERE f.model <> 'bg' AND n.model = 'bg')
SELECT aln_id, col - pos + 1 AS start, round(sum(s), 6) + 0.0 AS score FROM odds GROUP BY ALL HAVING count(*) = {MOTIFS[0].width}""")
def phylo_scan(t):
    """Windows of alignments under a motif's evolution against the background's."""
    keys = phylo.column_table(alignment(t), SPECIES)
    scored = phylo.score_columns(keys, phylo.parse_newick(TREE), SPECIES, MOTIFS[0].freqs, np.full(4, 0.25))
    return phylo.scan_alignment(keys, scored, MOTIFS[0].width, "wildcard").withColumn("score", F.round("score", 6) + 0.0)


@query(f"""WITH {ALN}, {pruned({'bg': ([0.25] * 4, 1.0), 'slow': ([0.25] * 4, 0.2)})}, odds AS (SELECT aln_id, col, log2(f.p / n.p) AS s FROM keys JOIN likes f USING (x, y, z) JOIN likes n USING (x, y, z) WHERE f.model = 'slow' AND n.model = 'bg')
SELECT aln_id, col, round(avg(s) OVER (PARTITION BY aln_id ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS score FROM odds""")
def conservation(t):
    """Slow against normal evolution, averaged over five columns."""
    out = phylo.conservation(phylo.column_table(alignment(t), SPECIES), phylo.parse_newick(TREE), SPECIES, np.full(4, 0.25))
    return out.withColumn("score", F.round("score", 6) + 0.0)


def both_sites(t):
    """One best site of each motif in each sequence, the first of equal ones."""
    b = C.best_sites(docs(t), PSSMS, "doc_id")
    return b.groupBy("motif_id", "seq_name").agg(F.min(F.struct("start", "stop")).alias("s")).select("motif_id", "seq_name", "s.*")


_SITES = "b AS (SELECT *, rank() OVER (PARTITION BY motif_id, seq_name ORDER BY score DESC) AS r FROM hits), one AS (SELECT motif_id, seq_name, min(start) AS start, min(stop) AS stop FROM b WHERE r = 1 GROUP BY ALL)"


@query(f"""WITH {SCAN}, {_SITES}, o AS (SELECT f.seq_name, length(seq) AS len, abs(20 - (g.start - f.start)) AS err FROM one f JOIN one g USING (seq_name) JOIN d ON doc_id::VARCHAR = f.seq_name WHERE f.motif_id = 'M1' AND g.motif_id = 'M2'),
m AS (SELECT *, len - 5 + 1 AS np, greatest(20 - err, 5 - len) AS lo, least(20 + err, len - 5) AS hi FROM o)
SELECT seq_name, 1 AS spacings, round(CASE WHEN lo >= 0 THEN (hi - lo + 1) * (np - (hi + lo) / 2.0) ELSE -lo * (np - (1 - lo) / 2.0) + (hi + 1) * (np - hi / 2.0) END / (np * np), 9) AS pvalue FROM m WHERE hi >= lo""")
def diagram_order(t):
    """How well best sites keep the spacing of a diagram."""
    lengths = docs(t).select(F.col("doc_id").cast("string").alias("seq_name"), F.length("seq").alias("len"))
    found = D.diagram_pvalues(both_sites(t), lengths, "[+M1]-15-[+M2]", {p.motif_id: p.width for p in PSSMS})
    return found.withColumn("pvalue", F.round("pvalue", 9))


@query(f"WITH {SCAN}, {_SITES}, l AS (SELECT *, start - lag(stop) OVER (PARTITION BY seq_name ORDER BY start, motif_id) - 1 AS between_ FROM one), e AS (SELECT *, CASE WHEN between_ IS NOT NULL THEN greatest(between_, 0) END AS gap FROM l), g AS (SELECT motif_id, count(*) AS n, avg(start) AS mean_start, avg(gap) AS gap FROM e GROUP BY 1) SELECT motif_id, n, round(mean_start, 6) AS mean_start, round(gap, 6) AS gap, (row_number() OVER (ORDER BY mean_start, motif_id))::INTEGER AS place FROM g")
def bead_order(t):
    """Motifs in the order of their sites, with the gaps between them."""
    return D.bead_order(both_sites(t)).select("motif_id", "n", F.round("mean_start", 6).alias("mean_start"), F.round("gap", 6).alias("gap"), "place")


@query()
def bead_scores(t):
    """Scores under a linear model made of the best sites."""
    bg = np.full(4, 0.25)
    return hmm.score_sequences(docs(t), D.bead_model(both_sites(t), MOTIFS[:2], bg), bg, "doc_id")


@query()
def purged(t):
    """Benchmark passages of which none aligns with an earlier one for 100 points or more."""
    from strandlake.operators import purge

    checkpointed(t.spark)
    return purge.purge(t.benchmark.select("item_id", "text"), "item_id", 100, "text").select("item_id")


@query(f"WITH {SCAN} SELECT seq_name || chr(9) || 'strandlake' || chr(9) || 'nucleotide_motif' || chr(9) || start || chr(9) || stop AS head, count(*) AS n FROM hits WHERE pvalue <= {MAX_P} GROUP BY 1")
def gff3(t):
    return writers.gff3(hits(t)).groupBy(F.substring_index("value", "\t", 5).alias("head")).agg(F.count("*").alias("n"))


@query(f"WITH {SCAN} SELECT motif_id, seq_name, count(*) AS n, min(start) AS first FROM hits WHERE pvalue <= {MAX_P} GROUP BY ALL")
def nested_hits(t):
    n = writers.nested(hits(t))
    return n.select("motif_id", "seq_name", F.size("matches").cast("bigint").alias("n"), F.array_min(F.transform("matches", lambda m: m["start"])).alias("first"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k, '{\"event_id\":' || event_id || '}' AS again FROM events")
def json_round_trip(t):
    k = F.from_json("props", "k int")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct("event_id")).alias("again"))


@query()
def workflow_hits(t):
    checkpointed(t.spark)
    d = docs(t).join(t.labels, "doc_id")
    return workflow.analyse(d.where("quality = 1"), d.where("quality = 0"), MOTIFS, "doc_id")["hits"]


@query(f"WITH RECURSIVE {SCAN}, {TILED} SELECT seq_name, count(*) AS n FROM tiled GROUP BY 1")
def tiled_by_sequence(t):
    return C.tile(hits(t)).groupBy("seq_name").agg(F.count("*").alias("n"))


@query()
def gapped_scan(t):
    """The best gapped matches of a motif, deletions and insertions allowed."""
    from strandlake.discover import gapped

    counts = np.concatenate([MOTIFS[0].freqs * 20, np.full((MOTIFS[0].width, 1), 0.5)], axis=1)
    return gapped.scan(docs(t), counts, np.full(4, 0.25), 100, "doc_id")


@query()
def non_redundant(t):
    """Benchmark passages of which no earlier one is kept that shares half of the smaller's words of eight letters."""
    from strandlake.operators import redundancy

    checkpointed(t.spark)
    return redundancy.non_redundant(t.benchmark.select("item_id", "text"), "item_id", "text").select("item_id")
