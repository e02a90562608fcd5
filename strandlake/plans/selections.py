"""Queries of selection, lookup, priors in scans, alignments, motif tables and hierarchies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.functions import significance as Z
from strandlake.functions import symbols as S
from strandlake.operators import alignment as A
from strandlake.operators import enrich as E
from strandlake.operators import lookup as L
from strandlake.operators import motifs as M
from strandlake.operators import pssm as P
from strandlake.operators import ranking as R
from strandlake.operators import scan as C
from strandlake.operators import select as G
from strandlake.operators import sequences as Q
from strandlake.plans.registry import checkpointed, query
from strandlake.plans.sequences import BEST_E, DOCS, MATRIX, MAX_P, MIDDLE, PSSMS, QVALUES, RC, SCAN, SCORES, WINDOWS, docs, hits, part_motifs
from strandlake.plans.statistics import BEST, EVENTS, MOTIFS, best_starts, events, genes
from strandlake.sources import readers

# Filters -------------------------------------------------------------------------------------------------------------


@query(f"WITH {SCAN}, {QVALUES} SELECT motif_id, seq_name, start, strand, round(qvalue, 9) AS qvalue FROM q WHERE qvalue <= 0.9")
def scan_below_q(t):
    d = docs(t)
    checkpointed(t.spark)
    found = C.with_qvalues(C.scan(d, PSSMS, "doc_id", "seq", MAX_P).checkpoint(), C.windows_tested(d, PSSMS))
    return G.below_q(found, 0.9).select("motif_id", "seq_name", "start", "strand", F.round("qvalue", 9).alias("qvalue"))


@query(f"WITH {SCAN}, {BEST_E}, p AS (SELECT seq_name, CASE WHEN n = 1 THEN k ELSE k * (1 - ln(k)) END AS pvalue FROM k), e AS (SELECT seq_name, pvalue * (SELECT count(*) FROM d) AS evalue FROM p) SELECT seq_name, round(evalue, 5) AS evalue FROM e WHERE evalue < 100")
def sequence_gate(t):
    """Sequences whose E-value is below 100."""
    scored = C.sequence_evalues(C.affinity(docs(t), PSSMS, "doc_id", "seq", MAX_P), 1).drop("evalue")
    return G.gate(scored, docs(t), 100.0).select("seq_name", F.round("evalue", 5).alias("evalue"))


_COMP = f"""comp AS (SELECT doc_id::VARCHAR AS seq_name, length(seq) AS len, length(regexp_replace(seq, '[^AT]', '', 'g')) / 2.0 / length(seq) AS at_, length(regexp_replace(seq, '[^CG]', '', 'g')) / 2.0 / length(seq) AS gc_ FROM d WHERE length(seq) > 0),
kinds AS ({' UNION ALL '.join(f"SELECT '{m}' AS motif_id, {' + '.join(f's{i}.s' for i in range(len(r)))} AS score, {' + '.join(f's{i}.g' for i in range(len(r)))} AS g FROM {', '.join(f'(SELECT s, (sym IN ($$C$$, $$G$$))::INTEGER AS g FROM pssm WHERE motif_id = {m!r} AND pos = {i + 1}) s{i}' for i in range(len(r)))}" for m, r in SCORES.items())}),
kind AS (SELECT motif_id, score, g, count(*) AS n FROM kinds GROUP BY ALL),
top AS (SELECT motif_id, seq_name, max(score) AS best FROM hits GROUP BY ALL)"""


@query(f"WITH {SCAN}, {_COMP} SELECT t.motif_id, t.seq_name, best, round(sum(n * pow(gc_, g) * pow(at_, w - g)), 7) AS best_p FROM top t JOIN comp USING (seq_name) JOIN kind k ON k.motif_id = t.motif_id AND k.score >= best JOIN width ON width.motif_id = t.motif_id GROUP BY ALL")
def own_composition(t):
    """P-values of best scores under each sequence's own composition."""
    a = C.affinity(docs(t), PSSMS, "doc_id", "seq", MAX_P, own=True).where("n_windows > 0")
    return a.select("motif_id", "seq_name", "best", F.round("best_p", 7).alias("best_p"))


@query(f"WITH {SCAN} SELECT motif_id, seq_name, start, stop, strand, score, round(pvalue, 9) AS pvalue FROM hits WHERE pvalue <= {MAX_P}")
def blocked_scan(t):
    """The scan in blocks of 100 symbols, which makes no difference."""
    return C.scan_blocks(docs(t), PSSMS, "doc_id", "seq", MAX_P, size=100).select("motif_id", "seq_name", "start", "stop", "strand", "score", F.round("pvalue", 9).alias("pvalue"))


# Priors whose log odds are whole: 0 to 3, by place; as whole scores have offset 0 and scale 1, so have sums of both.
@query(f"""WITH {SCAN}, s AS (SELECT motif_id, doc_id::VARCHAR AS seq_name, start, strand, score + (doc_id * 31 + start * 17) % 4 AS score FROM sites),
e AS (SELECT motif_id, score + j AS score FROM every_word, range(0, 4) x(j)), v AS (SELECT DISTINCT motif_id, score, count(*) OVER (PARTITION BY motif_id ORDER BY score DESC RANGE UNBOUNDED PRECEDING) / (4 * pow(4.0, w)) AS p FROM e JOIN width USING (motif_id))
SELECT motif_id, seq_name, start::INTEGER AS start, strand, score::INTEGER AS score, round(p, 9) AS pvalue FROM s JOIN v USING (motif_id, score) WHERE p <= 0.001""")
def scan_with_priors(t):
    """Scores and p-values with a prior at every place."""
    d = docs(t)
    at = d.select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)))).alias("pos"))
    odds = F.pow(F.lit(2.0), (F.col("doc_id") * 31 + F.col("pos") * 17) % 4)
    priors = at.select("doc_id", "pos", (odds / (odds + 1)).alias("prior"))
    bins = np.zeros(1000)  # of the range in which these four priors are middles of bins, as good as
    low, high = 0.4995, 0.8895
    for j in range(4):
        bins[int((2**j / (2**j + 1) - low) / (high - low) * 1000)] = 0.25
    found = C.scan_with_priors(d, PSSMS, priors, bins, low, high, 1.0, "doc_id", "seq", 0.001)
    return found.select("motif_id", "seq_name", "start", "strand", "score", F.round("pvalue", 9).alias("pvalue"))


@query(f"WITH {DOCS}, m AS (SELECT length(seq) AS len FROM d GROUP BY 1 ORDER BY count(*) DESC, len LIMIT 1) SELECT doc_id, seq FROM d, m WHERE length(seq) = len")
def equal_lengths(t):
    return G.equal_length(docs(t)).select("doc_id", "seq")


@query(f"WITH {DOCS} SELECT doc_id, length(seq) AS n FROM d WHERE length(seq) >= 60")
def long_enough(t):
    return G.long_enough(docs(t), 60).select("doc_id", F.length("seq").cast("bigint").alias("n"))


@query("SELECT event_id, value FROM events WHERE value >= 50")
def psm_filter(t):
    return G.passing(t.events, "value", "ge", 50.0).select("event_id", "value")


@query("SELECT item_id FROM benchmark WHERE NOT contains(upper(text), 'X')")
def known_only(t):
    return G.known_only(t.benchmark, "text").select("item_id")


@query(f"WITH {DOCS}, {WINDOWS.format(k=4)} SELECT doc_id, i::INTEGER AS start, '+' AS strand, w AS matched FROM w4 WHERE regexp_full_match(w, 'A[CG]T[AG]') UNION ALL SELECT doc_id, i::INTEGER, '-', w FROM w4 WHERE regexp_full_match({RC.format('w')}, 'A[CG]T[AG]')")
def iupac_both_strands(t):
    return L.iupac_hits(docs(t), "ASTR", "doc_id")


@query(f"WITH {DOCS}, p AS (SELECT unnest(['ACGT', 'AAAA', 'TAT']) AS part), x AS (SELECT doc_id, part, seq, unnest(range(1, length(seq) - length(part) + 2)) AS i FROM d, p) SELECT doc_id, part, i::INTEGER AS start FROM x WHERE substr(seq, i, length(part)) = part")
def substring_search(t):
    return L.substring_hits(docs(t), ["ACGT", "AAAA", "TAT"], "doc_id")


# Bounded results and samples ------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS}, c AS (SELECT event_id, event_type, s, count(*) OVER (PARTITION BY event_type ORDER BY s RANGE UNBOUNDED PRECEDING) AS k FROM e) SELECT event_id, event_type, s FROM c WHERE k <= 100")
def bounded_results(t):
    """The hundred best of each kind at most; all that tie at the bound go."""
    return G.bounded(events(t), 100, "s", ["event_type"]).select("event_id", "event_type", "s")


@query("SELECT event_id FROM events ORDER BY ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT, event_id LIMIT 50")
def reservoir_sample(t):
    return G.reservoir(t.events, 50, "event_id", 7).select("event_id")


_POISSON = " + ".join(f"(u >= {x!r})::INTEGER" for x in G.POISSON)


@query(f"WITH x AS (SELECT event_id, ('0x' || substr(md5('3:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events) SELECT event_id, ({_POISSON})::INTEGER AS weight FROM x")
def bootstrap_weights(t):
    return G.bootstrap(t.events, "event_id", 3).select("event_id", "weight")


@query("SELECT event_id, floor(('0x' || substr(md5('1:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 5)::INTEGER AS \"group\" FROM events")
def validation_groups(t):
    return G.groups(t.events, "event_id", 5).select("event_id", "group")


@query(f"""WITH {DOCS}, {', '.join(WINDOWS.format(k=k) for k in (4, 5, 6))}, x AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, w FROM w4 UNION ALL SELECT doc_id, w FROM w5 UNION ALL SELECT doc_id, w FROM w6)), c AS (SELECT length(w)::INTEGER AS width, w AS word, count(*) AS n_seqs FROM x GROUP BY ALL)
SELECT width, word, n_seqs FROM (SELECT *, row_number() OVER (PARTITION BY width ORDER BY n_seqs DESC, word) AS r FROM c) WHERE r <= 20""")
def seed_heaps(t):
    """The twenty best words of each width."""
    found = None
    for k in (4, 5, 6):
        own = Q.word_presence(docs(t), k, "doc_id").select(F.lit(k).alias("width"), "word", "n_seqs")
        found = own if found is None else found.unionByName(own)
    return G.best_seeds(found, 20, "n_seqs", ["width"], "word")


@query("SELECT o_orderkey AS id, o_totalprice AS score FROM orders UNION ALL SELECT event_id, value FROM events UNION ALL SELECT p_partkey, p_retailprice FROM part")
def merged_streams(t):
    return G.merged(["score", "id"], t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), t.events.select(F.col("event_id").alias("id"), F.col("value").alias("score")), t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")))


# Motif tables ---------------------------------------------------------------------------------------------------------

_CELLS = ", ".join(f"('{m.id}', {p + 1}, '{s}', {m.freqs[p, j]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for m in MOTIFS for p in range(m.width) for j, s in enumerate("ACGT"))
_BG = {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}


@query(f"""WITH c(motif_id, pos, sym, f) AS (VALUES {_CELLS}), o AS (SELECT *, log2((f * 20 + 0.1 * CASE WHEN sym IN ('A', 'T') THEN 0.3 ELSE 0.2 END) / 20.1 / CASE WHEN sym IN ('A', 'T') THEN 0.3 ELSE 0.2 END) AS x FROM c),
r AS (SELECT motif_id, floor(min(x)) AS low, floor({P.RANGE} / (max(x) - floor(min(x)) - (min(x) - floor(min(x))))) AS scale FROM o GROUP BY 1)
SELECT motif_id, pos, sym, round((x - low) * scale)::BIGINT AS score, low AS "offset", scale FROM o JOIN r USING (motif_id)""")
def scaled_matrices(t):
    """Whole scores of three motifs, with their offset and scale."""
    rows = []
    for p in (P.build(m, np.array(list(_BG.values()))) for m in MOTIFS):
        rows += [(p.motif_id, i + 1, s, int(p.scores[i, j]), p.offset, p.scale) for i in range(p.width) for j, s in enumerate(p.symbols)]
    return t.spark.createDataFrame(rows, "motif_id string, pos int, sym string, score bigint, offset double, scale double")


@query(f"WITH {MATRIX}, s AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS sym), p AS (SELECT DISTINCT motif_id, pos FROM f) SELECT motif_id, pos, sym, round(coalesce(freq, 0.0), 9) AS freq FROM p CROSS JOIN s LEFT JOIN f USING (motif_id, pos, sym)")
def remapped_motifs(t):
    """Motifs over another alphabet: symbols it lacks go, symbols it adds get 0."""
    return M.remap_rows(part_motifs(t), "abcdefghijklmnopqrstuvwxyz").withColumn("freq", F.round("freq", 9))


@query("SELECT motif_id, (row_number() OVER (ORDER BY motif_id))::VARCHAR AS new_id FROM (SELECT DISTINCT p_brand AS motif_id FROM part)")
def renumbered_motifs(t):
    return M.renamed(part_motifs(t), numbers=True)


@query(f"WITH {MATRIX} SELECT 'brands' AS db, motif_id, pos, sym, round(freq, 9) AS freq FROM f UNION ALL SELECT 'again', motif_id, pos, sym, round(freq, 9) FROM f WHERE pos <= 3")
def motif_union(t):
    m = part_motifs(t).select("motif_id", "pos", "sym", F.round("freq", 9).alias("freq"))
    return M.union_rows(brands=m, again=m.where("pos <= 3"))


@query("WITH w AS (SELECT upper(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS s FROM conversations), m AS (SELECT substr(s, i, 5) AS x FROM (SELECT s, unnest(range(1, length(s) - 3)) AS i FROM w)), k AS (SELECT substr(x, 3, 1) AS residue, count(*) AS total FROM m WHERE substr(x, 3, 1) IN ('S', 'T', 'Y') GROUP BY 1 HAVING count(*) >= 20) SELECT residue, total, p::INTEGER AS pos, substr(x, p, 1) AS sym, count(*) AS n FROM m JOIN k ON residue = substr(x, 3, 1), range(1, 6) r(p) GROUP BY ALL")
def simple_modification_motifs(t):
    """Counts around each modified residue that occurs twenty times or more."""
    letters = t.conversations.select(F.upper(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("seq"))
    windows = letters.select(F.explode(S.words("seq", 5)).alias("x")).withColumn("residue", F.substring("x", 3, 1)).where(F.col("residue").isin("S", "T", "Y"))
    total = windows.groupBy("residue").agg(F.count("*").alias("total")).where("total >= 20")  # a row for each residue
    cells = windows.select("residue", F.posexplode(F.filter(F.split("x", ""), lambda c: c != "")).alias("p", "sym")).groupBy("residue", (F.col("p") + 1).alias("pos"), "sym").agg(F.count("*").alias("n"))
    return cells.join(F.broadcast(total), "residue").select("residue", "total", "pos", "sym", "n")


# Alignments -----------------------------------------------------------------------------------------------------------

ROWS = "s AS (SELECT conv_id || '/' || turn // 3 AS aln_id, 's' || turn % 3 AS species, upper(regexp_replace(text, '[^ACGTNacgtn]', '-', 'g')) AS seq FROM conversations), c AS (SELECT aln_id, species, i::INTEGER AS col, substr(seq, i, 1) AS base FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM s))"


def gapped_alignment(t):
    """Conversations, three turns at a time, as alignments with a gap for every symbol but A, C, G, T and N."""
    rows = t.conversations.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 3).cast("string")).alias("aln_id"), F.concat(F.lit("s"), (F.col("turn") % 3).cast("string")).alias("species"), F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", "-")).alias("seq"))
    return readers.alignment_columns(rows)


@query(f"WITH {ROWS} SELECT aln_id, species, col - 4 AS col, base FROM c WHERE col BETWEEN 5 AND 24")
def alignment_slice(t):
    return A.cut(gapped_alignment(t), 5, 20)


@query(f"WITH {ROWS} SELECT aln_id, species, col, base FROM c WHERE NOT EXISTS (SELECT 1 FROM c g WHERE g.species = 's0' AND g.base = '-' AND g.aln_id = c.aln_id AND g.col = c.col)")
def alignment_without_gaps(t):
    return readers.drop_gap_columns(gapped_alignment(t), "s0")


@query(f"WITH {ROWS} SELECT aln_id, species, col, base, sum((base <> '-')::INTEGER) OVER (PARTITION BY aln_id, species ORDER BY col)::BIGINT AS seq_pos FROM c")
def alignment_coordinates(t):
    return readers.coordinate_map(gapped_alignment(t))


def _all_in(groups):
    return " OR ".join(f"len(list_filter(set, lambda b: NOT contains('{g}', b))) = 0" for g in groups)


@query(f"WITH {ROWS}, k AS (SELECT aln_id, col, list(DISTINCT base) AS set, bool_or(base = '-') AS gap FROM c GROUP BY ALL), x AS (SELECT aln_id, CASE WHEN gap THEN 'o' WHEN len(set) = 1 THEN 'i' WHEN {_all_in(A.STRONG)} THEN 's' WHEN {_all_in(A.WEAK)} THEN 'w' ELSE 'o' END AS k FROM k) SELECT aln_id, count(*) FILTER (k = 'i') AS identical, count(*) FILTER (k = 's') AS strong, count(*) FILTER (k = 'w') AS weak, count(*) FILTER (k = 'o') AS other FROM x GROUP BY 1")
def alignment_conservation_kinds(t):
    return A.conserved(gapped_alignment(t))


@query(f"WITH {ROWS} SELECT aln_id, col, bool_or(base = '-') AS gap, bool_or(base = 'N') AS ambiguous FROM c GROUP BY ALL")
def alignment_column_tests(t):
    return A.column_tests(gapped_alignment(t))


@query(f"WITH {ROWS}, n AS (SELECT aln_id, col, base, count(*) AS n FROM c WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY aln_id, col) AS f FROM n) SELECT aln_id, round(sum(f * log2(f / CASE WHEN base IN ('A', 'T') THEN 0.3 ELSE 0.2 END)), 5) AS bits FROM f GROUP BY 1")
def alignment_entropy(t):
    return A.relative_entropy(gapped_alignment(t), _BG).withColumn("bits", F.round("bits", 5))


@query(f"WITH {DOCS}, l AS (SELECT doc_id, i, substr(seq, i, 1) AS c FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM d)) SELECT doc_id, i::INTEGER AS pos, round(sum(ln(CASE WHEN c IN ('A', 'T') THEN 0.3 ELSE 0.2 END)) OVER (PARTITION BY doc_id ORDER BY i), 2) AS logp FROM l")
def cumulative_background(t):
    """Running sums of log background probabilities, every one."""
    return Q.cumulative_background(docs(t), _BG, "doc_id").withColumn("logp", F.round("logp", 2))


@query(f"WITH {SCAN}, m AS (SELECT DISTINCT seq_name, start, stop FROM hits WHERE pvalue <= 0.002), l AS (SELECT doc_id, i, substr(seq, i, 1) AS c FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM d)), h AS (SELECT DISTINCT seq_name::BIGINT AS doc_id, unnest(range(start, stop + 1)) AS i FROM m), p AS (SELECT l.doc_id, l.i, c, h.i IS NOT NULL AS hide FROM l LEFT JOIN h ON h.doc_id = l.doc_id AND h.i = l.i) SELECT doc_id, string_agg(CASE WHEN hide THEN 'N' ELSE c END, '' ORDER BY i) AS seq FROM p GROUP BY 1")
def masked_sites(t):
    sites = hits(t, 0.002).select(F.col("seq_name").cast("bigint").alias("doc_id"), "start", "stop")
    return A.mask_sites(docs(t).where(F.length("seq") > 0).select("doc_id", "seq"), sites, "doc_id")


# Enrichment -----------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT l_suppkey AS g, l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_extendedprice AS y FROM lineitem), u AS (SELECT g, id, x, y FROM l QUALIFY count(*) OVER (PARTITION BY id) = 1),
o AS (SELECT g, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM u GROUP BY 1), p AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY id) AS k FROM u),
s AS (SELECT g, turn, x, row_number() OVER (PARTITION BY g, turn ORDER BY ('0x' || substr(md5('1:' || turn || ':' || id), 1, 13))::BIGINT) AS k FROM u, range(1, 11) r(turn)),
n AS (SELECT g, turn, regr_r2(p.y, s.x) AS r2 FROM s JOIN p USING (g, k) GROUP BY ALL)
SELECT g, round(slope, 4) AS slope, round(o.r2, 6) AS r2, count(*) FILTER (n.r2 >= o.r2) AS below FROM o JOIN n USING (g) GROUP BY ALL""")
def regression_simulated(t):
    """Regression in each group against ten dealings of its values."""
    u = t.lineitem.select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    u = u.withColumn("c", F.count("*").over(Window.partitionBy("id"))).where("c = 1").drop("c")
    return E.regression_enrichment(u, "g", "id", "x", "y", 10).select("g", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), "below")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS c, n_nationkey // 3 AS p FROM nation WHERE n_nationkey > 0), x(c, p) AS (SELECT c, p FROM e UNION SELECT x.c, e.p FROM x JOIN e ON x.p = e.c), l AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0), y AS (SELECT * FROM x WHERE c IN (FROM l) AND p IN (FROM l)) SELECT k AS term, (SELECT count(*) FROM y WHERE c = k) AS n_above, (SELECT count(*) FROM y WHERE p = k) AS n_below, (SELECT count(*) FROM y WHERE p = k) > 0 AS implied FROM l")
def marked_terms(t):
    """Terms of a hierarchy with how many listed ones stand above and below."""
    checkpointed(t.spark)
    edges = t.nation.where("n_nationkey > 0").select(F.col("n_nationkey").alias("child"), F.expr("n_nationkey div 3").cast("int").alias("parent"))
    listed = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("term"))
    return E.marked(listed, E.closure(edges, "child", "parent"), "term", "child", "parent")


@query(f"""WITH {SCAN}, {BEST}, b1 AS (SELECT seq_name, min(start) AS s FROM k WHERE motif_id = 'M1' GROUP BY 1), b2 AS (SELECT seq_name, min(start) AS s FROM k WHERE motif_id = 'M2' GROUP BY 1),
o AS (SELECT seq_name, length(seq) AS len, abs(20 - (b2.s - b1.s)) AS err FROM b1 JOIN b2 USING (seq_name) JOIN d ON doc_id::VARCHAR = seq_name), m AS (SELECT *, len - 5 + 1 AS np, greatest(20 - err, 5 - len) AS lo, least(20 + err, len - 5) AS hi FROM o)
SELECT seq_name, round(CASE WHEN lo >= 0 THEN (hi - lo + 1) * (np - (hi + lo) / 2.0) ELSE -lo * (np - (1 - lo) / 2.0) + (hi + 1) * (np - hi / 2.0) END / (np * np), 9) AS pvalue FROM m WHERE hi >= lo""")
def diagram_spacing(t):
    """How well the two motifs' best sites keep a nominal spacing of 20 symbols."""
    b = best_starts(t).groupBy("seq_name").pivot("motif_id", ["M1", "M2"]).agg(F.min("start")).where("M1 is not null and M2 is not null")
    d = docs(t).select(F.col("doc_id").cast("string").alias("seq_name"), F.length("seq").alias("len"))
    p = Z.spacing_pvalue(F.lit(20), F.col("M2") - F.col("M1"), F.lit(5), F.col("len"))
    return b.join(d, "seq_name").select("seq_name", F.round(p, 9).alias("pvalue")).where("pvalue is not null")


@query()
def calibrated_clusters(t):
    """Clusters of hits with p-, E- and q-values by scores of synthetic sequences of the same composition."""
    checkpointed(t.spark)
    return C.calibrated_clusters(docs(t), PSSMS, "doc_id", max_p=MAX_P)


@query()
def affinity_pvalues(t):
    """P-values of average likelihood ratios by share of G and C."""
    return C.affinity_pvalues(docs(t), PSSMS, "doc_id")


@query(f"WITH {SCAN}, h AS (SELECT seq_name, motif_id, start, stop, strand, round(pvalue, 9) AS p FROM hits WHERE pvalue <= {MAX_P}) SELECT seq_name, count(*) AS n, count(DISTINCT motif_id) AS motifs, min(p) AS best FROM h GROUP BY 1")
def hit_diagrams(t):
    h = hits(t).withColumn("p", F.round("pvalue", 9))
    return h.groupBy("seq_name").agg(F.count("*").alias("n"), F.countDistinct("motif_id").alias("motifs"), F.min("p").alias("best"))


@query(f"WITH {DOCS}, l AS (SELECT d.*, quality FROM d JOIN labels USING (doc_id)), {{p}} SELECT word, pos, neg, round((pos + 1.0) / (pos + neg + 2.0), 9) AS prior FROM (SELECT w AS word, count(DISTINCT doc_id) FILTER (quality = 1) AS pos, count(DISTINCT doc_id) FILTER (quality = 0) AS neg FROM x GROUP BY 1)".replace("{p}", "x AS (SELECT doc_id, quality, substr(seq, i, 5) AS w FROM (SELECT *, unnest(range(1, length(seq) - 3)) AS i FROM l))"))
def discriminative_words(t):
    """Shares of documents of quality 1 among those that hold a word, with a count of one added on each side."""
    l = docs(t).join(t.labels, "doc_id")  # noqa: E741
    n = l.select("doc_id", "quality", F.explode(F.array_distinct(S.words("seq", 5))).alias("word")).groupBy("word").agg(F.countDistinct(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("pos"), F.countDistinct(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("neg"))
    return n.withColumn("prior", F.round((F.col("pos") + 1.0) / (F.col("pos") + F.col("neg") + 2.0), 9))


@query(f"WITH {EVENTS}, c AS (SELECT user_id, sum(value) AS score FROM events GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY score DESC) AS k FROM c) SELECT user_id, round(score, 6) AS score, k FROM r WHERE k <= 10")
def score_sort(t):
    """The ten sequences of best score, with ties."""
    c = t.events.groupBy("user_id").agg(F.sum("value").alias("score"))
    top = R.top_k(c.withColumn("all", F.lit(0)), 10, [F.desc("score")], ["all"])
    least = top.agg(F.min("score").alias("least"))
    best = c.join(F.broadcast(least), F.col("score") >= F.col("least"))  # few more than ten
    return best.select("user_id", F.round("score", 6).alias("score"), F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))).alias("k"))


@query(f"WITH {DOCS} SELECT doc_id, {MIDDLE.format(n=30)} AS mid, length({MIDDLE.format(n=30)})::INTEGER AS n FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def fetched_sequences(t):
    """Sequences fetched by a list of ids."""
    wanted = t.labels.where("toxic = 1").select(F.col("doc_id").alias("seq_name"))
    got = readers.fetch(docs(t).withColumnRenamed("doc_id", "seq_name"), wanted)
    return got.select(F.col("seq_name").alias("doc_id"), S.centred(F.col("seq"), 30).alias("mid")).withColumn("n", F.length("mid"))


@query("WITH x AS (SELECT l_suppkey AS term, exp(avg(ln(l_quantity))) AS score FROM lineitem GROUP BY 1) SELECT term, round(score, 6) AS score, rank() OVER (ORDER BY round(score, 6)) + (count(*) OVER (PARTITION BY round(score, 6)) - 1) / 2.0::DOUBLE AS place FROM x")
def ranked_terms(t):
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("term")).agg(F.round(F.exp(F.avg(F.log("l_quantity"))), 6).alias("score"))
    return R.average_ranks(g, "score", out="place")
