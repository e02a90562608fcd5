"""Queries over documents as sequences: their texts' A, C, G and T, in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import symbols as S
from strandlake.operators import lookup as L
from strandlake.operators import motifs as M
from strandlake.operators import pssm as P
from strandlake.operators import ranking as R
from strandlake.operators import scan as C
from strandlake.operators import sequences as Q
from strandlake.plans.registry import Tables, checkpointed, query

DOCS = "d AS (SELECT doc_id, source, lang, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
WINDOWS = "w{k} AS (SELECT doc_id, i, substr(seq, i, {k}) AS w FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM d))"
RC = "translate(reverse({0}), 'ACGT', 'TGCA')"


def docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "lang", S.core_only("text").alias("seq"))


@query(f"WITH {DOCS}, {WINDOWS.format(k=3)} SELECT w AS word, count(DISTINCT doc_id) AS n_seqs FROM w3 GROUP BY w")
def kmer_presence(t):
    return Q.word_presence(docs(t), 3, "doc_id")


@query(f"WITH {DOCS}, {WINDOWS.format(k=4)} SELECT least(w, {RC.format('w')}) AS word, count(DISTINCT doc_id) AS n_seqs FROM w4 GROUP BY 1")
def kmer_presence_canonical(t):
    return Q.word_presence(docs(t), 4, "doc_id", alphabet=S.DNA)


MARKOV = """WITH {docs}, a AS (SELECT unnest(['A','C','G','T']) AS x), {windows},
e AS (SELECT x AS tuple, 1 AS k FROM a UNION ALL SELECT p.x || q.x, 2 FROM a p, a q UNION ALL SELECT p.x || q.x || r.x, 3 FROM a p, a q, a r),
c AS (SELECT w, count(*) AS n FROM (SELECT w FROM w1 UNION ALL SELECT w FROM w2 UNION ALL SELECT w FROM w3) GROUP BY w),
j AS (SELECT tuple, k, coalesce(n, 0) AS n FROM e LEFT JOIN c ON tuple = w)
SELECT tuple, n, round((n + 0.1 / pow(4, k)) / (sum(n) OVER (PARTITION BY k) + 0.1), 9) AS p FROM j"""


@query(MARKOV.format(docs=DOCS, windows=", ".join(WINDOWS.format(k=k) for k in (1, 2, 3))))
def markov_background(t):
    return Q.background(docs(t), 2).select("tuple", "n", F.round("p", 9).alias("p"))


@query(f"WITH {DOCS} SELECT count(seq) AS n_seqs, min(length(seq)) AS min_len, max(length(seq)) AS max_len, round(avg(length(seq)), 6) AS avg_len, sum(length(seq))::BIGINT AS total_len FROM d")
def seq_stats(t):
    return Q.seq_stats(docs(t)).withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {DOCS} SELECT length(seq) AS len, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, len LIMIT 1")
def modal_length(t):
    return Q.modal_length(docs(t))


@query(f"WITH {DOCS}, {WINDOWS.format(k=1)} SELECT w AS sym, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS freq FROM w1 GROUP BY w")
def letter_freqs(t):
    return Q.letter_freqs(docs(t)).withColumn("freq", F.round("freq", 9))


@query(f"WITH {DOCS} SELECT doc_id, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(seq), 0), 9) AS gc FROM d WHERE length(seq) > 0")
def gc_content(t):
    return docs(t).select("doc_id", F.round(S.gc_content("seq"), 9).alias("gc")).where("gc is not null")


@query(f"WITH {DOCS} SELECT doc_id, {RC.format('seq')} AS rc FROM d")
def reverse_complement(t):
    return docs(t).select("doc_id", S.reverse_complement("seq").alias("rc"))


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.CODONS.items()) + "}"


@query(f"WITH {DOCS} SELECT doc_id, coalesce(array_to_string(list_transform(range(1, length(seq) - 1, 3), lambda i: {_MAP}[substr(seq, i, 3)]), ''), '') AS protein FROM d")
def translate_codons(t):
    return docs(t).select("doc_id", S.translate_dna("seq").alias("protein"))


@query("SELECT p_partkey, strpos(upper(p_name), 'A') AS first_a, length(regexp_replace(p_name, '[a-z]', 'N', 'g')) AS n FROM part")
def hard_mask(t):
    return t.part.select("p_partkey", F.instr(F.upper("p_name"), "A").cast("bigint").alias("first_a"), F.length(S.hard_mask("p_name")).cast("bigint").alias("n"))


@query("WITH c AS (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS i, p_name FROM part) SELECT i::INTEGER AS pos, substr(p_name, i, 1) AS sym, count(*) AS n FROM c GROUP BY 1, 2")
def count_matrix(t):
    return Q.count_matrix(t.part, "p_name")


MATRIX = "c AS (SELECT p_brand AS motif_id, unnest(range(1, length(p_name) + 1)) AS i, p_name FROM part), n AS (SELECT motif_id, i::INTEGER AS pos, substr(p_name, i, 1) AS sym, count(*) AS n FROM c GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY motif_id, pos) AS freq FROM n)"


def part_motifs(t: Tables) -> DataFrame:
    cells = t.part.select(F.col("p_brand").alias("motif_id"), F.posexplode(F.filter(F.split("p_name", ""), lambda c: c != "")).alias("p", "sym"))
    return M.normalise(cells.groupBy("motif_id", (F.col("p") + 1).alias("pos"), "sym").agg(F.count("*").alias("n")))


@query(f"WITH {MATRIX} SELECT motif_id, pos, sym, n, round(freq, 9) AS freq FROM f")
def position_freqs(t):
    return part_motifs(t).withColumn("freq", F.round("freq", 9))


@query(f"WITH {MATRIX} SELECT motif_id, pos, round(log2(32) + sum(freq * log2(freq)), 6) AS bits FROM f GROUP BY ALL")
def info_content(t):
    return M.information(part_motifs(t), 32).withColumn("bits", F.round("bits", 6))


@query(f"WITH {MATRIX}, b AS (SELECT motif_id, pos, log2(32) + sum(freq * log2(freq)) AS bits FROM f GROUP BY ALL) SELECT motif_id, min(pos) AS first, max(pos) AS last FROM b WHERE bits >= 2.5 GROUP BY 1")
def trim_by_bits(t):
    return M.trim_bounds(part_motifs(t), 32, 2.5)


@query(f"WITH {MATRIX}, m AS (SELECT motif_id, pos, first(sym ORDER BY freq DESC, sym) AS sym FROM f GROUP BY ALL) SELECT motif_id, string_agg(sym, '' ORDER BY pos) AS consensus FROM m GROUP BY 1")
def consensus(t):
    return M.consensus(part_motifs(t))


@query(f"WITH {MATRIX} SELECT motif_id, pos, sym, round((freq * 20 + 0.1 * 0.04) / 20.1, 9) AS freq, round(100 * log2((freq * 20 + 0.1 * 0.04) / 20.1 / 0.04), 4) AS score FROM f")
def pseudocount_log_odds(t):
    bg = dict.fromkeys(map(chr, range(32, 127)), 0.04)
    return M.log_odds(M.pseudocount(part_motifs(t), 20.0, 0.1, bg), bg).select("motif_id", "pos", "sym", F.round("freq", 9).alias("freq"), F.round("score", 4).alias("score"))


@query(f"WITH {MATRIX}, w AS (SELECT motif_id, max(pos) AS w FROM f GROUP BY 1) SELECT motif_id, w + 1 - pos AS pos, translate(sym, 'acgt', 'tgca') AS sym, round(freq, 9) AS freq FROM f JOIN w USING (motif_id) WHERE sym IN ('a','c','g','t')")
def motif_reverse_complement(t):
    low = S.Alphabet("dna", "acgt", {}, {}, {"a": "t", "c": "g", "g": "c", "t": "a"})
    return M.reverse_complement_rows(part_motifs(t), low).where("sym is not null").withColumn("freq", F.round("freq", 9))


# Two motifs with whole scores, and their p-values under a uniform background.
SCORES = {"M1": [[3, 0, 1, 0], [0, 3, 0, 1], [1, 0, 3, 0], [0, 1, 0, 3], [3, 1, 0, 0]], "M2": [[2, 0, 0, 2], [0, 2, 2, 0], [3, 0, 0, 0], [0, 0, 3, 0], [0, 2, 0, 2], [2, 0, 2, 0]]}
PSSMS = [P.from_integers(k, v, np.full(4, 0.25)) for k, v in SCORES.items()]
_VALUES = ", ".join(f"('{m}', {p}, '{s}', {v})" for m, rows in SCORES.items() for p, row in enumerate(rows, 1) for s, v in zip("ACGT", row, strict=True))
# Every word's score, from the scores alone: how many words of a width score so much or more.
_WORDS = " UNION ALL ".join(f"SELECT '{m}' AS motif_id, {' + '.join(f's{i}.s' for i in range(len(rows)))} AS score FROM {', '.join(f'(SELECT s FROM pssm WHERE motif_id = {m!r} AND pos = {i + 1}) s{i}' for i in range(len(rows)))}" for m, rows in SCORES.items())
_WIDTH = ", ".join(f"('{p.motif_id}', {p.width})" for p in PSSMS)
SCAN = f"""{DOCS}, pssm(motif_id, pos, sym, s) AS (VALUES {_VALUES}), width(motif_id, w) AS (VALUES {_WIDTH}), every_word AS ({_WORDS}),
pv AS (SELECT DISTINCT motif_id, score, count(*) OVER (PARTITION BY motif_id ORDER BY score DESC RANGE UNBOUNDED PRECEDING) / pow(4.0, w) AS p FROM every_word JOIN width USING (motif_id)),
rows_ AS (SELECT motif_id, pos, sym, s, '+' AS strand FROM pssm UNION ALL SELECT motif_id, w + 1 - pos, translate(sym, 'ACGT', 'TGCA'), s, '-' FROM pssm JOIN width USING (motif_id)),
letters AS (SELECT doc_id, i, substr(seq, i, 1) AS sym FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM d)),
sites AS (SELECT motif_id, strand, doc_id, i - pos + 1 AS start, sum(s)::INTEGER AS score FROM letters JOIN rows_ USING (sym) JOIN width USING (motif_id) GROUP BY ALL HAVING count(*) = any_value(w)),
hits AS (SELECT motif_id, doc_id::VARCHAR AS seq_name, start::INTEGER AS start, (start + w - 1)::INTEGER AS stop, strand, score, p AS pvalue FROM sites JOIN width USING (motif_id) JOIN pv USING (motif_id, score))"""
MAX_P = 0.004


def hits(t: Tables, max_p: float = MAX_P) -> DataFrame:
    return C.scan(docs(t), PSSMS, "doc_id", "seq", max_p)


@query(f"WITH {SCAN} SELECT motif_id, seq_name, start, stop, strand, score, round(pvalue, 9) AS pvalue FROM hits WHERE pvalue <= {MAX_P}")
def pssm_scan_both_strands(t):
    return hits(t).select("motif_id", "seq_name", "start", "stop", "strand", "score", F.round("pvalue", 9).alias("pvalue"))


QVALUES = f"""tested AS (SELECT motif_id, 2 * sum(greatest(length(seq) - w + 1, 0)) AS n FROM d, width GROUP BY 1),
best AS (SELECT *, least(1.0, pvalue * n / row_number() OVER (PARTITION BY motif_id ORDER BY pvalue)) AS fdr FROM hits JOIN tested USING (motif_id) WHERE pvalue <= {MAX_P}),
q AS (SELECT *, min(fdr) OVER (PARTITION BY motif_id ORDER BY pvalue RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qvalue FROM best)"""


@query(f"WITH {SCAN}, {QVALUES} SELECT motif_id, seq_name, start, stop, strand, score, round(pvalue, 9) AS pvalue, round(qvalue, 9) AS qvalue FROM q")
def scan_pvalue_qvalue(t):
    d = docs(t)
    checkpointed(t.spark)
    found = C.with_qvalues(hits(t).checkpoint(), C.windows_tested(d, PSSMS))  # hits are read twice, documents scanned once
    return found.select("motif_id", "seq_name", "start", "stop", "strand", "score", F.round("pvalue", 9).alias("pvalue"), F.round("qvalue", 9).alias("qvalue"))


@query(f"WITH {SCAN} SELECT motif_id, seq_name, count(*)::INTEGER AS n_windows, max(score) AS best, round(min(pvalue), 9) AS best_p, count(*) FILTER (pvalue <= {MAX_P})::INTEGER AS total_hits, round(avg(pow(2.0, score)), 6) AS avg_odds FROM hits GROUP BY ALL")
def affinity(t):
    a = C.affinity(docs(t), PSSMS, "doc_id", "seq", MAX_P).where("n_windows > 0")
    return a.select("motif_id", "seq_name", "n_windows", "best", F.round("best_p", 9).alias("best_p"), "total_hits", F.round("avg_odds", 6).alias("avg_odds"))


BEST_E = """b AS (SELECT motif_id, seq_name, count(*) AS n, min(pvalue) AS p FROM hits GROUP BY ALL),
e_ AS (SELECT seq_name, CASE WHEN p * n <= 0.001 THEN p * n ELSE 1 - pow(1 - p, n) END AS ev FROM b), k AS (SELECT seq_name, count(*)::INTEGER AS n, exp(sum(ln(ev))) AS k FROM e_ GROUP BY 1)"""


@query(f"WITH {SCAN}, {BEST_E} SELECT seq_name, n, round(CASE WHEN n = 1 THEN k ELSE k * (1 - ln(k)) END, 6) AS pvalue FROM k")
def sequence_search(t):
    """Combined p-value of each sequence over both motifs."""
    s = C.affinity(docs(t), PSSMS, "doc_id", "seq", MAX_P)
    return C.sequence_evalues(s, 1).select("seq_name", "n", F.round("pvalue", 6).alias("pvalue"))


@query(f"WITH {SCAN} SELECT motif_id, seq_name, start, strand, score FROM (SELECT *, rank() OVER (PARTITION BY motif_id, seq_name ORDER BY score DESC) AS r FROM hits WHERE pvalue <= {MAX_P}) WHERE r = 1")
def best_sites_with_ties(t):
    return R.best_with_ties(hits(t).select("motif_id", "seq_name", "start", "strand", "score"), "score", ["motif_id", "seq_name"]).select("motif_id", "seq_name", "start", "strand", "score")


@query(f"WITH {SCAN} SELECT motif_id, seq_name, start, strand, score FROM (SELECT *, row_number() OVER (PARTITION BY motif_id ORDER BY score DESC, seq_name, start, strand) AS r FROM hits WHERE pvalue <= {MAX_P}) WHERE r <= 25")
def top_hits_per_motif(t):
    return R.top_k(hits(t), 25, [F.desc("score"), F.col("seq_name"), F.col("start"), F.col("strand")], ["motif_id"]).select("motif_id", "seq_name", "start", "strand", "score")


@query(f"""WITH {SCAN}, o AS (SELECT *, max(stop) OVER (PARTITION BY seq_name ORDER BY start, stop, motif_id, strand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM hits WHERE pvalue <= {MAX_P}),
c AS (SELECT *, sum(CASE WHEN p IS NULL OR start - p - 1 > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_name ORDER BY start, stop, motif_id, strand ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM o)
SELECT seq_name, cluster, min(start) AS start, max(stop) AS stop, count(*) AS n_hits, round(sum(-log2(pvalue)), 6) AS score FROM c GROUP BY ALL""")
def hit_clusters(t):
    return C.clusters(hits(t)).withColumn("score", F.round("score", 6))


# Hits of each sequence in order, and what is kept after each of them.
TILED = f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seq_name ORDER BY start, motif_id, strand) AS i FROM hits WHERE pvalue <= {MAX_P}),
steps(seq_name, i, kept) AS (SELECT DISTINCT seq_name, 0::BIGINT, []::STRUCT(motif_id VARCHAR, start INTEGER, stop INTEGER, strand VARCHAR, score INTEGER, pvalue DOUBLE)[] FROM o UNION ALL
SELECT o.seq_name, o.i, CASE WHEN o.pvalue < coalesce(list_aggregate(list_transform(list_filter(kept, lambda k: k.stop >= o.start), lambda k: k.pvalue), 'product'), 2) THEN list_append(list_filter(kept, lambda k: k.stop < o.start), {{'motif_id': o.motif_id, 'start': o.start, 'stop': o.stop, 'strand': o.strand, 'score': o.score, 'pvalue': o.pvalue}}) ELSE kept END FROM steps JOIN o ON o.seq_name = steps.seq_name AND o.i = steps.i + 1),
tiled AS (SELECT seq_name, unnest(kept, recursive := true) FROM (SELECT seq_name, kept FROM steps QUALIFY row_number() OVER (PARTITION BY seq_name ORDER BY i DESC) = 1))"""


@query(f"WITH RECURSIVE {SCAN}, {TILED} SELECT motif_id, seq_name, start, stop, strand, score, round(pvalue, 9) AS pvalue FROM tiled")
def tiled_hits(t):
    """Hits that don't overlap."""
    return C.tile(hits(t)).drop("matched").withColumn("pvalue", F.round("pvalue", 9))


@query(f"WITH {SCAN} SELECT motif_id || '|' || seq_name || '|' || start || '|' || stop AS line FROM hits WHERE pvalue <= {MAX_P} AND strand = '+'")
def hit_lines(t):
    return hits(t).where("strand = '+'").select(F.concat_ws("|", "motif_id", "seq_name", "start", "stop").alias("line"))


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, i, substr(seq, i, 1) AS c FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM d)),
m AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN c IN ('A', 'T') THEN ln(0.3) ELSE ln(0.2) END) AS logp FROM l GROUP BY 1) SELECT doc_id, n, round(logp, 6) AS logp FROM m""")
def log_background(t):
    """The last of each sequence's running sums of log background probabilities."""
    at = F.length(F.regexp_replace("seq", "[^AT]", ""))
    n = F.length("seq")
    return docs(t).where(n > 0).select("doc_id", n.cast("bigint").alias("n"), F.round(at * F.log(F.lit(0.3)) + (n - at) * F.log(F.lit(0.2)), 6).alias("logp"))


@query(f"""WITH {DOCS}, {WINDOWS.format(k=5)} SELECT doc_id, min(list_sum(list_transform(range(1, 6), lambda j: (substr(w, j, 1) <> substr('ACGTA', j, 1))::INTEGER)))::INTEGER AS distance FROM w5 GROUP BY 1""")
def hamming_best(t):
    return Q.hamming_best(docs(t), "ACGTA", "doc_id").where("distance is not null")


@query(f"WITH {DOCS}, {WINDOWS.format(k=4)} SELECT doc_id, i::INTEGER AS start, w AS matched FROM w4 WHERE regexp_full_match(w, 'A[CG]T[AG]')")
def iupac_grep(t):
    return L.pattern_hits(docs(t), S.iupac_regex("ASTR"), "doc_id")


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN length(seq) <= 40 THEN seq ELSE substr(seq, CAST(floor((length(seq) - 40) / 2) AS INTEGER) + 1, 40) END AS mid FROM d")
def centre_trim(t):
    return docs(t).select("doc_id", S.centred(F.col("seq"), 40).alias("mid"))


@query("SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '_' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def unique_names(t):
    return Q.unique_names(t.part, "p_name", "p_partkey").select("p_partkey", "unique_name")


@query(f"WITH {DOCS} SELECT mid, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, CASE WHEN length(seq) <= 12 THEN seq ELSE substr(seq, CAST(floor((length(seq) - 12) / 2) AS INTEGER) + 1, 12) END AS mid FROM d) GROUP BY mid")
def dedup_by_centre(t):
    return docs(t).groupBy(S.centred(F.col("seq"), 12).alias("mid")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, CASE WHEN k <= 100 THEN 'sample' ELSE 'rest' END AS part FROM o")
def subsample(t):
    """A sample of 100 by hash and the rest, labelled."""
    d = docs(t).select("doc_id")
    some = Q.subsample(d, 100, "doc_id").withColumn("part", F.lit("sample"))
    return some.unionByName(Q.remainder(d, some, "doc_id").withColumn("part", F.lit("rest")))


@query()
def shuffled_letters(t):
    """Shuffles that keep the counts of pairs of letters."""
    return Q.shuffle_letters(docs(t).select("doc_id", "seq"), "doc_id", k=2)


@query()
def synthetic_sequences(t):
    return Q.synthesize(t.spark, 1000, 100, {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3})


@query()
def dust(t):
    return Q.dust_mask(docs(t).select("doc_id", "seq"))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT doc_id, lang, 0 FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def union_with_controls(t):
    d = t.documents.join(t.labels, "doc_id")
    return d.where("quality = 1").select("doc_id", "lang", "quality").unionByName(d.where("quality = 0").select("doc_id", "lang", F.lit(0).alias("quality")))


@query(f"WITH {DOCS}, {WINDOWS.format(k=6)}, p AS (SELECT DISTINCT source, w FROM w6 JOIN d USING (doc_id)) SELECT w AS word, count(*) AS n_sources FROM p GROUP BY w HAVING count(*) >= (SELECT count(DISTINCT source) FROM d) / 2")
def words_in_most_sources(t):
    d = docs(t)
    pairs = d.select("source", F.explode(F.array_distinct(S.words("seq", 6))).alias("word")).groupBy("word").agg(F.countDistinct("source").alias("n_sources"))
    return pairs.crossJoin(F.broadcast(d.agg(F.countDistinct("source").alias("all")))).where("n_sources >= all / 2").select("word", "n_sources")


@query("WITH s AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1), n AS (SELECT s_suppkey, s_nationkey FROM supplier) SELECT a.k AS a, b.k AS b, len(list_intersect(a.p, b.p))::INTEGER AS n FROM s a JOIN s b ON b.k = a.k + 1")
def shared_ids(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_partkey").alias("p"))
    return s.alias("a").join(s.alias("b"), F.col("b.k") == F.col("a.k") + 1).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.size(F.array_intersect("a.p", "b.p")).alias("n"))


MIDDLE = "CASE WHEN length(seq) <= {n} THEN seq ELSE substr(seq, CAST(floor((length(seq) - {n}) / 2) AS INTEGER) + 1, {n}) END"


@query(f"WITH {DOCS}, p AS (SELECT DISTINCT {MIDDLE.format(n=9)} AS peptide FROM d JOIN labels USING (doc_id)), {WINDOWS.format(k=9)}, s AS (SELECT peptide, doc_id, unnest(range(1, length(seq) - length(peptide) + 2)) AS i, seq FROM p, d WHERE length(peptide) BETWEEN 1 AND 8 AND contains(seq, peptide)) SELECT peptide, doc_id, i::INTEGER AS start FROM p JOIN w9 ON w = peptide UNION ALL SELECT peptide, doc_id, i::INTEGER FROM s WHERE substr(seq, i, length(peptide)) = peptide")
def kmer_lookup_join(t):
    """Where the middles of labelled sequences occur in all sequences."""
    middles = docs(t).select("doc_id", S.centred(F.col("seq"), 9).alias("peptide")).join(t.labels, "doc_id").select("peptide")
    return L.peptide_lookup(middles, docs(t), "doc_id")
