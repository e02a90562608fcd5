"""Queries through files: each writes tables by a writer, beside the checkpoints, and reads them back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.functions import symbols as S
from strandlake.operators import motifs as M
from strandlake.operators import phylo
from strandlake.operators import sequences as Q
from strandlake.operators import tracks as T
from strandlake.plans.registry import query, scratch
from strandlake.plans.sequences import DOCS, MARKOV, MAX_P, MIDDLE, RC, SCAN, WINDOWS, docs, hits
from strandlake.sources import readers, writers


def _written(t, frame, name):
    path = scratch(t.spark, name)
    frame.write.text(path)
    return path


# Sequences, tracks and tables -----------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT doc_id::VARCHAR AS seq_name, seq FROM d")
def fasta_round_trip(t):
    path = _written(t, writers.fasta(docs(t).select(F.col("doc_id").cast("string").alias("seq_name"), "seq")), "fasta")
    return readers.read_fasta(t.spark, path).select("seq_name", "seq")


_PLACE = "CASE WHEN doc_id % 2 = 0 THEN source || ':' || doc_id || '-' || (doc_id + n_chars) ELSE source || '_' || doc_id END"


@query(f'SELECT {_PLACE} AS seq_name, CASE WHEN doc_id % 2 = 0 THEN source ELSE source || \'_\' || doc_id END AS chrom, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS "offset", upper(regexp_replace(text, \'[^A-Za-z]\', \'\', \'g\')) AS seq FROM documents')
def genomic_names(t):
    """Names with genomic places, from a FASTA file of protein-like sequences."""
    name = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(":"), "doc_id", F.lit("-"), F.col("doc_id") + F.col("n_chars"))).otherwise(F.concat_ws("_", "source", "doc_id"))
    rows = t.documents.select(name.alias("seq_name"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    return readers.genomic_coordinates(readers.read_fasta(t.spark, _written(t, writers.fasta(rows), "places"))).select("seq_name", "chrom", "offset", "seq")


@query("SELECT 'u' || user_id AS chrom, event_id AS start, 1::BIGINT AS span, value / 1000000 AS value FROM events")
def wiggle_round_trip(t):
    """A track of small numbers, many of them in exponent form."""
    track = t.events.select(F.concat(F.lit("u"), "user_id").alias("chrom"), F.col("event_id").alias("start"), (F.col("value") / 1000000).alias("value"))
    return readers.read_wiggle(t.spark, _written(t, writers.wiggle(track), "wiggle"))


@query("SELECT 'u' || user_id AS seq_name, 8 AS width, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS pos, value / 1000 AS prior FROM events")
def psp_round_trip(t):
    rows = t.events.select(F.concat(F.lit("u"), "user_id").alias("seq_name"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("pos"), (F.col("value") / 1000).alias("prior"))
    return readers.read_psp(t.spark, _written(t, writers.psp(rows, 8), "psp"))


@query("SELECT value AS score FROM events WHERE event_type <> 'error'")
def score_column(t):
    """The second column of lines, those of errors being comments."""
    lines = t.events.select(F.concat(F.when(F.col("event_type") == "error", "# ").otherwise(""), "event_id", F.lit("  "), F.col("value").cast("string")).alias("value"))
    return readers.read_scores(t.spark, _written(t, lines, "scores"), 2)


@query("SELECT DISTINCT l_suppkey::VARCHAR AS term, l_partkey::VARCHAR AS gene FROM lineitem")
def term_map_round_trip(t):
    """Lines of a term and its genes, in several lines where there are many."""
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct().withColumn("line", F.pmod(F.hash("l_partkey"), F.lit(16)))
    lines = pairs.groupBy("l_suppkey", "line").agg(F.concat_ws("\t", F.col("l_suppkey").cast("string"), F.sort_array(F.collect_list(F.col("l_partkey").cast("string")))).alias("value"))
    return readers.read_map(t.spark, _written(t, lines.select("value"), "map"))


@query(f"WITH {SCAN} SELECT motif_id, seq_name::INTEGER AS seq_name, start, stop, strand, score, round(pvalue, 9) AS pvalue FROM hits WHERE pvalue <= {MAX_P}")
def hit_table_round_trip(t):
    path = scratch(t.spark, "hits")
    writers.write_hits(hits(t), path)
    r = readers.read_table(t.spark, path)
    return r.select("motif_id", F.col("sequence_name").cast("int").alias("seq_name"), "start", "stop", "strand", "score", F.round(F.col("`p-value`"), 9).alias("pvalue"))


_MATCHED = f"CASE strand WHEN '+' THEN substr(seq, start, stop - start + 1) ELSE {RC.format('substr(seq, start, stop - start + 1)')} END"


@query(f"WITH {SCAN} SELECT motif_id, seq_name, CASE strand WHEN '+' THEN start ELSE stop END AS start, CASE strand WHEN '+' THEN stop ELSE start END AS stop, score::DOUBLE AS score, round(pvalue, 9) AS pvalue, {_MATCHED} AS matched FROM hits JOIN d ON doc_id::VARCHAR = seq_name WHERE pvalue <= {MAX_P}")
def cisml_round_trip(t):
    path = scratch(t.spark, "cisml")
    writers.write_cisml(hits(t), path)
    return readers.read_cisml(t.spark, path).withColumn("pvalue", F.round("pvalue", 9))


@query(f"WITH {SCAN} SELECT motif_id, seq_name, start, stop, strand, score, round(pvalue, 9) AS pvalue FROM hits WHERE pvalue <= {MAX_P}")
def json_report_round_trip(t):
    path = scratch(t.spark, "json")
    writers.write_json(hits(t), path)
    match = "array<struct<start:int,stop:int,strand:string,score:int,pvalue:double>>"
    each = t.spark.read.schema(f"motif_id string, seq_name string, matches {match}").json(path).select("motif_id", "seq_name", F.explode("matches").alias("m")).select("motif_id", "seq_name", "m.*")
    return each.withColumn("pvalue", F.round("pvalue", 9))


@query(f"WITH {SCAN} SELECT seq_name, 'strandlake' AS source, 'nucleotide_motif' AS type, start, stop, round(least(1000.0, -10 * log10(pvalue)), 2) AS score, strand, '.' AS phase, motif_id, round(pvalue, 9) AS pvalue FROM hits WHERE pvalue <= {MAX_P}")
def gff3_round_trip(t):
    """All nine columns, the last one taken apart."""
    path = scratch(t.spark, "gff3")
    writers.write_gff3(hits(t), path)
    f = F.split("value", "\t")
    note = lambda k: F.regexp_extract(f[8], rf"(?:^|;){k}=([^;]*)", 1)
    return t.spark.read.text(path).select(f[0].alias("seq_name"), f[1].alias("source"), f[2].alias("type"), f[3].cast("int").alias("start"), f[4].cast("int").alias("stop"), f[5].cast("double").alias("score"), f[6].alias("strand"), f[7].alias("phase"), note("Name").alias("motif_id"), F.round(note("pvalue").cast("double"), 9).alias("pvalue"))


# Small files ----------------------------------------------------------------------------------------------------------


@query(MARKOV.format(docs=DOCS, windows=", ".join(WINDOWS.format(k=k) for k in (1, 2, 3))).replace("SELECT tuple, n, round", "SELECT tuple, round"))
def background_file(t):
    """A background of order 2 through its file, a line for each tuple."""
    rows = Q.background(docs(t), 2).select("tuple", "p").collect()  # 84 rows
    bg = readers.read_background("# order 2\n" + "\n".join(f"{r.tuple} {r.p!r}" for r in rows))
    return t.spark.createDataFrame([(k, round(p, 9)) for k, p in bg.items()], "tuple string, p double")


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), n AS (SELECT least(19, floor((value - lo) / (hi - lo) * 20))::INTEGER AS bin, count(*) AS n FROM events, e GROUP BY 1) SELECT b::INTEGER AS bin, lo, hi, coalesce(n, 0) / (SELECT count(*) FROM events)::DOUBLE AS share FROM range(20) r(b) CROSS JOIN e LEFT JOIN n ON bin = b")
def prior_distribution_file(t):
    """The distribution of values through its file: header figures and twenty shares."""
    counts = {r.bin: r.n for r in T.histogram(t.events, "value", 20).collect()}  # 20 rows
    lo, hi = t.events.agg(F.min("value"), F.max("value")).first()
    total = sum(counts.values()) or 1
    head, bins = readers.read_prior_distribution(writers.prior_distribution({"min": lo, "max": hi}, [counts.get(i, 0) / total for i in range(20)]))
    return t.spark.createDataFrame([(i, head["min"], head["max"], x) for i, x in enumerate(bins)], "bin int, lo double, hi double, share double")


_LANGS = f"WITH {DOCS}, x AS (SELECT lang, {MIDDLE.format(n=8)} AS s FROM d WHERE length(seq) >= 8 AND lang IS NOT NULL), c AS (SELECT lang, pos::INTEGER AS pos, substr(s, pos, 1) AS sym FROM x, range(1, 9) r(pos)), n AS (SELECT lang, pos, sym, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT DISTINCT lang, pos FROM n), a AS (SELECT unnest(['A', 'C', 'G', 'T']) AS sym), f AS (SELECT k.lang, k.pos, a.sym, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.lang, k.pos) AS freq FROM k CROSS JOIN a LEFT JOIN n ON n.lang = k.lang AND n.pos = k.pos AND n.sym = a.sym)"
DIALECTS = ["meme", "xml", "dreme", "html", "transfac", *writers.COUNT_FORMS]


def language_motifs(t):
    """A motif for each language: how often a base stands at each place of its sequences' middle eight symbols."""
    d = docs(t).where("lang is not null").where(F.length("seq") >= 8).select("lang", S.centred(F.col("seq"), 8).alias("s"))
    cells = d.select(F.col("lang").alias("motif_id"), F.posexplode(F.filter(F.split("s", ""), lambda c: c != "")).alias("p", "sym"))
    return M.from_rows(M.normalise(cells.groupBy("motif_id", (F.col("p") + 1).alias("pos"), "sym").agg(F.count("*").alias("n"))))


@query(f"{_LANGS} SELECT dialect, lang AS motif_id, pos, sym, round(CASE dialect WHEN 'meme' THEN printf('%.6f', freq::DOUBLE)::DOUBLE ELSE freq END, 9) AS freq FROM f, (SELECT unnest({DIALECTS}) AS dialect)")
def motif_dialects(t):
    """The languages' motifs written in each dialect and read back."""
    own, out = language_motifs(t), []
    for d in DIALECTS:
        for m in readers.load_motifs(writers.motif_text(own, d), d):
            out += [(d, m.id, i + 1, s, round(float(m.freqs[i, j]), 9)) for i in range(m.width) for j, s in enumerate(m.alphabet.core)]
    return t.spark.createDataFrame(out, "dialect string, motif_id string, pos int, sym string, freq double")


@query(f"{_LANGS}, b AS (SELECT lang, pos, string_agg(sym, '' ORDER BY sym) AS own FROM (SELECT *, max(freq) OVER (PARTITION BY lang, pos) AS top FROM f) WHERE freq >= top / 2 GROUP BY ALL) SELECT lang AS motif_id, pos, a.sym, CASE WHEN contains(own, a.sym) THEN round(1.0 / length(own), 9) ELSE 0 END::DOUBLE AS freq FROM b, a")
def iupac_motifs(t):
    """The languages' motifs as ambiguity codes, and motifs made of the codes again."""
    again = [readers.from_iupac(m.id, m.iupac()) for m in language_motifs(t)]
    return M.motif_rows(t.spark, again).withColumn("freq", F.round("freq", 9))


@query(f"{_LANGS}, b AS (SELECT lang, pos, string_agg(sym, '' ORDER BY sym) AS own FROM f WHERE freq >= 0.25 GROUP BY ALL) SELECT lang AS motif_id, pos, a.sym, CASE WHEN contains(own, a.sym) THEN round(1.0 / length(own), 9) ELSE 0 END::DOUBLE AS freq FROM b, a")
def regex_motifs(t):
    """The languages' motifs as patterns of classes, each of the symbols of a quarter or more, read as motifs."""
    lines = "\n".join(f"{m.id} " + "".join(f"[{''.join(s for s, f in zip('ACGT', row, strict=True) if f >= 0.25)}]" for row in m.freqs) for m in language_motifs(t))
    return M.motif_rows(t.spark, readers.load_motifs(lines, "regexp")).withColumn("freq", F.round("freq", 9))


@query(f"{_LANGS}, g AS (SELECT a.lang AS one, b.lang AS two, a.pos, a.sym, a.freq AS x, b.freq AS y FROM f a JOIN f b ON a.pos = b.pos AND a.sym = b.sym) SELECT one, two, round(avg(r), 6) AS score FROM (SELECT one, two, pos, corr(x, y) AS r FROM g GROUP BY ALL) GROUP BY ALL")
def aligned_correlations(t):
    """Mean correlation of the columns of each two motifs, one over the other."""
    from strandlake.operators import compare

    own = language_motifs(t)
    rows = [(a.id, b.id, round(float(np.mean(np.diag(compare.column_scores(a.freqs, b.freqs, "pearson")))), 6)) for a in own for b in own]
    return t.spark.createDataFrame(rows, "one string, two string, score double")


_TREE = "WITH n AS (SELECT r_name AS parent, n_name AS child, 1.0 + n_nationkey / 4.0 AS length FROM nation JOIN region ON n_regionkey = r_regionkey), r AS (SELECT 'root' AS parent, r_name AS child, 0.5 AS length FROM region WHERE r_name IN (SELECT parent FROM n)), e AS (FROM r UNION ALL FROM n)"


def world(t):
    """Nations below their regions as a tree, through its text."""
    under: dict[str, list[str]] = {}
    for r in t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect():  # the nations of the world
        under.setdefault(r.r_name, []).append(f"{r.n_name}:{1 + r.n_nationkey / 4}")
    return phylo.parse_newick("(" + ",".join(f"({','.join(v)}){k}:0.5" for k, v in sorted(under.items())) + ")root;")


def _edges(node):
    for c in node.children:
        yield node.label, c.label, float(c.length)
        yield from _edges(c)


@query(f"{_TREE} SELECT parent, child, length::DOUBLE AS length FROM e")
def tree_edges(t):
    return t.spark.createDataFrame(list(_edges(world(t))), "parent string, child string, length double")


@query(f"{_TREE}, k AS (SELECT * FROM n JOIN nation ON child = n_name WHERE n_nationkey % 3 = 0), z AS (SELECT parent, count(*) AS z FROM k GROUP BY 1) SELECT CASE WHEN z > 1 THEN parent ELSE 'root' END AS parent, child, CASE WHEN z > 1 THEN length ELSE length + 0.5 END::DOUBLE AS length FROM k JOIN z USING (parent) UNION ALL SELECT 'root', parent, 0.5 FROM z WHERE z > 1")
def trimmed_tree(t):
    """The tree with every third nation only; a region left with one of them passes its length on."""
    keep = {r.n_name for r in t.nation.where("n_nationkey % 3 = 0").collect()}  # nations
    tree = phylo.trim(world(t), keep)
    return t.spark.createDataFrame(list(_edges(tree)) if tree else [], "parent string, child string, length double")


@query(f"{_TREE}, k AS (SELECT * FROM n JOIN nation ON child = n_name WHERE n_nationkey % 2 = 1) SELECT (sum(length) + 0.5 * count(DISTINCT parent))::DOUBLE / (SELECT sum(length) FROM e)::DOUBLE AS score FROM k")
def branch_length(t):
    """The share of the tree's length that joins the odd nations."""
    odd = {r.n_name for r in t.nation.where("n_nationkey % 2 = 1").collect()}  # nations
    return t.spark.createDataFrame([(float(phylo.branch_length_score(world(t), odd)),)], "score double")
