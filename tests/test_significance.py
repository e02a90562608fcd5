"""Tables of significance, substitution models, formats and selections against enumeration and known values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.discover import em
from strandlake.functions import significance as Z
from strandlake.functions import symbols as S
from strandlake.operators import alignment, enrich, hmm, lookup, motifs, phylo, pssm, scan, select, tracks
from strandlake.sources import readers, writers

BG = np.array([0.3, 0.2, 0.2, 0.3])
MOTIF = motifs.Motif("m", np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1], [0.1, 0.1, 0.1, 0.7]]), nsites=10)


def test_karlin_of_a_simple_walk():
    lam, k, h = Z.karlin(-1, np.array([0.75, 0.0, 0.25]))
    assert lam == pytest.approx(math.log(3)) and k == pytest.approx((0.75 - 0.25) ** 2 / 0.75, rel=1e-6)
    assert h == pytest.approx(lam * (0.25 * 3 - 0.75 / 3) / math.log(2))
    with pytest.raises(ValueError):
        Z.karlin(-1, np.array([0.2, 0.0, 0.8]))


def test_llr_table_against_enumeration():
    t = Z.LlrTable(BG)
    for n in (2, 5, 7):
        scores = []
        for k in itertools.product(range(n + 1), repeat=4):
            if sum(k) == n:
                p = math.exp(math.lgamma(n + 1) - sum(math.lgamma(x + 1) for x in k) + sum(x * math.log(b) for x, b in zip(k, BG, strict=True)))
                scores.append((sum(x * math.log(x / (n * b)) for x, b in zip(k, BG, strict=True) if x), p))
        for s, _ in scores:
            low, high = (sum(p for x, p in scores if x >= s + e) for e in (0.01, -0.06))
            assert math.log(max(low, 1e-300)) - 1e-6 <= t.log_p(s, n, 1) <= math.log(high) + 1e-6
    assert t.log_p(9.0, 39, 2) == pytest.approx(Z.log_upper_gamma(3.0, 9.0), abs=0.4)
    assert Z.log_upper_gamma(1.0, 5.0) == pytest.approx(-5.0) and Z.log_upper_gamma(2.0, 0.5) == pytest.approx(math.log(1.5 * math.exp(-0.5)))
    assert Z.log_product(math.log(0.01), 2) == pytest.approx(math.log(0.01 * (1 + math.log(100)))) and Z.log_product(-3.0, 1) == pytest.approx(-3.0)


def test_alignment_counts():
    assert Z.log_alignments([5, 6], 3, 1) == pytest.approx(math.log(7)) and Z.log_alignments([5, 6], 3, 2) == pytest.approx(math.log(12))
    assert Z.log_alignments([5, 6], 3, 2, "anr") == pytest.approx(math.log(21)) and Z.log_placements(4, 3.0, 2) == pytest.approx(math.log(6 * 9))


def test_dirichlet_and_substitution():
    one = Z.dirichlet_posterior([3, 0, 0, 1], np.array([1.0]), np.ones((1, 4)))
    assert one == pytest.approx([4 / 8, 1 / 8, 1 / 8, 2 / 8])
    mix = Z.dirichlet_posterior([50, 0, 0, 0], np.array([0.5, 0.5]), np.array([[9.0, 0.1, 0.1, 0.1], [0.1, 9.0, 9.0, 9.0]]))
    assert mix[0] > 0.97 and mix.sum() == pytest.approx(1)
    m, f = Z.nucleotide_unit()
    joint = Z.substitution(m, f, 50, odds=False)
    assert joint.sum() == pytest.approx(1) and np.allclose(joint, joint.T) and Z.substitution(m, f, 50)[0, 0] > 0 > Z.substitution(m, f, 50)[0, 1]
    assert np.allclose(Z.substitution(m, f, 10**6, odds=False), 1 / 16)
    w, a = readers.parse_dirichlet("Mixture= 0.4\nAlpha= 3 1 1 0.5 0.5\nMixture= 0.6\nAlpha= 4 1 1 1 1\n")
    assert w.tolist() == [0.4, 0.6] and a.tolist() == [[1, 1, 0.5, 0.5], [1, 1, 1, 1]] and readers.parse_dirichlet("0.3 1 2\n0.7 2 1\n")[1].tolist() == [[1, 2], [2, 1]]
    s, x = readers.parse_score_matrix("# c\n  A C\nA 1 -1\nC -1 2\n")
    assert s == "AC" and x.tolist() == [[1, -1], [-1, 2]]
    assert em.maximise(np.array([[3.0, 0, 0, 1]]), BG, 0.0, (np.array([1.0]), np.ones((1, 4))))[0] == pytest.approx(one)


def test_gc_tables_and_affinity(spark):
    p = pssm.build(MOTIF, BG)
    t = Z.gc_tables(p, 3)
    assert t[1] == pytest.approx(pssm.tail(pssm.distribution(p.scores, np.full(4, 0.25)))) and (t[:, 0] > 0.999).all()
    one = Z.affinity_pvalue(2.0 ** float(p.raw(p.scores.max(axis=1).sum())), 1, 0.5, p, t)
    assert one == pytest.approx(1 / 64) and Z.affinity_pvalue(1e-9, 10, 0.5, p, t) == pytest.approx(1.0)
    df = spark.createDataFrame([("a", "ACTACTACT"), ("b", "GGGGGGGGG"), ("c", ""), ("d", None)], "seq_name string, seq string")
    got = {r["seq_name"]: r["pvalue"] for r in scan.affinity_pvalues(df, [p]).collect()}
    assert set(got) == {"a", "b"} and 0 < got["a"] < got["b"] <= 1


def test_priors_shift_scores_and_pvalues(spark):
    p = pssm.from_integers("m", [[3, 0, 1, 0], [0, 3, 0, 1]], np.full(4, 0.25))
    pv = pssm.with_prior_distribution(p, np.array([1.0, 1.0]), 0.25, 0.85)  # middles 0.4 and 0.7: log odds -0.58 and 1.22
    words = [(a + b, x) for a, b in itertools.product([3, 0, 1, 0], [0, 3, 0, 1]) for x in (0, 1)]  # below 0 counts as 0
    assert [pv[s] for s in range(8)] == pytest.approx([sum(w + x >= s for w, x in words) / 32 for s in range(8)])
    flat = pssm.with_prior_distribution(p, np.ones(5), 0.5, 0.5)
    assert flat[: len(p.pv)] == pytest.approx(p.pv)
    df = spark.createDataFrame([("a", "ACAC"), ("b", None), ("c", "AC")], "seq_name string, seq string")
    priors = spark.createDataFrame([("a", 3, 0.999), ("a", 99, 0.5), ("zz", 1, 0.5)], "seq_name string, pos int, prior double")
    got = {(r["seq_name"], r["start"]): r["score"] for r in scan.scan_with_priors(df, [p], priors, np.ones(5), 0.4, 0.9, max_p=1.0, both_strands=False).collect()}
    assert got["a", 3] > got["a", 1] == got["c", 1] == 7


def test_blocks_and_lookups(spark):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ACGT"), 1000))
    df = spark.createDataFrame([(2**60 + 1, text), (None, "ACGTACGT"), (3, None), (4, "")], "id bigint, seq string")
    p = pssm.build(MOTIF, BG)
    key = lambda rows: sorted((r["seq_name"] or "", r["start"], r["strand"], r["score"]) for r in rows)
    named = df.where("id is not null")
    assert key(scan.scan_blocks(named, [p], "id", "seq", 0.1, size=37).collect()) == key(scan.scan(named, [p], "id", "seq", 0.1).collect())
    hits = lookup.iupac_hits(df, "ASTR", "id").collect()
    want = [(i, s) for i, x in enumerate([text[k : k + 4] for k in range(997)]) for s, y in (("+", x), ("-", x[::-1].translate(str.maketrans("ACGT", "TGCA")))) if y[0] == "A" and y[1] in "CG" and y[2] == "T" and y[3] in "AG"]
    assert sorted((r["start"] - 1, r["strand"]) for r in hits if r["id"] == 2**60 + 1) == sorted(want)
    peptides = spark.createDataFrame([(text[5:25],), (text[5:24] + "N",), ("ACG",), ("",), (None,), ("ACGTACGT",)], "peptide string")
    found = {(r["peptide"], r["id"], r["start"]) for r in lookup.peptide_lookup(peptides, df, "id").collect()}
    assert (text[5:25], 2**60 + 1, 6) in found and not any(x[0].endswith("N") for x in found)
    assert {s for x, i, s in found if x == "ACG" and i == 2**60 + 1} == {k + 1 for k in range(998) if text[k : k + 3] == "ACG"}


def test_peptides_in_every_row_without_a_shuffle(spark, monkeypatch):
    """Against brute force: null and repeated names, peptides that begin alike, odd symbols, several passes and blocks."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (300, 200, 1, 0)] + ["A" * 70 + "C", None, "\u00e9 \U0001f600\u00e9 x\ud7ff"]
    rows = list(zip([None, 2**60 + 1, 2**60 + 1, 4, None, 6, 7], texts, strict=True))
    peptides = [texts[0][9:18], texts[1][:40], texts[1][:39] + "N", texts[1][:33], "A", "C", "AC", "A" * 60, "A" * 69 + "C", "A" * 72, "\u00e9 \U0001f600", " ", "A C", "T ", "", None, "A"]
    want = sorted((str(i), p, k + 1) for i, x in rows for p in {p for p in peptides if p} for k in range(len(x or "")) if x.startswith(p, k))
    df, own = spark.createDataFrame(rows, "id bigint, seq string"), spark.createDataFrame([(p,) for p in peptides], "peptide string")
    for size, block in ((1 << 19, 1 << 18), (4, 16)):
        monkeypatch.setattr(lookup, "PASS", size)
        monkeypatch.setattr(lookup, "BLOCK", block)
        found = lookup.peptide_lookup(own, df, "id")
        assert sorted((str(r["id"]), r["peptide"], r["start"]) for r in found.collect()) == want
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert lookup.peptide_lookup(own.where("peptide is null"), df, "id").collect() == []


def test_selections(spark):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "ACG"), ("c", "TTTT"), ("d", "AXGTT"), ("e", None)], "id string, seq string")
    ids = lambda x: sorted(r["id"] for r in x.collect())
    assert ids(select.equal_length(df)) == ["a", "c"] and ids(select.long_enough(df, 4)) == ["a", "c", "d"] and ids(select.known_only(df)) == ["a", "b", "c", "e"]
    h = spark.createDataFrame([("m", p) for p in (0.1, 0.2, 0.2, 0.2, 0.3)] + [("n", 0.5)], "motif_id string, pvalue double")
    assert select.bounded(h, 3, "pvalue", ["motif_id"]).count() == 2 and select.bounded(h, 4, "pvalue", ["motif_id"]).count() == 5
    many = spark.range(4000).withColumnRenamed("id", "k")
    w = [r["weight"] for r in select.bootstrap(many, "k").collect()]
    assert abs(np.mean(w) - 1) < 0.06 and abs(np.var(w) - 1) < 0.1
    assert sorted(r["n"] for r in select.groups(many, "k", 4).groupBy("group").agg(F.count("*").alias("n")).collect())[0] > 900
    with pytest.raises(KeyError):
        select.passing(df, "id", "near", 1.0)


def test_masks_and_conserved_columns(spark):
    df = spark.createDataFrame([("a", "ACGTACGT"), ("b", "AAAA")], "id string, seq string")
    sites = spark.createDataFrame([("a", 2, 3), ("a", 3, 5), ("a", 2, 3)], "id string, start int, stop int")
    assert {r["id"]: r["seq"] for r in alignment.mask_sites(df, sites, "id").collect()} == {"a": "ANNNNCGT", "b": "AAAA"}
    aln = spark.createDataFrame([("x", s, i + 1, b) for s, t in (("s", "STACW-"), ("t", "TTVSW-"), ("u", "AT-APA")) for i, b in enumerate(t)], "aln_id string, species string, col int, base string")
    r = alignment.conserved(aln).first()
    assert (r["identical"], r["strong"], r["weak"], r["other"]) == (1, 1, 1, 3)


def test_motif_and_result_formats(spark, tmp_path):
    dreme = '<dreme><model><alphabet name="DNA"><letter id="A" symbol="A"/><letter symbol="C"/><letter symbol="G"/><letter symbol="T"/></alphabet></model><motifs><motif id="m01" alt="D-1" seq="AC" length="2" nsites="9" evalue="1e-3"><pos A="0.9" C="0.1" G="0" T="0"/><pos A="0" C="1" G="0" T="0"/><match seq="AC"/></motif></motifs></dreme>'
    (m,) = readers.parse_dreme_xml(dreme)
    assert (m.id, m.alt_id, m.nsites, m.evalue) == ("AC", "D-1", 9, 1e-3) and m.freqs.tolist() == [[0.9, 0.1, 0, 0], [0, 1, 0, 0]]
    cis = '<?xml version="1.0"?><cis-element-search><parameters/><pattern accession="M1" name="M1"><scanned-sequence accession="s" name="s1"><matched-element start="3" stop="5" score="2.5" pvalue="0.01"><sequence>ACG</sequence></matched-element><matched-element start="9" stop="7" score="1.5" pvalue="0.02"><sequence>TTT</sequence></matched-element></scanned-sequence></pattern><pattern accession="M2" name="M2"/></cis-element-search>'
    (tmp_path / "c.xml").write_text(cis)
    got = sorted(map(tuple, readers.read_cisml(spark, str(tmp_path / "c.xml")).collect()))
    assert got == [("M1", "s1", 3, 5, 2.5, 0.01, "ACG"), ("M1", "s1", 9, 7, 1.5, 0.02, "TTT")]
    bg = readers.parse_hart_background("0.3 0.2 0.2 0.3\n0.4 0.2 0.2 0.2\n0.25 0.25 0.25 0.25\n0.25 0.25 0.25 0.25\n0.1 0.2 0.3 0.4\n")
    assert bg["A"] == 0.3 and bg["AA"] == pytest.approx(0.12) and bg["TT"] == pytest.approx(0.12) and sum(v for k, v in bg.items() if len(k) == 2) == pytest.approx(1)
    svg = writers.logo_svg(MOTIF)
    assert svg.startswith("<svg") and svg.count("<text") >= 3
    hits = spark.createDataFrame([("M<1", "s", 1, 3, "+", 5, 0.1)], "motif_id string, seq_name string, start int, stop int, strand string, score int, pvalue double")
    page = [r["value"] for r in writers.hit_html(hits).collect()]
    assert page[0].startswith("<!DOCTYPE") and "<td>M&lt;1</td>" in page[1] and page[2] == "</table>"
    aln = spark.createDataFrame([("x", 0, "one", "AC-GT" * 30), ("x", 1, "two", "ACCGT" * 30)], "aln_id string, row int, species string, seq string")
    text = writers.msf(aln).first()["value"]
    assert "MSF: 150" in text and text.count("\none ") == 3 and "AC.GT" in text


def test_clusters_are_calibrated(spark):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("ACGT"), 300)) for _ in range(30)]
    rich = plain[0][:100] + "ACTGACTCACTTACTACTGACT" + plain[0][122:]
    df = spark.createDataFrame([("rich", rich), *[(str(i), s) for i, s in enumerate(plain[1:])]], "seq_name string, seq string")
    if spark.sparkContext.getCheckpointDir() is None:
        from strandlake.plans.registry import checkpointed

        checkpointed(spark)
    rows = scan.calibrated_clusters(df, [pssm.build(MOTIF, np.full(4, 0.25))], max_p=0.02, max_gap=5, copies=2).collect()
    assert all(0 < r["pvalue"] <= 1 and 0 <= r["qvalue"] <= 1 and r["evalue"] == pytest.approx(r["pvalue"] * len(rows)) for r in rows)
    assert min(rows, key=lambda r: (r["pvalue"], -r["score"]))["seq_name"] == "rich"


def test_fits():
    rng = np.random.default_rng(1)
    mu, lam = hmm.fit_gumbel(rng.gumbel(3.0, 1 / 0.7, 20000))
    assert mu == pytest.approx(3.0, abs=0.05) and lam == pytest.approx(0.7, abs=0.02)
    m = hmm.fit_mixture(np.concatenate([rng.exponential(1.0, 9000), rng.normal(12, 1, 1000)]))
    assert m["mean"] == pytest.approx(12, abs=0.2) and m["weight"] == pytest.approx(0.1, abs=0.02) and m["rate"] == pytest.approx(1.0, abs=0.1)


def test_small_tables(spark, tmp_path):
    tree = phylo.parse_newick("((a:0.2,b:0.3):0.1,c:0.4);")
    assert phylo.branch_length_score(tree, {"a", "b", "c"}) == pytest.approx(1.0) and phylo.branch_length_score(tree, {"a", "b"}) == pytest.approx(0.5) and phylo.branch_length_score(tree, {"a"}) == 0.0
    pos, neg = (spark.createDataFrame([(i, s) for i, s in enumerate(x)], "id int, seq string") for x in (["ACAC", "AC"], ["GTGT", "AC"]))
    prior = {r["word"]: r["prior"] for r in tracks.discriminative_prior(pos, neg, 2, "id").collect()}
    assert prior["CA"] == pytest.approx(0.9) and prior["GT"] == pytest.approx(0.1) and prior["AC"] == pytest.approx(0.1 + 0.8 * 0.75)
    (tmp_path / "map.tsv").write_text("t1\tg1\tg2\n\nt2\tg3\n")
    assert sorted(map(tuple, readers.read_map(spark, str(tmp_path / "map.tsv")).collect())) == [("t1", "g1"), ("t1", "g2"), ("t2", "g3")]
    assert enrich.redundant({"a", "b"}, {"b", "c", "d"}) is False and enrich.redundant({"a", "b"}, {"a", "b", "c"})
    assert enrich.log_e_central(5, 10, 1, 2, 1) == pytest.approx(math.log(638 / 1024), abs=1e-6)
    assert S.guess_alphabet({"A": 5, "C": 5, "U": 4}).name == "RNA"


def test_discovery_chooses_width_and_strand(spark):
    rng = np.random.default_rng(2)
    seqs = []
    for i in range(60):
        s = list(rng.choice(list("ACGT"), 50))
        at = int(rng.integers(0, 40))
        s[at : at + 8] = list("TGACGGCA" if i % 2 else "TGCCGTCA")
        seqs.append((str(i), "".join(s)))
    df = spark.createDataFrame(seqs, "seq_name string, seq string").cache()
    (m,) = em.discover_significant(df, 6, 10, both=True)
    assert m.evalue < 1e-20 and 45 <= m.nsites <= 60 and ("TGACGGCA" in m.consensus() or "TGCCGTCA" in m.consensus()) and 8 <= m.width <= 10
    noise = spark.createDataFrame([(str(i), "".join(rng.choice(list("ACGT"), 50))) for i in range(30)], "seq_name string, seq string")
    assert em.discover_significant(noise, 6, 7, max_log_e=-5.0) == []
