"""Scoring, ranking, discovery, models and formats on small inputs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.discover import em, regex
from strandlake.operators import compare, hmm, motifs, phylo, pssm, ranking, scan
from strandlake.sources import readers, writers

BG = np.array([0.3, 0.2, 0.2, 0.3])
MOTIF = motifs.Motif("m", np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1], [0.1, 0.1, 0.1, 0.7]]), nsites=10)


def test_pvalue_table_against_all_words():
    p = pssm.build(MOTIF, BG)
    all_ = [(int(sum(p.scores[i, c] for i, c in enumerate(w))), float(np.prod(BG[list(w)]))) for w in itertools.product(range(4), repeat=3)]
    for s in {s for s, _ in all_}:
        assert p.pv[s] == pytest.approx(sum(q for t, q in all_ if t >= s))
    assert p.pv[0] == pytest.approx(1.0)


def test_scan_against_brute_force(spark):
    p = pssm.build(MOTIF, BG)
    seqs = {"a": "ACTACGNACT", "b": "AGT", "c": "", "d": "NN"}
    df = spark.createDataFrame([*seqs.items(), ("e", None)], "seq_name string, seq string")
    got = {(r["seq_name"], r["start"], r["strand"], r["score"]) for r in scan.scan(df, [p], max_p=1.0).collect()}
    want = set()
    for name, s in seqs.items():
        for i in range(len(s) - 2):
            w = s[i : i + 3]
            if set(w) <= set("ACGT"):
                for strand, x in (("+", w), ("-", w[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                    want.add((name, i + 1, strand, int(sum(p.scores[j, "ACGT".index(c)] for j, c in enumerate(x)))))
    assert got == want


def test_qvalues_are_monotone_and_tie(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.01, 0.2, 0.9, 1.0, None])], "i int, p double")
    q = {r["i"]: r["qvalue"] for r in ranking.qvalues(df, "p").collect()}
    assert q[0] == q[1] == pytest.approx(0.025) and q[2] == pytest.approx(0.2 * 5 / 3) and q[4] == 1.0 and q[5] is None


def test_ranks_sum(spark):
    df = spark.createDataFrame([(v,) for v in [3, 1, 1, 2, 2, 2, 9]], "v int")
    assert sum(r["rank"] for r in ranking.average_ranks(df, "v").collect()) == 28


def test_em_recovers_planted_motif(spark):
    rng = np.random.default_rng(1)
    seqs = []
    for i in range(60):
        s = list(rng.choice(list("ACGT"), 60))
        at = int(rng.integers(0, 54))
        s[at : at + 6] = list("TGACTC")
        seqs.append((str(i), "".join(s)))
    df = spark.createDataFrame(seqs, "seq_name string, seq string")
    assert em.discover(df, 6, "zoops")[0].consensus() == "TGACTC"
    assert em.discover(df, 6, "anr")[0].consensus() == "TGACTC"
    assert em.branch(df, ["TGAATC"], np.full(4, 0.25))[0] == "TGACTC"
    control = spark.createDataFrame([(str(i), "".join(rng.choice(list("ACGT"), 60))) for i in range(60)], "seq_name string, seq string")
    found = regex.discover(df, control, "seq_name", k=5)[0]
    assert found.consensus() in ("TGACT", "GACTC", "GAGTC", "AGTCA")


def test_smoothing_bounds_windows():
    z = em.smooth(np.array([0.9, 0.8, 0.1, 0.7]), 2)
    assert all(z[i : i + 2].sum() <= 1 + 1e-9 for i in range(3))


def test_hmm_against_enumeration():
    m = hmm.build([MOTIF], BG, "star", 2.0)
    c = scan.encode("ACTGA", "ACGT")
    n = len(m.trans)
    total, best = 0.0, 0.0
    for path in itertools.product(range(1, n - 1), repeat=len(c)):
        p = m.trans[0, path[0]] * np.prod([m.trans[a, b] for a, b in zip(path, path[1:])]) * np.prod([m.emit[s, x] for s, x in zip(path, c)]) * m.trans[path[-1], n - 1]
        total, best = total + p, max(best, p)
    assert hmm.forward(m, c) == pytest.approx(np.log(total), abs=1e-6) and hmm.backward(m, c) == pytest.approx(np.log(total), abs=1e-6)
    assert hmm.viterbi(m, c)[0] == pytest.approx(np.log(best), abs=1e-6)


def test_pruning_against_enumeration():
    tree, pi = phylo.parse_newick("((a:0.1,b:0.2):0.3,c:0.4);"), BG
    q = phylo.rate_matrix("hky", pi)
    col = {"a": "A", "b": "G", "c": "A"}
    p = lambda t: phylo.transition(q, t)
    want = sum(pi[r] * p(0.3)[r, i] * p(0.1)[i, 0] * p(0.2)[i, 2] * p(0.4)[r, 0] for r in range(4) for i in range(4))
    assert phylo.likelihood(tree, col, q, pi) == pytest.approx(want)
    assert np.allclose(pi @ p(3.0), pi)
    assert phylo.rerooted(tree, "a").total_length() == pytest.approx(tree.total_length())


def test_motif_formats_round_trip():
    text = writers.meme_text([MOTIF])
    again = readers.load_motifs(text)
    assert again[0].id == "m" and np.allclose(again[0].freqs, MOTIF.freqs, atol=1e-6) and again[0].nsites == 10
    jaspar = ">MA1 x\nA [ 8 1 ]\nC [ 1 1 ]\nG [ 1 1 ]\nT [ 0 7 ]\n"
    assert np.allclose(readers.load_motifs(jaspar, "jaspar")[0].freqs[0], [0.8, 0.1, 0.1, 0])
    transfac = "ID X\nP0 A C G T\n01 1 2 3 4 N\n02 10 0 0 0 A\n//\n"
    assert readers.load_motifs(transfac)[0].consensus() == "TA"


def test_same_motif_compares_best(spark):
    others = [motifs.Motif(str(i), np.random.default_rng(i).dirichlet(np.ones(4), 5)) for i in range(8)]
    got = compare.compare(spark, others[:2], others, "pearson").collect()
    for q in "01":
        assert min((r for r in got if r["query_id"] == q), key=lambda r: r["pvalue"])["target_id"] == q


def test_fasta_and_tracks(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">chr1:10-20 first one\nACGT\nAC\n>b\nGG\n>c\n\n")
    rows = {r["seq_name"]: r for r in readers.genomic_coordinates(readers.read_fasta(spark, str(tmp_path / "x.fa"))).collect()}
    assert rows["chr1:10-20"]["seq"] == "ACGTAC" and rows["chr1:10-20"]["offset"] == 10 and rows["b"]["seq"] == "GG" and rows["c"]["seq"] == ""
    (tmp_path / "x.wig").write_text("track\nfixedStep chrom=chr1 start=5 step=2 span=2\n0.5\n0.7\nvariableStep chrom=chr2 span=3\n10 1.5\n20 2.5\n")
    got = sorted(map(tuple, readers.read_wiggle(spark, str(tmp_path / "x.wig")).collect()))
    assert got == [("chr1", 5, 2, 0.5), ("chr1", 7, 2, 0.7), ("chr2", 10, 3, 1.5), ("chr2", 20, 3, 2.5)]
    (tmp_path / "x.psp").write_text(">s1 3\n0.1 0.2 0.3\n>s2 3\n0.4\n")
    assert readers.read_psp(spark, str(tmp_path / "x.psp")).count() == 4
    (tmp_path / "x.txt").write_text("# c\na 0.5\nb x\nc 0.25\n")
    assert [r["score"] for r in readers.read_scores(spark, str(tmp_path / "x.txt"), 2, header=True).collect()] == [0.5, 0.25]
    (tmp_path / "x.aln").write_text("CLUSTAL W\n\na    AC-\nb    ACG\n     **\n\na    GT\nb    GA\n")
    assert {r["species"]: r["seq"] for r in readers.read_clustal(spark, str(tmp_path / "x.aln")).collect()} == {"a": "AC-GT", "b": "ACGGA"}


def test_streamed_scan_equals_batch(spark, tmp_path):
    from strandlake.streaming import scan as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">s1\nACTACT\n>s2\nGGGACT\n")
    p = pssm.build(MOTIF, BG)
    stream.write_stream(stream.scan_stream(spark, str(tmp_path / "in"), [p], 0.2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = scan.scan(readers.read_fasta(spark, str(tmp_path / "in")), [p], max_p=0.2)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_gapped_motif_is_found_and_scanned(spark):
    from strandlake.discover import gapped

    rng = np.random.default_rng(6)
    seqs = []
    for i in range(24):
        s = list(rng.choice(list("ACGT"), 30))
        at = int(rng.integers(0, 20))
        s[at : at + 9] = list("TGACGGCTA") if i % 3 else list("TGACAGGCTA")  # an insertion in every third
        seqs.append("".join(s))
    bg = np.full(4, 0.25)
    best = gapped.discover(spark, seqs, 9, restarts=2, steps=600).first()
    counts = np.array(best["columns"])
    assert counts[:, :4].max(axis=1).sum() >= 0.8 * 24 * 9
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)] + [("none", "")], "seq_name string, seq string")
    found = gapped.scan(df, counts, bg, 10).collect()
    assert len(found) == 10 and all(r["score"] > 0 for r in found)


def test_keep_first_equals_going_through_in_order(spark):
    from strandlake.operators import redundancy
    from strandlake.plans.registry import checkpointed

    checkpointed(spark)
    rng = np.random.default_rng(8)
    pairs = {tuple(sorted(map(int, rng.integers(0, 40, 2)))) for _ in range(45)}
    pairs = {(a, b) for a, b in pairs if a != b}
    kept: list[int] = []
    for i in range(40):
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    got = redundancy.keep_first(spark.range(40), spark.createDataFrame(sorted(pairs), "a long, b long"), "id")
    assert sorted(r["id"] for r in got.collect()) == kept


def test_workflow_hits_are_of_whole_sequences(spark):
    import numpy as np

    from strandlake.operators import workflow

    rng = np.random.default_rng(5)
    make = lambda site: "".join((x := rng.choice(list("ACGT"), 300))[:20]) + site + "".join(x[26:147]) + site + "".join(x[153:])
    pos = spark.createDataFrame([(str(i), make("TTGACA")) for i in range(30)], "seq_name string, seq string")
    neg = spark.createDataFrame([(str(i), "".join(rng.choice(list("ACGT"), 300))) for i in range(30)], "seq_name string, seq string")
    hits = workflow.analyse(pos, neg, [])["hits"].collect()
    first = {r["motif_id"]: 0 for r in hits}
    for r in hits:
        first[r["motif_id"]] += 19 <= r["start"] <= 23
    assert max(first.values()) >= 30 and max(r["stop"] for r in hits) > 250


def test_spacing_pvalues_count_the_spacings(spark):
    from strandlake.operators import enrich

    found = spark.createDataFrame([(i % 150, i % 4) for i in range(6000)], "gap int, quadrant int")
    got = {(r["orientation"], r["bin"]): (r["n"], r["pvalue"]) for r in enrich.spacing_pvalues(enrich.spacing_histogram(found, 10), 150, 1, 10).collect()}
    assert all(n == 400 and 0.4 < p < 0.6 for (o, _), (n, p) in got.items() if o == "any") and len(got) == 9 * 15
    assert all(0.2 < p < 0.8 for _, p in got.values())
