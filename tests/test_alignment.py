"""Pairwise alignment, purging, diagrams, bead models, error rates of sites under evolution, and motif texts."""

import itertools

import numpy as np
import pytest

from strandlake.discover import gapped
from strandlake.functions.symbols import DNA
from strandlake.operators import compare, diagram, enrich, hmm, phylo, purge
from strandlake.operators.motifs import Motif
from strandlake.sources import readers, writers

BG = np.full(4, 0.25)


def alignments(a, b):
    if not a and not b:
        yield "", ""
    if a and b:
        yield from ((a[0] + x, b[0] + y) for x, y in alignments(a[1:], b[1:]))
    if a:
        yield from ((a[0] + x, "-" + y) for x, y in alignments(a[1:], b))
    if b:
        yield from (("-" + x, b[0] + y) for x, y in alignments(a, b[1:]))


def cost(x, y):
    total, kinds = 0.0, []
    for p, q in zip(x, y, strict=True):
        kind = 1 if q == "-" else 2 if p == "-" else 0
        total += (1 if p == q else -1) if kind == 0 else -1 if kinds and kinds[-1] == kind else -2
        kinds.append(kind)
    return total


def test_global_alignment_against_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = ("".join(rng.choice(list("ACG"), rng.integers(0, 6))) for _ in range(2))
        x, y = purge.global_align(a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b
        assert cost(x, y) == max(cost(*z) for z in alignments(a, b))


def test_gapless_span():
    assert purge.gapless_span(["ACGTACGT", "ACGTACGT"]) == (0, 8)
    assert purge.gapless_span(["ACGTTTACGTACGT", "ACGTTTCGTACGT"]) == (7, 14)  # the site lacks the A of column 6
    assert purge.gapless_span(["AAACCCGGGT", "AAACCCTTGGGT"]) == (0, 6)  # two symbols before column 6
    assert purge.gapless_span([""]) == (0, 0) and purge.gapless_span(["ACG"]) == (0, 3)


def test_segment_score_against_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = ("".join(rng.choice(list("ACG"), rng.integers(0, 9))) for _ in range(2))
        score = lambda i, j, n: sum(5 if a[i + k] == b[j + k] else -4 for k in range(n))  # noqa: B023, E731
        assert purge.segment_score(a, b) == max([0, *(score(i, j, n) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1))])


def test_purge(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    one, two = "ACGTTGCAAGCTTAGCCATG", "TTTTGGGGCCCCAAAATGTG"
    df = spark.createDataFrame([(1, one), (2, one[:12] + "TTTTTTTT"), (3, two), (4, two), (5, ""), (6, None)], "id int, seq string")
    assert sorted(r.id for r in purge.purge(df, "id", 60).collect()) == [1, 3, 5, 6]
    assert sorted(r.id for r in purge.purge(df, "id", 80).collect()) == [1, 2, 3, 5, 6]
    assert purge.purge(df.where("id > 9"), "id", 60).count() == 0


def test_diagrams(spark):
    assert diagram.parse_diagram("4-[+1]-15-[-2]-8") == [(4, "1", "+"), (15, "2", "-"), (8, "", "")]
    assert diagram.parse_diagram("[1]-3-4-<-b(1e-5)>") == [(0, "1", "+"), (7, "b", "-"), (0, "", "")]
    assert diagram.parse_diagram("30") == [(30, "", "")]
    for bad in ("[+1", "[+1>", "5--3", "5-", "x"):
        with pytest.raises(ValueError):
            diagram.parse_diagram(bad)
    sites = spark.createDataFrame([("s", "a", 5, 8), ("s", "b", 19, 22), ("s", "c", 30, 33), ("t", "a", 1, 4), ("t", "b", 40, 43)], "seq_name string, motif_id string, start int, stop int")
    lengths = spark.createDataFrame([("s", 60), ("t", 60)], "seq_name string, len int")
    one = lambda text: {r.seq_name: r.pvalue for r in diagram.diagram_pvalues(sites, lengths, text, {"a": 4, "b": 4, "c": 4}).collect()}
    ab, bc, abc = one("[a]-10-[b]"), one("[b]-9-[c]"), one("[a]-10-[b]-9-[c]")
    k = ab["s"] * bc["s"]
    assert set(abc) == {"s"} and abc["s"] == pytest.approx(k * (1 - np.log(k))) and ab["s"] < ab["t"]
    # the chance by counting both starts
    near = sum(abs(y - x - 14) <= 0 for x in range(57) for y in range(57))
    assert ab["s"] == pytest.approx(near / 57**2)
    order = {r.motif_id: (r.place, r.gap) for r in diagram.bead_order(sites).collect()}
    assert order == {"a": (1, None), "b": (2, pytest.approx((10 + 35) / 2)), "c": (3, 7.0)}  # means 3, 29.5 and 30
    motifs = [Motif(x, np.eye(4)[[i, i]] * 0.96 + 0.01) for i, x in enumerate("abc")]
    model = diagram.bead_model(sites, motifs, BG)
    assert model.names == ["a", "b", "c"]
    assert hmm.forward(model, np.array([0, 0, 1, 2, 2, 3, 1, 1])) < 0


def test_error_rates_against_enumeration():
    f = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.2, 0.3, 0.4]])
    rates = phylo.error_rates(phylo.parse_newick("(a:0.3);"), f, BG, bins=100_000)
    for threshold, yes, no in rates:  # one leaf holds what the equilibrium does
        words = [w for w in itertools.product(range(4), repeat=2) if sum(np.log2(f[i, x] / 0.25) for i, x in enumerate(w)) >= threshold - 1e-3]
        assert yes == pytest.approx(sum(f[0, a] * f[1, b] for a, b in words), abs=1e-9) and no == pytest.approx(len(words) / 16)
    two = phylo.error_rates(phylo.parse_newick("(a:0.3,b:0.3);"), f, BG)
    assert two[0][1] == pytest.approx(1) and two[0][2] == pytest.approx(1)
    power = lambda r: max(y for _, y, n in r if n <= 0.07)
    assert power(two) >= power(rates)  # a second species tells more


def test_best_threshold(spark):
    rows = [("m", s, q) for s, q in [(9, 1), (8, 1), (7, 1), (6, 0), (5, 1), (4, 0), (3, 0), (2, 0)]] + [("none", 1, 0)]
    df = spark.createDataFrame(rows, "motif_id string, score int, quality int")
    got = {r.motif_id: (r.score, r.pos_hits, r.neg_hits, r.log_p) for r in enrich.best_threshold(df.where("quality = 1"), df.where("quality = 0"), "motif_id", "score").collect()}
    assert got["m"][:3] == (7, 3, 0) and np.exp(got["m"][3]) == pytest.approx(4 / 56) and got["none"][3] == 0


@pytest.mark.parametrize("dialect", ["meme", "xml", "dreme", "html", "transfac", *writers.COUNT_FORMS])
def test_motif_texts_are_read_back(dialect):
    motifs = [Motif("one", np.array([[0.7, 0.1, 0.1, 0.1], [0.25, 0.25, 0.25, 0.25]]), nsites=20), Motif("two", np.array([[0, 0, 0.5, 0.5]]), nsites=8)]
    again = readers.load_motifs(writers.motif_text(motifs, dialect), dialect)
    assert [m.id for m in again] == ["one", "two"] and all(np.allclose(a.freqs, b.freqs, atol=1e-6) for a, b in zip(again, motifs, strict=True))
    assert readers.load_motifs(writers.motif_text([], dialect), dialect) == []


def test_tracks_with_exponents(spark, tmp_path):
    df = spark.createDataFrame([("c", 70000, 1e-7), ("c", 3, -2.5), ("c", 4, 0.0)], "chrom string, start bigint, value double")
    writers.wiggle(df).write.text(str(tmp_path / "w"))
    assert sorted(map(tuple, readers.read_wiggle(spark, str(tmp_path / "w")).collect())) == [("c", 3, 1, -2.5), ("c", 4, 1, 0.0), ("c", 70000, 1, 1e-7)]


def test_moved_columns_meet_their_symbols():
    rng = np.random.default_rng(4)
    codes = [rng.integers(0, 5, n) for n in (12, 9, 3, 0)]  # 4: an unknown symbol
    rows, places = [], []
    for c in codes:
        at = np.sort(rng.choice(np.arange(len(c)), 3, replace=False)) if len(c) >= 3 else np.zeros(0, int)
        rows.append(np.where(c[at] < 4, c[at], gapped.GAP) if len(c) else None)
        places.append(np.where(c[at] < 4, at, -1) if len(c) else np.full(3, -1))
    moved = 0
    for _ in range(60):
        before = [None if r is None else r.tolist() for r in rows]
        rows, places = gapped.move_column(rows, places, codes, BG, 50.0, rng)
        moved += before != [None if r is None else r.tolist() for r in rows]
        for r, at, c in zip(rows, places, codes, strict=True):
            if r is not None:
                assert len(r) == len(at) == 3 and all(x == (c[i] if i >= 0 else gapped.GAP) for x, i in zip(r, at, strict=True))
                held = at[at >= 0].tolist()
                assert held == sorted(set(held))
    assert moved > 10


def test_columns_move_to_the_motif():
    """Rows that all start one symbol late are only mended by a move."""
    codes = [np.array([0, 1, 2, 3, 0, 1, x]) for x in (0, 1, 2, 3) * 5]
    rows, places = [c[1:7].copy() for c in codes], [np.arange(1, 7) for _ in codes]
    start, rng = gapped.total_score(rows, 6, BG), np.random.default_rng(1)
    for _ in range(200):
        rows, places = gapped.move_column(rows, places, codes, BG, 0.1, rng)
    assert gapped.total_score(rows, 6, BG) > start and rows[0].tolist() == [0, 1, 2, 3, 0, 1]


def test_motif_groups(spark):
    rng = np.random.default_rng(3)
    sharp = lambda: np.eye(4)[rng.integers(0, 4, 8)] * 0.92 + 0.02
    a, b = sharp(), sharp()
    others = [Motif(f"x{i}", rng.dirichlet(np.ones(4), 8)) for i in range(20)]
    one = [Motif("a", a), Motif("b", b), Motif("a2", a[1:]), Motif("b2", Motif("", b, alphabet=DNA).reverse_complement().freqs)]
    order = [m.id for m in one + others]
    got = {m: (first, strand) for m, first, _, strand in compare.group_motifs(compare.compare(spark, one + others, one + others), order, 0.001)}
    assert sorted(got) == sorted(order) and got["a"] == ("a", "+") and got["a2"] == ("a", "+") and got["b2"] == ("b", "-")
    assert compare.group_motifs(compare.compare(spark, one[:1], one[:1]).where("false"), []) == []


def test_alignment_files(spark, tmp_path):
    aln = spark.createDataFrame([("x", 0, "one", "AC-GT" * 30), ("x", 1, "two", "ACCGT" * 30)], "aln_id string, row int, species string, seq string")
    writers.clustal(aln).coalesce(1).write.text(str(tmp_path / "c"))
    assert {r.species: r.seq for r in readers.read_clustal(spark, str(tmp_path / "c" / "part*")).collect()} == {"one": "AC-GT" * 30, "two": "ACCGT" * 30}
    assert writers.phylip(aln).first()["value"].splitlines() == ["2 150", "one       " + "AC-GT" * 30, "two       " + "ACCGT" * 30]
    (tmp_path / "w.fa").write_text(">WEIGHTS 0.5 1\n>a\nAC\n>b\nGT\n")
    left, weights = readers.split_weights(readers.read_fasta(spark, str(tmp_path / "w.fa")))
    assert weights == [0.5, 1.0] and sorted(r.seq_name for r in left.collect()) == ["a", "b"]
    m = hmm.build([Motif("a", np.eye(4) * 0.96 + 0.01)], BG)
    again, codes = hmm.read_hmm(hmm.write_hmm(m)), np.array([3, 0, 1, 2, 3, 2])
    assert hmm.viterbi(again, codes) == hmm.viterbi(m, codes) and hmm.forward(again, codes) == pytest.approx(hmm.forward(m, codes))
