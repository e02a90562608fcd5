"""Special functions against enumeration, expressions against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import special as X
from strandlake.functions import symbols as S


def test_fisher_against_enumeration():
    for hits, total, ch, ct in itertools.product(range(4), (3, 5), range(4), (3, 6)):
        n, k = total + ct, hits + ch
        tail = sum(math.comb(k, i) * math.comb(n - k, total - i) for i in range(hits, min(total, k) + 1)) / math.comb(n, total)
        want = 0.0 if k in (0, n) or hits * ct < ch * total else math.log(tail)
        assert X.log_fisher(hits, total, ch, ct) == pytest.approx(want, abs=1e-9)


def test_fisher_as_a_sum_of_chances():
    for hits, total, ch, ct in itertools.product(range(4), (3, 5), range(4), (3, 6)):
        assert X.log_fisher_sum(hits, total, ch, ct) == pytest.approx(X.log_fisher(hits, total, ch, ct), abs=1e-9)
    for counts in ((1300, 3000, 1600, 4000), (20_000, 88_000, 3_000, 14_000)):  # several steps
        assert X.log_fisher_sum(*counts, step=16) == X.log_fisher_sum(*counts, step=1 << 20) == pytest.approx(X.log_fisher(*counts), abs=1e-6)
    assert X.log_fisher_sum(600, 600, 0, 600) == -math.inf and X.log_fisher(600, 600, 0, 600) == pytest.approx(-math.log(math.comb(1200, 600)))


def test_binomial_tail_against_sum():
    for n, k, p in ((10, 3, 0.2), (40, 39, 0.5), (7, 0, 0.3), (25, 12, 0.9)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert math.exp(X.log_binomial_tail(k, n, p)) == pytest.approx(want, rel=1e-9)


def test_multihg_reduces_to_fisher():
    assert X.log_multihg([6, 4], [2, 3]) == pytest.approx(X.log_fisher(3, 5, 1, 5))


def test_ranksum_is_symmetric():
    a, b = X.ranksum(20, 8, 100), X.ranksum(20, 12, 110)
    assert a["left"] == pytest.approx(b["right"])


def test_qfast_and_sidak(spark):
    r = spark.range(1).select(X.qfast(F.lit(0.01), F.lit(2)).alias("q"), X.sidak(F.lit(0.2), F.lit(3.0)).alias("s")).first()
    assert r["q"] == pytest.approx(0.01 * (1 - math.log(0.01)))
    assert r["s"] == pytest.approx(1 - 0.8**3)


def test_sequence_expressions(spark):
    df = spark.createDataFrame([("ACGTN",), ("atgaaatag",), ("",), (None,)], "s string")
    rc = [r[0] for r in df.select(S.reverse_complement(S.reverse_complement("s"))).collect()]
    assert rc == ["ACGTN", "atgaaatag", "", None]
    assert df.select(S.translate_dna("s")).collect()[1][0] == "MK*"
    assert df.select(S.encode("s")).first()[0] == [0, 1, 2, 3, -1]
    assert df.select(S.words("s", 3)).first()[0] == ["ACG", "CGT", "GTN"]
    assert S.iupac_regex("ANR") == "A[ACGT][AG]"


def test_alphabet_definition():
    a = S.parse_alphabet('ALPHABET "x"\nA "Adenine" CC0000 ~ T "Thymine" 008000\nC ~ G\nN = ACGT\nU = T\n')
    assert a.core == "ATCG" and a.complement["A"] == "T" and a.comprises["N"] == "ACGT" and a.aliases["U"] == "T"


def test_euler_shuffle_keeps_word_counts():
    from collections import Counter

    from strandlake.operators.sequences import euler_shuffle

    for k in (1, 2, 3):
        s = "ACGTACGGTTACGACGTTTAACCGGAT" * 3
        t = euler_shuffle(s, k, np.random.default_rng(5))
        words = lambda x: Counter(x[i : i + k] for i in range(len(x) - k + 1))
        assert words(s) == words(t)
        assert s != t
