"""Counting and summarising sequences; sampling and shuffling them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlake.functions.symbols import DNA, Alphabet, canonical, words


def seq_stats(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: n_seqs, min_len, max_len, avg_len, total_len."""
    n = F.length(seq).cast("bigint")
    return df.agg(F.count(seq).alias("n_seqs"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("avg_len"), F.sum(n).alias("total_len"))


def modal_length(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The most frequent length, the shorter of those that tie."""
    return df.groupBy(F.length(seq).cast("bigint").alias("len")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "len").limit(1)


def letter_freqs(df: DataFrame, seq: str = "seq") -> DataFrame:
    """sym, n, freq. Letters are counted row by row before anything is shuffled."""
    letters = df.select(F.explode(F.split(F.upper(seq), "")).alias("sym")).where("sym <> ''").groupBy("sym").agg(F.count("*").alias("n"))
    return letters.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def word_counts(df: DataFrame, k: int, seq: str = "seq", alphabet: Alphabet = DNA, both_strands: bool = False) -> DataFrame:
    """tuple, n: overlapping words of core symbols; with ``both_strands`` each counts for its reverse complement too."""
    found = df.select(F.explode(words(seq, k)).alias("tuple")).where(~F.col("tuple").rlike(f"[^{alphabet.core}]")).groupBy("tuple").agg(F.count("*").alias("n"))
    if both_strands:
        from strandlake.functions.symbols import reverse_complement

        found = found.unionByName(found.select(reverse_complement("tuple").alias("tuple"), "n")).groupBy("tuple").agg(F.sum("n").alias("n"))
    return found


def word_tables(df: DataFrame, longest: int, seq: str = "seq", alphabet: Alphabet = DNA) -> list[np.ndarray]:
    """Counts of all words of 1 to ``longest`` core symbols, by their number to the base of the alphabet's size: one pass over the
    sequences, a table for each partition, sums of these. Tables have size ** ``longest`` entries."""
    size = len(alphabet.core)

    def run(batches):
        from strandlake.operators.scan import encode, joined

        tables = [np.zeros(size**k, np.int64) for k in range(1, longest + 1)]
        for batch in batches:
            for _, _, whole, _ in joined(batch.column(seq).to_pylist()):
                codes = encode(whole, alphabet.core)
                word, ok = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
                for k in range(longest):
                    ahead = codes[k:]
                    word, ok = word[: len(ahead)] * size + np.minimum(ahead, size - 1), ok[: len(ahead)] & (ahead < size)
                    tables[k] += np.bincount(word[ok], minlength=size ** (k + 1))
        for k, t in enumerate(tables):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k + 1, np.int32)), pa.array(at), pa.array(t[at])], names=["k", "word", "n"])

    out = [np.zeros(size**k, np.int64) for k in range(1, longest + 1)]
    for r in df.select(seq).mapInArrow(run, "k int, word bigint, n bigint").groupBy("k", "word").agg(F.sum("n").alias("n")).collect():  # as many rows as words
        out[r["k"] - 1][r["word"]] = r["n"]
    return out


def background(df: DataFrame, order: int = 0, seq: str = "seq", alphabet: Alphabet = DNA, pseudo: float = 0.1, both_strands: bool = False) -> DataFrame:
    """tuple, n, p for all words of up to ``order`` + 1 symbols: (n + pseudo / words) / (total + pseudo) at each length.
    Words that don't occur have their share of the pseudocount."""
    size, rows = len(alphabet.core), []
    for k, counts in enumerate(word_tables(df, order + 1, seq, alphabet), 1):
        digits = np.arange(size**k)[:, None] // size ** np.arange(k - 1, -1, -1) % size
        if both_strands:
            other = np.array([alphabet.core.index(alphabet.complement[s]) for s in alphabet.core])
            counts = counts + counts[other[digits][:, ::-1] @ size ** np.arange(k - 1, -1, -1)]
        p = (counts + pseudo / size**k) / (counts.sum() + pseudo)
        rows += [("".join(alphabet.core[d] for d in w), int(n), float(x)) for w, n, x in zip(digits, counts, p, strict=True)]
    return df.sparkSession.createDataFrame(rows, "tuple string, n bigint, p double")


def word_presence(df: DataFrame, k: int, name: str, seq: str = "seq", alphabet: Alphabet | None = None) -> DataFrame:
    """word, n_seqs: sequences that hold a word; with an alphabet, the word or its reverse complement. Words repeat within
    a sequence, so they are made distinct there first; sequences of one name count once."""
    found = F.array_distinct(words(seq, k))
    if alphabet is not None:
        found = F.array_distinct(F.transform(F.filter(found, lambda w: ~w.rlike(f"[^{alphabet.core}]")), lambda w: canonical(w, alphabet)))
    return df.select(name, F.explode(found).alias("word")).groupBy("word").agg(F.countDistinct(name).alias("n_seqs"))


def count_matrix(df: DataFrame, seq: str, width: int | None = None) -> DataFrame:
    """pos (from 1), sym, n: column counts of aligned sequences."""
    cut = F.col(seq) if width is None else F.substring(seq, 1, width)
    return df.select(F.posexplode(F.filter(F.split(cut, ""), lambda c: c != "")).alias("p", "sym")).groupBy((F.col("p") + 1).alias("pos"), "sym").agg(F.count("*").alias("n"))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get _2, _3 ... in ``order``."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), k.cast("string"))))


def subsample(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """``n`` rows by hash of the key and the seed: a top-n, not a sort of the table."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), key).limit(n)


def remainder(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    return df.join(sample.select(key), key, "left_anti")


def euler_shuffle(seq: str, k: int, rng: np.random.Generator) -> str:
    """A shuffle that keeps the count of every word of ``k`` symbols: a random Eulerian path over words of k - 1."""
    if k <= 1:
        return "".join(rng.permutation(list(seq))) if seq else seq
    if len(seq) <= k:
        return seq
    nodes = [seq[i : i + k - 1] for i in range(len(seq) - k + 2)]
    edges: dict[str, list[str]] = {}
    for a, b in zip(nodes, nodes[1:], strict=False):
        edges.setdefault(a, []).append(b)
    end = nodes[-1]
    last: dict[str, str] = {}  # each node's last edge; together a tree into the end, by loop-erased walks
    done = {end}
    for start in edges:
        at, path = start, []
        while at not in done:
            last[at] = edges[at][rng.integers(len(edges[at]))]
            path.append(at)
            at = last[at]
        done.update(path)
    order = {}
    for a, out in edges.items():
        rest = list(out)
        tail = []
        if a != end:
            rest.remove(last[a])
            tail = [last[a]]
        order[a] = [rest[i] for i in rng.permutation(len(rest))] + tail
    at, out = nodes[0], [nodes[0]]
    used = dict.fromkeys(order, 0)
    for _ in range(len(nodes) - 1):
        used[at] += 1
        at = order[at][used[at] - 1]
        out.append(at[-1])
    return "".join(out)


def shuffle_letters(df: DataFrame, key: str, seq: str = "seq", k: int = 1, copies: int = 1, seed: int = 1) -> DataFrame:
    """copy, ``key``, ``seq``: shuffles that keep the counts of words of ``k``, seeded by key and copy."""
    @F.pandas_udf("string")
    def run(names: pd.Series, seqs: pd.Series, copy: pd.Series) -> pd.Series:
        import zlib

        return pd.Series([euler_shuffle(s or "", k, np.random.default_rng([seed, int(c), zlib.crc32(str(n).encode())])) for n, s, c in zip(names, seqs, copy, strict=True)])

    return df.select(F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"), key, seq).withColumn(seq, run(F.col(key).cast("string"), seq, "copy"))


def synthesize(spark, n: int, length: int, freqs: dict[str, float], seed: int = 1) -> DataFrame:
    """seq_id, seq: random sequences from letter frequencies."""
    symbols, p = list(freqs), np.array(list(freqs.values()))

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(["".join(np.random.default_rng([seed, int(i)]).choice(symbols, length, p=p / p.sum())) for i in ids])

    return spark.range(n).select(F.col("id").alias("seq_id"), run("id").alias("seq"))


def dust_mask(df: DataFrame, seq: str = "seq", window: int = 64, level: float = 20.0, word: int = 3) -> DataFrame:
    """Masks low-complexity spans by N: in half-overlapping windows, the span with the largest 10 x repeats / length."""
    @F.pandas_udf("string")
    def run(seqs: pd.Series) -> pd.Series:
        def one(s: str) -> str:
            hide = np.zeros(len(s), bool)
            for a in range(0, max(1, len(s)), window // 2):
                part, best = s[a : a + window], (level, 0, 0)
                w = [part[i : i + word] for i in range(len(part) - word + 1)]
                for i in range(len(w)):
                    seen: dict[str, int] = {}
                    total = 0
                    for j in range(i, len(w)):
                        total += seen.get(w[j], 0)
                        seen[w[j]] = seen.get(w[j], 0) + 1
                        if j > i and 10 * total / (j - i) > best[0]:
                            best = (10 * total / (j - i), i, j + word)
                hide[a + best[1] : a + best[2]] = True
            return "".join("N" if h else c for c, h in zip(s, hide, strict=True))

        return pd.Series([one(s or "") for s in seqs])

    return df.withColumn(seq, run(seq))


def hamming_best(df: DataFrame, pattern: str, name: str, seq: str = "seq") -> DataFrame:
    """name, distance: the least Hamming distance of any window to a pattern; null if the sequence is too short."""
    off = lambda w: sum(((F.substring(w, i + 1, 1) != s).cast("int") for i, s in enumerate(pattern)), F.lit(0))
    return df.select(name, F.array_min(F.transform(words(seq, len(pattern)), off)).alias("distance"))


def masked(seq: Column, pattern: str) -> Column:
    """Occurrences of a regular expression replaced by as many N."""
    return F.regexp_replace(seq, pattern, "N" * len(pattern) if pattern.isalpha() else "N")


def cumulative_background(df: DataFrame, freqs: dict[str, float], name: str, seq: str = "seq") -> DataFrame:
    """name, pos (from 1), logp: running sums of the log chances of a sequence's symbols; others than those of ``freqs`` count 0.
    A sequence is summed where it is read."""
    schema = StructType([df.schema[name], *StructType.fromDDL("pos int, logp double")])
    table = np.zeros(256)
    for s, p in freqs.items():
        table[[ord(s), ord(s.lower())]] = np.log(p)

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(seq).to_pylist()):
                if text:
                    sums = np.cumsum(table[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)])
                    rows = pa.array(np.full(len(sums), i))
                    yield pa.RecordBatch.from_arrays([batch.column(name).take(rows), pa.array(np.arange(1, len(sums) + 1, dtype=np.int32)), pa.array(sums)], names=[name, "pos", "logp"])

    return df.select(name, seq).mapInArrow(run, schema)
