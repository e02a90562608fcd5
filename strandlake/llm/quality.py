"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words. Each passage is encoded (how its words look, how they repeat, which they
are), gated attention weighs the encodings, and a logistic score is read off their weighted mean; encoder, attention and
score are learned together from document labels, by Adam in numpy, on a bounded sample.

Attention weights are bounded, so a text's sums of exp(weight) and exp(weight) x encoding may be taken slice by slice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_sample, expand_texts, fold_of, table
from strandlake.llm.shingles import mix, powers
from strandlake.llm.textvec import BAR, DIGIT, MARK, SPACE, STOP, SYMBOL, UPPER, classes, codes, slices

WORDS = 40
#: Buckets of hashed words; with the other features, LOOKS, a passage's features.
HASHED, LOOKS = 48, 16
FEATURES = HASHED + LOOKS
HIDDEN, GATE = 24, 12
#: Bounds of the labelled rows that are learned from, and of the passages of each (evenly over the text).
SAMPLE_ROWS, BAG = 5_000, 64
THRESHOLD = 0.3


def passages(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, (passages, FEATURES), and the piece of each. A piece without a word has one of zeros."""
    c, starts = codes(pieces)
    kind = classes()[c]
    inside = kind != SPACE
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    last = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    piece = np.searchsorted(starts, first, side="right") - 1
    n_words = np.bincount(piece, minlength=len(pieces))
    place = np.arange(len(first)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    per = np.maximum(-(-n_words // WORDS), 1)
    base = np.cumsum(per) - per
    of_word = base[piece] + place // WORDS
    total = int(per.sum())
    x = np.zeros((total, FEATURES), np.float32)
    n = np.bincount(of_word, minlength=total).astype(np.float64)
    if len(first):
        size = (last - first).astype(np.float64)
        up, down = powers()
        sums = np.concatenate([[np.uint64(0)], np.cumsum(((c | np.uint32(32)).astype(np.uint64) + np.uint64(1)) * up[: len(c)], dtype=np.uint64)])
        word = mix((sums[last] - sums[first]) * down[first]).view(np.int64)

        def share(mask: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(mask)])
            return (run[last] - run[first]) / size

        upper, digit, symbol, bar, mark, stop = (share(kind == k) for k in (UPPER, DIGIT, SYMBOL, BAR, MARK, STOP))
        same = np.zeros(len(word), bool)
        same[1:] = (word[1:] == word[:-1]) & (of_word[1:] == of_word[:-1])
        order = np.lexsort((word, of_word))
        again = np.zeros(len(word), bool)
        again[order[1:]] = (word[order][1:] == word[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
        end = kind[last - 1]
        looks = (size / 10, upper, upper > 0.9, digit, symbol, symbol > 0.3, bar > 0.9, mark, end == MARK, stop, end == STOP, size <= 3, size > 14, same, again)
        for j, v in enumerate(looks):
            x[:, j] = np.bincount(of_word, weights=v, minlength=total)
        x[:, len(looks)] = n / WORDS * n
        bucket = (word >> 8) % HASHED
        x[:, LOOKS:] = np.bincount(of_word * HASHED + bucket, minlength=total * HASHED).reshape(total, HASHED) * 4
        x /= np.maximum(n, 1)[:, None].astype(np.float32)
    return x, np.repeat(np.arange(len(pieces)), per)


@dataclass
class Model:
    """Weights by name. Without any (nothing to learn from) every score is 0.5."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        h = np.tanh(((x - w["mean"]) / w["dev"]) @ w["V"] + w["v"])
        t, s = np.tanh(h @ w["T"]), 1 / (1 + np.exp(-(h @ w["S"])))
        return {"h": h, "t": t, "s": s, "e": np.exp(5 * np.tanh((t * s) @ w["a"]))}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1; texts without a word are bags of one empty passage."""
        if not self.w:
            return np.full(len(texts), 0.5)
        top, bottom = np.zeros((len(texts), HIDDEN)), np.zeros(len(texts))
        blank = [i for i, t in enumerate(texts) if not t]
        for at, pieces in [*slices(texts), *([(np.array(blank), [""] * len(blank))] if blank else [])]:
            x, of = passages(pieces)
            z = self.encode(x)
            np.add.at(top, at[of], z["e"][:, None] * z["h"])
            np.add.at(bottom, at[of], z["e"])
        return 1 / (1 + np.exp(-(top / bottom[:, None] @ self.w["c"] + self.w["b"][0])))


def bag(text: str | None) -> np.ndarray:
    """Features of BAG passages at most, evenly over the text; of one empty passage for a text without a word."""
    found = np.concatenate([passages(pieces)[0] for _, pieces in slices([text])] or [passages([""])[0]])
    return found[np.unique(np.linspace(0, len(found) - 1, BAG).astype(int))] if len(found) > BAG else found


def train(texts: list[str], labels: list[int], **how) -> Model:
    return learn([(bag(t), y) for t, y in zip(texts, labels, strict=True)], **how)


def gradient(w: dict[str, np.ndarray], bags: list[tuple[np.ndarray, int]]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of some bags and its gradient, through score, attention and encoder."""
    model = Model(w)
    x, y = np.concatenate([b for b, _ in bags]), np.array([y for _, y in bags])
    n = [len(b) for b, _ in bags]
    starts, of = np.cumsum([0, *n[:-1]]), np.repeat(np.arange(len(bags)), n)
    z = model.encode(x)
    h, t, g, e = z["h"], z["t"], z["s"], z["e"]
    whole = np.add.reduceat(e, starts)
    att = e / whole[of]
    mean = np.add.reduceat(att[:, None] * h, starts)
    p = 1 / (1 + np.exp(-(mean @ w["c"] + w["b"][0])))
    d = (p - y) / len(y)
    dmean = d[:, None] * w["c"]
    datt = (h * dmean[of]).sum(axis=1)
    dlog = att * (datt - np.add.reduceat(att * datt, starts)[of])
    u = np.tanh((t * g) @ w["a"])
    du = dlog * 5 * (1 - u**2)
    dtg = du[:, None] * w["a"]
    dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
    dh = att[:, None] * dmean[of] + dt @ w["T"].T + dg @ w["S"].T
    dz = dh * (1 - h**2)
    grad = {"c": mean.T @ d, "b": np.array([d.sum()]), "a": (t * g).T @ du, "T": h.T @ dt, "S": h.T @ dg, "V": ((x - w["mean"]) / w["dev"]).T @ dz, "v": dz.sum(axis=0)}
    return float(-np.mean(y * np.log(p + 1e-300) + (1 - y) * np.log(1 - p + 1e-300))), grad


def learn(bags: list[tuple[np.ndarray, int]], *, epochs: int = 12, batch: int = 64, rate: float = 0.004, seed: int = 0) -> Model:
    """Adam on the log loss of the bags; labels all alike teach nothing."""
    if len({y for _, y in bags}) < 2:
        return Model()
    rng = np.random.default_rng(seed)
    every = np.concatenate([x for x, _ in bags])
    init = lambda a, b: rng.normal(0, a**-0.5, (a, b))
    w = {"V": init(FEATURES, HIDDEN), "v": np.zeros(HIDDEN), "T": init(HIDDEN, GATE), "S": init(HIDDEN, GATE), "a": rng.normal(0, 0.1, GATE), "c": np.zeros(HIDDEN), "b": np.zeros(1)}
    fixed = {"mean": every.mean(axis=0), "dev": every.std(axis=0) + 1e-3}
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for s in range(0, len(order), batch):
            _, grad = gradient(w | fixed, [bags[i] for i in order[s : s + batch]])
            step += 1
            for k in w:
                grad[k] = grad[k] + 1e-4 * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w | fixed)


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, limit: int = SAMPLE_ROWS) -> Model:
    """A model of at most ``limit`` labelled documents, by hash of the id, whose fold isn't ``held_out``. The sample is
    drawn from the labels before texts are looked up; the driver gets features, of BAG passages of each text at most. Of labels or
    texts that share an id the lower, or the first by order, is taken."""
    rows = labels.where(F.col("quality").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    some = F.broadcast(bounded_sample(rows, "doc_id", limit))  # at most ``limit`` rows
    got = docs.where("text is not null").select("doc_id", "text").join(some, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    seen = expand_texts(got, "text", ["doc_id", "quality"], {"bag": "binary"}, lambda texts, _: [[bag(t).tobytes() for t in texts]]).collect()
    return learn([(np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES), r["quality"]) for r in sorted(seen, key=lambda r: r["doc_id"])])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds quality_score (a column of this name is replaced). Null texts count as empty and have a score too; other
    columns pass through; repeated rows are answered alike."""
    df = df.drop("quality_score")
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    return expand_texts(df, text, df.columns, {"quality_score": "double"}, lambda texts, _: [shared.value.score(texts)])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole text, by a model of labelled rows that aren't held out. Null and empty texts, null ids (never held
    out) and repeated rows are scored too; without labels every score is 0.5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
