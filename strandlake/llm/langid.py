"""Language identification: hashed subwords, their embeddings averaged over the text, a linear softmax; trained by
stochastic gradient descent in numpy on a bounded sample, with a temperature and a rejection level set on rows held back
from it.

The averaged embedding times the softmax weights is the average of the subwords' products, so scoring needs one table of
``BUCKETS`` rows of as many numbers as there are languages; that table is what goes to the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_sample, expand_texts, fold_of, table
from strandlake.llm.textvec import codes, letters, slices

BUCKETS = 1 << 16
DIM = 16
#: Bounds of the labelled rows that are learned from, and of the passages of PASSAGE characters cut from them.
SAMPLE_ROWS, PASSAGES, PASSAGE = 4_000, 10_000, 160
UNKNOWN = "und"
#: Share of rightly predicted calibration rows whose confidence lies below the rejection level.
REJECT = 0.001
#: The level is never above this share of the way from chance to certainty: clear texts stay however sharp the model is.
MOST = 0.5


def subwords(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of 1 to 4 letters, a word's edge counting as a letter: array (4, characters) of buckets, BUCKETS
    where there is none; and where each piece starts."""
    raw, starts = codes([p.lower() for p in pieces])
    c = np.concatenate([np.where(letters()[raw], raw, 0).astype(np.uint32), np.zeros(3, np.uint32)])
    n = len(raw)
    a, b, d, e = c[:n], c[1 : n + 1], c[2 : n + 2], c[3 : n + 3]
    out = np.full((4, n), BUCKETS, dtype=np.int32)
    h = a * np.uint32(2654435761)
    for k, (more, valid) in enumerate((
        (np.uint32(0x9E3779B9), a != 0),
        (b * np.uint32(2246822519) + np.uint32(1), (a != 0) | (b != 0)),
        (d * np.uint32(3266489917) + np.uint32(1), (b != 0) & ((a != 0) | (d != 0))),
        (e * np.uint32(668265263) + np.uint32(1), (b != 0) & (d != 0)),
    )):
        h = h + more
        mixed = h ^ (h >> np.uint32(15))
        out[k][valid] = ((mixed * np.uint32(2246822519)) >> np.uint32(16)).astype(np.int32)[valid]
    return out, starts


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages), the last row zero
    temperature: float = 1.0
    level: float = 0.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean logits of each text, and whether it has a letter."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for at, pieces in slices(texts):
            grams, starts = subwords(pieces)
            for row in grams:
                np.add.at(sums, at, np.add.reduceat(self.table[row], starts, axis=0))
            np.add.at(counts, at, np.add.reduceat((grams < BUCKETS).sum(axis=0), starts))
        return sums / np.maximum(counts, 1)[:, None], counts > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and whether it is accepted. Without a letter: UNKNOWN, 0, False."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        logits, known = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1) if len(texts) else np.zeros(0, int)
        score = np.where(known, p[np.arange(len(texts)), best], 0.0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, known & (score >= self.level)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learn(cut: list[tuple[str, str]], *, rate: float = 1.0, epochs: int = 2, batch: int = 32, seed: int = 0) -> Model:
    """Learns from (passage, language). Nothing to learn from: a model without languages, which answers UNKNOWN."""
    langs = sorted({lang for _, lang in cut})
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32))
    y_of, rng = {lang: i for i, lang in enumerate(langs)}, np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS + 1, DIM)).astype(np.float32) / DIM
    emb[BUCKETS] = 0
    out = np.zeros((DIM, len(langs)), np.float32)
    steps, step = max(1, epochs * ((len(cut) + batch - 1) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for s in range(0, len(cut), batch):
            some = [cut[i] for i in order[s : s + batch]]
            grams, starts = subwords([t for t, _ in some])
            where = np.repeat(np.arange(len(some)), np.diff([*starts, grams.shape[1]]))
            ids, of = grams.T.ravel(), np.repeat(where, 4)
            ids, of = ids[ids < BUCKETS], of[ids < BUCKETS]
            n = np.bincount(of, minlength=len(some))
            some, n = [x for x, k in zip(some, n, strict=True) if k], n[n > 0]
            if not some:
                continue
            mean = np.add.reduceat(emb[ids], np.cumsum([0, *n[:-1]]), axis=0) / n[:, None]
            g = softmax(mean @ out) - np.eye(len(langs))[[y_of[y] for _, y in some]]
            lr = rate * (1 - step / steps)
            down = (lr * g @ out.T).astype(np.float32)
            out -= (lr * mean.T @ g).astype(np.float32)
            np.add.at(emb, ids, -np.repeat(down / n[:, None].astype(np.float32), n, axis=0))
            step += 1
    return Model(langs, (emb @ out).astype(np.float32))


def calibrate(model: Model, logits: np.ndarray, labels: list[str]) -> Model:
    """Sets temperature and rejection level from the logits of whole texts that weren't learned from; labels that the model
    doesn't know are passed over."""
    at = {lang: i for i, lang in enumerate(model.langs)}
    known = np.array([lab in at for lab in labels], bool)
    if known.any():
        logits, y = logits[known], np.array([at[lab] for lab in labels if lab in at])
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).sum() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        chance = 1 / len(model.langs)
        model.level = min(float(np.quantile(right, REJECT)) if len(right) else 0.0, chance + MOST * (1 - chance))
    return model


def train(texts: list[str], labels: list[str], **how) -> Model:
    """Learns from whole texts cut into passages; every sixth text is held back for the temperature and the level."""
    rows = list(zip(texts, labels, strict=True))
    model = learn([(t[s : s + PASSAGE], lab) for i, (t, lab) in enumerate(rows) if i % 6 != 5 for s in range(0, len(t), PASSAGE)], **how)
    kept = [(t, lab) for t, lab in rows[5::6] if any(c.isalpha() for c in t)]
    return calibrate(model, model.logits([t for t, _ in kept])[0], [lab for _, lab in kept]) if kept and model.langs else model


def fit(docs: DataFrame, *, folds: int = 4, held_out: int = 2, limit: int = SAMPLE_ROWS, passages: int = PASSAGES) -> Model:
    """A model of the rows with text, lang and doc_id whose fold isn't ``held_out``: of at most ``limit`` ids, by their hash, five
    sixths give at most ``passages`` passages (by hash, over the whole texts) to learn from, the others calibrate. The driver gets
    these passages, and of each calibrating text the logits alone."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out)).select("doc_id", "text", "lang")
    ids = bounded_sample(rows.select("doc_id").distinct(), "doc_id", limit)  # ``limit`` ids
    rows = rows.join(F.broadcast(ids), "doc_id")
    back = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("back")), F.lit(6)) == 5
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0))
    cut = rows.where(~back).select("doc_id", "lang", F.posexplode(parts).alias("at", "t")).select("lang", "t", F.xxhash64("doc_id", "at", "t").alias("key"))
    model = learn([(r["t"], r["lang"]) for r in bounded_sample(cut, "key", passages).collect()])
    if not model.langs:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + 1) rows x languages of float32

    def weigh(texts, _):
        logits, known = shared.value.logits(texts)
        return [[v.tobytes() if k else None for v, k in zip(logits, known, strict=True)]]

    kept = expand_texts(rows.where(back).dropDuplicates(["doc_id"]), "text", ["lang"], {"logits": "binary"}, weigh).where("logits is not null").collect()  # ``limit`` rows
    return calibrate(model, np.array([np.frombuffer(r["logits"]) for r in kept]), [r["lang"] for r in kept]) if kept else model


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, lang_score and lang_accepted (columns of these names are replaced). Null, empty and letterless
    texts get UNKNOWN, 0 and False; other columns pass through, nulls included; repeated rows are answered alike."""
    df = df.drop("lang_pred", "lang_score", "lang_accepted")
    shared = df.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + 1) rows x languages of float32, whatever the input
    return expand_texts(df, text, df.columns, {"lang_pred": "string", "lang_score": "double", "lang_accepted": "boolean"}, lambda texts, _: list(shared.value.predict(texts)))


def op8_language(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text, by a model of the rows that aren't held out. Null and letterless texts: und, score 0; the
    columns are those of every row, null ids (never held out) and repeated ones included."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
