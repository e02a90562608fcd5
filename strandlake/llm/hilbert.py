"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few random orthogonal directions, shifted, and ordered along a Hilbert curve; CURVES such
orderings differ in directions and shift. Each is range-partitioned and ranked in Spark; a query's candidates are the rows
within a window of ranks around its own place on every curve. Windows are met block by block, scored on the original
vectors in double precision and merged: rows go to the one block of ranks that holds their place, queries to the blocks that
their windows touch. Blocks grow with the window up to a bound, so queries are sent to a few of them as long as that lasts. A task reads
the rows of a block first and then its queries, batch by batch, however many they are.

The window is what the data ask for: on a bounded sample of queries, the exact neighbours' least rank distance over the
curves is taken and its quantile RECALL becomes the half window. Vectors that cluster need short windows; vectors without
structure need long ones, since then no ordering keeps neighbours together.

Inner products are turned into distances by one more coordinate, sqrt(longest^2 - |v|^2), zero for queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_sample, materialize, table

CURVES, AXES, BITS = 3, 8, 7
RECALL, SAMPLE = 0.96, 200
#: Ranks to a block, at least and at most; numbers that a batch of queries is scored into at once.
BLOCK, LARGEST, SCORED = 8192, 65536, 1 << 24


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of grid points, (n, axes) of whole numbers below 2**bits, as int64 (axes x bits < 64).
    Bits are taken from the top; each axis is reflected or swapped with the first as the curve turns (Skilling 2004)."""
    x = x.astype(np.int64).T.copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(axes):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = out << 1 | (x[i] >> b & 1)
    return out


def usable(vector: str, dim: int) -> Column:
    """Vectors of ``dim`` finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def curves(dim: int, longest: float, spread: float, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and shift of each curve, scaled so that projections fall on the grid."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(CURVES):
        q, _ = np.linalg.qr(rng.normal(size=(dim + 1, min(AXES, dim + 1))))
        shift = rng.uniform(-0.25, 0.25, q.shape[1])
        out.append((q / (6 * spread), 0.5 + shift / 6))
    return out


def _keys(x: np.ndarray, extra: np.ndarray, made: list) -> list[np.ndarray]:
    full = np.concatenate([x, extra[:, None]], axis=1)
    return [hilbert(np.clip((full @ q + s) * (1 << BITS), 0, (1 << BITS) - 1)) for q, s in made]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dim))


def best(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int | None, k: int, rough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows with the largest inner product with ``q``, ties to the smaller id, without ``own``. A fast product (``rough``,
    if it is known) selects, with some slack; what is kept is summed in one order, so that equal vectors tie."""
    rough = x @ q if rough is None else rough
    if own is not None:
        rough = np.where(ids == own, -np.inf, rough)
    at = np.flatnonzero(rough > -np.inf)
    if len(at) > k:
        least = np.partition(rough[at], len(at) - k)[len(at) - k]
        at = at[rough[at] >= least - 1e-9 * (1 + abs(least))]
    exact = (x[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def _top(hits: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` nearest of its hits, which may repeat."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_neighbours(data: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, dim: int) -> DataFrame:
    """Brute force: a bounded set of queries against all rows, block by block."""
    shared = data.sparkSession.sparkContext.broadcast(queries)  # at most SAMPLE vectors

    def run(frames):
        for f in frames:
            x, ids = _matrix(f["v"], dim), f["vec_id"].to_numpy()
            for own, q in shared.value:
                i, s = best(ids, x, q, own, k)
                yield pd.DataFrame({"query_id": own, "vec_id": i, "score": s})

    return _top(data.select("vec_id", "v").mapInPandas(run, "query_id bigint, vec_id bigint, score double"), k)


def search(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of which ``is_query`` holds, the nearest others by inner product.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
    do rows with a null id; an empty table gives no rows. All queries of equal vectors are answered alike, but for the
    row left out. Of equal vectors only the k + 1 with the least ids can be among anyone's k nearest, so only these are
    compared. Ids are distinct; of rows that repeat one, each is a candidate and one is returned."""
    spark = df.sparkSession
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = row["n"] if row else 0
    rows = df.where(F.col(vec_id).isNotNull() & usable(vector, dim)).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("query"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("norm", norm)
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    data = materialize(rows.withColumn("__n", first).where(F.col("__n") <= k + 1).drop("__n"), "vectors")
    asked = materialize(rows.where("query").select("vec_id", "v", "norm"), "queries")
    stats = data.agg(F.count("*").alias("n"), F.max("norm").alias("longest"), F.sqrt(F.avg(F.col("norm") * F.col("norm"))).alias("rms")).first()
    n, n_asked = stats["n"], asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    longest = float(stats["longest"])
    made = curves(dim, longest, float(stats["rms"]) / np.sqrt(dim))

    def place(frames):
        for f in frames:
            x, norm = _matrix(f["v"], dim), f["norm"].to_numpy()
            asked = f["asked"].to_numpy()
            extra = np.where(asked, 0.0, np.sqrt(np.maximum(longest**2 - norm**2, 0)))
            scale = np.where(asked, longest / norm, 1.0)
            for c, key in enumerate(_keys(x * scale[:, None], extra, made)):
                yield pd.DataFrame({"curve": c, "key": key, "vec_id": f["vec_id"], "asked": asked})

    keyed = data.withColumn("asked", F.lit(False)).select("vec_id", "v", "norm", "asked").unionByName(asked.withColumn("asked", F.lit(True)))
    keyed = materialize(keyed.mapInPandas(place, "curve int, key bigint, vec_id bigint, asked boolean"), "keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(frames):
        part, seen = TaskContext.get().partitionId(), [0] * CURVES
        for f in frames:
            at = np.zeros(len(f), np.int64)
            for c in range(CURVES):
                own = f["curve"].to_numpy() == c
                run = np.cumsum(~f["asked"].to_numpy()[own].astype(bool))
                at[own] = seen[c] + run
                seen[c] += int(run[-1]) if own.any() else 0
            yield f.assign(part=part, at=at)

    placed = keyed.repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id", "asked")
    placed = materialize(placed.mapInPandas(count, "curve int, key bigint, vec_id bigint, asked boolean, part int, at bigint"), "places")
    before = placed.groupBy("curve", "part").agg(F.sum((~F.col("asked")).cast("bigint")).alias("n"))  # a row for each curve and partition
    ahead = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(before.select("curve", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), ["curve", "part"])
    ranked = materialize(ranked.select("curve", "vec_id", "asked", (F.col("base") + F.col("at")).alias("place")), "ranks")
    spots, wants = ranked.where("not asked").drop("asked"), ranked.where("asked").select("curve", F.col("vec_id").alias("query_id"), F.col("place").alias("q"))

    some = [(r["vec_id"], np.array(r["v"], dtype=np.float64)) for r in bounded_sample(asked, "vec_id", SAMPLE).collect()]
    truth = materialize(exact_neighbours(data, some, k, dim).select("query_id", "vec_id"), "truth")
    far = spots.join(truth, "vec_id").join(wants, ["curve", "query_id"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("place") - F.col("q"))).alias("d"))
    half = far.agg(F.percentile("d", F.lit(RECALL)).alias("w")).first()["w"]
    half = int(half or 0) + k

    size = max(BLOCK, min(LARGEST, half))
    last = (n + 1) // size
    block = lambda p: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(p / size)))
    left = spots.join(data.select("vec_id", "v"), "vec_id").select("curve", block(F.col("place")).alias("block"), F.lit(False).alias("asked"), "vec_id", "v", "place")
    right = wants.join(asked.select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"]), "query_id")
    right = right.select("curve", F.explode(F.sequence(block(F.col("q") - half), block(F.col("q") + half))).alias("block"), F.lit(True).alias("asked"), F.col("query_id").alias("vec_id"), "v", F.col("q").alias("place"))
    # The parts that meet: as many as blocks, so that a task holds one block's rows, or a few blocks one after the other.
    met = left.unionByName(right).repartition(max(parts, CURVES * (last + 1)), "curve", "block").sortWithinPartitions("curve", "block", "asked")
    fields = "query_id bigint, vec_id bigint, score double"

    def meet(batches):
        at, held, ready = None, [], None
        for batch in batches:
            f = batch.to_pandas()
            for key, part in f.groupby(["curve", "block"], sort=True):
                if key != at:
                    at, held, ready = key, [], None
                rows, wanted = part[~part["asked"]], part[part["asked"]]
                if len(rows):
                    held.append((rows["place"].to_numpy(), rows["vec_id"].to_numpy(), _matrix(rows["v"], dim)))
                if not len(wanted) or not held:
                    continue
                if ready is None:
                    place, ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(place, kind="stable")
                    ready = place[order], ids[order], x[order]
                place, ids, x = ready
                step = max(1, SCORED // len(ids))
                for s in range(0, len(wanted), step):
                    some = wanted.iloc[s : s + step]
                    q, own = _matrix(some["v"], dim), some["vec_id"].to_numpy()
                    lo, hi = np.searchsorted(place, some["place"].to_numpy() - half), np.searchsorted(place, some["place"].to_numpy() + half + 1)
                    rough, out = q @ x.T, []
                    for j in range(len(some)):
                        a, b = lo[j], hi[j]
                        i, score = best(ids[a:b], x[a:b], q[j], own[j], k, rough[j, a:b])
                        out.append((np.full(len(i), own[j]), i, score))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    hits = met.mapInArrow(meet, fields)
    return _top(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector; nulls, odd vectors, ties, repeated rows and an empty table as in ``search``."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
