"""Near duplicates by DartMinHash: darts are thrown, by hashes alone, into the weighted regions of a text's shingles; the
earliest dart at each coordinate is the signature, banded signatures propose candidates and exact likenesses decide.

A shingle that occurs c times has a region of width c, cut into strips [0, 1), [1, 2), [2, 4), [4, 8) and so on. Darts reach a
strip as a Poisson process in time, at a rate of its width, each at a place within it and on one of COORDINATES coordinates, all
drawn from a hash of shingle, strip and number; those beyond c miss. So the earliest dart of two texts agrees with probability
their weighted Jaccard likeness. Only darts before a horizon of about (ln COORDINATES + 2.5) x COORDINATES / weight are thrown:
for a text of any weight some hundred darts, besides one look at each strip, of which a shingle has one more than log2 of its
count. Texts left with an empty coordinate get a longer horizon.

Candidates are never paired off within a bucket. Its leader (most copies, then least number) is compared with each
member; likeness being one less a metric distance, what the leader is near to (distance D) needs no more comparison with
what is farther than twice that, and so on:

    links have distance <= D = 0.2; star: within D of the leader, linked through it; ring: within 2D; field: within 3D
    star-star: linked already. star-beyond the ring, ring-beyond the field: too far apart for a link
    ring-field (which holds star and ring): compared in blocks of bounded size, without a row for each pair
    beyond-beyond: compared in blocks likewise, bucket by bucket

So every link between texts that share a bucket is found or is implied by others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import expand_texts, forget, materialize, table, text_or_empty
from strandlake.llm.shingles import CELL, ODD, cell_array, cells_of, mix, shingles

ROWS, BANDS = 4, 20
COORDINATES = ROWS * BANDS
#: A link: 5 x shared >= 4 x all, likeness 0.8.
LINK = (4, 5)
BLOCK = 256
#: Places that the rows of one group are dealt among where they meet what is known of the group.
SALTS = 64
#: Keys that hold more than one in HOT of all rows, of which there are at most HOT, are joined by broadcast.
HOT = 1_000


def signatures(gram: np.ndarray, count: np.ndarray, of: np.ndarray, texts: int, k: int = COORDINATES) -> np.ndarray:
    """Earliest darts' hashes, (texts, k), uint64; zero for texts without shingles. Shingles are distinct within a text."""
    weight = np.bincount(of, weights=count, minlength=texts)
    sig, full = np.zeros(texts * k, np.uint64), weight == 0
    wide = np.log(k) + 2.5
    strips = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))), 0).astype(np.int64) + 1
    at = np.repeat(np.arange(len(gram)), strips)
    strip = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(strip > 0, 2.0 ** np.maximum(strip - 1, 0), 0.0)
    width, seed = np.where(strip > 0, low, 1.0), mix(gram[at] + ODD) ^ mix(strip.astype(np.uint64) * ODD)
    part = lambda h, salt: ((mix(h ^ np.uint64(salt)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    while not full.all():
        horizon = wide * k / np.maximum(weight, 1)
        live = ~full[of[at]]
        cell, doc, base, span, top = seed[live], of[at][live], low[live], width[live], count[at][live]
        time, times, darts, spots = np.zeros(len(cell)), [], [], []
        turn = 0
        while len(cell):
            turn += 1
            h = mix(cell + np.uint64(turn * int(ODD) % 2**64))
            time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / span
            soon = time < horizon[doc]
            cell, doc, base, span, top, time, h = (x[soon] for x in (cell, doc, base, span, top, time, h))
            hit = base + span * part(h, 0x2545F4914F6CDD1D) < top
            dart = mix(h[hit] ^ np.uint64(0x5851F42D4C957F2D))
            times.append(time[hit])
            darts.append(dart)
            spots.append(doc[hit] * k + (dart % np.uint64(k)).astype(np.int64))
        time, dart, spot = np.concatenate(times), np.concatenate(darts), np.concatenate(spots)
        order = np.argsort(-time, kind="stable")
        found = np.zeros(texts * k, bool)
        found[spot] = True
        sig[spot[order]] = dart[order]  # the last written is the earliest
        full |= found.reshape(texts, k).all(axis=1)
        wide *= 2
    return sig.reshape(texts, k)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) of 64-bit hashes, different for each band."""
    n, k = sig.shape
    out = np.tile(np.arange(k // rows, dtype=np.uint64) * ODD, (n, 1))
    for j in range(rows):
        out = mix(out * ODD + sig.reshape(n, k // rows, rows)[:, :, j])
    return out.view(np.int64)


def sign(df: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """A row for each row: ``key``, the columns ``carry``, row (a number of its own), same (hash of the word sequence),
    bands, cells."""

    def run(texts, at):
        gram, count, of, keys = shingles(texts)
        held = np.bincount(of, minlength=len(texts)) > 0
        bands = band_keys(signatures(gram, count, of, len(texts)))
        row = (TaskContext.get().partitionId() << 40) + at + np.arange(len(texts))
        return [row, [k.tobytes() for k in keys], [b if h else b[:0] for b, h in zip(bands, held, strict=True)], cells_of(gram, count, of, len(texts))]

    return expand_texts(df, text, [key, *(carry or [])], {"row": "bigint", "same": "binary", "bands": "array<bigint>", "cells": "binary"}, run)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _likenesses(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, node) with shared and all: sizes of intersection and union."""
    both = pairs.join(sets.select(F.col("row").alias("node"), F.col("cells").alias("b")), "node")
    both = both.join(sets.select(F.col("row").alias("leader"), F.col("cells").alias("a")), "leader")

    def run(batches):
        for batch in batches:  # pair by pair, so that no more than two sets are unpacked
            a, b, out = batch.column("a"), batch.column("b"), []
            for i in range(batch.num_rows):
                x, y = cell_array(a[i].as_py()), cell_array(b[i].as_py())
                n = shared(x, y)
                out.append((n, len(x) + len(y) - n))
            columns = [pa.array([r[j] for r in out], pa.int64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("node"), *columns], names=["leader", "node", "shared", "whole"])

    return both.select("leader", "node", "a", "b").mapInArrow(run, "leader bigint, node bigint, shared bigint, whole bigint")


def _within(times: int) -> F.Column:
    """Distance within ``times`` of a link's: 1 - shared/whole <= times (1 - LINK)."""
    low, high = LINK
    return F.col("shared") * high >= F.col("whole") * (high - times * (high - low))


def _blocks(field: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links, (a, b), between rows of a group (kind, leader, node, ring) of which one at least is of the ring, and which
    join different components. Ring and whole group are cut into blocks of about BLOCK; every block of the one meets every
    block of the other in a task of its own."""
    group = ["kind", "leader"]
    field = field.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    worth = field.groupBy(*group).agg(F.count("*").alias("m"), F.sum(F.col("ring").cast("int")).alias("r"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    worth = worth.where("r > 0 and lo < hi").select(*group, F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("r") / BLOCK).cast("int").alias("rb"))
    # A group may be large: its counts are sent to SALTS places, and its rows are dealt among these.
    worth = worth.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    field = field.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(worth, [*group, "salt"])
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    right = field.select(*group, "node", "comp", F.lit(False).alias("ring"), place("mb").alias("j"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("i"))
    left = field.where("ring").select(*group, "node", "comp", "ring", place("rb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"))
    rows = right.unionByName(left).join(sets.select(F.col("row").alias("node"), "cells"), "node")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        field, low, high = f[~f["ring"]], *LINK
        size = np.array([len(x) // CELL for x in field["cells"]], dtype=np.int64)
        cells, of = cell_array(b"".join(field["cells"])), np.repeat(np.arange(len(size)), size)
        order = np.argsort(cells, kind="stable")
        cells, of, comps, nodes, out = cells[order], of[order], field["comp"].to_numpy(), field["node"].to_numpy(), []
        for node, comp, raw in f[f["ring"]][["node", "comp", "cells"]].itertuples(index=False):
            own = cell_array(raw)
            lo, hi = np.searchsorted(cells, own, "left"), np.searchsorted(cells, own, "right")
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            n = np.bincount(of[at], minlength=len(size))
            for i in np.flatnonzero((n * high >= (len(own) + size - n) * low) & (comps != comp)):
                out.append((node, nodes[i], comps[i]))
        return pd.DataFrame(out, columns=["a", "b", "c"]).drop_duplicates(["a", "c"])[["a", "b"]].astype("int64")  # one link to a component will do

    return rows.groupBy(*group, "i", "j").applyInPandas(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): one name for all nodes that links connect, for every node with a link. In each round a node takes on
    the neighbour (or itself) whose hash for the round is least, and links are drawn between what they have become: about
    half go, whatever the shape. Rounds are written, so that lineage stays short."""
    links, steps = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), []
    while True:
        rank = lambda c, turn=len(steps): F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))
        ends = links.select(F.col("a").alias("node"), rank("b").alias("r")).unionByName(links.select(F.col("b").alias("node"), rank("a").alias("r")))
        step = ends.groupBy("node").agg(F.min("r").alias("r")).select("node", F.least("r", rank("node"))["to"].alias("to"))
        steps.append(materialize(step, "step"))
        a, b = (steps[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        after = links.join(a, "a").join(b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        after, before = materialize(after, "links"), links
        links = after
        forget(before)
        if links.limit(1).count() == 0:
            break
    out = steps[0].select("node", F.col("to").alias("comp"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    out = materialize(out, "labels")
    forget(links, *steps)
    return out


def _joined(rows: DataFrame, known: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Rows with what is known of their ``key`` (each has one row in ``known``, and holds ``count`` rows): the few keys that hold
    many rows by broadcast, the others by a shuffle."""
    hot = F.broadcast(known.where(F.col(count) * HOT > total))  # fewer than HOT rows
    cold = rows.join(hot.select(key), key, "left_anti").join(known.where(F.col(count) * HOT <= total), key)
    return rows.join(hot, key).unionByName(cold.select(*rows.join(hot, key).columns))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """A row for each row of ``df``: ``key``, the columns ``carry``, class_id (least ``key`` of the class), class_rows, and keep, true
    for one row of each class. Classes are the components of links: equal word sequences, or weighted Jaccard likeness of
    five-word shingles of 0.8 or more.

    Null texts count as empty; texts without a word form one class, as equal texts do. Rows with a null key take part (a
    class of them alone has a null class_id); repeated rows are rows of their own."""
    carry = carry or []
    signed = materialize(sign(df, text, key, carry), "signed")
    ids = materialize(signed.select(key, *carry, "row", "same"), "ids")  # all that is needed in the end
    least = lambda: F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "row")).alias("least")
    same = materialize(ids.groupBy("same").agg(F.min("row").alias("node"), F.count("*").alias("copies"), least()), "same")
    one = signed.select("row", "bands").join(same.select(F.col("node").alias("row"), "copies"), "row")
    rows = one.select(F.explode("bands").alias("band"), F.struct("copies", F.col("row").alias("node")).alias("who"))
    sets, pair = signed.select("row", "cells"), lambda x: x.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    lead = rows.groupBy("band").agg(F.max("who").alias("lead"), F.count("*").alias("n")).where("n > 1")
    lead = lead.select("band", F.col("lead.node").alias("leader"), "n")
    members = F.col("who.node").alias("node")
    rows = _joined(rows.select("band", members), lead, "band", "n", same.count() * BANDS).select("band", "leader", "node")
    rows = materialize(rows.where("node <> leader"), "buckets")
    seen = materialize(_likenesses(rows.select("leader", "node").distinct(), sets), "seen")
    labels = components(seen.where(_within(1)).select(F.col("leader").alias("a"), F.col("node").alias("b")))
    field = seen.where(_within(3)).select(F.lit(0).alias("kind"), "leader", "node", (~_within(1) & _within(2)).alias("ring"))
    field = field.unionByName(field.select("kind", "leader", F.col("leader").alias("node"), F.lit(False).alias("ring")).distinct())
    beyond = rows.join(seen.where(~_within(2)).select("leader", "node"), ["leader", "node"], "left_semi")
    beyond = beyond.select(F.lit(1).alias("kind"), F.col("band").alias("leader"), "node", F.lit(True).alias("ring"))
    more = materialize(_blocks(field.unionByName(beyond), labels, sets), "more")
    if more.limit(1).count():
        labels = components(more.unionByName(pair(labels)))
    forget(rows, seen, more, signed)
    named = same.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = named.groupBy("comp").agg(F.min("least").alias("first"), F.sum("copies").alias("class_rows"), F.count("*").alias("texts"))
    total = ids.count()
    named = _joined(named.select("comp", "same", "copies"), classes, "comp", "texts", total)
    out = _joined(ids, named.select("same", "copies", "first", "class_rows"), "same", "copies", total)
    return out.select(key, *carry, F.col("first.key").alias("class_id"), "class_rows", (F.col("row") == F.col("first.row")).alias("keep"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Class of every document; nulls, empty texts, repeated rows and an empty table as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` of which ``keep`` holds, one for each class, columns as they were. Rows are told apart by key
    and text; of rows equal in both, one stays."""
    rows = df.withColumn("__digest", F.md5(text_or_empty(text).cast("binary")))
    marked = near_duplicates(rows.select(key, text, "__digest"), text, key, ["__digest"])
    kept = marked.groupBy(F.col(key).alias("__kept"), F.col("__digest").alias("__of")).agg(F.max("keep").alias("keep"), F.count("*").alias("n")).where("keep")
    kept = materialize(kept.select("__kept", "__of", "n"), "kept")  # a row for each class
    named = lambda some: rows.join(some, F.col(key).eqNullSafe(F.col("__kept")) & (F.col("__digest") == F.col("__of")), "left_semi")
    out = named(kept.where("n = 1")).select(*df.columns)
    if kept.where("n > 1").limit(1).count():  # rows that repeat in key and text: one of each
        one = Window.partitionBy(key, "__digest").orderBy(F.col(text).isNull())
        out = out.unionByName(named(kept.where("n > 1")).withColumn("__rn", F.row_number().over(one)).where("__rn = 1").select(*df.columns))
    return out
