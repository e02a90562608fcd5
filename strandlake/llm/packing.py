"""Packing documents into sequences of bounded length by linear grouping and best fit.

Lengths are whole numbers up to the capacity, so their histogram (at most ``capacity`` counts, however many documents)
says all that matters. The driver packs the histogram:

1. pieces as long as the capacity fill a sequence each;
2. large lengths, longest first, fall into groups of equal cardinality; within a group all count as its longest;
3. over these few sizes, configurations are chosen one after the other: the longest size left together with the fullest
   set of others (a subset-sum over bits), repeated as often as the counts allow;
4. the actual lengths take their group's places in order, longest first;
5. small lengths, longest first, go where they leave least room, several at once into the same sequence.

The outcome is a list of runs (so many pieces of one length, from a rank among its equals on, go to consecutive
sequences at one offset). Executors number the pieces of each length and look their places up in it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlake.llm.common import expand_texts, materialize, table
from strandlake.llm.tokens import encoder

CAPACITY, END_ID = 4096, 1
#: Lengths above CAPACITY // LARGE are grouped; so many groups.
LARGE, GROUPS = 3, 400


@dataclass
class Plan:
    """``runs[length]``: rows (first rank, number of pieces, first sequence, pieces to a sequence, offset), by rank."""

    capacity: int
    sequences: int = 0
    runs: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, _, base, each, offset = np.array(self.runs[length], dtype=np.int64).T
        i = np.searchsorted(first, ranks, side="right") - 1
        k = ranks - first[i]
        return base[i] + k // each[i], offset[i] + k % each[i] * length


def configuration(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest size with a count and the fullest set of others beside it that fits: size -> number of places."""
    longest = max(counts)
    room, left = capacity - longest, {s: c - (s == longest) for s, c in counts.items()}
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in sorted(left, reverse=True):
        for _ in range(min(left[size], room // size)):
            steps.append((size, reach))
            reach |= (reach << size) & mask
    out, at = defaultdict(int, {longest: 1}), reach.bit_length() - 1
    for size, before in reversed(steps):
        if not before >> at & 1:
            out[size] += 1
            at -= size
    return dict(out)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> Plan:
    """Where the pieces of each length go. Every piece gets a place; no sequence exceeds the capacity."""
    out = Plan(capacity)
    counts = {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
    taken: dict[int, int] = defaultdict(int)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, number of sequences)
    rooms: list[int] = []

    def put(length: int, n: int, base: int, each: int, offset: int) -> None:
        out.runs[length].append((taken[length], n, base, each, offset))
        taken[length] += n

    def leave(left: int, base: int, n: int) -> None:
        if left > 0 and n > 0:
            if not room[left]:
                insort(rooms, left)
            room[left].append((base, n))

    if full := counts.pop(capacity, 0):
        put(capacity, full, 0, 1, 0)
        out.sequences = full
    big = [(n, c) for n, c in counts.items() if n > capacity // large]
    share = -(-sum(c for _, c in big) // groups) or 1
    members: dict[int, list[list[int]]] = {}  # rounded size -> [length, count], longest first
    filled = share
    for n, c in big:
        while c:
            if filled >= share:
                size = n
                if size in members:  # a length that spans groups stays one size
                    members[size].append([n, c])
                    filled, c = filled + c, 0
                    continue
                members[size], filled = [], 0
            part = min(c, share - filled)
            members[size].append([n, part])
            filled, c = filled + part, c - part
    left = {size: sum(c for _, c in m) for size, m in members.items()}
    while left:
        config = configuration(left, capacity)
        times = min(left[s] // k for s, k in config.items())
        segments = [(out.sequences, times, 0)]  # (first sequence, number of sequences, used)
        out.sequences += times
        for size in (s for s, k in config.items() for _ in range(k)):
            split = []
            for base, n, used in segments:
                while n:
                    m = members[size][0]
                    part = min(n, m[1])
                    put(m[0], part, base, 1, used)
                    split.append((base, part, used + m[0]))
                    base, n, m[1] = base + part, n - part, m[1] - part
                    if not m[1]:
                        members[size].pop(0)
            segments = split
        for base, n, used in segments:
            leave(capacity - used, base, n)
        for size, k in config.items():
            left[size] -= times * k
            if not left[size]:
                del left[size]
    for n, c in counts.items():
        if n > capacity // large:
            continue
        while c:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n
                m = -(-c // each)
                leave(capacity, out.sequences, m)
                out.sequences += m
                continue
            space = rooms[i]
            base, m = room[space].pop()
            if not room[space]:
                rooms.pop(i)
            each, used = space // n, capacity - space
            whole = min(m, c // each)
            if whole:
                put(n, whole * each, base, each, used)
                leave(space - each * n, base, whole)
                base, m, c = base + whole, m - whole, c - whole * each
            if m and c:  # fewer are left than fit
                put(n, c, base, c, used)
                leave(space - c * n, base, 1)
                base, m, c = base + 1, m - 1, 0
            leave(space, base, m)
    return out


def pieces(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """A row for each piece: ``key``, piece, start, length, ids_crc32; part and rank number it among the pieces of its
    length in its partition. ``ids`` adds them, as little-endian unsigned 32-bit numbers.

    Null and empty texts are the closing id alone; repeated rows are documents of their own."""
    cut = capacity * 4
    ranks: dict[tuple[int, int], dict[int, int]] = {}  # of the task at work

    def encode(texts, at):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        if (part, attempt) not in ranks:
            ranks.clear()
            ranks[part, attempt] = defaultdict(int)
        seen, rows, out = ranks[part, attempt], [], [[] for _ in range(7)]
        for i, raw in enumerate(encoder(tokenizer).encode(texts)):
            raw += END_ID.to_bytes(4, "little")
            for p, a in enumerate(range(0, len(raw), cut)):
                own = raw[a : a + cut]
                n = len(own) // 4
                rows.append(i)
                for column, v in zip(out, (p, a // 4, n, zlib.crc32(own), part, seen[n], own if ids else b""), strict=True):
                    column.append(v)
                seen[n] += 1
        return out[: 6 + ids], rows

    add = {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "part": "int", "rank": "bigint"} | ({"ids": "binary"} if ids else {})
    return expand_texts(df, text, [key], add, encode)


def pack(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """The pieces of ``df`` with sequence_id and offset. An empty table gives an empty one.

    Pieces are written once; a task that runs again numbers its pieces alike, since parts follow the input's splits."""
    cut = materialize(pieces(df, tokenizer, text, key, capacity, ids), "pieces")
    each = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    made = plan({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)  # at most ``capacity`` rows
    shared = df.sparkSession.sparkContext.broadcast({n: np.array(r, dtype=np.int64) for n, r in made.runs.items()})

    def place(batches):
        for batch in batches:
            rank = batch.column("before").to_numpy() + batch.column("rank").to_numpy()
            length = batch.column("length").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[own[0]])
                seq[own], off[own] = Plan(capacity, 0, {n: shared.value[n]}).place(n, rank[own])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    kept = [c for c in cut.columns if c not in ("part", "rank")]
    schema = StructType([*[cut.schema[c] for c in kept], *StructType.fromDDL("sequence_id bigint, offset bigint")])
    return cut.join(base, ["part", "length"]).select(*cut.columns, "before").mapInArrow(place, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed. Null and empty texts are one id, the closing one; null ids stay null; rows that repeat are packed
    each."""
    return pack(table(spark, sf_dir, "documents"), vocabulary()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
