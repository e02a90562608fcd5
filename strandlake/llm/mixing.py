"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order fixed by a hash, form blocks; block i of a source with ``w`` of ``SLOTS`` shares is
released at slot floor(i SLOTS / w) and due by ceil((i + 1) SLOTS / w). In every slot the released block that is due first
runs (earliest deadline first), so at any time each source is less than one block from its target. A block has BLOCK
characters, or as many as the longest document if that is longer, so that no document spans blocks that lie between. As shares add
up to SLOTS the schedule repeats after SLOTS slots: one period places every block. It is worked out by an expression over a
single row or, for more than FOLD sources, by a heap on the driver, which then holds a row for each source; both say the same.
Where sources are more than SLOTS, a period has EACH slots for each of them.

Native: built-in expressions, windows and joins. Running sums go through three levels (hash prefixes of two lengths, then
the rows of a prefix), so that no task sorts a source.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import table, text_or_empty

SLOTS, BLOCK = 1000, 10_000
#: Slots to a source, where there are more than SLOTS sources.
EACH = 4
#: Sources up to which an expression works the period out.
FOLD = 64
#: A source of less than a share of 1 / MINOR of the largest one's characters doesn't end the mix when it runs out.
MINOR = 100
#: Target weights are the sources' amounts to this power, unless given.
TEMPER = 0.7
#: Rows to a hash prefix, about.
FINE = 4_000


def shares(totals: DataFrame, temper: float = TEMPER, slots: int = SLOTS) -> DataFrame:
    """(source, total, w): whole shares of ``slots`` by tempered amounts; what rounding down leaves goes to the largest
    remainders. Every source has one share at least; there may be at most ``slots`` sources with an amount (``mix`` sees to it)."""
    every = Window.partitionBy(F.lit(0))
    weight = F.pow(F.col("total").cast("double"), F.lit(temper))
    raw = totals.where("total > 0").withColumn("exact", F.round(weight * (slots - F.count("*").over(every)) / F.sum(weight).over(every), 9))
    raw = raw.withColumn("low", F.floor("exact") + 1).withColumn("rest", F.lit(slots) - F.sum("low").over(every))
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("exact") - F.floor("exact")), "__source")
    return raw.select("__source", "total", (F.col("low") + F.when(F.row_number().over(by_rest) <= F.col("rest"), 1).otherwise(0)).cast("bigint").alias("w"))


def given_shares(totals: DataFrame, weights: dict[str, float], slots: int = SLOTS) -> DataFrame:
    """As ``shares``, for stated weights; sources without one have no place in the mix."""
    whole = sum(w for w in weights.values() if w > 0)
    low = {s: max(1, int(slots * w / whole)) for s, w in weights.items() if w > 0}
    largest = [(-n, s) for s, n in low.items()]
    heapq.heapify(largest)
    for _ in range(sum(low.values()) - slots):  # least shares of one have made too many
        n, s = heapq.heappop(largest)
        low[s] -= 1
        heapq.heappush(largest, (n + 1, s))
    for s in sorted(low, key=lambda s: -(slots * weights[s] / whole % 1))[: slots - sum(low.values())]:
        low[s] += 1
    pairs = F.create_map(*[F.lit(x) for kv in low.items() for x in kv]) if low else F.lit(None).cast("map<string,int>")
    return totals.withColumn("w", pairs[F.col("__source")].cast("bigint")).where("w is not null and total > 0")


def period(shared: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(source, k, slot): the slot of each source's k-th block within a period, earliest deadline first, ties to the
    source that comes first by name."""
    one = shared.groupBy().agg(F.array_sort(F.collect_list(F.struct("__source", "w"))).alias("s"))  # at most ``slots`` entries

    def run(state: Column, t: Column) -> Column:
        due = F.transform("s", lambda x, i: F.when(F.get(state["n"], i) * slots < (t + 1) * x["w"], F.struct(F.ceil((F.get(state["n"], i) + 1) * slots / x["w"]).alias("due"), i.alias("i"))))
        pick = F.array_min(due)["i"]
        n = F.transform(state["n"], lambda c, i: F.when(i == pick, c + 1).otherwise(c))
        return F.struct(n.alias("n"), F.concat(state["out"], F.array(F.struct(pick.alias("i"), F.get(state["n"], pick).alias("k")))).alias("out"))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("bigint")).alias("n"), F.array().cast("array<struct<i:int,k:bigint>>").alias("out"))
    slotted = one.where(F.size("s") > 0).select("s", F.posexplode(F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint")), start, run)["out"]).alias("slot", "x"))
    return slotted.select(F.get("s", F.col("x.i"))["__source"].alias("__source"), F.col("x.k").alias("k"), F.col("slot").cast("bigint").alias("slot"))


def schedule(shares: list[int], slots: int) -> list[tuple[int, int, int]]:
    """(i, k, slot) as ``period`` has them, for shares listed by name."""
    ready, waiting, out = [], [(0, i, 0) for i in range(len(shares))], []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * slots // shares[i]), i, k))
        if ready:
            _, i, k = heapq.heappop(ready)
            out.append((i, k, t))
            heapq.heappush(waiting, ((k + 1) * slots // shares[i], i, k + 1))
    return out


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a literal of the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def mix(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", key: str = "doc_id", text: str = "text", temper: float = TEMPER, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """Adds mix_slot (place in the mix; documents of one slot follow by hash), mix_block (of the source) and in_mix: whether
    the place lies before the first at which a source of some size (see MINOR) has run out, up to which the mix has its target
    weights. Columns of these names are replaced; no row is lost.

    A document counts its characters, one at least (null text: empty); one that spans two blocks takes the place of the first.
    Null sources are one source, named ''. Sources without a weight get null and False. Documents follow by a hash of key and
    text (nulls as ''), so rows without a key, or of one key, are spread by their text; rows that repeat tie, and which of them
    comes first makes no difference."""
    spark, df = df.sparkSession, df.drop("mix_slot", "mix_block", "in_mix")
    size = F.greatest(F.length(text_or_empty(text)), F.lit(1)).cast("bigint")
    held = df.groupBy(F.coalesce(F.col(source), F.lit("")).alias("__source")).agg(F.count("*").alias("n"), F.sum(size).cast("bigint").alias("total"), F.max(size).alias("longest"))
    totals = held.select("__source", "total")
    held = held.agg(F.sum("n").alias("n"), F.count("*").alias("sources"), F.max("longest").alias("longest")).first()
    block = max(block, held["longest"] or 0)
    sources = held["sources"] if weights is None else sum(w > 0 for w in weights.values())
    slots = EACH * sources if sources > slots else slots
    shared = given_shares(totals, weights, slots) if weights is not None else shares(totals, temper, slots)
    if sources > FOLD:
        named = sorted(tuple(r) for r in shared.select("__source", "total", "w").collect())  # a row for each source
        shared = _table(spark, named, "__source string, total bigint, w bigint")
        times = _table(spark, [(named[i][0], k, t) for i, k, t in schedule([w for _, _, w in named], slots)], "__source string, k bigint, slot bigint")
    else:
        times = period(shared, slots)
    digits = max(2, math.ceil(math.log(max(1, held["n"] or 0) / FINE, 16) + 1))
    coarse = digits // 2
    digest = F.md5(F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("")), text_or_empty(text)).cast("binary"))
    rows = df.withColumns({"__source": F.coalesce(F.col(source), F.lit("")), "__size": size, "__hash": digest})
    rows = rows.withColumn("__fine", F.substring("__hash", 1, digits))
    fine = rows.groupBy("__source", "__fine").agg(F.sum("__size").alias("n")).withColumn("__coarse", F.substring("__fine", 1, coarse))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = fine.groupBy("__source", "__coarse").agg(F.sum("n").alias("n")).select("__source", "__coarse", ahead(Window.partitionBy("__source").orderBy("__coarse")).alias("base"))
    base = fine.withColumn("more", ahead(Window.partitionBy("__source", "__coarse").orderBy("__fine"))).join(top, ["__source", "__coarse"])
    base = base.select("__source", "__fine", (F.col("base") + F.col("more")).alias("__base"))
    own = Window.partitionBy("__source", "__fine").orderBy("__hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(base, ["__source", "__fine"]).withColumn("mix_block", F.floor((F.col("__base") + F.coalesce(F.sum("__size").over(own), F.lit(0))) / block))
    every = Window.partitionBy(F.lit(0))
    lasts = F.when(F.col("total") * MINOR >= F.max("total").over(every), F.floor(F.col("total") * slots / (F.col("w") * block)))
    ends = shared.withColumn("ends", F.min(lasts).over(every))
    places = times.join(ends.select("__source", "w", "ends"), "__source")  # ``slots`` rows
    places = F.broadcast(places.select(*[F.col(c).alias(f"__{c.strip('_')}_of") for c in ("__source", "k", "slot", "w", "ends")]))
    weight = F.broadcast(shared.select("__source", F.col("w").alias("__w")))  # a row for each source
    rows = rows.join(weight, "__source", "left")
    rows = rows.join(places, (F.col("__source") == F.col("__source_of")) & (F.col("mix_block") % F.col("__w") == F.col("__k_of")), "left")
    slot = F.floor(F.col("mix_block") / F.col("__w_of")) * slots + F.col("__slot_of")
    return rows.withColumns({"mix_slot": slot, "in_mix": F.coalesce(slot < F.col("__ends_of"), F.lit(False))}).select(*df.columns, "mix_slot", "mix_block", "in_mix")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the mix. Null ids, texts and sources have one too, as ``mix`` states."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "mix_slot", "mix_block", "in_mix")


OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, greatest(length(coalesce(text, '')), 1) AS n, md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS h FROM documents),
blk AS (SELECT greatest({BLOCK}, max(n)) AS size FROM d),
tot AS (SELECT s, sum(n)::BIGINT AS total FROM d GROUP BY s),
raw AS (SELECT s, total, round(pow(total::DOUBLE, {TEMPER}) * ({SLOTS} - count(*) OVER ()) / sum(pow(total::DOUBLE, {TEMPER})) OVER (), 9) AS x FROM tot),
sh AS (SELECT s, total, (floor(x) + 1 + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, s) <= {SLOTS} - sum(floor(x) + 1) OVER () THEN 1 ELSE 0 END)::BIGINT AS w FROM raw),
ws AS (SELECT list(w ORDER BY s) AS w, list(s ORDER BY s) AS names FROM sh),
r(t, n, p) AS (
  SELECT 0::BIGINT, (SELECT list_transform(w, lambda x: 0::BIGINT) FROM ws), NULL::BIGINT
  UNION ALL
  SELECT t + 1, list_transform(n, lambda c, i: c + CASE WHEN i = q THEN 1 ELSE 0 END), q FROM (
    SELECT t, n, list_aggregate(list_transform(w, lambda x, i: CASE WHEN n[i] * {SLOTS} < (t + 1) * x THEN ceil((n[i] + 1) * {SLOTS} / x)::BIGINT * 1000000 + i END), 'min') % 1000000 AS q
    FROM r, ws WHERE t < {SLOTS})),
slots AS (SELECT names[p] AS s, t - 1 AS slot, row_number() OVER (PARTITION BY p ORDER BY t) - 1 AS k FROM r, ws WHERE p IS NOT NULL),
b AS (SELECT *, floor(coalesce(sum(n) OVER (PARTITION BY s ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / size)::BIGINT AS mix_block FROM d, blk),
e AS (SELECT min(floor(total * {SLOTS} / (w * size)))::BIGINT AS ends FROM sh, blk WHERE total * {MINOR} >= (SELECT max(total) FROM sh))
SELECT doc_id, source, (mix_block // w) * {SLOTS} + slot AS mix_slot, mix_block, (mix_block // w) * {SLOTS} + slot < ends AS in_mix
FROM b JOIN sh USING (s) JOIN slots ON slots.s = b.s AND slots.k = b.mix_block % sh.w, e
"""
