"""Document fingerprints by winnowing: hash every k-gram, keep the minimum of each window, the rightmost where it ties,
together with its position. Two texts that share a run of ``k + window - 1`` tokens share a fingerprint.

Native: built-in expressions in one pass. Hashes of grams and minima of windows are put together from shorter ones (of two
tokens, then of four; of two keys, four, six) by whole arrays, so a position costs the logarithm of either length. Finding each
document's neighbour shuffles texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import table, text_or_empty

#: Thai, kana and ideographs, written without spaces, give a token a character; other runs of letters, marks and digits are cut,
#: so that no text is a single token.
ALONE = r"\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{2fa1f}"
TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{ALONE}]]{{1,16}}|[{ALONE}]"
#: A text without any such token has its other characters for tokens.
ANY = r"\S"
K, WINDOW = 4, 6
#: A key is 32 bits of hash above 31 bits of position counted from the end, so the least key is the rightmost minimum.
LAST = 2**31 - 1
#: Ids to a bucket within which neighbours are found by sorting; characters of text to a task.
BUCKET, TASK = 256, 1 << 26


def _joined(df: DataFrame, column: str, length: int, join) -> DataFrame:
    """At every position of an array what ``join`` makes of it and the ``length`` - 1 after it, or of as many as there are
    (``join`` leaves nulls out): by doubling, then once more by what is missing."""
    done = 1
    while done < length:
        step = min(done, length - done)
        df = df.withColumn(column, F.zip_with(column, F.slice(column, step + 1, F.greatest(F.size(column), F.lit(1))), join))
        done += step
    return df


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``out``, array<bigint> of (hash << 31 | LAST - position), by position.

    Null and empty texts have none. A text of fewer than ``k`` tokens is one gram, one of fewer grams than ``window`` is
    one window. Equal texts have equal fingerprints, whatever the partitioning; repeated rows are answered alike.
    """
    at, size, low = f"__{out}", f"__{out}_size", F.lower(text_or_empty(text))
    df = df.withColumn(at, F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)))
    df = df.withColumn(at, F.when(F.size(at) > 0, F.col(at)).otherwise(F.regexp_extract_all(low, F.lit(ANY), F.lit(0))))
    df = df.withColumn(size, F.size(at)).withColumn(at, F.transform(at, lambda t: F.xxhash64(t)))
    df = _joined(df, at, k, lambda a, b: F.xxhash64(a, b))
    key = lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(2**32 - 1)), 31).bitwiseOR((F.lit(LAST - 1) - i).cast("bigint"))
    df = df.withColumn(at, F.transform(F.slice(at, 1, F.greatest(F.col(size) - (k - 1), F.lit(1))), key))
    df = _joined(df, at, window, lambda a, b: F.least(a, b))
    return df.withColumn(out, F.array_distinct(F.slice(at, 1, F.greatest(F.col(size) - (k + window - 2), F.lit(1))))).drop(at, size)


def hashes(fingerprint: str | Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the ``hashes`` of two fingerprints; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def fingerprint_text(fingerprint: str | Column) -> Column:
    """``hash:position`` joined by commas; hashes in hex, positions in tokens from 0."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", F.lower(F.hex(F.shiftrightunsigned(x, 31))), (F.lit(LAST - 1) - x.bitwiseAND(F.lit(LAST))).cast("string"))), ",")


def _chain(tops: DataFrame, levels: int) -> DataFrame:
    """(bucket, low): of buckets (bucket, ...), the next lower one in use, or for the lowest the highest. Buckets are linked within
    buckets of buckets, so that no task sorts more than the last level's few rows."""
    if levels == 0:
        w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
        return tops.select("bucket", F.coalesce(F.lead("bucket").over(w), F.first("bucket").over(w)).alias("low"))
    group = F.floor(F.col("bucket") / 1024)
    linked = tops.select("bucket", group.alias("group"), F.lead("bucket").over(Window.partitionBy(group).orderBy(F.desc("bucket"))).alias("low"))
    heads = tops.groupBy(group.alias("bucket")).agg(F.max("bucket").alias("head"))
    over = _chain(heads, levels - 1).join(heads.select(F.col("bucket").alias("low"), "head"), "low").select(F.col("bucket").alias("group"), "head")
    ends = linked.where("low is null").join(over, "group").select("bucket", F.col("head").alias("low"))
    return linked.where("low is not null").select("bucket", "low").unionByName(ends)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", make=lambda rows: rows, carry: tuple[str, ...] = (), levels: int = 1) -> DataFrame:
    """Adds what ``make`` does, then next_text and next_ of each of ``carry``: those of the row that follows by descending ``key``
    (nulls last), and of the first row after the last. Rows of equal key are ordered by text; a row alone follows itself. Columns
    __bucket, __of, __last and __n are dropped; others pass through.

    Rows are shuffled once, to their bucket of BUCKET ids; only the first row of each bucket goes further, to the bucket
    before, where the last row has it joined on."""
    rows = df.withColumn("__bucket", F.coalesce(F.floor(F.col(key) / BUCKET), F.lit(-(2**60))).cast("bigint"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files, or far too much
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(parts, min(-(-size // TASK), 1 << 16)), "__bucket")
    order, given = Window.partitionBy("__bucket").orderBy(F.desc_nulls_last(key), text), (text, *carry)
    firsts = make(rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n"))
    chain = _chain(rows.select(F.col("__bucket").alias("bucket")).distinct(), levels)
    ghosts = chain.join(firsts, F.col("low") == F.col("__bucket")).select(F.col("bucket").alias("__of"), *[F.col(c).alias(f"__{c}") for c in given])
    rows = make(rows)
    rows = rows.withColumns({"__last": F.lead(F.lit(1)).over(order).isNull(), **{f"next_{c}": F.lead(c).over(order) for c in given}})
    rows = rows.join(ghosts, (F.col("__bucket") == F.col("__of")) & F.col("__last"), "left")
    return rows.withColumns({f"next_{c}": F.when(F.col("__last"), F.col(f"__{c}")).otherwise(F.col(f"next_{c}")) for c in given}).drop("__bucket", "__of", "__last", *[f"__{c}" for c in given])


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness. Null texts are empty; null ids come last, in the
    order of their texts; rows that repeat follow each other; a single document follows itself; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, make=lambda r: with_fingerprint(r, "text", "fp").withColumn("own", hashes("fp")), carry=("own",))
    rows = rows.withColumn("n_chars", F.length("text")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.left("text", F.col("n_chars") - F.col("cut")), F.left("next_text", F.col("cut")))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "efp").withColumn("theirs", hashes("efp"))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text("fp").alias("fingerprint"),
        fingerprint_text("efp").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("theirs")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
