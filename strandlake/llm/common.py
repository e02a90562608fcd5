"""What the operators share: reading tables, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlake.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and the master is local, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = spark.conf.get("strandlake.checkpoint.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("strandlake.checkpoint.dir", own)
        spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends here, and a lost executor costs
    no recomputation of what stands above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*written: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for these frames, once nothing will read them any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of text that an operator in Python takes up at once (one longer text is taken up alone).
TAKE = 1 << 20
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def portions(batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about TAKE bytes of ``texts``."""
    if batch.num_rows:
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(t)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
        cut = [0, *(np.flatnonzero(np.diff(ends // TAKE)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def expand_texts(df: DataFrame, text: str | list[str], keep: list[str], add: dict[str, str], make: Callable) -> DataFrame:
    """Rows made from the texts of ``df``: columns ``keep`` as they stand in Arrow (so that 64-bit numbers beside nulls, decimals
    and nested values stay exact), then columns ``add`` (name -> type, as in ARROW).

    ``make`` takes the texts of a portion, None for null (a list for each column of ``text``), and the number of the portion's
    first row in its partition; it returns a list of the columns of ``add``, or a pair of this list and, for each new row,
    the place of the row it comes from."""
    texts = [text] if isinstance(text, str) else text
    fields = [df.schema[k] for k in keep]
    schema = StructType(fields + [StructType.fromDDL(f"`{name}` {kind}")[0] for name, kind in add.items()])

    def run(batches):
        at = 0
        for whole in batches:
            for batch in portions(whole, texts):
                made = make(*[batch.column(t).to_pylist() for t in texts], at)
                values, rows = made if isinstance(made, tuple) else (made, None)
                kept = [batch.column(k) for k in keep]
                if rows is not None:
                    kept = [c.take(pa.array(rows, pa.int64())) for c in kept]
                new = [pa.array(v, ARROW[kind]) for v, kind in zip(values, add.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[*keep, *add])
                at += batch.num_rows

    return df.select(*dict.fromkeys([*keep, *texts])).mapInArrow(run, schema)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of ``key``: the same rows whatever the partitioning. Counts
    first, so that little more than the sample leaves the scan."""
    n, place = df.count(), F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 24))
    if n > 2 * limit:
        df = df.where(place < int((1 << 24) * min(1.0, 1.3 * limit / n)))
    return df.orderBy(place, F.col(key)).limit(limit)


def utf32(text: str) -> np.ndarray:
    """Code points of ``text``; lone surrogates survive."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def crc32_text(value: object) -> int:
    return zlib.crc32(str(value).encode())
