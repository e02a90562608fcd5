"""Scanning a stream of sequence files: a narrow, stateless pass. P-values need nothing from other rows; q-values do, so they
are left to batch reads of the output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.pssm import Pssm
from strandlake.operators.scan import scan


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """seq_name, seq of the FASTA files that appear in a folder."""
    raw = spark.readStream.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"))
    return raw.select(F.regexp_extract("r", r"^(\S*)", 1).alias("seq_name"), F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))


def scan_stream(spark: SparkSession, path: str, pssms: list[Pssm], max_p: float = 1e-4) -> DataFrame:
    return scan(read_stream(spark, path), pssms, max_p=max_p)


def write_stream(hits: DataFrame, path: str, checkpoint: str):
    """Appends hits as Parquet; each file of sequences is scanned once, also across restarts."""
    return hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
