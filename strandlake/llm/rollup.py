"""Token counts as delta-maintained rollups.

Inserts, deletes and revised counts become signed rows; a batch of them is summed by source, language and tokenizer
version and written to a folder of its own. A manifest, a small file that names the folder and the batch ids in it, commits
it: it is written under a temporary name and renamed to that of its batch id without overwriting, so a batch counts once
however often and by however many writers it is sent, and a writer that dies leaves nothing that is read. Totals are sums over
committed batches; ``compact`` folds them into one without changing what they say or which ids are taken.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import expand_texts, materialize, shared_dir, table
from strandlake.llm.packing import vocabulary
from strandlake.llm.tokens import encoder

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def inserted(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Signed rows of new documents: KEYS, docs, tokens. A null count is 0."""
    return df.select(*KEYS, F.lit(1).cast("bigint").alias("docs"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("tokens"))


def deleted(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return inserted(df, tokens).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def revised(df: DataFrame, old: str = "tokens", new: str = "new_tokens") -> DataFrame:
    """Signed rows of documents whose count has changed; documents stay as many."""
    change = F.coalesce(F.col(new).cast("bigint"), F.lit(0)) - F.coalesce(F.col(old).cast("bigint"), F.lit(0))
    return df.select(*KEYS, F.lit(0).cast("bigint").alias("docs"), change.alias("tokens"))


class TokenRollup:
    """Totals kept under ``path``, a folder in a store that all executors share. One process at a time may compact; any number
    may commit meanwhile."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at, conf = hadoop.Path, spark._jsc.hadoopConfiguration()
        top = self._at(self.path)
        self._fs = top.getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)  # no option: an existing file isn't overwritten

    def _manifests(self) -> dict[str, dict]:
        """Manifests that count, by name. Once a compaction holds a batch, the batch's own manifest and any smaller compaction
        count no more, wherever the compaction was interrupted."""
        top, found = self._at(self.path), {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []
        for name in names:
            if name.startswith("batch="):
                stream = self._fs.open(self._at(f"{self.path}/{name}"))
                try:
                    found[name] = json.loads(bytes(stream.readAllBytes()))
                finally:
                    stream.close()
        held = {n: set(m["ids"]) for n, m in found.items()}
        return {n: m for n, m in found.items() if not any(held[n] <= held[o] and (held[n] < held[o] or o < n) for o in found if o != n)}

    def committed(self) -> set[str]:
        """Ids of batches that count, compacted ones included."""
        return {i for m in self._manifests().values() for i in m["ids"]}

    def commit(self, batch_id: str, signed: DataFrame) -> bool:
        """Adds a batch unless its id has been committed; says whether it was added. Ids are letters, digits, - and _, at most
        200. An empty batch counts as one."""
        if not batch_id.replace("-", "").replace("_", "").isalnum() or len(batch_id) > 200:
            raise ValueError(f"batch id {batch_id!r}")
        if batch_id in self.committed():
            return False
        summed = signed.groupBy(*KEYS).agg(F.sum("docs").cast("bigint").alias("docs"), F.sum("tokens").cast("bigint").alias("tokens"))
        return self._put(summed, f"batch={batch_id}", [batch_id])

    def _put(self, rows: DataFrame, name: str, ids: list[str]) -> bool:
        new = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/_data-{new}")
        draft, target = self._at(f"{self.path}/_draft-{new}"), self._at(f"{self.path}/{name}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(json.dumps({"ids": ids, "data": f"_data-{new}"}).encode())
        finally:
            stream.close()
        try:
            self._context.rename(self._context.makeQualified(draft), self._context.makeQualified(target), self._keep)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            self._fs.delete(draft, False)
            self._fs.delete(self._at(f"{self.path}/_data-{new}"), True)
            return False
        return True

    def _read(self, manifests: dict[str, dict]) -> DataFrame:
        parts = [f"{self.path}/{m['data']}" for m in manifests.values()]
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """KEYS, docs, tokens; groups that have lost all their documents are left out. Null keys are groups too."""
        return self._read(self._manifests()).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds all committed batches into one; the old ones go once its manifest is in place. A totals frame made before may
        then fail to read and is to be made anew."""
        old = self._manifests()
        if len(old) > 1:
            self._put(self._read(old), f"batch=compact+{uuid.uuid4().hex}", sorted({i for m in old.values() for i in m["ids"]}))
            for name, m in old.items():
                self._fs.delete(self._at(f"{self.path}/{name}"), False)
                self._fs.delete(self._at(f"{self.path}/{m['data']}"), True)


def count_tokens(df: DataFrame, texts: dict[str, str], tokenizer: str) -> DataFrame:
    """Puts a column of token counts in place of each text column of ``texts`` (text -> count); null texts have a null count,
    empty ones 0, repeated rows are counted each; columns named like a count are replaced, others pass through."""

    def run(*columns):
        enc = encoder(tokenizer)
        return [[None if t is None else len(b) // 4 for t, b in zip(column, enc.encode(column), strict=True)] for column in columns[:-1]]

    return expand_texts(df, list(texts), [c for c in df.columns if c not in texts and c not in texts.values()], dict.fromkeys(texts.values(), "bigint"), run)


def count_words(text: str) -> Column:
    """Runs of characters other than blanks."""
    return F.size(F.regexp_extract_all(F.col(text), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))).cast("bigint")


#: A licence line, as a corpus may have to drop.
LICENCE = r"(?i)\n[^\n]*\blicen[cs]e[^\n]*"


def op2_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Totals of ``documents`` after three batches: all are inserted; texts with licence lines are revised to be without
    them; toxic documents (as ``labels`` marks them) are deleted. The second batch is sent twice. Two tokenizer versions
    count side by side: the public word BPE, and blank-separated words."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    clean = F.regexp_replace("text", LICENCE, "")
    docs = docs.withColumn("clean", F.when(clean != F.col("text"), clean))
    docs = docs.withColumns({"words": count_words("text"), "clean_words": count_words("clean")})
    counted = count_tokens(docs, {"text": "pieces", "clean": "clean_pieces"}, vocabulary())
    counted = counted.join(toxic, "doc_id", "left")
    versions = F.array(
        F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens"), F.col("clean_words").alias("new_tokens")),
        F.struct(F.lit("word_bpe_49k-1").alias("tokenizer"), F.col("pieces").alias("tokens"), F.col("clean_pieces").alias("new_tokens")),
    )
    rows = materialize(counted.select("source", "lang", "toxic", F.inline(versions)), "counts")
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/strandlake-rollup-{uuid.uuid4().hex}")
    changed = rows.where("new_tokens is not null")
    rollup.commit("insert-1", inserted(rows))
    rollup.commit("revise-1", revised(changed))
    rollup.commit("revise-1", revised(changed))
    rollup.commit("delete-1", deleted(rows.where("toxic").withColumn("tokens", F.coalesce("new_tokens", "tokens"))))
    return rollup.totals()
