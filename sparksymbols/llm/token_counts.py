"""Token counts by source, language and tokenizer, kept up to date by signed changes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksymbols.llm.common import join_back, stored, text_or_empty
from sparksymbols.session import scratch_path, ship_with_tasks

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_bytes")
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published splitting pattern of the 50,257-token byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, vocabulary: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_docs, n_tokens, n_bytes, digest`` for every document, from its whole text.

    ``digest`` is the SHA-256 of the text, made on the same pass.

    ``vocabulary`` names a file of byte-level BPE ranks on the driver (about 1 MB), which is sent to the tasks once.
    Null texts count as empty and have no tokens. Repeated rows count each.
    """
    ship_with_tasks(__name__)
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines()) if a}
        coder = tiktoken.Encoding(tokenizer, pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            n = [len(coder.encode_ordinary(t)) for t in batch["text"]]
            yield batch.drop(columns="text").assign(n_tokens=n)

    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.col(lang_col).alias("lang"),
        F.octet_length(text_or_empty(F.col(text_col))).cast("bigint").alias("n_bytes"),
        F.sha2(text_or_empty(F.col(text_col)).cast("binary"), 256).alias("digest"),
        text_or_empty(F.col(text_col)).alias("text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInPandas(count, "doc_id string, source string, lang string, n_bytes bigint, digest string, n_tokens bigint")
    return found.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "source", "lang", F.lit(tokenizer).alias("tokenizer"),
        F.lit(1).cast("bigint").alias("n_docs"), "n_tokens", "n_bytes", "digest",
    )


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as a change: 1 for inserts, -1 for deletes. A revision is the old counts with -1 and the new with 1."""
    return counts.select(*KEYS, *((F.col(c) * sign).cast("bigint").alias(c) for c in SUMS))


class TokenRollup:
    """Additive totals below ``path``: one folder of sums per committed batch, and their sum as the totals.

    A batch is reduced to its sums by key before it is written, so its cost follows the batch. A batch counts once Spark
    has committed its folder; committing the same batch again changes nothing, so a job may be repeated after any
    failure. Nulls in a key are a value of their own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def committed(self) -> list[str]:
        fs, root = self._files(self.path)
        if not fs.exists(root):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(root)]
        return sorted(n for n in names if n.startswith("batch=") and self._is_done(n))

    def _is_done(self, name: str) -> bool:
        fs, mark = self._files(f"{self.path}/{name}/_SUCCESS")
        return fs.exists(mark)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if it is there already."""
        if self._is_done(f"batch={batch}"):
            return False
        sums = changes.groupBy(*KEYS).agg(*(F.sum(c).cast("bigint").alias(c) for c in SUMS))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """Sums by key over all batches; keys whose documents are all gone have no row."""
        batches = self.committed()
        schema = ", ".join([*(f"{k} string" for k in KEYS), *(f"{c} bigint" for c in SUMS)])
        if not batches:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{b}" for b in batches))
        sums = rows.groupBy(*KEYS).agg(*(F.sum(c).cast("bigint").alias(c) for c in SUMS))
        return sums.where(" OR ".join(f"{c} <> 0" for c in SUMS))


def corpus_history(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", multilingual: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Totals after a history of the corpus: all documents inserted, exact copies deleted, other texts revised.

    Batch ``load`` inserts every document, counted with the first tokenizer. ``copies`` deletes those whose text
    a document with a larger id has too; rows without an id lose against any with one and stay otherwise, rows alike in
    id and text stay or go together. ``languages`` recounts the remaining ones that are not English with the
    tokenizer for many languages, as signed revisions. Each batch is committed twice; the second time changes nothing.
    """
    spark = docs.sparkSession
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    keyed = docs.select("doc_id", "text", "source", "lang")
    counts = stored(token_counts(keyed, vocabulary, "byte_bpe_50k"), "token-counts")
    keep = stored(counts.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "kept-texts")

    def staying(rows: DataFrame) -> DataFrame:
        """Rows with ``stays``: of equal texts the largest id's; all of them, if none has an id."""
        return join_back(rows, keep, ["digest"]).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")))

    judged = stored(staying(counts), "judged-counts")
    abroad = ~F.col("lang").eqNullSafe("en")
    recounted = staying(token_counts(keyed.where(abroad), multilingual, "byte_bpe_multi_50k")).where("stays")
    gone, before = judged.where("NOT stays"), judged.where(F.col("stays") & abroad)
    for _ in range(2):
        rollup.commit("load", signed(counts, 1))
        rollup.commit("copies", signed(gone, -1))
        rollup.commit("languages", signed(before, -1).unionByName(signed(recounted, 1)))
    return rollup.totals()
