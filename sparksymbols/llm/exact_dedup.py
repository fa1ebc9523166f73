"""Exact duplicates by a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparksymbols.llm.common import join_back, stored, text_or_empty

DIGEST = "text_sha256"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_or_empty(F.col(text_col)).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias(DIGEST))


def heavy_digests(rows: DataFrame, support: float) -> DataFrame:
    """Exact size and largest id of the digests that may hold more than ``support`` of all rows.

    Misra-Gries counters (Spark's ``freqItems``) hold at most 1 / ``support`` digests, all frequent ones among them;
    a second look at the rows gives their true counts. So there are at most 1 / ``support`` rows.
    """
    found = rows.stat.freqItems([DIGEST], support).select(F.explode(f"{DIGEST}_freqItems").alias(DIGEST))
    return rows.join(F.broadcast(found), DIGEST, "left_semi").groupBy(DIGEST).agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.002) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if their UTF-8 bytes are; null counts as empty. Of equal texts the row with the largest id stays.
    The few frequent digests are settled map-side by a broadcast of at most 1 / ``support`` rows; all others are
    grouped by an ordinary shuffle of ids and digests. Texts are read once and never shuffled.

    Rows without an id lose against any row with one; among themselves they all stay. Rows that repeat both id and
    text cannot be told apart and are kept or dropped together. An empty table gives an empty result. Other columns
    are not looked at.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    heavy = stored(heavy_digests(rows, support), "heavy-digests")
    settled = rows.join(F.broadcast(heavy), DIGEST)
    rest = rows.join(F.broadcast(heavy), DIGEST, "left_anti")
    groups = rest.groupBy(DIGEST).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    both = settled.unionByName(join_back(rest, groups, [DIGEST]))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), DIGEST)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_id"), F.col(DIGEST).alias("_digest"))
    digest = F.sha2(text_or_empty(F.col(text_col)).cast("binary"), 256)
    same = docs[id_col].eqNullSafe(kept["_id"]) & (digest == kept["_digest"])
    return docs.join(kept, same, "left_semi")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""
