"""Streams that keep tables current: the change stream, the lease stream and live progress.

The gates run per micro-batch on the batch's rows and the stored state of the batch's keys, with the same
segment split as in batch jobs, so a key with most of the rows does not end up in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparksymbols.operators.gates import ordered_gate
from sparksymbols.operators.mutations import latest_per_key
from sparksymbols.sources.tables import DELETED_HASH, KeyedTable


def gate_batch(
    changes: DataFrame, stored: DataFrame | None, keys: Sequence[str], order: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Decisions for a batch of changes ``(keys, order, ts, fileHash)``, given the stored ``(keys, ts, fileHash)``.

    The stored row of a key takes part as the first row of its history.
    """
    narrow = changes.select(*keys, *order, "ts", "fileHash", F.lit(1).alias("generation"))
    if stored is not None:
        asked = changes.select(*keys).distinct()
        first = stored.select(*keys, *(F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in order), "ts", "fileHash")
        narrow = narrow.unionByName(first.join(asked, list(keys), "left_semi").withColumn("generation", F.lit(0)))
    decided = ordered_gate(narrow, keys, ["generation", *order], partitions=partitions)
    return decided.where(F.col("generation") == 1).drop("generation")


def stream_of(batch: DataFrame, checkpoint: str) -> str:
    """Name of the stream a micro-batch belongs to: the id that Spark keeps in its checkpoint folder."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return query or hashlib.sha1(checkpoint.encode()).hexdigest()


def index_batch(
    changes: DataFrame,
    batch_id: int,
    table: KeyedTable,
    order: Sequence[str],
    parse: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    partitions: int | None = None,
    stream: str = "changes",
) -> None:
    """Gate one batch and store the last accepted change of each key; a batch of a stream that is stored already is
    left alone, whatever else the table has got meanwhile.

    Changes with a ``kind`` of ``D`` delete their key. Only keys, times and hashes go through the gate, against
    the stored rows of the batch's keys alone. Content is joined back for the rows that are stored.
    """
    mark = f"{stream}.{batch_id}"
    if mark in table.marks():
        return
    keys = list(table.keys)
    gone = F.col("kind").eqNullSafe("D") if "kind" in changes.columns else F.lit(False)
    changes = changes.withColumn("deleted", gone).withColumn("fileHash", F.when(gone, DELETED_HASH).otherwise(F.col("fileHash")))
    current = table.current("ts", "fileHash", keys=changes, with_deleted=True)
    decided = gate_batch(changes, current, keys, order, partitions)
    accepted = decided.where(F.col("decision") == "accepted").select(*keys, *order)
    last = latest_per_key(accepted.withColumn("rank", F.struct(*order)), keys, ["rank"]).drop("rank")
    taken = changes.join(last, [*keys, *order], "left_semi")
    live = parse(taken.where(~F.col("deleted")).drop("deleted", "kind")).withColumn("deleted", F.lit(False))
    marks = taken.where(F.col("deleted")).select(*dict.fromkeys((*keys, *order, "ts", "fileHash", "deleted")))
    table.append(live.unionByName(marks, allowMissingColumns=True), mark)


def index_stream(
    changes: DataFrame,
    table: KeyedTable,
    order: Sequence[str],
    checkpoint: str,
    parse: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    partitions: int | None = None,
    compact_every: int = 100,
) -> StreamingQuery:
    """Run a change stream into ``table`` until all available input is taken."""

    def store(batch: DataFrame, batch_id: int) -> None:
        index_batch(batch, batch_id, table, order, parse, partitions, stream_of(batch, checkpoint))
        if (batch_id + 1) % compact_every == 0:
            table.compact()

    return (
        changes.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_progress(changes: DataFrame, keys: Sequence[str], outcome: Column) -> DataFrame:
    """Running outcome counts per key while batches land."""
    return changes.withColumn("outcome", outcome).groupBy(*keys).agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("outcome") == name).alias(name) for name in ("processed", "failed", "skipped")),
    )


def write_progress(progress: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the counts of the keys that a batch has changed to ``path/batch=n``; a repeated batch writes the same rows."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        progress.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_progress(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The counts of each key after the last batch that has changed it."""
    return latest_per_key(spark.read.parquet(path), keys, ["batch"]).drop("batch")
