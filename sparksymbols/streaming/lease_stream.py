"""Lease requests as a stream: each micro-batch continues from the stored lease of its keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparksymbols.operators.gates import lease_grants
from sparksymbols.session import checkpointed
from sparksymbols.sources.tables import KeyedTable
from sparksymbols.streaming.index_stream import stream_of

KEY = "lock_key"
_FIELDS = (KEY, "arrival", "requested_at", "kind", "ttl_seconds")


def lease_batch(requests: DataFrame, stored: DataFrame | None, partitions: int | None = None) -> DataFrame:
    """Decisions for a batch of requests ``(lock_key, arrival, requested_at, kind, ttl_seconds)``, given the stored
    leases ``(lock_key, expires_at)``. A stored lease takes part as a first request that ends when the lease does."""
    rows = requests.select(*_FIELDS, F.lit(1).alias("generation"))
    if stored is not None:
        asked = requests.select(KEY).distinct()
        held = stored.where(F.col("expires_at").isNotNull()).join(asked, KEY, "left_semi")
        arrival = F.lit(None).cast(requests.schema["arrival"].dataType)
        first = held.select(
            KEY,
            arrival.alias("arrival"),
            F.col("expires_at").alias("requested_at"),
            F.lit("acquire").alias("kind"),
            F.lit(0).alias("ttl_seconds"),
            F.lit(0).alias("generation"),
        )
        rows = rows.unionByName(first)
    decided = lease_grants(rows, order=("generation", "requested_at", "arrival"), partitions=partitions)
    return decided.where(F.col("generation") == 1).drop("generation")


def leases_after(decided: DataFrame, order: Sequence[str] = ("requested_at", "arrival")) -> DataFrame:
    """The lease each key is left with: ``expires_at``, null once released."""
    ends = F.col("requested_at") + F.make_dt_interval(secs=F.col("ttl_seconds"))
    moved = decided.where(F.col("decision").isin("granted", "extended", "released"))
    moved = moved.withColumn("expires_at", F.when(F.col("decision") != "released", ends))
    last = moved.groupBy(KEY).agg(F.max_by(F.struct("expires_at", *order), F.struct(*order)).alias("last"))
    return last.select(KEY, "last.*")


def lease_stream(
    requests: DataFrame, leases: KeyedTable, decisions: KeyedTable, checkpoint: str, partitions: int | None = None
) -> StreamingQuery:
    """Decide a stream of requests until all available input is taken; both tables get one batch per micro-batch.

    The leases are written last: a batch that stopped halfway is decided again from the same stored leases.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        mark = f"{stream_of(batch, checkpoint)}.{batch_id}"
        if mark in leases.marks():
            return
        decided = checkpointed(lease_batch(batch, leases.current("expires_at", keys=batch), partitions))
        if mark not in decisions.marks():
            decisions.append(decided, mark)
        leases.append(leases_after(decided), mark)

    return (
        requests.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
