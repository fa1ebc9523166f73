"""Ordered work on keys of any size.

One key may hold a third of all rows, so its rows must not meet in one task. Rows are range-partitioned by
(key, order) and written once to the shared folder; a key then spans as many segments as its size asks for.
Only a key that crosses a partition border spans two segments, so there are fewer spanning keys than
partitions, and what has to be carried from segment to segment is a table of at most two rows per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparksymbols.session import checkpointed

SEGMENT = "segment"
ROWS_PER_SEGMENT = 2_000_000
FEWEST_ROWS = 20_000


def segment_count(rows: int, cores: int) -> int:
    """Segments of at most ``ROWS_PER_SEGMENT`` rows; small inputs still use the cores, but not for a few rows."""
    return max(1, -(-rows // ROWS_PER_SEGMENT), min(cores, -(-rows // FEWEST_ROWS)))


def frozen_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows sorted by (keys, order) within range partitions, with the partition number in ``segment``.

    The number of segments follows the number of rows. The checkpoint makes the borders final: a recomputed range
    partitioning may place them elsewhere.
    """
    count = partitions or segment_count(df.count(), df.sparkSession.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(count, *keys, *order).sortWithinPartitions(*keys, *order)
    return checkpointed(ranged.withColumn(SEGMENT, F.spark_partition_id()))


def spanning_keys(frozen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with rows in more than one segment; fewer than there are partitions.

    Such a key is the first or the last of each of its segments, so two keys per segment are all to look at.
    """
    key = F.struct(*keys)
    ends = frozen.groupBy(SEGMENT).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    borders = ends.select(SEGMENT, F.explode(F.array("low", "high")).alias("key"))
    spans = borders.groupBy("key").agg(F.min(SEGMENT).alias("first"), F.max(SEGMENT).alias("last"))
    return spans.where(F.col("first") < F.col("last")).select("key.*")


def running_sums(
    frozen: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]
) -> DataFrame:
    """Add running sums within each key, in order: sums inside a segment plus what the segments before it hold."""
    spanning = F.broadcast(spanning_keys(frozen, keys))
    parts = (
        frozen.join(spanning, list(keys), "left_semi")
        .groupBy(*keys, SEGMENT)
        .agg(*(F.sum(column).alias(name) for name, column in sums.items()))
    )
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, SEGMENT, *(F.sum(name).over(before).alias(f"{name}_before") for name in sums))
    within = Window.partitionBy(SEGMENT, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = frozen.select("*", *(F.sum(column).over(within).alias(name) for name, column in sums.items()))
    joined = summed.join(F.broadcast(carried), [*keys, SEGMENT], "left")
    return joined.select(
        *frozen.columns,
        *((F.col(name) + F.coalesce(f"{name}_before", F.lit(0))).cast("bigint").alias(name) for name in sums),
    )


def row_numbers(frozen: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return running_sums(frozen, keys, order, {name: F.lit(1)})
