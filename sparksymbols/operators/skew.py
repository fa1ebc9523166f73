"""Joins and per-key limits for keys of any frequency.

Spark splits a large key of a join at run time, if both sides are dealt out for that join. A table with one row per key
often comes straight from an aggregate, whose dealing Spark would reuse; a hash of the keys as a further join column
makes it deal both sides anew. No rows are counted beforehand, and the plan does not depend on their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROBE = "_probe"
SLICES = 64


def split_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] = (),
    hot: DataFrame | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Join ``many`` with ``one`` (at most one row per key) without putting a frequent key into one task.

    Where the caller names ``hot`` keys, those are cut into ``slices`` by a hash of ``spread_by`` whatever Spark does,
    and their rows of ``one`` are repeated per slice.
    """
    if hot is None:
        probe = F.xxhash64(*keys)
        joined = many.withColumn(PROBE, probe).join(one.withColumn(PROBE, probe), [*keys, PROBE], how)
        return joined.drop(PROBE)
    named = F.broadcast(hot.select(*keys).distinct().withColumn("slices", F.lit(slices)))
    count = F.coalesce("slices", F.lit(1))
    slice_of = F.pmod(F.xxhash64(*(spread_by or many.columns)), count).cast("bigint")
    left = many.join(named, list(keys), "left").select(*many.columns, slice_of.alias("slice"))
    all_slices = F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)
    right = one.join(named, list(keys), "left").select(*one.columns, F.explode(all_slices).alias("slice"))
    return left.join(right, [*keys, "slice"], how).drop("slice")


def _numbered(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[str], count: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= count).drop("place")


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], count: int, slices: int = SLICES) -> DataFrame:
    """The first ``count`` rows of each key.

    Spark keeps only ``count`` rows per key in each task before it shuffles. Very many tasks may still leave many for
    one key, so its slices are reduced first.
    """
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    return _numbered(_numbered(sliced, [*keys, "slice"], order, count).drop("slice"), keys, order, count)
