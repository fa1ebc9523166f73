"""Table changes as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. An aggregate, not a window: each task first reduces its own rows to one per key."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return last.select(*(c if c in keys else F.col(f"last.{c}").alias(c) for c in rows.columns))


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by the same kind of aggregate."""
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("first"))
    return first.select(*(c if c in keys else F.col(f"first.{c}").alias(c) for c in rows.columns))


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` put in by key; of several changes to a key the last counts."""
    both = base.withColumn("generation", F.lit(0)).unionByName(changes.withColumn("generation", F.lit(1)))
    return latest_per_key(both, keys, ["generation", *order]).drop("generation")


def patch(base: DataFrame, patches: DataFrame, keys: Sequence[str], stamp: dict[str, Column]) -> DataFrame:
    """``base`` with the non-null columns of ``patches`` (one row per key) set and the ``stamp`` columns renewed."""
    changed = [c for c in patches.columns if c not in keys]
    renamed = patches.select(*keys, F.lit(True).alias("patched"), *(F.col(c).alias(f"new_{c}") for c in changed))
    joined = base.join(renamed, list(keys), "left")

    def value(c: str) -> Column:
        if c in stamp:
            return F.when(F.col("patched"), stamp[c]).otherwise(F.col(c)).alias(c)
        return F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c)

    return joined.select(*(value(c) for c in base.columns))


def delete_keys(base: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` (one row per key) without the given keys."""
    return base.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def delete_report(base: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each requested key, whether ``base`` (one row per key) holds it."""
    present = base.select(*keys, F.lit(True).alias("present"))
    asked = doomed.select(*keys).distinct()
    return asked.join(present, list(keys), "left").select(*keys, F.coalesce("present", F.lit(False)).alias("found"))


def status_transition(repositories: DataFrame, error: Column | None = None) -> DataFrame:
    """Status of repositories in ``processing`` after their load ran: ``completed`` once every file was looked at, be it
    processed or failed; ``failed`` with a message where ``error`` says that the load itself broke."""
    running = F.col("status") == "processing"
    message = F.when(running, error) if error is not None else F.lit(None).cast("string")
    done = running & (F.col("processedFiles") + F.col("failedFiles") >= F.col("totalFiles"))
    return repositories.withColumn("errorMessage", message).withColumn(
        "status", F.when(F.col("errorMessage").isNotNull(), "failed").when(done, "completed").otherwise(F.col("status"))
    )
