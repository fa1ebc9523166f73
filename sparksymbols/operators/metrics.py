"""Counts and roll-ups. All are partial aggregates, so a large repository is reduced in every task first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksymbols.operators.filters import progress_percent
from sparksymbols.operators.segments import frozen_segments, running_sums

BATCH_SIZE = 50
DIRECT_LIMIT = 100


def language_distribution(files: DataFrame, language: str = "language") -> DataFrame:
    return files.groupBy(language).agg(F.count("*").alias("files")).orderBy(language)


def symbol_totals(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.size("exports")), F.lit(0)).alias("exports"),
        F.coalesce(F.sum(F.size("imports")), F.lit(0)).alias("imports"),
    )


def store_stats(repositories: DataFrame, files: DataFrame) -> DataFrame:
    """Row counts of both tables in one row (two one-row aggregates, summed after a union)."""
    zero = F.lit(0).cast("bigint")
    parts = repositories.agg(F.count("*").alias("total_repositories"), zero.alias("total_file_indexes")).union(
        files.agg(zero.alias("total_repositories"), F.count("*").alias("total_file_indexes"))
    )
    return parts.agg(*(F.sum(c).alias(c) for c in ("total_repositories", "total_file_indexes")))


def outcome(allowed: Column, deleted: Column, missing: Column, failed: Column) -> Column:
    """Outcome of one file: skipped, failed or processed."""
    return F.when(~allowed | deleted, "skipped").when(missing | failed, "failed").otherwise("processed")


def outcome_tally(files: DataFrame, keys: Sequence[str], column: str = "outcome") -> DataFrame:
    return files.groupBy(*keys).agg(
        F.count("*").alias("total_files"),
        *(F.count_if(F.col(column) == name).alias(name) for name in ("processed", "failed", "skipped")),
    )


def commit_summary(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of added, deleted, modified and all changed files."""
    return diff.groupBy(*keys).agg(
        F.count_if(F.col("change_type") == "A").alias("added"),
        F.count_if(F.col("change_type") == "D").alias("deleted"),
        F.count_if(F.col("change_type") == "M").alias("modified"),
        F.count("*").alias("changed"),
    )


def repo_rollup(index: DataFrame, repo: str, commit: str, ts: str, tie: str) -> DataFrame:
    """Per repository: number of files, last commit and its time, recomputed from the rows."""
    return index.groupBy(repo).agg(
        F.count("*").alias("processedFiles"),
        F.max_by(commit, F.struct(ts, tie)).alias("lastProcessedCommit"),
        F.max(ts).alias("lastProcessedCommitTimestamp"),
    )


def batch_progress(
    files: DataFrame, repo: str, order: Sequence[str], column: str = "outcome", size: int = BATCH_SIZE
) -> DataFrame:
    """Progress after each batch of ``size`` files per repository, in file order.

    Positions and running counts come from segments, since one repository may hold most files; they only
    grow, so the value at the end of a batch is its maximum.
    """
    frozen = frozen_segments(files.select(repo, *order, column), [repo], order)
    counted = running_sums(
        frozen,
        [repo],
        order,
        {
            "position": F.lit(1),
            "processed": (F.col(column) == "processed").cast("int"),
            "failed": (F.col(column) == "failed").cast("int"),
        },
    )
    totals = frozen.groupBy(repo).agg(F.count("*").alias("total"))
    batches = counted.groupBy(repo, F.floor((F.col("position") - 1) / size).alias("batch")).agg(
        F.count("*").alias("batch_files"), F.max("processed").alias("processed"), F.max("failed").alias("failed")
    )
    return batches.join(totals, repo).select(
        repo,
        "batch",
        "batch_files",
        "processed",
        "failed",
        progress_percent(F.col("processed"), F.col("total")).alias("percent"),
    )


def size_route(files: DataFrame, repo: str, limit: int = DIRECT_LIMIT) -> DataFrame:
    """Per repository: number of files and whether it is small enough for direct processing."""
    counted = files.groupBy(repo).agg(F.count("*").alias("files"))
    return counted.withColumn("route", F.when(F.col("files") <= limit, "direct").otherwise("batch"))
