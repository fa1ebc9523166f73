"""A commit taken into the index: what changed, which of it is new, parsed, stored, and summed up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparksymbols.operators import joins as J
from sparksymbols.operators import metrics as A
from sparksymbols.operators import mutations as M


class Commit(NamedTuple):
    """The index after a commit, the commit's changes (``change_type`` A, D, M) and why each changed file was taken or not."""

    index: DataFrame
    diff: DataFrame
    decisions: DataFrame


def process_commit(
    index: DataFrame,
    before: DataFrame,
    after: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    order: Sequence[str],
    spread_by: Sequence[str],
    hash_column: str = "fileHash",
    ts: str = "ts",
) -> Commit:
    """Apply the difference of two snapshots (one row per key each) to ``index``.

    Added and modified files pass the change gate against their stored row, are parsed by ``parse`` and put in by key;
    deleted ones go. ``parse`` keeps the columns of a file row that the index has and adds those it lacks. Files that are
    the same in both snapshots are not read.
    """
    diff = J.snapshot_diff(before, after, keys, hash_column)
    touched = after.join(diff.where("change_type <> 'D'").select(*keys), list(keys), "left_semi")
    decisions = J.gate_reason(J.with_stored(touched, index, keys, spread_by, hash_column, ts), hash_column, ts)
    taken = decisions.where(F.col("reason").isin("new", "changed")).select(*after.columns)
    stored = M.upsert(index, parse(taken).select(*index.columns), keys, order)
    gone = diff.where("change_type = 'D'")
    return Commit(M.delete_keys(stored, gone, keys), diff, decisions)


def commit_report(commit: Commit, repo: str, hash_column: str, ts: str, tie: str) -> DataFrame:
    """Per repository: numbers of added, deleted and modified files, and the roll-up of what the index holds now."""
    summary = A.commit_summary(commit.diff, [repo])
    return A.repo_rollup(commit.index, repo, hash_column, ts, tie).join(summary, repo, "full_outer").na.fill(0)
