"""Rows from nested index entries and back.

All explodes are outer explodes with a filter on their result. An inner explode makes Spark add a filter on the
array itself and push it below the steps that build the array, which would then run again for the filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(df: DataFrame, array: Column | str, keys: Sequence[str], outer: bool = False) -> DataFrame:
    """The keys, the ``place`` and the fields of each struct of an array; ``outer`` keeps rows with empty arrays."""
    rows = df.select(*keys, F.posexplode_outer(array).alias("place", "entry"))
    if not outer:
        rows = rows.where(F.col("place").isNotNull())
    return rows.select(*keys, "place", "entry.*")


def flatten(index: DataFrame, column: str, keys: Sequence[str], fields: Sequence[str], outer: bool = True) -> DataFrame:
    """One row per entry of an array column with its position; with ``outer`` a row also for empty arrays."""
    return entries(index, column, keys, outer).select(*keys, F.col("place").alias("pos"), *fields)


def flatten_members(index: DataFrame, keys: Sequence[str], arrays: dict[str, str], fields: Sequence[str]) -> DataFrame:
    """Member rows of several arrays, each tagged with its kind and its position in its own array."""

    def tagged(kind: str, column: str) -> Column:
        return F.transform(
            F.col(column),
            lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), *(m[f].alias(f) for f in fields)),
        )

    members = F.concat(*(tagged(kind, column) for kind, column in arrays.items()))
    return entries(index, members, keys).select(*keys, "kind", "position", *fields)


def assemble(files: DataFrame, keys: Sequence[str], symbols: str = "symbols") -> DataFrame:
    """Index rows from files with a ``symbols`` array: exports and imports in rule and text order, in the same row."""
    ordered = F.array_sort(symbols)
    return files.select(
        *keys,
        F.filter(ordered, lambda s: s["type"] != "import").alias("exports"),
        F.filter(ordered, lambda s: s["type"] == "import").alias("imports"),
    )
