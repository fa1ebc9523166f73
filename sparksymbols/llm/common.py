"""Steps that several operators share: scratch tables, joins on keys of any frequency, checked broadcasts."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparksymbols.llm.files import filesystem
from sparksymbols.session import scratch_path

#: Words are runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of up to so many rows may be broadcast; their rows are short.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later passes see the same rows and repeat no work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_and_observed(df: DataFrame, name: str, *values: Column) -> tuple[DataFrame, tuple]:
    """``df`` as by ``stored``, with aggregates over its rows that the write itself has counted."""
    seen = Observation()
    names = [f"v{i}" for i in range(len(values))]
    kept = stored(df.observe(seen, *(v.alias(n) for v, n in zip(values, names, strict=True))), name)
    return kept, tuple(seen.get[n] for n in names)


def discard(table: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more; what cannot be deleted stays."""
    for folder in {path.rpartition("/")[0] for path in table.inputFiles()}:
        with contextlib.suppress(OSError):
            system, inner = filesystem(folder)
            system.delete_dir(inner)


def join_back(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to one row per key, where a key may hold a third of all rows.

    The hash as a further key makes Spark deal both sides anew, and only such a join can be split at run time when
    one key is large; groups that come straight from an aggregate would otherwise keep its dealing.
    """
    probe = F.xxhash64(*keys)
    left, right = rows.withColumn("_probe", probe), groups.withColumn("_probe", probe)
    return left.join(right, [*keys, "_probe"], how).drop("_probe")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it is seen to have at most so many rows; else as it is, for an ordinary join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once; used bare inside a lambda it is computed for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank texts."""
    return F.filter(F.split(text_or_empty(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; rows with 0 are held out from learning. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
