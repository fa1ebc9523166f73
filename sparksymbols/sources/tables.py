"""Stored tables: batches of rows are added, and the current state is the last row of each key.

Each batch is a folder that counts once Spark has committed it, so writing it again after a failure replaces it. A batch
may carry a mark that says where it came from, such as a stream and the number the stream gave it; the table numbers its
batches by itself. Now and then the current state is written as a base, so that a read costs the state and the batches
since, and what the base before that made superfluous is deleted. Asked for some keys only, a read costs their buckets.

A deleted key keeps a row with the time of its deletion, so that an older change cannot bring it back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksymbols.operators.mutations import latest_per_key

BUCKET = "repo_bucket"
#: Stands for the hash of a deleted key, so that the same content may come again.
DELETED_HASH = "deleted"


class KeyedTable:
    """Rows by key below ``path``; ``deleted`` rows remove their key. ``order`` ranks rows inside a batch."""

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64
    ):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, tuple(keys), tuple(order), buckets

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _committed(self, kind: str) -> list[tuple[int, str, str, bool]]:
        """Committed folders as (number, mark, path, whether they hold rows), in order."""
        fs, root = self._files()
        found = []
        for folder in [status.getPath() for status in fs.listStatus(root)] if fs.exists(root) else []:
            if not folder.getName().startswith(f"{kind}="):
                continue
            number = int(folder.getName().removeprefix(f"{kind}="))
            for inner in (status.getPath() for status in fs.listStatus(folder)):
                if not inner.getName().startswith("mark="):
                    continue
                names = {status.getPath().getName() for status in fs.listStatus(inner)}
                if "_SUCCESS" in names:
                    path = f"{self.path}/{folder.getName()}/{inner.getName()}"
                    found.append((number, inner.getName().removeprefix("mark="), path, names != {"_SUCCESS"}))
        return sorted(found)

    def batches(self) -> list[int]:
        """Numbers of the committed batches that are still there."""
        return [number for number, *_ in self._committed("batch")]

    def marks(self) -> set[str]:
        """Marks of the committed batches; the last one of each stream is always there."""
        return {mark for _, mark, *_ in self._committed("batch")}

    def bucket_of(self, repo):
        return F.pmod(F.xxhash64(repo), F.lit(self.buckets)).cast("int")

    def _store(self, rows: DataFrame, folder: str) -> None:
        # Rebalancing gives files of even size: Spark joins small buckets and cuts the bucket of a large repository.
        bucketed = rows.withColumn(BUCKET, self.bucket_of(F.col(self.keys[0]))).hint("rebalance", BUCKET)
        ordered = bucketed.sortWithinPartitions(BUCKET, *self.keys)
        ordered.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")

    def write(self, rows: DataFrame, batch: int, mark: str = "none") -> bool:
        """Write one batch; rows without a ``deleted`` column are live. An empty batch is stored as done."""
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        self._store(rows, f"batch={batch}/mark={mark}")
        return True

    def append(self, rows: DataFrame, mark: str = "none") -> int:
        """Write the next batch and give its number."""
        last = [n for kind in ("batch", "base") for n, *_ in self._committed(kind)]
        batch = max(last, default=-1) + 1
        self.write(rows, batch, mark)
        return batch

    def _parts(self) -> tuple[DataFrame | None, DataFrame | None]:
        """The rows of the last base and those of all batches after it; None where there are none."""
        bases = self._committed("base")
        base = bases[-1] if bases else None
        paths = [path for n, _, path, rows in self._committed("batch") if rows and (base is None or n > base[0])]
        read = self.spark.read.option("basePath", self.path).option("mergeSchema", "true")
        delta = read.parquet(*paths).drop("mark") if paths else None
        state = None
        if base is not None and base[3]:
            state = self.spark.read.parquet(base[2]).withColumn("batch", F.lit(base[0]))
        return state, delta

    def rows(self) -> DataFrame | None:
        """The last base and all batches after it, with ``batch`` and the bucket; None for a table without any."""
        state, delta = self._parts()
        if state is None or delta is None:
            return delta if state is None else state
        return state.unionByName(delta, allowMissingColumns=True)

    def current(self, *columns: str, keys: DataFrame | None = None, with_deleted: bool = False) -> DataFrame | None:
        """The last row of each key; only the given columns (and the key) are read.

        With ``keys`` only their buckets are read, and only their rows go further. Rows of the base, one per key
        already, are not grouped again; those with a later row are left out.
        """
        state, delta = self._parts()
        if state is None and delta is None:
            return None
        wanted = list(dict.fromkeys((*self.keys, *columns, *self.order, "deleted", "batch", BUCKET))) if columns else ["*"]
        asked = numbers = None
        if keys is not None:
            asked = keys.select(*self.keys).distinct()
            numbers = [r[0] for r in asked.select(self.bucket_of(F.col(self.keys[0]))).distinct().collect()]

        def part(rows: DataFrame | None) -> DataFrame | None:
            if rows is None or asked is None:
                return rows if rows is None else rows.select(*wanted)
            mine = rows.where(F.col(BUCKET).isin(numbers)).select(*wanted)
            return mine.join(asked, list(self.keys), "left_semi")

        state, delta = part(state), part(delta)
        if delta is not None:
            last = latest_per_key(delta, self.keys, ["batch", *self.order])
            changed = delta.select(*self.keys).distinct()
            state = last if state is None else state.join(changed, list(self.keys), "left_anti").unionByName(last, allowMissingColumns=True)
        if with_deleted:
            return state.drop("batch", BUCKET)
        return state.where(~F.col("deleted")).drop("deleted", "batch", BUCKET)

    def lookup(self, repo: str) -> DataFrame | None:
        """Current rows of one repository; only its bucket is read."""
        rows = self.rows()
        if rows is None:
            return None
        mine = rows.where((F.col(BUCKET) == self.bucket_of(F.lit(repo))) & (F.col(self.keys[0]) == repo))
        last = latest_per_key(mine, self.keys, ["batch", *self.order])
        return last.where(~F.col("deleted")).drop("deleted", "batch", BUCKET)

    def delete(self, keys: DataFrame, at: Column | None = None) -> int | None:
        """Add a batch that removes the given keys as far as they are there.

        The deletion has the time ``at``, by default that of the row it removes; changes before it stay without effect.
        """
        state = self.current(keys=keys)
        if state is None:
            return None
        kept = {*self.keys, *self.order, "ts"}
        gone = state.select(*(F.col(f.name) if f.name in kept else F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema))
        if "fileHash" in state.columns:
            gone = gone.withColumn("fileHash", F.lit(DELETED_HASH))
        if at is not None and "ts" in state.columns:
            gone = gone.withColumn("ts", at.cast(state.schema["ts"].dataType))
        return self.append(gone.withColumn("deleted", F.lit(True)))

    def compact(self, forget_before: Column | None = None) -> None:
        """Write the current state as a base, so that reads start there instead of at the first batch.

        Deleted keys are kept with their time; those deleted before ``forget_before`` are forgotten. Folders that the
        base before this one already made superfluous are deleted, so a read that began with that base still ends.
        """
        state = self.current(with_deleted=True)
        if state is None:
            return
        if forget_before is not None:
            state = state.where(~F.col("deleted") | (F.col("ts") >= forget_before))
        previous = self._committed("base")
        number = self.batches()[-1]
        if not previous or previous[-1][0] < number:
            self._store(state, f"base={number}/mark=none")
            self._drop_before(previous[-1][0] if previous else None)

    def _drop_before(self, base: int | None) -> None:
        if base is None:
            return
        fs, _ = self._files()
        batches = self._committed("batch")
        last_of_stream = {mark.rpartition(".")[0]: number for number, mark, *_ in batches}
        doomed = [f"batch={n}" for n, mark, *_ in batches if n <= base and last_of_stream[mark.rpartition(".")[0]] != n]
        doomed += [f"base={n}" for n, *_ in self._committed("base") if n < base]
        for name in doomed:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
