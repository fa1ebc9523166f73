"""Inputs: landed file tables, file trees on a shared mount and change feeds."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparksymbols import schemas
from sparksymbols.functions import scalars as S
from sparksymbols.operators.filters import indexable_files
from sparksymbols.session import checkpointed, ship_with_tasks

ship_with_tasks(__name__)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """A landed table (repoId, filePath, content)."""
    return spark.read.schema(schemas.FILE_ROW).parquet(path)


def decoded(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Turn a binary column into ``content``, dropping bytes that are not UTF-8."""
    return files.withColumn("content", S.tolerant_decode(F.col(raw))).drop(raw)


#: Levels of folders that are dealt out one by one before each task walks what is below its own.
LEVELS = 3
LISTED_ROWS, READ_BYTES = 10_000, 16 << 20

LISTED = "repoId string, root string, filePath string, is_folder boolean"


def _paths(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["repoId", "root", "filePath", "is_folder"])


def _list_folders(below: bool):
    """Entries of folders, or all files below them; a folder that cannot be read has none. Links to folders are files."""

    def entries(root: str, folder: str) -> Iterator[tuple[str, bool]]:
        try:
            with os.scandir(os.path.join(root, folder)) as found:
                for entry in found:
                    yield os.path.join(folder, entry.name), entry.is_dir(follow_symlinks=False)
        except OSError:
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                todo = [row["filePath"]]
                while todo:
                    for path, is_folder in entries(row["root"], todo.pop()):
                        if is_folder and below:
                            todo.append(path)
                            continue
                        held.append((row["repoId"], row["root"], path, is_folder))
                        if len(held) >= LISTED_ROWS:
                            yield _paths(held)
                            held = []
        yield _paths(held)

    return run


def list_trees(roots: DataFrame, levels: int = LEVELS, tasks: int | None = None) -> DataFrame:
    """``repoId, root, filePath`` of all files below each root ``(repoId, root)``.

    Folders of the first levels are listed one by one and dealt out again after each, so that one root is the work of
    many tasks; then each task walks what is below its folders. There is one job per level.
    """
    tasks = tasks or 4 * roots.sparkSession.sparkContext.defaultParallelism
    folders = roots.select("repoId", "root", F.lit("").alias("filePath"))
    files = []
    for level in range(levels + 1):
        dealt = folders.repartition(tasks, "root", "filePath")
        listed = dealt.mapInArrow(_list_folders(below=level == levels), LISTED)
        listed = checkpointed(listed) if level < levels else listed
        files.append(listed.where("NOT is_folder").drop("is_folder"))
        folders = listed.where("is_folder").drop("is_folder")
    return reduce(DataFrame.union, files)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of files, some megabytes a batch; null for a file that cannot be read."""
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["repoId", "filePath", "raw"])

    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            try:
                with open(os.path.join(row["root"], row["filePath"]), "rb") as f:
                    raw = f.read()
            except OSError:
                raw = None
            rows.append((row["repoId"], row["filePath"], raw))
            size += len(raw or b"")
            if size >= READ_BYTES:
                yield made()
                rows, size = [], 0
    yield made()


def scan_trees(roots: DataFrame, **filters) -> DataFrame:
    """Indexable files below each root ``(repoId, root)`` on a mount that all executors share.

    Paths are dealt out before any file is read, so a large tree is listed and read by all tasks. A file that cannot be
    read has null ``content``. (``binaryFile`` would skip names such as ``__init__.py``.)
    """
    wanted = indexable_files(list_trees(roots), **filters).repartition("repoId", "filePath")
    read = wanted.mapInArrow(_read_files, "repoId string, filePath string, raw binary")
    return decoded(read)


def tree_scan(files: DataFrame, **filters) -> DataFrame:
    """The list of indexable files of a landed table in path order. Content takes no part in the sort."""
    return indexable_files(files, **filters).drop("content").orderBy("repoId", "filePath")


def read_changes(spark: SparkSession, path: str, file_format: str = "parquet", schema: T.StructType = schemas.CHANGE_EVENT) -> DataFrame:
    return spark.read.schema(schema).format(file_format).load(path)


def stream_changes(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    schema: T.StructType = schemas.CHANGE_EVENT,
    name_filter: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(file_format)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
