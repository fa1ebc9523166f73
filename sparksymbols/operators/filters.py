"""Look-ups, listings, searches, validation and per-row measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparksymbols.functions import scalars as S
from sparksymbols.operators.skew import first_rows, split_join


def indexable_files(
    files: DataFrame,
    extensions: Sequence[str] = S.EXTENSIONS,
    folders: tuple[str, ...] = S.ALLOWED_FOLDERS,
    path: str = "filePath",
) -> DataFrame:
    """Files with an indexed extension, at the top or below an allowed folder."""
    return files.where(S.extension(F.col(path)).isin(*extensions) & S.in_allowed_folder(F.col(path), folders))


def get_repository(repositories: DataFrame, url: str) -> DataFrame:
    """The repository with this url; empty if there is none."""
    return repositories.where(F.col("url") == url)


def get_repositories(repositories: DataFrame, urls: DataFrame) -> DataFrame:
    """Look-up of many urls: each asked url once, with ``found``."""
    asked = urls.select("url").distinct()
    rows = repositories.withColumn("found", F.lit(True))
    return asked.join(rows, "url", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def list_files(index: DataFrame, repo: str) -> DataFrame:
    return index.where(F.col("repoId") == repo)


def list_files_of(index: DataFrame, repositories: DataFrame) -> DataFrame:
    """Files of all given repositories; one of them may own most of the index."""
    return split_join(index, repositories.select("repoId").distinct(), ["repoId"], "left_semi", ["filePath"])


def get_file(index: DataFrame, repo: str, path: str) -> DataFrame:
    return list_files(index, repo).where(F.col("filePath") == path).limit(1)


def get_files(index: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Look-up of many keys: each asked key once, with ``found``. ``index`` has one row per key."""
    asked = wanted.select(*keys).distinct()
    rows = index.withColumn("found", F.lit(True))
    return asked.join(rows, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def file_summary(index: DataFrame) -> DataFrame:
    """Header columns with the number of exports and imports."""
    headers = [c for c in index.columns if c not in ("exports", "imports", "symbols", "parseErrors")]
    return index.select(
        *headers, F.size("exports").cast("bigint").alias("export_count"), F.size("imports").cast("bigint").alias("import_count")
    )


def search_exports(index: DataFrame, query: str, repo: str | None = None, limit: int | None = None) -> DataFrame:
    """Files with an export whose name contains ``query`` (any case), with only those exports.

    All files are looked at; with ``limit`` only the first ones of each repository, in path order.
    """
    files = index if repo is None else list_files(index, repo)
    if limit is not None:
        files = first_rows(files, ["repoId"], ["filePath"], limit)
    matching = F.filter("exports", lambda e: S.icontains(e["name"], F.lit(query)))
    return files.withColumn("exports", matching).where(F.size("exports") > 0)


def parse_documents(rows: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Add ``document`` and ``malformed``; a text that is not a document of the schema gives null and true."""
    with_reject = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = rows.withColumn("_read", F.from_json(column, with_reject, options))
    bad = F.col("_read").isNull() | F.col("_read._corrupt").isNotNull()
    fields = F.struct(*(F.col(f"_read.{f.name}").alias(f.name) for f in schema.fields))
    return read.select(*rows.columns, F.when(~bad, fields).alias("document"), bad.alias("malformed"))


def skip_malformed(rows: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """The readable documents only."""
    return parse_documents(rows, column, schema).where(~F.col("malformed")).drop("malformed")


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks; a rule is a condition that must hold, and null counts as broken."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.filter(F.array(*checks), lambda v: v.isNotNull())


def status_rule(column: str = "status") -> Column:
    return F.col(column).isin(*S.REPOSITORY_STATUSES)


def visibility_rule(column: str = "visibility") -> Column:
    return F.col(column).isin(*S.VISIBILITIES)


def sha_rule(column: str) -> Column:
    return F.length(column) >= S.MIN_SHA_LENGTH


def count_rule(column: str) -> Column:
    return F.col(column) >= 0


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return rows.withColumn("violations", violations(rules))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows)."""
    clean = F.size("violations") == 0
    return checked.where(clean), checked.where(~clean)


def repo_metrics(repositories: DataFrame) -> DataFrame:
    """Add progress in percent, completeness and whether anything failed."""
    total, processed = F.col("totalFiles"), F.col("processedFiles")
    return (
        repositories.withColumn("progress", F.when(total == 0, F.lit(0.0)).otherwise(processed / total * 100))
        .withColumn("is_complete", (F.col("status") == "completed") & (processed >= total))
        .withColumn("has_failures", (F.col("status") == "failed") | ((total > 0) & (processed < total)))
    )


def progress_percent(processed: Column, total: Column) -> Column:
    """Whole percent, rounded down; 0 without files."""
    return F.when(total > 0, F.floor(processed / total * 100)).otherwise(0).cast("int")


def index_report(tally: DataFrame) -> DataFrame:
    """What a finished load reports per repository (see ``outcome_tally``): counts of files, and nothing else."""
    return tally.select("repoId", "total_files", "processed", "failed", "skipped")
