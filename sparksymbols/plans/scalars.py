"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksymbols import bindings as B
from sparksymbols.functions import scalars as S
from sparksymbols.functions import text as X
from sparksymbols.operators.nested import entries
from sparksymbols.plans import registry as R
from sparksymbols.plans.registry import query


@query("F1_content_hash", "SELECT doc_id, sha256(text) AS fileHash FROM documents")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return B.load(spark, folder, "documents").select("doc_id", S.content_hash(F.col("text")).alias("fileHash"))


@query(
    "F2_git_blob_id",
    "SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS blob_id FROM documents",
)
def git_blob_id(spark: SparkSession, folder: str) -> DataFrame:
    return B.load(spark, folder, "documents").select("doc_id", S.git_blob_id(F.col("text")).alias("blob_id"))


@query("F3_short_key", "SELECT page_id, substr(md5(url), 1, 8) AS short_key FROM pages")
def short_key(spark: SparkSession, folder: str) -> DataFrame:
    return B.load(spark, folder, "pages").select("page_id", S.short_key(F.col("url")).alias("short_key"))


@query("F4_doc_key", f"WITH {R.FILES} SELECT page_id, repoId || '_' || replace(filePath, '/', '_') AS doc_key FROM files")
def doc_key(spark: SparkSession, folder: str) -> DataFrame:
    files = B.pages_as_files(spark, folder)
    return files.select("page_id", S.doc_key(F.col("repoId"), F.col("filePath")).alias("doc_key"))


@query("F5_lock_key", f"WITH {R.CHANGES} SELECT event_id, repoId || ':' || filePath AS lock_key FROM changes")
def lock_key(spark: SparkSession, folder: str) -> DataFrame:
    changes = B.events_as_changes(spark, folder)
    return changes.select("event_id", S.lock_key(F.col("repoId"), F.col("filePath")).alias("lock_key"))


@query(
    "F6_parse_iso_ts",
    """SELECT event_id, CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN epoch_us(ts) - 7200000000
       ELSE epoch_us(ts) END AS micros FROM events""",
)
def parse_iso_ts(spark: SparkSession, folder: str) -> DataFrame:
    """Times written with Z, with an offset, without either, and unreadable ones."""
    events = B.load(spark, folder, "events")
    clock = F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T"))
    text = (
        F.when(F.col("event_type") == "error", "not a time")
        .when(F.col("event_type") == "view", F.concat(clock, F.lit("+02:00")))
        .when(F.col("event_type") == "click", clock)
        .otherwise(F.concat(clock, F.lit("Z")))
    )
    return events.select("event_id", F.coalesce(F.unix_micros(S.parse_iso_ts(text)), F.lit(-1)).alias("micros"))


@query("F7_format_iso_ts", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM events")
def format_iso_ts(spark: SparkSession, folder: str) -> DataFrame:
    return B.load(spark, folder, "events").select("event_id", S.format_iso_ts(F.col("ts")).alias("iso"))


@query(
    "F8_path_parts",
    f"WITH {R.FILES} SELECT page_id, {R.PARTS}[1] AS first_part, CAST(len({R.PARTS}) AS INT) AS parts FROM files",
)
def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = S.path_parts(F.col("filePath"))
    files = B.pages_as_files(spark, folder)
    return files.select("page_id", F.get(parts, F.lit(0)).alias("first_part"), F.size(parts).alias("parts"))


SENTENCE_END = "([A-Za-z]+)\\.\\n"


@query(
    "F9_line_number",
    f"SELECT doc_id, CAST(i AS INT) AS pos, regexp_extract(found, '{SENTENCE_END}', 1) AS name, line"
    f" FROM {R.matches('documents', 'doc_id', SENTENCE_END, 'text')}",
)
def line_number(spark: SparkSession, folder: str) -> DataFrame:
    documents = B.spread(B.load(spark, folder, "documents").select("doc_id", "text"))
    found = entries(documents, F.expr(X.find_all("text", SENTENCE_END)), ["doc_id"])
    name = F.regexp_extract("text", SENTENCE_END, 1).alias("name")
    return found.select("doc_id", (F.col("place") + 1).alias("pos"), name, "line")


@query("F10_icontains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('RING'))")
def icontains(spark: SparkSession, folder: str) -> DataFrame:
    part = B.load(spark, folder, "part").select("p_partkey", "p_name")
    return part.where(S.icontains(F.col("p_name"), F.lit("RING")))


@query("F11_strip_quotes", "SELECT event_id, trim(trim(' \"''' || props || '''\" '), '\"''') AS text FROM events")
def strip_quotes(spark: SparkSession, folder: str) -> DataFrame:
    quoted = F.concat(F.lit(" \"'"), F.col("props"), F.lit("'\" "))
    return B.load(spark, folder, "events").select("event_id", S.strip_quotes(quoted).alias("text"))


@query(
    "F12_split_params",
    """SELECT doc_id, len(names) AS params, md5(array_to_string(names, '|')) AS names_md5 FROM (
       SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda p: trim(split_part(p, ':', 1))),
       lambda p: p <> '') AS names FROM documents)""",
)
def split_params(spark: SparkSession, folder: str) -> DataFrame:
    names = B.load(spark, folder, "documents").select("doc_id", S.split_params(F.col("text")).alias("names"))
    return names.select(
        "doc_id", F.size("names").cast("bigint").alias("params"), F.md5(F.array_join("names", "|")).alias("names_md5")
    )


@query(
    "F13_brace_block",
    """SELECT doc_id, length(block) AS chars, md5(block) AS block_md5 FROM (
       SELECT doc_id, replace(regexp_replace(text, '[{}]', '', 'g'), ' ', '{ }') AS block FROM documents)""",
)
def brace_block(spark: SparkSession, folder: str) -> DataFrame:
    """The block of a text whose blanks became nested braces, followed by an unbalanced rest."""
    documents = B.spread(B.load(spark, folder, "documents").select("doc_id", "text"))
    braced = documents.selectExpr(
        "doc_id", "concat('head {', replace(regexp_replace(text, '[{}]', ''), ' ', '{ }'), '} rest } {') AS braced"
    )
    block = braced.select("doc_id", F.expr(X.first_block("braced")).alias("block"))
    return block.select("doc_id", F.length("block").cast("bigint").alias("chars"), F.md5("block").alias("block_md5"))


