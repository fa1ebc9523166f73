"""Sources, filters, look-ups and per-row measures over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparksymbols import bindings as B
from sparksymbols.functions import scalars as S
from sparksymbols.operators import extract, nested
from sparksymbols.operators import filters as L
from sparksymbols.operators.mutations import latest_per_key, upsert
from sparksymbols.operators.rules import PAGE_RULES, RuleRegistry
from sparksymbols.plans import registry as R
from sparksymbols.plans.registry import query
from sparksymbols.session import scratch_path
from sparksymbols.sources import landing
from sparksymbols.sources.tables import KeyedTable

KEYS = ["repoId", "filePath"]
PAGES = RuleRegistry(rule._replace(language="html") for rule in PAGE_RULES)
CUT = f"timestamp_ntz'{R.CUT}'"


def page_index(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with links as imports and script variables as exports, one nested row per page."""
    files = B.spread(B.pages_as_files(spark, folder)).withColumn("language", F.lit("html"))
    parsed = extract.dispatch(files, PAGES)
    return nested.assemble(parsed.withColumn("fileHash", S.content_hash(F.col("content"))), ["page_id", *KEYS, "fileHash"])


@query(
    "S1_tree_scan",
    f"WITH {R.FILES} SELECT page_id, repoId, filePath, sha256(content) AS fileHash FROM files"
    f" WHERE {R.EXTENSION} = '.html' AND {R.allowed('en', 'fr')} ORDER BY repoId, filePath",
)
def tree_scan(spark: SparkSession, folder: str) -> DataFrame:
    files = B.pages_as_files(spark, folder).withColumn("fileHash", S.content_hash(F.col("content")))
    scanned = landing.tree_scan(files, extensions=(".html",), folders=("en", "fr"))
    return scanned.select("page_id", *KEYS, "fileHash")


@query("S2_tolerant_decode", "SELECT doc_id, sha256(text) AS fileHash, length(text) AS chars FROM documents")
def tolerant_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with stray bytes put in front, in the middle and at the end must come back whole."""
    raw = F.concat(
        F.unhex(F.lit("FF")),
        F.encode(F.substr("text", F.lit(1), F.lit(10)), "UTF-8"),
        F.unhex(F.lit("C0FE")),
        F.encode(F.substr("text", F.lit(11)), "UTF-8"),
        F.unhex(F.lit("80")),
    )
    files = landing.decoded(B.load(spark, folder, "documents").select("doc_id", raw.alias("raw")))
    chars = F.length("content").cast("bigint").alias("chars")
    return files.select("doc_id", S.content_hash(F.col("content")).alias("fileHash"), chars)


@query(
    "S2_genuine_replacement",
    "SELECT doc_id, sha256(text || chr(65533) || chr(1) || 'b') AS fileHash, length(text) + 3 AS chars FROM documents",
)
def genuine_replacement(spark: SparkSession, folder: str) -> DataFrame:
    """The replacement character is kept where the text itself has it, beside bytes that cannot be decoded."""
    genuine = F.concat(F.col("text"), F.lit("\ufffd\u0001b"))
    raw = F.concat(F.unhex(F.lit("FFE282")), F.encode(genuine, "UTF-8"), F.unhex(F.lit("C3")))
    files = landing.decoded(B.load(spark, folder, "documents").select("doc_id", raw.alias("raw")))
    chars = F.length("content").cast("bigint").alias("chars")
    return files.select("doc_id", S.content_hash(F.col("content")).alias("fileHash"), chars)


@query(
    "S3_change_source",
    f"WITH {R.CHANGES} SELECT event_id, repoId AS repo_url, filePath AS file_path, content AS file_content,"
    " ts AS file_timestamp FROM changes",
)
def change_source(spark: SparkSession, folder: str) -> DataFrame:
    """A feed written as JSON lines and read with the schema of change events."""
    changes = B.events_as_changes(spark, folder)
    feed = changes.select(
        F.col("repoId").alias("repo_url"),
        F.col("filePath").alias("file_path"),
        F.col("event_id").cast("string").alias("commit_sha"),
        F.col("ts").alias("file_timestamp"),
        F.col("content").alias("file_content"),
        F.lit(None).cast("string").alias("language"),
    )
    path = scratch_path(spark, "feed")
    form = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    feed.write.option("timestampNTZFormat", form).option("timestampFormat", form + "XXX").json(path)
    return landing.read_changes(spark, path, "json").select(
        F.col("commit_sha").cast("bigint").alias("event_id"), "repo_url", "file_path", "file_content",
        F.col("file_timestamp").cast("timestamp_ntz").alias("file_timestamp"),
    )


def events_table(spark: SparkSession, folder: str, name: str) -> tuple[KeyedTable, DataFrame]:
    table = KeyedTable(spark, scratch_path(spark, name), KEYS, ["ts", "event_id"], buckets=4)
    return table, B.events_as_changes(spark, folder)


@query("S4_index_sink_append", f"WITH {R.CHANGES} SELECT event_id, repoId, filePath, fileHash, ts FROM changes")
def index_sink_append(spark: SparkSession, folder: str) -> DataFrame:
    table, changes = events_table(spark, folder, "append")
    table.append(changes.where(F.expr(f"ts < {CUT}")))
    table.append(changes.where(F.expr(f"ts >= {CUT}")))
    return table.rows().select("event_id", *KEYS, "fileHash", "ts")


LATEST = (
    "SELECT repoId, filePath, event_id, fileHash, ts FROM changes"
    " QUALIFY row_number() OVER (PARTITION BY repoId, filePath ORDER BY ts DESC, event_id DESC) = 1"
)


@query("S5_index_sink_keyed", f"WITH {R.CHANGES} {LATEST}")
def index_sink_keyed(spark: SparkSession, folder: str) -> DataFrame:
    table, changes = events_table(spark, folder, "keyed")
    table.append(changes.where(F.expr(f"ts < {CUT}")))
    table.append(changes.where(F.expr(f"ts >= {CUT}")))
    return table.current().select(*KEYS, "event_id", "fileHash", "ts")


@query("S6_batch_write", f"WITH {R.CHANGES} {LATEST}")
def batch_write(spark: SparkSession, folder: str) -> DataFrame:
    """One write of all rows, and one of none."""
    table, changes = events_table(spark, folder, "batch")
    table.append(changes)
    table.append(changes.limit(0))
    return table.current().select(*KEYS, "event_id", "fileHash", "ts")


@query(
    "S7_repo_sink",
    "SELECT 'repo://orders/' || o_orderkey AS url, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'processing'"
    " WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'pending' END AS status,"
    " o_orderdate AS lastUpdated FROM orders",
)
def repo_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories added (again) from a date on start in ``processing``."""
    orders = B.load(spark, folder, "orders")
    base = orders.select(
        B.repository_url(F.col("o_orderkey")).alias("url"), B.order_status().alias("status"), F.col("o_orderdate").alias("lastUpdated")
    )
    added = base.where(F.expr("lastUpdated >= timestamp_ntz'1997-01-01 00:00:00'")).withColumn("status", F.lit("processing"))
    return upsert(base, added, ["url"], ["lastUpdated"])


@query(
    "P1_allowed_folder",
    f"WITH {R.FILES} SELECT page_id, {R.allowed('en', 'fr')} AS allowed FROM files",
)
def allowed_folder(spark: SparkSession, folder: str) -> DataFrame:
    files = B.pages_as_files(spark, folder)
    return files.select("page_id", S.in_allowed_folder(F.col("filePath"), ("en", "fr")).alias("allowed"))


@query("P2_extension_filter", f"WITH {R.FILES} SELECT page_id, filePath FROM files WHERE {R.EXTENSION} IN ('.html', '.htm')")
def extension_filter(spark: SparkSession, folder: str) -> DataFrame:
    files = B.pages_as_files(spark, folder)
    return files.where(S.extension(F.col("filePath")).isin(".html", ".htm")).select("page_id", "filePath")


WEB_LANGUAGES = (*S.LANGUAGES, (".html", "html", "html"))


@query(
    "P3_language_tag",
    f"WITH {R.FILES} SELECT page_id, CASE WHEN {R.EXTENSION} = '.html' THEN 'html' ELSE 'text' END AS language FROM files",
)
def language_tag(spark: SparkSession, folder: str) -> DataFrame:
    return extract.with_language(B.pages_as_files(spark, folder), WEB_LANGUAGES).select("page_id", "language")


@query("P4_list_repositories", f"WITH {R.REPOSITORIES} SELECT * FROM repositories")
def list_repositories(spark: SparkSession, folder: str) -> DataFrame:
    return B.orders_as_repositories(spark, folder)


@query(
    "P5_get_repository",
    f"WITH {R.REPOSITORIES}, asked AS (SELECT DISTINCT 'repo://orders/' || (2 * orderkey) AS url FROM lines)"
    " SELECT url, repoId, status, repoId IS NOT NULL AS found FROM asked LEFT JOIN repositories USING (url)",
)
def get_repository(spark: SparkSession, folder: str) -> DataFrame:
    """Every order number that has lines, doubled: half of the urls are not there."""
    asked = B.lineitem_as_files(spark, folder).select(B.repository_url(F.col("orderkey") * 2).alias("url"))
    orders = B.load(spark, folder, "orders").select(
        B.repository_url(F.col("o_orderkey")).alias("url"),
        F.col("o_orderkey").cast("string").alias("repoId"),
        B.order_status().alias("status"),
    )
    return L.get_repositories(orders, asked).select("url", "repoId", "status", "found")


@query(
    "P6_list_files",
    f"WITH {R.CHANGES} SELECT repoId, filePath, event_id, fileHash FROM ({LATEST}) WHERE repoId IN"
    " (SELECT CAST(user_id + 10 AS VARCHAR) FROM events)",
)
def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Listings of all repositories a shifted list names; some of them do not exist."""
    index = latest_per_key(B.events_as_changes(spark, folder).select("event_id", *KEYS, "fileHash", "ts"), KEYS, ["ts", "event_id"])
    asked = B.load(spark, folder, "events").select((F.col("user_id") + 10).cast("string").alias("repoId"))
    return L.list_files_of(index, asked).select(*KEYS, "event_id", "fileHash")


@query(
    "P7_get_file",
    f"WITH {R.CHANGES}, latest AS ({LATEST}), asked AS (SELECT DISTINCT CAST(user_id + 10 AS VARCHAR) AS repoId,"
    " event_type AS filePath FROM events) SELECT repoId, filePath, fileHash, fileHash IS NOT NULL AS found"
    " FROM asked LEFT JOIN latest USING (repoId, filePath)",
)
def get_file(spark: SparkSession, folder: str) -> DataFrame:
    """Look-up of every (repository, path) with the repository number shifted, so that some are missing."""
    index = latest_per_key(B.events_as_changes(spark, folder).select("event_id", *KEYS, "fileHash", "ts"), KEYS, ["ts", "event_id"])
    asked = B.load(spark, folder, "events").select(
        (F.col("user_id") + 10).cast("string").alias("repoId"), F.col("event_type").alias("filePath")
    )
    return L.get_files(index, asked, KEYS).select(*KEYS, "fileHash", "found")


SUMMARY = (
    f"WITH {R.SYMBOLS} SELECT f.page_id, f.repoId, f.filePath, sha256(any_value(content)) AS fileHash,"
    " count(*) FILTER (WHERE type = 'variable') AS export_count, count(*) FILTER (WHERE type = 'import') AS import_count"
    " FROM files f LEFT JOIN symbols s ON s.page_id = f.page_id GROUP BY ALL"
)


@query("P8_file_summary", SUMMARY)
def file_summary(spark: SparkSession, folder: str) -> DataFrame:
    return L.file_summary(page_index(spark, folder))


@query(
    "P9_search_exports",
    f"WITH {R.SYMBOLS} SELECT page_id, repoId, filePath, string_agg(name, ',' ORDER BY i) AS names"
    " FROM symbols WHERE type = 'import' AND contains(lower(name), 'th') GROUP BY ALL",
)
def search_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Link names that contain a text, in all files of every host."""
    index = page_index(spark, folder).select("page_id", *KEYS, F.col("imports").alias("exports"))
    found = L.search_exports(index, "TH")
    return found.select("page_id", *KEYS, F.array_join("exports.name", ",").alias("names"))


@query(
    "P10_skip_malformed",
    "SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events"
    " WHERE event_type <> 'error'",
)
def skip_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut short for one event type are left out."""
    cut_short = F.expr("if(event_type = 'error', substring(props, 1, length(props) - 1), props)")
    rows = B.load(spark, folder, "events").select("event_id", cut_short.alias("text"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    return L.skip_malformed(rows, "text", schema).select("event_id", "document.k")


@query(
    "P11_validate",
    """WITH checked AS (SELECT doc_id, list_filter([
         CASE WHEN toxic = 1 THEN 'visibility' END, CASE WHEN quality = 0 THEN 'fileHash' END,
         CASE WHEN quality - toxic < 0 THEN 'totalFiles' END, CASE WHEN quality + toxic = 2 THEN 'status' END
       ], lambda v: v IS NOT NULL) AS v FROM labels)
       SELECT doc_id, len(v) = 0 AS valid, array_to_string(v, ',') AS violations FROM checked""",
)
def validate(spark: SparkSession, folder: str) -> DataFrame:
    labels = B.load(spark, folder, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "hidden").otherwise("private").alias("visibility"),
        F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6).alias("short"),
        F.md5(F.col("doc_id").cast("string")).alias("long"),
        "quality",
        (F.col("quality") - F.col("toxic")).alias("totalFiles"),
        F.when(F.col("quality") + F.col("toxic") == 2, "done").otherwise("paused").alias("status"),
    )
    rows = labels.withColumn("fileHash", F.when(F.col("quality") == 0, F.col("short")).otherwise(F.col("long")))
    rules = {
        "visibility": L.visibility_rule(),
        "fileHash": L.sha_rule("fileHash"),
        "totalFiles": L.count_rule("totalFiles"),
        "status": L.status_rule(),
    }
    valid, rejected = L.split_valid(L.validate(rows, rules))
    both = valid.withColumn("valid", F.lit(True)).unionByName(rejected.withColumn("valid", F.lit(False)))
    return both.select("doc_id", "valid", F.array_join("violations", ",").alias("violations"))


@query(
    "P12_repo_metrics",
    f"WITH {R.REPOSITORIES} SELECT repoId, CASE WHEN totalFiles = 0 THEN 0.0 ELSE processedFiles / totalFiles * 100 END"
    " AS progress, status = 'completed' AND processedFiles >= totalFiles AS is_complete,"
    " status = 'failed' OR (totalFiles > 0 AND processedFiles < totalFiles) AS has_failures FROM repositories",
)
def repo_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = L.repo_metrics(B.orders_as_repositories(spark, folder))
    return metrics.select("repoId", "progress", "is_complete", "has_failures")


@query(
    "P13_progress_pct_int",
    f"WITH {R.REPOSITORIES} SELECT repoId, CASE WHEN totalFiles > 0 THEN CAST(floor(processedFiles / totalFiles * 100)"
    " AS INT) ELSE 0 END AS percent FROM repositories",
)
def progress_pct_int(spark: SparkSession, folder: str) -> DataFrame:
    percent = L.progress_percent(F.col("processedFiles"), F.col("totalFiles"))
    return B.orders_as_repositories(spark, folder).select("repoId", percent.alias("percent"))
