"""Queries over the test tables by name, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


# Views of the tables, as SQL.

FILES = (
    "files AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS repoId,"
    " regexp_extract(url, '://[^/]+/([^?#]*)', 1) AS filePath, html AS content, url FROM pages)"
)
PARTS = "list_filter(string_split(filePath, '/'), lambda x: x <> '')"
EXTENSION = r"lower(regexp_extract(filePath, '[^./](\.[^./]+)$', 1))"


def allowed(*folders: str) -> str:
    listed = ", ".join(f"'{f}'" for f in folders)
    return f"(len({PARTS}) = 1 OR coalesce({PARTS}[1] IN ({listed}), false))"


CHANGES = (
    "changes AS (SELECT event_id, CAST(user_id AS VARCHAR) AS repoId, event_type AS filePath, props AS content,"
    " sha256(props) AS fileHash, ts FROM events)"
)
LINES = (
    "lines AS (SELECT l_suppkey AS suppkey, l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey,"
    " CASE WHEN l_linestatus = 'F' THEN 'processed' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'skipped' END AS outcome,"
    " l_shipdate AS ts FROM lineitem)"
)
REPOSITORIES = (
    f"{LINES}, counted AS (SELECT orderkey, count(*) AS total, count(*) FILTER (WHERE outcome = 'processed') AS processed,"
    " count(*) FILTER (WHERE outcome = 'failed') AS failed FROM lines GROUP BY orderkey),"
    " repositories AS (SELECT CAST(o_orderkey AS VARCHAR) AS repoId, 'repo://orders/' || o_orderkey AS url,"
    " CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' WHEN 'P' THEN 'pending' END AS status,"
    " CAST(coalesce(total, 0) AS BIGINT) AS totalFiles, CAST(coalesce(processed, 0) AS BIGINT) AS processedFiles,"
    " CAST(coalesce(failed, 0) AS BIGINT) AS failedFiles, o_orderdate AS lastUpdated"
    " FROM orders LEFT JOIN counted ON orderkey = o_orderkey)"
)


def newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def matches(source: str, keys: str, pattern: str, content: str = "content") -> str:
    """Rows (keys, i, found, line) for all matches of a pattern: the line is counted from the text before each."""
    before = "array_to_string(gaps[1:i], '') || array_to_string(hits[1:i - 1], '')"
    return (
        f"(SELECT {keys}, i, hits[i] AS found, CAST(1 + {newlines(before)} AS INT) AS line FROM"
        f" (SELECT {keys}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM"
        f" (SELECT {keys}, regexp_extract_all({content}, '{pattern}') AS hits,"
        f" string_split_regex({content}, '{pattern}') AS gaps FROM {source})))"
    )


LINK = '<a href="([^"]*)">([^<]*)</a>'
VARIABLE = "\\bvar ([A-Za-z_]+)="
SYMBOLS = (
    f"{FILES}, symbols AS (SELECT page_id, repoId, filePath, 1 AS rule_no, i, regexp_extract(found, '{LINK}', 2) AS name,"
    f" 'import' AS type, regexp_extract(found, '{LINK}', 1) AS source, line"
    f" FROM {matches('files', 'page_id, repoId, filePath', LINK)}"
    f" UNION ALL SELECT page_id, repoId, filePath, 2, i, regexp_extract(found, '{VARIABLE}', 1), 'variable', NULL, line"
    f" FROM {matches('files', 'page_id, repoId, filePath', VARIABLE)})"
)

CUT = "2024-01-16 00:00:00"

# Generated source files: {base} is the line of the last line of the text, the template's lines follow it.
CODE = (
    "docs AS (SELECT doc_id AS n, doc_id + 1 AS m, lang, source AS repoId, 'src/' || lang || '/doc' || doc_id || '{suffix}'"
    " AS filePath, CAST(1 + length(text) - length(replace(text, chr(10), '')) AS INT) AS base,"
    " CAST(doc_id % 4 AS INT) AS k FROM documents)"
)
TS_DOCS = CODE.replace("{suffix}", ".ts")
PY_DOCS = CODE.replace("{suffix}", ".py")


def value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def facts(columns: str, rows: list[tuple]) -> str:
    """A VALUES table of what every generated file holds."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows) + f") AS facts({columns})"


def fill(column: str) -> str:
    """A text column with the document numbers put in."""
    return f"replace(replace(replace({column}, '<n>', CAST(n AS VARCHAR)), '<m>', CAST(m AS VARCHAR)), '<lang>', lang)"
