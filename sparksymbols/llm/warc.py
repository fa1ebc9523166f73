"""Pages as WARC archives, written and read in chunks.

A record is a run of rows ``record, chunk_no, data``; no step holds more of it than a chunk. Digests grow with the
chunks. Archives are gzip members, one a record, in the shared folder, with a table of sections that can be read apart.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksymbols.llm import files
from sparksymbols.llm.common import join_back, stored, text_or_empty
from sparksymbols.session import scratch_path, ship_with_tasks

CHUNK_BYTES = 256 * 1024
SECTION_BYTES = 8 * 1024 * 1024
FILE_BYTES = 1024**3
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"

SECTIONS = "path string, offset bigint, length bigint, records bigint"
CHUNKS = (
    "record string, url string, record_type string, refers_to string, stated_digest string, stated_bytes bigint,"
    " chunk_no int, bytes_so_far bigint, digest_so_far string, last boolean, data binary"
)


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages as ``page_id, url, payload, digest, payload_bytes, refers_to``; ``refers_to`` is null for responses.

    Of equal payloads of at least ``least_bytes`` the one with the largest id is the response. Only ids and digests are
    grouped; the join back can be split where a third of all pages are the same.
    """
    payload = text_or_empty(F.col("payload")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    narrow = rows.where(F.col("payload_bytes") >= least_bytes).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.max("page_id").alias("first_id"))
    joined = join_back(rows, first, ["digest"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= least_bytes), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes", refers.alias("refers_to"))


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The payloads as rows ``record, chunk_no, chunks, data`` and the record's headers; revisits have an empty chunk.

    All chunks of a record come one after the other from the task that holds its row.
    """
    kept = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    chunks = F.greatest(F.lit(1), F.ceil(kept / chunk_bytes)).cast("int")
    numbered = rows.select("*", chunks.alias("chunks"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk_no"))
    piece = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return numbered.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("record"),
        F.regexp_replace(text_or_empty(F.col("url")), r"[\r\n]+", " ").alias("url"),
        "digest",
        "payload_bytes",
        F.col("refers_to").cast("string").alias("refers_to"),
        "chunks",
        "chunk_no",
        F.when(F.col("refers_to").isNull(), piece).otherwise(F.lit(b"")).alias("data"),
    )


def _head(row: dict, date: str) -> bytes:
    """WARC and HTTP headers of a record."""
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    revisit = row["refers_to"] is not None
    length = len(http) + (0 if revisit else row["payload_bytes"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID_PREFIX}{row['record']}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {row['url']}"] if row["url"] else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{row['refers_to']}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {length}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _writer(folder: str, date: str, section_bytes: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sections: list[dict] = []
        path = out = packer = sha = None
        offset = start = records = expected = 0

        def close() -> None:
            nonlocal out, offset, start, records
            if out is not None:
                if records:
                    sections.append({"path": path, "offset": start, "length": offset - start, "records": records})
                out.close()
            out, offset, start, records = None, 0, 0, 0

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, out = files.create(folder, ".warc.gz")
                if row["chunk_no"] == 0:
                    packer, sha, expected = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1(), 0
                    offset += out.write(packer.compress(_head(row, date)))
                if row["chunk_no"] != expected:
                    raise ValueError(f"record {row['record']}: chunk {row['chunk_no']} instead of {expected}")
                expected += 1
                sha.update(row["data"])
                offset += out.write(packer.compress(row["data"]))
                if expected < row["chunks"]:
                    continue
                if row["refers_to"] is None and sha.hexdigest() != row["digest"]:
                    raise ValueError(f"record {row['record']}: its chunks do not have its digest")
                offset += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                records += 1
                if offset - start >= section_bytes:
                    sections.append({"path": path, "offset": start, "length": offset - start, "records": records})
                    start, records = offset, 0
                if offset >= file_bytes:
                    close()
        close()
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("records", pa.int64())])
        yield pa.RecordBatch.from_pylist(sections, schema=schema)

    return run


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES, section_bytes: int = SECTION_BYTES) -> DataFrame:
    """Write the records of ``roles`` as archives below ``folder``; the committed table of their sections."""
    ship_with_tasks(__name__)
    ship_with_tasks(files.__name__)
    written = chunked(rows, chunk_bytes).mapInArrow(_writer(folder, date, section_bytes, FILE_BYTES), SECTIONS)
    return stored(written, "warc-sections")


def _headers(stream) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in iter(stream.readline, b"\r\n"):
        if not line:
            raise ValueError("a record ends in its headers")
        name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
        found[name.lower()] = value
    return found


def read_records(path: str, offset: int, length: int, chunk_bytes: int, with_data: bool) -> Iterator[dict]:
    """The chunk rows of all records in a section of an archive."""
    with files.Section(path, offset, length) as section:
        stream = gzip.GzipFile(fileobj=io.BufferedReader(section, 1 << 16))
        while first := stream.readline():
            if not first.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at its place")
            head = _headers(stream)
            left = int(head["content-length"])
            http = {}
            if head.get("content-type", "").startswith("application/http"):
                status = stream.readline()
                http = _headers(stream)
                left -= len(status) + sum(len(f"{k}: {v}".encode()) + 2 for k, v in http.items()) + 2
            row = {
                "record": head["warc-record-id"].strip("<>").removeprefix(ID_PREFIX),
                "url": head.get("warc-target-uri"),
                "record_type": head["warc-type"],
                "refers_to": head["warc-refers-to"].strip("<>").removeprefix(ID_PREFIX) if "warc-refers-to" in head else None,
                "stated_digest": head["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in head else None,
                "stated_bytes": int(http["content-length"]) if "content-length" in http else left,
            }
            sha, so_far, number = hashlib.sha1(), 0, 0
            while True:
                data = stream.read(min(chunk_bytes, left))
                if len(data) < min(chunk_bytes, left):
                    raise ValueError(f"record {row['record']} is cut off")
                left -= len(data)
                so_far += len(data)
                sha.update(data)
                yield {
                    **row,
                    "chunk_no": number,
                    "bytes_so_far": so_far,
                    "digest_so_far": base64.b32encode(sha.digest()).decode(),
                    "last": not left,
                    "data": data if with_data else None,
                }
                number += 1
                if not left:
                    break
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {row['record']} is longer than it says")


def _reader(chunk_bytes: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, long = pa.string(), pa.int64()
        schema = pa.schema(
            [("record", text), ("url", text), ("record_type", text), ("refers_to", text), ("stated_digest", text), ("stated_bytes", long),
             ("chunk_no", pa.int32()), ("bytes_so_far", long), ("digest_so_far", text), ("last", pa.bool_()), ("data", pa.binary())]
        )
        most = 64 if with_data else 4096
        for batch in batches:
            for part in batch.to_pylist():
                held: list[dict] = []
                for row in read_records(part["path"], part["offset"], part["length"], chunk_bytes, with_data):
                    held.append(row)
                    if len(held) == most:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def read_archives(sections: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives: a row per chunk, with size and digest of the payload so far."""
    ship_with_tasks(__name__)
    ship_with_tasks(files.__name__)
    parts = sections.select("path", "offset", "length").repartition(max(1, sections.count()))
    return parts.mapInArrow(_reader(chunk_bytes, with_data), CHUNKS)


def archive_round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages, read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact``.

    Sizes and digests of responses are those of the bytes read; ``intact`` says that they are the stated ones.
    Revisits hold no payload: theirs are the stated ones. A null payload is empty, a null url is left out, a null id
    reads back as null and never is what others refer to, unless all of its equals have none: then all are responses.
    Pages that repeat id and payload are alike, so both are responses. An empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = roles(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload")), least_bytes)
    sections = write_archives(rows, scratch_path(spark, "warc"))
    response = F.col("record_type") == "response"
    return read_archives(sections, with_data=False).where("last").select(
        F.when(F.col("record") != "", F.col("record").cast(kind)).alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        (~response | ((F.col("digest_so_far") == F.col("stated_digest")) & (F.col("bytes_so_far") == F.col("stated_bytes")))).alias("intact"),
    )


SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS first_id,
            list_transform(range(8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS INTEGER)) AS parts FROM rows),
placed AS (SELECT *, list_reduce(list_transform(parts, lambda v: list_reduce(list_transform([15, 10, 5, 0],
             lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> k) & 31 AS INTEGER) + 1, 1)),
             lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest FROM named)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, true AS intact FROM placed
"""
