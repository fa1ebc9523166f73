"""Bytes that repeat a string of an earlier document, found by suffix arrays over the places where texts can agree.

Texts are packed once into sections of files in the shared folder and never shuffled. A window is a string of the asked
length; equal windows have equal anchors (the least hash of a short string in them). The steps are:

1. anchors: sections send the hashes of their anchors, by buckets of hashes, and learn which occur in several documents;
2. pieces: sections send the text around such anchors, each different piece once with the smallest id that has it;
3. each bucket sorts the suffixes of its pieces in two stages; adjacent ones with a long common prefix agree, and a
   window is a repeat if a smaller id agrees. The answer is a bit per window;
4. sections remove what the bits cover.

An anchor that very many documents share is not sent around with its surroundings: its windows go one by one, by their
own hash, so equal ones still meet, but no bucket gets all that surrounds a frequent passage.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksymbols.llm import files, shingles, suffixes
from sparksymbols.llm.common import stored, text_or_empty
from sparksymbols.session import scratch_path, ship_with_tasks

SECTION_BYTES = 1 << 22
FILE_BYTES = 1 << 30
#: Text for each bucket of anchor hashes, and how many buckets of pieces there are for one of these.
BUCKET_BYTES = 1 << 25
PIECE_BUCKETS = 16
MOST_TASKS = 20_000
#: Anchors in so many documents send their windows one by one.
HOT = 20_000

_ANSWER = "kind int, section string, bucket int, bits binary"


def _pack(folder: str, section_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sections: list[dict] = []
        path = out = None
        offset, held, size = 0, [], 0

        def flush() -> None:
            nonlocal path, out, offset, held, size
            if not held:
                return
            if out is None:
                path, out = files.create(folder, ".texts")
                offset = 0
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held)
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(whole)
            data = sink.getvalue()
            out.write(data)
            sections.append({"section": f"{path}|{offset}|{len(data)}", "bytes": size})
            offset += len(data)
            held, size = [], 0
            if offset >= FILE_BYTES:
                out.close()
                out = None

        for batch in batches:
            lengths = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: len(batch) + 1]) if len(batch) else []
            start = 0
            for i, n in enumerate(lengths):
                size += int(n)
                if size >= section_bytes:
                    held.append(batch.slice(start, i + 1 - start))
                    flush()
                    start = i + 1
            if start < len(batch):
                held.append(batch.slice(start))
        flush()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(sections, schema=pa.schema([("section", pa.string()), ("bytes", pa.int64())]))

    return run


class Section:
    """The documents of a section and the runs of windows of those with an id."""

    def __init__(self, name: str, length: int):
        path, offset, size = name.rsplit("|", 2)
        with files.Section(path, int(offset), int(size)) as raw:
            table = pa.ipc.open_stream(raw.read(int(size)) if int(size) < 1 << 16 else raw.readall()).read_all()
        self.length = length
        self.ids = table.column(0).to_pylist()
        self.texts = [x.as_buffer().to_pybytes() for x in table.column(1).combine_chunks()] if len(table) else []
        self.data = b"".join(self.texts)
        self.ends = np.cumsum([len(x) for x in self.texts]) if self.texts else np.zeros(0, np.int64)
        self.start, self.count, self.hash, self.doc = suffixes.anchors(np.frombuffer(self.data, np.uint8), self.ends, length)
        named = np.array([x is not None for x in self.ids], bool)
        if not named.all():
            keep = named[self.doc]
            self.start, self.count, self.hash, self.doc = (x[keep] for x in (self.start, self.count, self.hash, self.doc))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct anchor hashes, the number of documents that have each, and the place of each run among them."""
        order = np.lexsort((self.doc, self.hash))
        h, d = self.hash[order], self.doc[order]
        if not len(h):
            return h, np.zeros(0, np.int64), order
        new = np.concatenate([[True], h[1:] != h[:-1]])
        other = new | np.concatenate([[True], d[1:] != d[:-1]])
        starts = np.flatnonzero(new)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        return h[starts], np.add.reduceat(other.astype(np.int64), starts), place

    def pieces(self, flags: np.ndarray, buckets: int):
        """Distinct pieces to send, by bucket, with their smallest id; and for each run of windows its piece.

        ``flags`` has for each distinct anchor 1 if other documents have it and 2 more if very many have.
        """
        _, _, place = self.anchors()
        flag = flags[place] if len(place) else np.zeros(0, np.uint8)
        shift = np.uint64(64 - buckets.bit_length() + 1)
        runs = np.flatnonzero(flag == 1)
        start, count, doc = self.start[runs], self.count[runs], self.doc[runs]
        bucket = (self.hash[runs] >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(runs), np.int64)
        single = np.flatnonzero(flag == 3)
        if len(single):
            n = self.count[single]
            windows = np.repeat(self.start[single] - np.cumsum(n) + n, n) + np.arange(n.sum())
            own = np.array(
                [int.from_bytes(hashlib.blake2b(self.data[p : p + self.length], digest_size=8).digest(), "big") for p in windows.tolist()], np.uint64
            )
            start, count = np.concatenate([start, windows]), np.concatenate([count, np.ones(len(windows), np.int64)])
            doc = np.concatenate([doc, np.repeat(self.doc[single], n)])
            bucket = np.concatenate([bucket, (own >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(own), np.int64)])
        found: dict[int, dict[bytes, int]] = {}
        least: dict[int, list[int]] = {}
        which = np.zeros(len(start), np.int64)
        data, tail, ids = self.data, self.length - 1, self.ids
        for i, (p, n, d, k) in enumerate(zip(start.tolist(), count.tolist(), doc.tolist(), bucket.tolist(), strict=True)):
            own = found.setdefault(k, {})
            at = own.setdefault(data[p : p + n + tail], len(own))
            which[i] = at
            smallest = least.setdefault(k, [])
            if at == len(smallest):
                smallest.append(ids[d])
            elif ids[d] < smallest[at]:
                smallest[at] = ids[d]
        return found, least, start, count, doc, bucket, which


def _blob(lengths: np.ndarray, ids: np.ndarray, data: bytes) -> bytes:
    return zlib.compress(len(lengths).to_bytes(4, "little") + lengths.astype(np.uint16).tobytes() + ids.astype(np.int64).tobytes() + data, 1)


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zlib.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, np.uint16, n, 4).astype(np.int64), np.frombuffer(raw, np.int64, n, 4 + 2 * n), raw[4 + 10 * n :]


def _send_anchors(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("section").to_pylist():
                hashes, docs, _ = Section(name, length).anchors()
                cuts = np.searchsorted(hashes >> np.uint64(64 - buckets.bit_length() + 1), np.arange(buckets + 1)) if buckets > 1 else [0, len(hashes)]
                rows = [
                    {"bucket": k, "section": name, "hashes": hashes[lo:hi].tobytes(), "docs": np.minimum(docs[lo:hi], 255).astype(np.uint8).tobytes()}
                    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                    if hi > lo
                ]
                schema = pa.schema([("bucket", pa.int32()), ("section", pa.string()), ("hashes", pa.binary()), ("docs", pa.binary())])
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _answers(kind: int, bucket: int, sections: list[str], bits: list[bytes]) -> pa.Table:
    n = len(sections)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "section": sections, "bucket": pa.array([bucket] * n, pa.int32()), "bits": pa.array(bits, pa.binary())})


def _judge_anchors(hot: int):
    def run(rows: pa.Table) -> pa.Table:
        sections = rows.column("section").to_pylist()
        parts = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        docs = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("docs").to_pylist()]).astype(np.int64)
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        total = np.repeat(np.add.reduceat(docs[order], starts), np.diff(np.append(starts, len(order))))
        flags = np.empty(len(hashes), np.uint8)
        flags[order] = (total > 1).astype(np.uint8) + 2 * (total > hot).astype(np.uint8)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return _answers(1, rows.column("bucket")[0].as_py(), sections, [zlib.compress(x.tobytes(), 1) for x in np.split(flags, cuts)])

    return run


def _flags(section: Section, rows: list[dict]) -> np.ndarray:
    """The flags of the section's distinct anchors, put together from the answers of all buckets."""
    parts = sorted((r["bucket"], r["bits"]) for r in rows if r["kind"] == 1)
    return np.frombuffer(b"".join(zlib.decompress(bits) for _, bits in parts), np.uint8)


def _send_pieces(length: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        name = rows.column("section")[0].as_py()
        section = Section(name, length)
        found, least, *_ = section.pieces(_flags(section, rows.to_pylist()), buckets)
        keys = sorted(found)
        blobs = [_blob(np.array([len(p) for p in found[k]]), np.array(least[k]), b"".join(found[k])) for k in keys]
        return pa.table({"bucket": pa.array(keys, pa.int32()), "section": pa.array([name] * len(keys), pa.string()), "blob": pa.array(blobs, pa.binary())})

    return run


def _judge_pieces(length: int):
    def run(rows: pa.Table) -> pa.Table:
        sections = rows.column("section").to_pylist()
        asked = [_unblob(x) for x in rows.column("blob").to_pylist()]
        known: dict[bytes, int] = {}
        which, smallest = [], []
        for lengths, ids, data in asked:
            ends = np.cumsum(lengths)
            for lo, hi, doc in zip((ends - lengths).tolist(), ends.tolist(), ids.tolist(), strict=True):
                at = known.setdefault(data[lo:hi], len(known))
                which.append(at)
                if at == len(smallest):
                    smallest.append(doc)
                elif doc < smallest[at]:
                    smallest[at] = doc
        text = np.frombuffer(b"".join(known), np.uint8)
        sizes = np.array([len(p) for p in known])
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        eligible = np.arange(len(text)) + length <= ends[piece]
        least = suffixes.shared_least(text, eligible, np.array(smallest)[piece], length)
        # For each asked piece its windows: is the least id of each smaller than the one that asks?
        which = np.array(which)
        windows = sizes[which] - length + 1
        at = np.repeat((ends - sizes)[which] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        smaller = least[at] < np.repeat(np.concatenate([ids for _, ids, _ in asked]), windows)
        cuts = np.cumsum([int((lengths - length + 1).sum()) for lengths, _, _ in asked])[:-1]
        return _answers(2, rows.column("bucket")[0].as_py(), sections, [zlib.compress(np.packbits(x).tobytes(), 1) for x in np.split(smaller, cuts)])

    return run


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _remove(length: int, buckets: int, with_text: bool):
    def run(rows: pa.Table) -> pa.Table:
        section = Section(rows.column("section")[0].as_py(), length)
        answers = rows.to_pylist()
        found, least, start, count, doc, bucket, which = section.pieces(_flags(section, answers), buckets)
        bits = {r["bucket"]: np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), np.uint8)) for r in answers if r["kind"] == 2}
        keys = sorted(found)
        offsets, base, joined, smallest = {}, {}, [], []
        total = pieces = 0
        for k in keys:
            sizes = np.array([len(p) - length + 1 for p in found[k]])
            offsets[k], base[k] = total, pieces
            joined.append((sizes, bits[k][: sizes.sum()]))
            smallest.extend(least[k])
            total, pieces = total + int(sizes.sum()), pieces + len(sizes)
        covered = np.zeros(len(section.data) + 1, np.int64)
        if keys:
            sizes, repeated = np.concatenate([s for s, _ in joined]), np.concatenate([b for _, b in joined]).astype(bool)
            begin = np.cumsum(sizes) - sizes
            first = np.zeros(max(keys) + 1, np.int64)
            first[keys] = [base[k] for k in keys]
            piece = first[bucket] + which
            ids = np.array([x if x is not None else 0 for x in section.ids])
            later = ids[doc] > np.array(smallest)[piece]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            gone = repeated[np.repeat(begin[piece], count) + step] | np.repeat(later, count)
            window = (np.repeat(start, count) + step)[gone]
            covered[: len(section.data)] += np.bincount(window, minlength=len(section.data))[: len(section.data)]
            covered -= np.bincount(window + length, minlength=len(section.data) + 1)[: len(section.data) + 1]
        gone = np.cumsum(covered)[:-1] > 0
        data, out, at = np.frombuffer(section.data, np.uint8), [], 0
        for doc_id, text in zip(section.ids, section.texts, strict=True):
            own = gone[at : at + len(text)]
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            kept = data[at : at + len(text)][~own].tobytes() if spans else text
            row = {"doc_id": doc_id, "n_bytes": len(text), "n_removed": int(own.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}
            out.append({**row, "kept": kept} if with_text else row)
            at += len(text)
        fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        return pa.Table.from_pylist(out, schema=pa.schema(fields + [("kept", pa.binary())] * with_text))

    return run


def remove_repeats(
    spark: SparkSession, docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
    section_bytes: int = SECTION_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every document, and the ``kept`` bytes on request.

    Removed is each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.
    Strings are judged on the input and never cross documents; ``n_spans`` counts maximal removed runs.

    Ids are integers. A null text is empty. Rows without an id stay whole and remove nothing elsewhere; rows that repeat
    an id do not remove each other. Texts shorter than ``length`` stay whole. An empty table gives an empty result.
    ``section_bytes``, ``bucket_bytes`` and ``hot`` change sizes of steps, never results.
    """
    for module in (shingles, files, suffixes):
        ship_with_tasks(module.__name__)
    ship_with_tasks(__name__)
    if length <= suffixes.GRAM:
        raise ValueError(f"strings have more than {suffixes.GRAM} bytes")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).cast("binary").alias("text"))
    packed = texts.mapInArrow(_pack(scratch_path(spark, "texts"), section_bytes), "section string, bytes bigint")
    sections = stored(packed, "text-sections")
    count, size = sections.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = 2 ** math.ceil(math.log2(max(1, size / bucket_bytes)))
    spread = sections.select("section").repartition(max(1, count))
    sent = spread.mapInArrow(_send_anchors(length, buckets), "bucket int, section string, hashes binary, docs binary")
    # Rows are few and large, so tasks are counted by the text behind them, not by their bytes.
    tasks = max(1, min(count, MOST_TASKS))
    flags = stored(sent.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(_judge_anchors(hot), _ANSWER), "anchor-flags")
    pieces = flags.repartition(tasks, "section").groupBy("section").applyInArrow(
        _send_pieces(length, buckets * PIECE_BUCKETS), "bucket int, section string, blob binary"
    )
    pieces = pieces.repartition(min(buckets * PIECE_BUCKETS, MOST_TASKS), "bucket")
    found = pieces.groupBy("bucket").applyInArrow(_judge_pieces(length), _ANSWER)
    all_sections = sections.select(F.lit(0).alias("kind"), "section", F.lit(0).alias("bucket"), F.lit(b"").alias("bits"))
    answers = all_sections.unionByName(flags).unionByName(found)
    schema = _RESULT + (", kept binary" if with_text else "")
    return answers.repartition(tasks, "section").groupBy("section").applyInArrow(_remove(length, buckets * PIECE_BUCKETS, with_text), schema)
