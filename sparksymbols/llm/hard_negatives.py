"""Hard negatives by score windows, with bounds along a spanning tree of the anchors.

A candidate's score at an anchor differs from that at the anchor's parent by at most the length of the edge times the
candidate's norm. So bounds run down the tree, and only candidates whose bounds meet an anchor's window are scored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparksymbols.llm import files
from sparksymbols.llm.common import stored
from sparksymbols.session import scratch_path, ship_with_tasks

ship_with_tasks(__name__)
ship_with_tasks(files.__name__)

#: Candidates of a strip and anchors of a block; a task holds one of each, with two bounds for each pair of them.
STRIP_ROWS, BLOCK_ROWS = 2048, 512
#: Strips are dealt into so many groups, or more so that none has over so many strips; a task sees one block with the
#: strips of one group, one after the other.
GROUPS, GROUP_STRIPS = 16, 4096
POSITIVES, NEGATIVES = 5, 5
#: Anchors are the rows whose id is divisible by this.
EVERY = 100
#: A negative's score is at least this many per cent of the positive's, and at most the positive's.
LEAST_PERCENT = 80
#: Sums of integers up to this are exact as doubles.
EXACT = 2.0**53
LARGEST = (1 << 63) - 1


def vectors(embeddings: DataFrame) -> DataFrame:
    """The rows that take part, as ``vec_id, label, vector`` with integer components (as doubles)."""
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return embeddings.where(F.coalesce(fine, F.lit(False))).select("vec_id", label.cast("bigint").alias("label"), scaled.alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = int(lengths.max(initial=0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _packed(**arrays: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {name: held[name] for name in held.files}


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, and where they are null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def _strip_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strips of a partition in one file, rows by label; a table says where each begins."""
        path = stream = None
        at = 0
        for batch in batches:
            for start in range(0, batch.num_rows, STRIP_ROWS):
                part = batch.slice(start, STRIP_ROWS)
                ids, nulls = _ids(part.column("vec_id"))
                labels = part.column("label").to_numpy(zero_copy_only=False)
                order = np.argsort(labels, kind="stable")
                matrix = _matrix(part.column("vector"))[order]
                data = _packed(ids=ids[order], nulls=nulls[order], labels=labels[order], matrix=matrix, norms=_norms(matrix))
                if stream is None:
                    path, stream = files.create(folder, ".strips")
                stream.write(data)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "offset": pa.array([at], pa.int64()), "length": pa.array([len(data)], pa.int64())})
                at += len(data)
        if stream is not None:
            stream.close()

    return write


def _norms(matrix: np.ndarray) -> np.ndarray:
    """Lengths of vectors, a little too large if anything."""
    return np.sqrt((matrix * matrix).sum(axis=1)) * (1 + 1e-9) + 1e-6


def spanning_tree(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parents and edge lengths of a shortest spanning tree over the rows; the root's parent is -1."""
    n = len(matrix)
    nearest, parent = np.full(n, np.inf), np.full(n, -1)
    order, edges, todo = np.zeros(n, int), np.zeros(n), np.ones(n, bool)
    at = 0
    for place in range(n):
        order[place], edges[at], todo[at] = at, nearest[at] if parent[at] >= 0 else 0.0, False
        distance = _norms(matrix - matrix[at])
        closer = todo & (distance < nearest)
        nearest[closer], parent[closer] = distance[closer], at
        at = int(np.argmin(np.where(todo, nearest, np.inf)))
    return order, parent, edges


def _block_writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in blocks with their spanning trees, in one row a block."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            ids, _ = _ids(part.column("vec_id"))
            matrix = _matrix(part.column("vector"))
            order, parent, edges = spanning_tree(matrix)
            data = _packed(
                ids=ids, labels=part.column("label").to_numpy(zero_copy_only=False), matrix=matrix, norms=_norms(matrix), order=order, parent=parent, edges=edges
            )
            yield pa.RecordBatch.from_pydict({"anchors": pa.array([data])})


def _scores(matrix: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as integers; those too large for doubles are summed as Python's integers and held to 64 bits."""
    width = min(matrix.shape[1], len(anchor))
    if exact:
        return matrix[:, :width] @ anchor[:width]
    whole = [int(x) for x in anchor[:width]]
    sums = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in matrix[:, :width].tolist()]
    return np.array([max(-LARGEST - 1, min(LARGEST, s)) for s in sums], dtype=object)


class Best:
    """The first few rows by score, then id (a null id last), of all that were offered."""

    def __init__(self, size: int):
        self.size, self.rows = size, []

    def floor(self) -> float:
        """Rows that score less cannot come in."""
        return self.rows[-1][0] if len(self.rows) == self.size else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        if scores.dtype == object:
            first = sorted(range(len(scores)), key=lambda i: (-scores[i], bool(nulls[i]), int(ids[i])))[: self.size]
            scores, ids, nulls = scores[first], ids[first], nulls[first]
        elif len(scores) > self.size:  # all that tie with the last of the first few, then the smallest ids of them
            edge = np.partition(scores, len(scores) - self.size)[len(scores) - self.size]
            fits = np.nonzero(scores >= edge)[0]
            fits = fits[np.lexsort((ids[fits], nulls[fits], -scores[fits]))][: self.size]
            scores, ids, nulls = scores[fits], ids[fits], nulls[fits]
        new = [(int(s), bool(none), int(i)) for s, i, none in zip(scores, ids, nulls, strict=True)]
        self.rows = sorted([*self.rows, *new], key=lambda row: (-row[0], row[1], row[2]))[: self.size]


def _spans(block: dict, windows: dict | None, at: int, best: dict) -> list[tuple[float, float, int]]:
    """Score windows of an anchor, with their places: from what can still come in to what is allowed."""
    if windows is None:
        return [(best[at, at].floor() if (at, at) in best else -np.inf, np.inf, at)]
    out = []
    for place in range(at * POSITIVES, (at + 1) * POSITIVES):
        high = windows.get(place)
        low = high if high is None else -(-LEAST_PERCENT * high // 100)
        if high is not None and low <= high:
            out.append((max(low, best[at, place].floor()) if (at, place) in best else low, high, place))
    return out


FOUND = "block bigint, at int, place int, anchor_id bigint, vec_id bigint, score bigint"


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a block of anchors and the strips of a group: the first few rows of each window.

    Without windows these are the rows of an anchor's own label (but its own id), else those of other labels.
    """
    for batch in batches:
        for row in batch.to_pylist():
            block = _unpacked(row["anchors"])
            windows = {w["place"]: w["score"] for w in row["windows"]} if "windows" in row else None
            best: dict[tuple[int, int], Best] = {}
            for place in row["strips"]:
                with files.Section(place["path"], place["offset"], place["length"]) as stream:
                    mine_strip(block, _unpacked(stream.read()), windows, best)
            out = [
                (row["block"], at, place, int(block["ids"][at]), None if none else i, score)
                for (at, place), held in best.items() for score, none, i in held.rows
            ]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in FOUND.split(", ")])


def mine_strip(block: dict, strip: dict, windows: dict | None, best: dict) -> tuple[int, int]:
    """Offer what a strip has to the windows of a block; how many pairs were scored, of how many."""
    scored = pairs = 0
    matrix, norms, labels = strip["matrix"], strip["norms"], strip["labels"]
    exact = float(norms.max(initial=0)) * float(block["norms"].max(initial=0)) < EXACT
    n = len(labels)
    low, high = np.empty((len(block["ids"]), n)), np.empty((len(block["ids"]), n))
    for at in block["order"]:
        parent, label = block["parent"][at], block["labels"][at]
        if parent < 0:
            low[at], high[at] = -np.inf, np.inf
        else:
            reach = block["edges"][at] * norms + 1
            low[at], high[at] = low[parent] - reach, high[parent] + reach
        start, end = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
        wanted = np.zeros(n, bool)
        for least, most, _ in (spans := _spans(block, windows, at, best)):
            wanted |= (high[at] >= least) & (low[at] <= most)
        if windows is None:
            wanted[:start] = wanted[end:] = False
        else:
            wanted[start:end] = False
        chosen = np.nonzero(wanted)[0]
        scored, pairs = scored + len(chosen), pairs + (end - start if windows is None else n - end + start)
        # The root is scored for all, so that its children's bounds are as narrow as their edges.
        rows = np.arange(n) if parent < 0 else chosen
        if not len(rows):
            continue
        scores = _scores(matrix if len(rows) == n else matrix[rows], block["matrix"][at], exact)
        if exact:
            low[at, rows] = high[at, rows] = scores
        if len(rows) > len(chosen):
            scores = scores[chosen]
        ids, nulls = strip["ids"][chosen], strip["nulls"][chosen]
        for least, most, place in spans:
            fits = (scores >= least) & (scores <= most)
            if windows is None:
                fits &= nulls | (ids != block["ids"][at])
            if fits.any():
                best.setdefault((at, place), Best(POSITIVES if windows is None else NEGATIVES)).offer(scores[fits], ids[fits], nulls[fits])
    return scored, pairs


def _first(found: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The first few rows of each key by score, then id, with their ``rank``; each task keeps so many before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)


def hard_negatives(embeddings: DataFrame, every: int = EVERY) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive.

    Anchors are the rows whose id is divisible by ``every``; scores are inner products of integer vectors, higher ones
    come first, ties by the smaller id. Positives are the first ``POSITIVES`` rows of an anchor's label, negatives the
    first ``NEGATIVES`` of other labels that score ``LEAST_PERCENT`` to 100 per cent of the positive.

    Rows are written once in strips, anchors in blocks of a label with a shortest spanning tree. Every block meets
    every strip, a group of strips a task, first for positives, then for negatives. Bounds go down the tree, and only
    rows whose bounds meet a window are scored. A task holds one block and one strip; the lists of the first few rows
    are merged by an ordinary window. Only sections of files are listed, never rows.

    Rows with a null label, vector or component, or one that is not finite, take no part. Null ids are no anchors and
    come last among ties; rows with an anchor's own id are not its positives. Repeated rows count each. Shorter vectors
    end in zeros. Scores beyond 64 bits stop at their ends; an empty table gives an empty result.
    """
    spark: SparkSession = embeddings.sparkSession
    rows = vectors(embeddings)
    strips = stored(rows.mapInArrow(_strip_writer(scratch_path(spark, "strips")), "path string, offset bigint, length bigint"), "strip-list")
    anchors = rows.where(F.col("vec_id") % every == 0)
    partitions = max(1, -(-anchors.count() // BLOCK_ROWS))
    ranged = anchors.repartitionByRange(partitions, "label", "vec_id").sortWithinPartitions("label", "vec_id")
    numbered = ranged.mapInArrow(_block_writer, "anchors binary").withColumn("block", F.monotonically_increasing_id())
    blocks = stored(numbered, "anchor-blocks")
    groups = max(GROUPS, -(-strips.count() // GROUP_STRIPS))
    listed = strips.groupBy(F.pmod(F.xxhash64("path", "offset"), F.lit(groups)).cast("int").alias("group")).agg(
        F.collect_list(F.struct("path", "offset", "length")).alias("strips")
    )
    tasks = min(blocks.count() * groups, 32 * spark.sparkContext.defaultParallelism) or 1

    def mined(of_blocks: DataFrame) -> DataFrame:
        pairs = of_blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(listed, "group")
        return pairs.repartition(tasks, "block", "group").mapInArrow(_mine, FOUND)

    positives = _first(mined(blocks), ["block", "at"], POSITIVES)
    positives = positives.withColumn("place", F.col("at") * POSITIVES + F.col("rank") - 1).drop("rank")
    positives = stored(positives, "positives")
    windows = positives.groupBy("block").agg(F.collect_list(F.struct("place", "score")).alias("windows"))
    negatives = _first(mined(blocks.join(windows, "block")), ["block", "place"], NEGATIVES)
    named = positives.select("block", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named, ["block", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = f"""
WITH fine AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
anchors AS (SELECT row_number() OVER () AS a, * FROM fine WHERE vec_id % {EVERY} = 0),
pairs AS (
  SELECT a, x.vec_id AS anchor_id, x.label AS anchor_label, c.vec_id, c.label, list_dot_product(x.v, c.v)::BIGINT AS score
  FROM anchors x, fine c
),
positives AS (
  SELECT * FROM pairs WHERE label = anchor_label AND vec_id IS DISTINCT FROM anchor_id
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) <= {POSITIVES}
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.vec_id ORDER BY n.score DESC, n.vec_id NULLS LAST)::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n
  ON n.a = p.a AND n.label <> n.anchor_label AND {LEAST_PERCENT} * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= {NEGATIVES}
"""
