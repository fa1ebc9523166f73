"""Near duplicates: banded MinHash candidates, odd sketches to judge them, full sets to confirm them.

No step expands a group of copies into its pairs. Equal sets are one representative. In each bucket of a band, members
are first compared with the smallest one only; links that hold join them into classes. Where a bucket still holds several
classes, members outside the largest are compared with the one of another class that their sketches put nearest, which
joins most of them. Only then all members of different classes that are left in a bucket are compared, in blocks. So
every pair that shares a bucket is either connected or compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksymbols.llm import shingles
from sparksymbols.llm.common import discard, join_back, stored, stored_and_observed, text_or_empty
from sparksymbols.session import ship_with_tasks

#: One hash with so many bins gives the MinHash samples (one permutation; empty bins borrow from others).
BINS = 256
#: Bands have at most so many samples; there are as many bands as keep the probability that a pair at the least similarity
#: shares none of them below this: 25 bands for 0.85, 37 for 0.80.
ROWS, MISSED = 5, 5e-7
SKETCH_BITS = 512
#: At 0.85 odd sketches reject this far below: six standard errors. Small sets are not judged by sketch.
SKETCH_SLACK = 0.18
SKETCH_LEAST = 64
#: Counts of a set's hashes by their last bits bound what two sets can share. They stop at 255; where two sets both have
#: such a count they bound nothing.
COUNTS = 1024
BLOCK_MEMBERS = 1024
BATCH_BYTES = 1 << 21

_RANDOM = np.random.default_rng(20_240_118)
_PROBES = _RANDOM.integers(0, BINS, (BINS, 4096), dtype=np.int64)
_SEEDS = _RANDOM.integers(0, 2**63, BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row per set (none of them empty): the least hash of each bin.

    An empty bin takes the sample of the first filled bin in a fixed random order of its own, the same for all sets.
    """
    out = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = (s >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        out[i, bins[first]] = s[first]
        filled[i, bins[first]] = True
    row, column = np.nonzero(~filled)
    for step in range(_PROBES.shape[1]):
        if not len(row):
            break
        probe = _PROBES[column, step]
        hit = filled[row, probe]
        out[row[hit], column[hit]] = out[row[hit], probe[hit]]
        row, column = row[~hit], column[~hit]
    if len(row):
        out[row, column] = np.array([sets[r][0] for r in row], np.uint64)
    return out


def band_shape(percent: int) -> tuple[int, int]:
    """Number of bands and of samples in each, for a least similarity; the longest bands of which enough fit the samples."""
    for rows in range(ROWS, 0, -1):
        apart = 1 - (percent / 100) ** rows
        count = int(np.ceil(np.log(MISSED) / np.log(apart))) if apart > 0 else 1
        if count * rows <= BINS:
            return count, rows
    raise ValueError(f"{BINS} samples are too few for pairs at {percent} per cent")


def bands(sampled: np.ndarray, count: int, rows: int) -> np.ndarray:
    """Keys of the bands of each row, the number of the band mixed in."""
    parts = sampled[:, : count * rows].reshape(len(sampled), count, rows)
    keys = (parts * _SEEDS[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(count, dtype=np.uint64) * _SEEDS[rows]
    return shingles.mixed(keys)


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples as 8 words a row: each sample flips the bit that it hashes to."""
    spots = shingles.mixed(sampled + _SEEDS) % np.uint64(SKETCH_BITS)
    flat = spots.astype(np.int64) + np.arange(len(sampled))[:, None] * SKETCH_BITS
    odd = np.bincount(flat.ravel(), minlength=len(sampled) * SKETCH_BITS) & 1
    return np.packbits(odd.reshape(len(sampled), SKETCH_BITS).astype(np.uint8), axis=1).view(np.uint64)


def sketch_slack(percent: int) -> float:
    """How far below a least similarity sketches reject: it grows with the standard error."""
    return float(SKETCH_SLACK * np.sqrt(percent * (100 - percent) / (85 * 15)))


def most_flips(similarity: float) -> int:
    """The largest XOR population count at which the estimate 1 + n / 4k ln(1 - 2z / n) reaches ``similarity``."""
    return int(SKETCH_BITS / 2 * (1 - np.exp(4 * BINS / SKETCH_BITS * (similarity - 1))))


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts, about ``BATCH_BYTES`` of text at a time."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        held, size, start = [], 0, 0
        for i, text in enumerate(texts):
            held.append(text.as_buffer().to_pybytes())
            size += len(held[-1])
            if size >= BATCH_BYTES or i + 1 == len(texts):
                yield ids.slice(start, len(held)), held
                held, size, start = [], 0, i + 1


def _signatures(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batched(batches):
            sets = list(shingles.shingle_sets(texts, size))
            full = [i for i, s in enumerate(sets) if len(s)]
            sampled = samples([sets[i] for i in full])
            keys, words = bands(sampled, *band_shape(percent)).view(np.int64), odd_sketches(sampled).view(np.int64)
            at = dict(zip(full, range(len(full)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([keys[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([words[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "digest", "bands", "sketch"],
            )

    return run


def hash_counts(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS), 255).astype(np.uint8).tobytes()


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batched(batches):
            sets = list(shingles.shingle_sets(texts, size))
            hashes, counts = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([hash_counts(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, hashes, counts], names=["doc_id", "shingles", "counts"])

    return run


def _close(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _flips(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _block_pairs(percent: int, flips: int, nearest: bool):
    """Pairs of members of different classes in one block of a bucket, by size, sketch and the most they can share; rows
    come sorted by block.

    The sum of the lesser counts is never below what two sets share, so no linked pair is left out by it. With ``nearest`` each member outside the block's largest class gives its nearest partner only.
    """

    def within(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n, label = rows.column("n").to_numpy(), rows.column("label_code").to_numpy()
        words = np.stack(rows.column("sketch").combine_chunks().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
        counts = np.stack([np.frombuffer(x, np.uint8) for x in rows.column("counts").to_pylist()])
        full = (counts == 255).any(axis=1)
        side, low, high = rows.column("side").to_numpy(), rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        places = np.arange(len(n))
        names, sizes = np.unique(label, return_counts=True)
        found_a, found_b = [], []
        if len(names) < 2:
            return np.array([], np.int64), np.array([], np.int64)
        for i in places[label != names[np.argmax(sizes)]]:
            # In a block of two sides members meet those of the other side; pairs inside a side have a block of their own.
            others = places if low == high else places[side != side[i]]
            fits = (label[others] != label[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
            others = others[fits]
            if not len(others):
                continue
            apart = np.bitwise_count(words[others] ^ words[i]).sum(axis=1)
            close = (apart <= flips) | (n[others] < SKETCH_LEAST) | (n[i] < SKETCH_LEAST)
            near, apart = others[close], apart[close]
            most = np.minimum(counts[near], counts[i]).sum(axis=1, dtype=np.int64)
            may = (100 * most >= percent * (n[near] + n[i] - most)) | (full[near] & full[i])
            near, apart = near[may], apart[may]
            if nearest and len(near):
                near = near[[np.argmin(apart)]]
            found_a.extend([i] * len(near))
            found_b.extend(near)
        return np.array(found_a, np.int64), np.array(found_b, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            a, b = within(rows)
            if len(a):
                ids = rows.column("rep").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            place = batch.column("place").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]]) if len(place) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column("place")[0].as_py() != place[lo]:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``node, component`` for the nodes of links ``a, b`` but the smallest of each: the smallest that can be reached.

    Alternates large and small stars: nodes are linked to the least of their neighbours until nothing changes, a
    logarithmic number of rounds. A node may have any number of neighbours; nothing is gathered per node but a minimum.
    A round is one write, which also tells whether it changed anything.
    """

    def both(edges: DataFrame) -> DataFrame:
        return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))

    def kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
        """Edges written once, with their number and a sum of hashes."""
        return stored_and_observed(edges, name, F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))

    edges, seen = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while seen[0]:
        sides = both(edges)
        large = join_back(sides, least(sides), ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.select("a", F.col("b")).where("b < a")
        stars = join_back(low, least(low), ["a"])
        small = stars.select(F.col("b").alias("a"), F.col("m").alias("b")).union(stars.select("a", F.col("m").alias("b")))
        last = edges
        edges, now = kept(small.where("a <> b").distinct())
        discard(last)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def joined_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` after further links: only what the links join of different classes goes through the rounds again."""
    label = lambda side: classes.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    named = join_back(join_back(links, label("a"), ["a"], "left"), label("b"), ["b"], "left")
    ends = named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    roots = stored(components(ends, "class-links"), "roots")
    moved = join_back(classes, roots.select(F.col("node").alias("component"), F.col("component").alias("to")), ["component"], "left")
    moved = moved.select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(roots.join(classes, "node", "left_anti"))


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = shingles.WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents are linked if their sets of ``words``-word shingles share at least ``percent`` per cent of their union;
    ``component_id`` is the smallest id that can be reached and ``kept`` marks the document that has it.

    A null, empty or blank text has no shingles, is linked with nothing and is kept; one of fewer words is a single
    shingle. Null ids are never the smallest: such rows belong to the component of their equals, if those have ids.
    Rows that repeat an id are one document, linked by any of its texts; where the id is the smallest they are all kept.
    """
    ship_with_tasks(__name__)
    ship_with_tasks(shingles.__name__)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).cast("binary").alias("text"))
    schema = f"doc_id {kind}, n bigint, digest binary, bands array<bigint>, sketch array<bigint>"
    signed = stored(texts.mapInArrow(_signatures(words, percent), schema), "signatures")
    flips = most_flips(percent / 100 - sketch_slack(percent))

    same = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    same = stored(same, "same-sets")
    reps = signed.join(same, [signed["digest"] == same["digest"], signed["doc_id"] == same["rep"]], "left_semi")
    reps = reps.select(F.col("doc_id").alias("rep"), "n", "bands", "sketch")
    keyed = reps.select("rep", "n", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = stored(join_back(keyed, hubs, ["key"]).select("key", "rep", "n", "hub", "size"), "members")
    sketches = stored(reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "sketch"), "sketches")

    def by_sketch(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, na, b, nb`` whose sketches allow the similarity; many pairs may share ``a``."""
        one = pairs.join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        two = join_back(one, sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), ["a"])
        tiny = (F.col("na") < SKETCH_LEAST) | (F.col("nb") < SKETCH_LEAST)
        return two.where(tiny | (_flips(F.col("sketch_a"), F.col("sketch_b")) <= flips)).select("a", "b")

    # Full sets of all members of buckets, made once: the one time that texts are dealt out. The join is never a
    # broadcast, so that it costs the same share of the input at every size.
    asked = members.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    made = texts.join(asked, "doc_id", "left_semi").mapInArrow(_full_sets(words), f"doc_id {kind}, shingles array<bigint>, counts binary")
    sets = stored(made, "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that are linked, by their full sets."""
        one = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        two = join_back(one, sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), ["a"])
        shared = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
        sized = two.select("a", "b", F.size("set_a").alias("x"), F.size("set_b").alias("y"), shared.alias("shared"))
        return stored(sized.where(100 * F.col("shared") >= percent * (F.col("x") + F.col("y") - F.col("shared"))).select("a", "b"), "links")

    stars = members.where("rep <> hub.rep").where(_close(F.col("n"), F.col("hub.n"), percent))
    stars = stars.select(F.col("hub.rep").alias("a"), F.col("hub.n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb")).distinct()

    def across(classes: DataFrame, nearest: bool) -> DataFrame:
        """Pairs ``a, b`` of members of buckets that still hold more than one class, who meet in blocks."""
        placed = members.join(classes, members["rep"] == classes["node"], "left")
        placed = placed.select("key", "rep", "n", "size", F.coalesce("component", "rep").alias("label"))
        open_keys = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        rest = join_back(placed, open_keys, ["key"])
        blocks = F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int")
        rest = rest.select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("side"))
        rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        low, high = F.least("side", "other"), F.greatest("side", "other")
        rest = rest.select(
            "rep", "n", "side", low.alias("low"), high.alias("high"),
            F.xxhash64("label").alias("label_code"), F.xxhash64("key", low, high).alias("place"),
        )
        rest = rest.join(sketches, "rep").join(sets.select(F.col("doc_id").alias("rep"), "counts"), "rep").repartition("place").sortWithinPartitions("place")
        met = rest.mapInArrow(_block_pairs(percent, flips, nearest), f"a {kind}, b {kind}")
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    classes = stored(components(confirmed(by_sketch(stars))), "classes")
    for nearest in (True, False):
        classes = stored(joined_components(classes, confirmed(across(classes, nearest))), "classes")

    grouped = join_back(signed.where("n > 0").select("doc_id", "n", "digest"), same, ["digest"])
    grouped = grouped.join(classes, grouped["rep"] == classes["node"], "left").select(
        "doc_id", "n", F.coalesce("component", "rep", "doc_id").alias("component_id")
    )
    alone = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One document of each group of near copies, with all columns; rows without an id stay."""
    gone = near_duplicates(docs, percent, id_col=id_col, text_col=text_col).where("NOT kept AND doc_id IS NOT NULL")
    gone = gone.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["_id"], "left_anti")
