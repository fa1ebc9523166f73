"""Gates whose state moves only on accepted rows: the ordered change gate and the lease.

A skipped row does not move the stored state, so neither is a window function. Each key's history is split
into segments (see ``segments``). What the rows of a segment do to any state that enters them is a map of a few
pieces, made in one pass from the last row to the first:

1. Maps are made for keys that span segments, all segments at once.
2. The maps of a key, at most one per partition, are applied one after the other: the state entering each segment.
3. One pass labels all rows.

So the number of jobs does not depend on rows, segments or how long states last. A map of a lease has a piece for each
request that may be the next one granted; where there are too many to send, because leases outlast thousands of
requests, grants are found by links instead: each request is linked to the first one after its lease would end, and
the links are followed in steps of doubling length.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparksymbols.operators.segments import SEGMENT, frozen_segments, row_numbers, running_sums, spanning_keys
from sparksymbols.session import checkpointed, ship_with_tasks

ship_with_tasks(__name__)

#: What is stored for a key: a time in microseconds and a content hash (empty for leases); nothing is None.
State = tuple[int, str] | None

#: Pieces of a map that is sent; a lease that outlasts more requests of a segment is followed by links.
LARGEST_MAP = 4096

SAME = "same"
_LEAST = float("-inf")
# A row without a readable time is never stale, and after it no row is.
_EVER = -(2**63)


class Pieces:
    """A function over times: ``values[i]`` from ``lows[i]`` to the next low; the first low is below all times."""

    def __init__(self, value: Any):
        self.lows: list[float] = [_LEAST]
        self.values: list[Any] = [value]

    def at(self, time: float) -> Any:
        return self.values[bisect_right(self.lows, time) - 1]

    def change(self, low: float, high: float, new: Callable[[Any], Any]) -> None:
        """Put ``new(value)`` for the values from ``low`` up to, not including, ``high``; equal neighbours join."""
        for time in (low, high):
            i = bisect_left(self.lows, time)
            if time != float("inf") and (i == len(self.lows) or self.lows[i] != time):
                self.lows.insert(i, time)
                self.values.insert(i, self.values[i - 1])
        i, j = bisect_left(self.lows, low), bisect_left(self.lows, high)
        lows, values = self.lows[i:j], [new(value) for value in self.values[i:j]]
        first, last = max(i - 1, 0), min(j + 1, len(self.lows))
        lows, values = self.lows[first:i] + lows + self.lows[j:last], self.values[first:i] + values + self.values[j:last]
        kept = [k for k in range(len(lows)) if k == 0 or values[k] != values[k - 1]]
        self.lows[first:last], self.values[first:last] = [lows[k] for k in kept], [values[k] for k in kept]

    def __len__(self) -> int:
        return len(self.lows)


class StateMap:
    """What rows do to a state. Only its plain parts travel, as the class itself may be unknown to a worker's pickle."""

    pieces: Pieces
    fresh: State = None

    def __len__(self) -> int:
        return len(self.pieces)

    def packed(self) -> bytes:
        return pickle.dumps((self.pieces.lows, self.pieces.values, self.fresh))

    def unpacked(self, data: bytes) -> StateMap:
        self.pieces.lows, self.pieces.values, self.fresh = pickle.loads(data)
        return self


class GateMap(StateMap):
    """What rows of the change gate do to a state. Pieces are ``(content, end if another content, end if this one)``."""

    def __init__(self):
        self.pieces = Pieces((None, SAME, SAME))

    def __call__(self, state: State) -> State:
        if state is None:
            return self.fresh
        content, other, own = self.pieces.at(state[0])
        end = own if state[1] == content else other
        return state if end == SAME else end

    def prepend(self, row: tuple) -> None:
        at, content = int(row[0]), row[1]
        end = self.fresh = self((at, content))

        def accepted(value: tuple) -> tuple:
            before = value[2] if value[0] == content else value[1]
            return (None, end, end) if before == end else (content, end, before)

        self.pieces.change(_LEAST, float("inf") if at == _EVER else at + 1, accepted)


class LeaseMap(StateMap):
    """What requests do to the time at which a lease ends; no lease ends below all times."""

    def __init__(self):
        self.pieces = Pieces(SAME)

    def ends(self, expiry: float) -> float:
        end = self.pieces.at(expiry)
        return expiry if end == SAME else end

    def __call__(self, state: State) -> State:
        end = self.ends(_LEAST if state is None else state[0])
        return None if end == _LEAST else (int(end), "")

    def prepend(self, row: tuple) -> None:
        at, kind, ttl = int(row[0]), row[1], int(row[2])
        end = self.ends(_LEAST if kind == "release" else at + ttl)
        low, high = (_LEAST, at) if kind == "acquire" else (at, float("inf"))
        self.pieces.change(low, high, lambda _: end)


class Fold(NamedTuple):
    """A recurrence over one key's rows.

    ``inputs`` are the columns it reads, ``step`` maps (state, row values) to (label, new state). ``whole`` makes an
    empty map, to which rows are added from the last to the first. ``linked`` says of two neighbouring rows that the
    next accepted row is the first with a later time, so that links can be followed.
    """

    inputs: tuple[str, ...]
    step: Callable[[State, tuple], tuple[str, State]]
    whole: Callable[[], StateMap]
    linked: Callable[[tuple, tuple], bool]


_ENTRY = ("entry_set", "entry_at", "entry_content")


def _labelled(batches: Iterator[pd.DataFrame], keys: Sequence[str], fold: Fold, label: str) -> Iterator[pd.DataFrame]:
    """Label sorted rows; the state restarts with each key, from its entry where the segment has one."""
    current, state = None, None
    for batch in batches:
        key_rows = zip(batch[SEGMENT], *(batch[k] for k in keys), strict=True)
        values = zip(*(batch[c] for c in fold.inputs), strict=True)
        entries = zip(*(batch[c] for c in _ENTRY), strict=True)
        labels = []
        for key, row, (known, at, content) in zip(key_rows, values, entries, strict=True):
            if key != current:
                current, state = key, (int(at), content) if known else None
            done, state = fold.step(state, row)
            labels.append(done)
        yield batch.drop(columns=list(_ENTRY)).assign(**{label: labels})


def _maps(batches: Iterator[pd.DataFrame], keys: Sequence[str], fold: Fold) -> Iterator[pd.DataFrame]:
    """The map of each (segment, key), rows given from the last to the first; null if it is too large."""
    current, made, after, linked = None, None, None, True

    def row() -> pd.DataFrame:
        small = made.packed() if made is not None else None
        return pd.DataFrame([(*current, small, linked)] if current else [], columns=[SEGMENT, *keys, "map", "linked"])

    for batch in batches:
        key_rows = zip(batch[SEGMENT], *(batch[k] for k in keys), strict=True)
        values = zip(*(batch[c] for c in fold.inputs), strict=True)
        for key, value in zip(key_rows, values, strict=True):
            if key != current:
                yield row()
                current, made, after, linked = key, fold.whole(), None, True
            linked = linked and (after is None or fold.linked(value, after))
            after = value
            if made is not None:
                made.prepend(value)
                made = made if len(made) <= LARGEST_MAP else None
    yield row()


def _chained(parts: pd.DataFrame, keys: Sequence[str], fold: Fold) -> pd.DataFrame:
    """The state that enters each segment of one key; ``open`` from the first one on that no map leads into."""
    parts = parts.sort_values(SEGMENT)
    rows, state, certain = [], None, True
    for key, made, exit_ in zip(zip(parts[SEGMENT], *(parts[k] for k in keys), strict=True), parts["map"], parts["exit"], strict=True):
        rows.append((*key, certain and state is not None, *((state or (0, "")) if certain else (0, "")), not certain, bool(parts["linked"].all())))
        if exit_ is not None:
            state = pickle.loads(exit_)
        elif made is not None:
            state = fold.whole().unpacked(made)(state) if certain else None
        else:
            certain = False
    return pd.DataFrame(rows, columns=[SEGMENT, *keys, *_ENTRY, "open", "linked"])


def _exits(batches: Iterator[pd.DataFrame], keys: Sequence[str], fold: Fold) -> Iterator[pd.DataFrame]:
    """The state that each (segment, key) ends in, from its entry."""
    current, state = None, None

    def row() -> pd.DataFrame:
        return pd.DataFrame([(*current, pickle.dumps(state))] if current else [], columns=[SEGMENT, *keys, "exit"])

    for batch in batches:
        key_rows = zip(batch[SEGMENT], *(batch[k] for k in keys), strict=True)
        values = zip(*(batch[c] for c in fold.inputs), strict=True)
        for key, value, known, at, content in zip(key_rows, values, *(batch[c] for c in _ENTRY), strict=True):
            if key != current:
                yield row()
                current, state = key, (int(at), content) if known else None
            state = fold.step(state, value)[1]
    yield row()


def _same_keys(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """A join with a small table in which null keys are equal to each other."""
    right = right.select(*(F.col(c).alias(f"_{c}") if c in columns else F.col(c) for c in right.columns))
    test = reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_{c}"]) for c in columns))
    return left.join(F.broadcast(right), test, how).drop(*(f"_{c}" for c in columns))


def entry_states(frozen: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold) -> DataFrame:
    """The state that enters each segment of each spanning key: at most two rows per partition."""
    part = [SEGMENT, *keys]
    typed = [frozen.schema[k] for k in part]
    spanning = spanning_keys(frozen, keys)
    rows = _same_keys(frozen.select(*dict.fromkeys([*part, *order, *fold.inputs])), spanning, list(keys), "left_semi")
    backwards = rows.sortWithinPartitions(*(F.desc(c) for c in (*keys, *order)))
    schema = T.StructType([*typed, T.StructField("map", T.BinaryType()), T.StructField("linked", T.BooleanType())])
    maps = checkpointed(backwards.mapInPandas(lambda b: _maps(b, keys, fold), schema).withColumn("exit", F.lit(None).cast("binary")))
    chained = T.StructType(
        [*typed, T.StructField("entry_set", T.BooleanType()), T.StructField("entry_at", T.LongType()), T.StructField("entry_content", T.StringType()),
         T.StructField("open", T.BooleanType()), T.StructField("linked", T.BooleanType())]
    )

    def chain(maps: DataFrame) -> DataFrame:
        return checkpointed(maps.groupBy(*keys).applyInPandas(lambda parts: _chained(parts, keys, fold), chained))

    entries = chain(maps)
    open_keys = entries.where("open").select(*keys, "linked").distinct()
    if open_keys.isEmpty():
        return entries.select(*part, *_ENTRY)
    by_links = open_keys.where("linked")
    if not by_links.isEmpty():
        found = linked_entries(_same_keys(frozen, by_links.select(*keys), list(keys), "left_semi"), keys, order, fold)
        entries = _same_keys(entries, by_links.select(*keys), list(keys), "left_anti").unionByName(
            found.withColumns({"open": F.lit(False), "linked": F.lit(True)})
        )
    # What is neither small nor linked: leases that outlast thousands of requests and are extended or released. The
    # first open segment of each key is read with the state that really enters it, until none is left.
    rest = _same_keys(maps, entries.where("open").select(*keys).distinct(), list(keys), "left_semi")
    while not entries.where("open").isEmpty():
        first = entries.where("open").groupBy(*keys).agg((F.min(SEGMENT)).alias("_open"))
        stuck = _same_keys(entries.where("NOT open"), first, list(keys), "inner").where(F.col(SEGMENT) < F.col("_open"))
        last = stuck.groupBy(*keys).agg(F.max_by(F.struct(SEGMENT, *_ENTRY), SEGMENT).alias("last")).select(*keys, "last.*")
        asked = _same_keys(frozen.select(*part, *fold.inputs), last, part, "inner")
        exits = asked.mapInPandas(lambda b: _exits(b, keys, fold), T.StructType([*typed, T.StructField("exit", T.BinaryType())]))
        exits = exits.withColumnRenamed("exit", "_exit")
        rest = _same_keys(rest, exits, part, "left").withColumn("exit", F.coalesce("exit", "_exit")).drop("_exit")
        rest = checkpointed(rest)
        again = chain(rest)
        entries = _same_keys(entries, rest.select(*keys).distinct(), list(keys), "left_anti").unionByName(again)
    return entries.select(*part, *_ENTRY)


def linked_entries(frozen: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold) -> DataFrame:
    """Entry states of keys whose next grant is the first request after the lease ends.

    Counts of requests in one order with the ends of leases give each request's successor; the granted ones are those
    that links reach from the first, found in rounds over links of doubled length.
    """
    at, _, ttl = fold.inputs
    numbered = checkpointed(row_numbers(frozen.select(SEGMENT, *keys, *order, at, (F.col(at) + F.col(ttl)).alias("_ends")), keys, order, "_pos"))
    requests = numbered.select(*keys, F.col(at).alias("_time"), F.lit(0).alias("_last"), "_pos")
    ends = numbered.select(*keys, F.col("_ends").alias("_time"), F.lit(1).alias("_last"), "_pos")
    sort = ["_time", "_last", "_pos"]
    merged = frozen_segments(requests.unionByName(ends), keys, sort)
    counted = running_sums(merged, keys, sort, {"_next": 1 - F.col("_last")}).where("_last = 1")
    last = counted.groupBy(*keys).agg(F.max("_pos").alias("_n"))
    after = F.greatest(F.col("_next"), F.col("_pos")) + 1
    bounded = _same_keys(counted, last, list(keys), "inner").select(*keys, "_pos", F.when(after <= F.col("_n"), after).alias("_next"))
    links = checkpointed(bounded)
    granted = checkpointed(links.where("_pos = 1").select(*keys, "_pos"))

    def onward(rows: DataFrame, place: str, how: str) -> DataFrame:
        """Rows with ``_end``, the link that starts at their ``place``."""
        to = links.select(*(F.col(k).alias(f"_to_{k}") for k in keys), F.col("_pos").alias("_at"), F.col("_next").alias("_end"))
        same = reduce(lambda x, y: x & y, (rows[k].eqNullSafe(to[f"_to_{k}"]) for k in keys))
        return rows.join(to, (rows[place] == to["_at"]) & same, how).drop("_at", *(f"_to_{k}" for k in keys))

    while True:
        reached = onward(granted, "_pos", "inner").where("_end IS NOT NULL").select(*keys, F.col("_end").alias("_pos"))
        reached = checkpointed(reached)
        if reached.isEmpty():
            break
        granted = checkpointed(granted.unionByName(reached))
        links = checkpointed(onward(links, "_next", "left").select(*keys, "_pos", F.col("_end").alias("_next")))
    marked = numbered.join(granted.select(*(F.col(k).alias(f"_to_{k}") for k in keys), F.col("_pos").alias("_at")).alias("g"), reduce(
        lambda x, y: x & y, [F.col("_pos") == F.col("g._at"), *(F.col(k).eqNullSafe(F.col(f"_to_{k}")) for k in keys)]
    ), "left")
    parts = marked.groupBy(SEGMENT, *keys).agg(F.max_by("_ends", F.when(F.col("_at").isNotNull(), F.col("_pos"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    held = F.last("_last", ignorenulls=True).over(before)
    return parts.select(SEGMENT, *keys, held.alias("_held")).select(
        SEGMENT, *keys, F.col("_held").isNotNull().alias("entry_set"), F.coalesce("_held", F.lit(0)).cast("bigint").alias("entry_at"), F.lit("").alias("entry_content")
    )


def run_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, label: str, partitions: int | None = None
) -> DataFrame:
    """``df`` with the fold's label for each row."""
    frozen = frozen_segments(df, keys, order, partitions)
    entries = entry_states(frozen, keys, order, fold)
    schema = T.StructType([*frozen.schema.fields, T.StructField(label, T.StringType())])
    entered = _same_keys(frozen, entries, [SEGMENT, *keys], "left").withColumns({
        "entry_set": F.coalesce("entry_set", F.lit(False)), "entry_at": F.coalesce("entry_at", F.lit(0).cast("bigint")), "entry_content": F.coalesce("entry_content", F.lit("")),
    })
    return entered.mapInPandas(lambda batches: _labelled(batches, keys, fold, label), schema).drop(SEGMENT)


def _gate_step(state: State, row: tuple) -> tuple[str, State]:
    at, content = row
    if state is None:
        return "accepted", (int(at), content)
    if at != _EVER and at < state[0]:
        return "stale", state
    if content == state[1]:
        return "unchanged", state
    return "accepted", (int(at), content)


CHANGE_GATE = Fold(("gate_time", "gate_hash"), _gate_step, GateMap, lambda row, after: False)


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds of a timestamp column as a number. Without a zone the clock reading itself counts, so the
    session zone plays no part."""
    if df.select(column).schema[0].dataType == T.TimestampType():
        return F.unix_micros(column)
    clock = (F.hour(column) * 60 + F.minute(column)).cast("bigint") * 60_000_000
    seconds = (F.expr(f"extract(SECOND FROM {column})") * 1_000_000).cast("bigint")
    return F.unix_date(F.col(column).cast("date")).cast("bigint") * 86_400_000_000 + clock + seconds


def ordered_gate(
    changes: DataFrame,
    keys: Sequence[str] = ("repoId", "filePath"),
    order: Sequence[str] = ("arrival",),
    ts: str = "ts",
    hash_column: str = "fileHash",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``decision`` to each change, taken in arrival order per key: ``stale`` if older than the last accepted
    change, ``unchanged`` if it has the same hash, else ``accepted``. ``order`` must rank the rows of a key fully."""
    rows = changes.withColumn("gate_time", F.coalesce(micros(changes, ts), F.lit(_EVER))).withColumn(
        "gate_hash", F.coalesce(hash_column, F.lit(""))
    )
    return run_fold(rows, keys, order, CHANGE_GATE, "decision", partitions).drop("gate_time", "gate_hash")


def _lease_step(state: State, row: tuple) -> tuple[str, State]:
    at, kind, ttl = row
    held = state is not None and state[0] >= at
    if kind == "acquire":
        return ("refused", state) if held else ("granted", (int(at + ttl), ""))
    if not held:
        return "ignored", state
    if kind == "extend":
        return "extended", (int(at + ttl), "")
    return "released", None


def _requests_only(row: tuple, after: tuple) -> bool:
    return row[1] == after[1] == "acquire" and row[0] <= after[0]


LEASE = Fold(("lease_time", "kind", "lease_ttl"), _lease_step, LeaseMap, _requests_only)


def lease_grants(
    requests: DataFrame,
    keys: Sequence[str] = ("lock_key",),
    order: Sequence[str] = ("requested_at", "arrival"),
    ts: str = "requested_at",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``decision`` to lease requests (``kind``, ``ttl_seconds``) per key in time order.

    ``acquire`` is granted if no lease is held or the last one ended before; ``extend`` and ``release`` act on
    a held lease and are ignored otherwise.
    """
    rows = requests.withColumn("lease_time", F.coalesce(micros(requests, ts), F.lit(_EVER))).withColumn(
        "lease_ttl", F.coalesce(F.col("ttl_seconds").cast("bigint") * 1_000_000, F.lit(0))
    )
    fold = LEASE if order[0] == ts else LEASE._replace(linked=lambda row, after: False)
    return run_fold(rows, keys, order, fold, "decision", partitions).drop("lease_time", "lease_ttl")


def lease_status(decided: DataFrame, at: str, keys: Sequence[str] = ("lock_key",), ts: str = "requested_at") -> DataFrame:
    """State of each key's lease at the SQL timestamp ``at``: ``held`` and ``seconds_left`` (never below 0)."""
    timed = decided.withColumn("at", F.expr(at))
    moved = timed.where(F.col("decision").isin("granted", "extended", "released") & (F.col(ts) <= F.col("at")))
    ends = micros(timed, ts) + F.col("ttl_seconds").cast("bigint") * 1_000_000
    left = F.when(F.col("decision") == "released", F.lit(-1)).otherwise(ends - micros(timed, "at"))
    last = moved.withColumn("left", left).groupBy(*keys).agg(F.max_by("left", F.struct(ts, "arrival")).alias("left"))
    return last.select(
        *keys, (F.col("left") >= 0).alias("held"), (F.greatest("left", F.lit(0)) / 1_000_000).alias("seconds_left")
    )
