"""Conversations mended turn by turn: faults found, and the cheapest edits that make the roles take turns.

Rows are sorted into range partitions; a conversation may span several. What a run of rows does to the programme of
``turn_repair`` is a table of a few small numbers, so one look at the rows at the borders of partitions, composed over
at most two runs per partition, tells each run the costs behind it and the state it starts from. Then all runs are
walked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparksymbols.llm import files, turn_repair
from sparksymbols.llm.common import join_back, small
from sparksymbols.session import checkpointed, scratch_path, ship_with_tasks

ship_with_tasks(__name__)

#: Rows of a partition; it is held by a task while it is walked.
SEGMENT_ROWS, FEWEST_ROWS = 200_000, 1_000
BLANK = r"[^\x20\x09-\x0D]"
CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
LONGEST = (1 << 63) - 1


def _or_space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by a hash of id and turn; a null counts as one space.

    Of twenty rows one is dropped, one loses its text, one its sentence ends, one is there twice and one is a user's.
    """
    key = F.concat_ws(":", _or_space(F.col("conv_id")), _or_space(F.col("turn")))
    rows = conversations.select(
        "conv_id", "turn", _or_space(F.col("role")).alias("role"), _or_space(F.col("text")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("dice"),
    ).where("dice <> 0")
    text = F.when(F.col("dice") == 1, "").when(F.col("dice") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("dice") == 4, "user").otherwise(F.col("role"))
    twice = rows.select("*", F.explode(F.when(F.col("dice") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with a digest of conversation, role and text, and the order of their turns, nulls first."""
    whole = F.concat_ws("\0", _or_space(F.col("conv_id")), F.col("role"), F.col("text"))
    return rows.select(
        "conv_id", "turn", _or_space(F.col("role")).alias("role"), _or_space(F.col("text")).alias("text"),
    ).select("*", F.sha2(whole, 256).alias("same"), F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("moment"))


def segments(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in order within range partitions, written once: ``segment, at`` and, per row, its code but for its twins.

    ``twin`` says that the row equals the one before it, the last one of the partition before included. Rows that
    repeat role and text of an earlier turn are told by the earliest turn of each repeated text, a narrow aggregate.
    Ties of turn and role go by the SHA-256 of the text; rows alike in all go to any partition.
    """
    spark = rows.sparkSession
    keyed = _keyed(rows)
    count = rows.count()
    partitions = partitions or max(1, -(-count // SEGMENT_ROWS), min(spark.sparkContext.defaultParallelism, -(-count // FEWEST_ROWS)))
    repeated = keyed.groupBy("same").agg(F.min("moment").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    small_repeated = small(repeated)
    joined = keyed.join(small_repeated, "same", "left") if small_repeated is not repeated else join_back(keyed, repeated, ["same"], "left")
    blank, later = ~F.col("text").rlike(BLANK), F.coalesce(F.col("moment") > F.col("first"), F.lit(False))
    fault = F.when(blank, "blank").when(later, "duplicate").when(F.col("text").rlike(CUT_OFF), "truncated")
    known = joined.select("conv_id", "turn", "role", "text", "same", fault.alias("fault"), F.monotonically_increasing_id().alias("any"))
    order = ["conv_id", "turn", "role", "same", "any"]
    ranged = known.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop("any")
    placed = ranged.withColumns({"segment": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    frozen = checkpointed(placed)
    ends = frozen.groupBy("segment").agg(F.max_by(F.struct("same", "turn"), "at").alias("end"))
    before = ends.select("segment", F.lag("end").over(Window.orderBy("segment")).alias("end_before"))
    return frozen.join(F.broadcast(before), "segment", "left")


def _runs(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[dict]:
    """The conversations of a partition, one after the other, each as codes, faults and, if asked for, its rows."""
    run, last, number = None, None, -1
    for batch in batches:
        data = batch.to_pydict()
        for i, conv_id in enumerate(data["conv_id"]):
            same, turn = data["same"][i], data["turn"][i]
            if last is None:
                end = data["end_before"][i]
                last = (end["same"], end["turn"]) if end else ("", None)
            twin, last = (same, turn) == last, (same, turn)
            if run is None or run["conv_id"] != conv_id:
                if run is not None:
                    yield run | {"at_end": False}
                number += 1
                run = {"conv_id": conv_id, "kind": batch.schema.field("conv_id").type, "number": number, "segment": data["segment"][i], "codes": bytearray(), "rows": [], "plan": data["plan"][i] if texts else None}
                run |= {"blank": 0, "duplicate": 0, "truncated": 0}
            fault = data["fault"][i]
            fault = "duplicate" if twin and fault != "blank" else fault
            if fault:
                run[fault] += 1
            initial = data["role"][i][:1]
            run["codes"].append(turn_repair.code_of(initial, {None: turn_repair.FINE, "truncated": turn_repair.CUT}.get(fault, turn_repair.GONE)))
            if texts:
                run["rows"].append((turn, data["role"][i], data["text"][i]))
    if run is not None:
        yield run | {"at_end": True}


def _batch(run: dict, rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = [pa.array([run["conv_id"]] * len(rows), run["kind"])]
    columns += [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", *(name for name, _ in fields)])


BORDER = [("segment", pa.int32()), ("vectors", pa.list_(pa.int32())), ("states", pa.list_(pa.int32())), ("high", pa.int32())]


def _border_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of a partition: what its rows do to costs and states."""
    for run in _runs(batches, texts=False):
        if run["number"] == 0 or run["at_end"]:
            vectors, states = turn_repair.through(bytes(run["codes"]))
            yield _batch(run, [(run["segment"], vectors, states, run["codes"][-1])], BORDER)


def _chained(parts: pd.DataFrame) -> pd.DataFrame:
    """For each run of one conversation: the vector behind it, the state before it and the code ahead of it."""
    parts = parts.sort_values("segment")
    behind, vector = [], 0
    for vectors in reversed(list(parts["vectors"])):
        behind.append(vector)
        vector = int(vectors[vector])
    behind.reverse()
    starts, state = [], turn_repair.START
    for vector, states in zip(behind, parts["states"], strict=True):
        starts.append(state)
        state = int(states[4 * vector + state])
    before = [-1, *(int(code) for code in parts["high"])][: len(parts)]
    last = [False] * (len(parts) - 1) + [True]
    plan = [{"behind": b, "start": s, "before": c, "last": end} for b, s, c, end in zip(behind, starts, before, last, strict=True)]
    return pd.DataFrame({"conv_id": parts["conv_id"], "segment": parts["segment"], "plan": plan, "n": len(parts)})


PLAN = "struct<behind: int, start: int, before: int, last: boolean>"


def planned(frozen: DataFrame) -> DataFrame:
    """Rows of ``segments`` with ``plan`` where their conversation spans partitions; there are at most two per partition."""
    kind = frozen.schema["conv_id"].dataType.simpleString()
    narrow = frozen.select("conv_id", "segment", "turn", "role", "fault", "same", "end_before")
    ends = narrow.mapInArrow(
        _border_runs, f"conv_id {kind}, segment int, vectors array<int>, states array<int>, high int"
    )
    plans = ends.groupBy("conv_id").applyInPandas(_chained, f"conv_id {kind}, segment int, plan {PLAN}, n int").where("n > 1").drop("n")
    plans = checkpointed(plans)
    keyed = plans.select(_or_space(F.col("conv_id")).alias("_id"), F.col("segment").alias("_segment"), "plan")
    same = (_or_space(frozen["conv_id"]) == keyed["_id"]) & (frozen["segment"] == keyed["_segment"])
    return frozen.join(F.broadcast(keyed), same, "left").drop("_id", "_segment")


def _mended(run: dict) -> Iterator[tuple[str, int, str, str, str]]:
    """A run walked: for each row, its letters, the state before them, and its turn, role and text; the end last."""
    plan = run["plan"] or {"behind": 0, "start": turn_repair.START, "before": -1, "last": True}
    state = plan["start"]
    for (letters, after), row in zip(turn_repair.walk(bytes(run["codes"]), plan["behind"], state), run["rows"], strict=True):
        yield letters, state, *row
        state = after
    if plan["last"]:
        yield turn_repair.closing(state), state, None, "", ""


TURNS = [("segment", pa.int32()), ("line", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, texts=True):
        out = []
        for letters, state, turn, role, text in _mended(run):
            out += [(edit, None if edit == "I" else turn, r, t) for edit, r, t in turn_repair.lines(letters, state, role, text)]
        if out:
            yield _batch(run, [(run["segment"], line, *row) for line, row in enumerate(out)], TURNS)


def repaired_turns(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mended conversations: ``conv_id, segment, line, edit, turn, role, text`` in the order of segment and line.

    ``edit`` is K for a turn kept, R for one with another role, I for an empty one put in, which has no ``turn``.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    return planned(segments(rows, partitions)).mapInArrow(
        _turns, f"conv_id {kind}, segment int, line int, edit string, turn bigint, role string, text string"
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
REPORT = [
    ("segment", pa.int32()), *((name, pa.int64()) for name in COUNTS), ("audit", pa.string()), ("sha256", pa.string()), ("path", pa.string()),
]


def _reports(folder: str):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, texts=True):
            plan, codes = run["plan"], run["codes"]
            audit, cost = [], 0

            def lines(run=run, codes=codes, audit=audit):
                nonlocal cost
                for at, (letters, state, _, role, text) in enumerate(_mended(run)):
                    audit.append(letters)
                    cost += turn_repair.cost_of(letters, codes[at] if at < len(codes) else 0)
                    for _, r, t in turn_repair.lines(letters, state, role, text):
                        yield f"{r}:{t}"

            digest = path = None
            if plan is None:
                digest = turn_repair.sha256_of(lines())
            else:
                path, stream = files.create(folder, ".turns")
                with stream:
                    n = 0
                    for n, line in enumerate(lines(), 1):
                        stream.write((b"\n" if n > 1 else b"") + line.encode("utf-8", "surrogatepass"))
                path = path if n else None
            illegal = turn_repair.illegal_pairs(codes, plan["before"] if plan and plan["before"] >= 0 else None)
            row = (run["segment"], run["blank"], run["duplicate"], run["truncated"], illegal, cost, "".join(audit), digest, path)
            yield _batch(run, [row], REPORT)

    return report


@F.pandas_udf(T.StringType())
def _joined_sha256(paths: pd.Series) -> pd.Series:
    return paths.map(turn_repair.sha256_of_sections)


def repair(rows: DataFrame, ids: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per id of ``ids``: its faults and the cheapest edits, ``audit``, that make its roles take turns.

    ``rows`` has ``conv_id, turn, role, text``. A row is ``blank`` without a character that is not white space,
    ``duplicate`` if role and text were there earlier in the conversation, ``truncated`` if it ends in no stop; the first
    that holds counts. ``gaps`` are missing numbers between the least and the largest turn, ``illegal`` adjacent
    roles that may not follow each other. Edits: keep 0, another role (user or assistant) 2, delete 3, which blank and
    duplicate rows must be, insert an empty turn 2; a truncated row that stays adds 1. Of the cheapest edits the
    ASCII-least letters are taken. ``repaired_sha256`` is of the lines ``role:text`` of the mended conversation.

    Null roles and texts count as one space, null ids are one conversation, null turns come first. Roles that start
    with none of ``s``, ``u``, ``a``, empty ones among them, must be changed or deleted. Rows alike in all are
    duplicates of each other; ties of a turn go by role and the SHA-256 of the text. Ids without rows have zeros, an
    empty audit and the hash of nothing. Other columns are not looked at. A task holds the part of a conversation that
    lies in its partition; a conversation over several is hashed from files, a megabyte at a time.
    """
    spark: SparkSession = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    folder = scratch_path(spark, "repaired")
    parts = planned(segments(rows, partitions)).mapInArrow(
        _reports(folder),
        f"conv_id {kind}, segment int, {', '.join(f'{name} bigint' for name in COUNTS)}, audit string, sha256 string, path string",
    )
    whole = parts.groupBy("conv_id").agg(
        *(F.sum(name).alias(name) for name in COUNTS),
        F.max("sha256").alias("sha256"),
        F.sort_array(F.collect_list(F.struct("segment", "audit", "path"))).alias("parts"),
    )
    paths = F.filter(F.transform("parts", lambda p: p["path"]), lambda p: p.isNotNull())
    mended = whole.select(
        "conv_id", *COUNTS, F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"),
        F.coalesce("sha256", _joined_sha256(paths)).alias("repaired_sha256"),
    )
    spread = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("conv_id").agg(F.least(F.coalesce(spread, F.lit(0)), F.lit(LONGEST)).cast("bigint").alias("gaps"))
    every = ids.select("conv_id").distinct()
    for side in (gaps, mended):
        side = side.withColumnRenamed("conv_id", "_id")
        every = every.join(side, every["conv_id"].eqNullSafe(side["_id"]), "left").drop("_id")
    zeros = [F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in ("gaps", *COUNTS)]
    return every.select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def damaged_and_repaired(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    return repair(damaged(conversations), conversations, partitions)


def _kept_sql(state: int) -> str:
    """The costs behind a row that is kept in a state, null where its role may not come."""
    kept = " ".join(f"WHEN '{turn_repair.INITIALS[i]}' THEN v{to}" for (at, i), to in turn_repair.NEXT.items() if at == state)
    return f"CASE left(role, 1) {kept} END AS k{state}"


def _plain_sql(state: int) -> str:
    """The least of deleting, keeping and another role, as cost, letters and lines."""
    grown = turn_repair.GROWN[state]
    other = f"'{turn_repair.ROLE_INTO[grown]}:' || text"
    return f"""list_min([
      {{c: v{state}.c + {turn_repair.DELETE}, a: 'D' || v{state}.a, l: v{state}.l}},
      CASE WHEN stays AND k{state} IS NOT NULL THEN {{c: k{state}.c + more, a: 'K' || k{state}.a, l: list_prepend(role || ':' || text, k{state}.l)}} END,
      CASE WHEN stays THEN {{c: v{grown}.c + {turn_repair.REROLE} + more, a: 'R' || v{grown}.a, l: list_prepend({other}, v{grown}.l)}} END
    ]) AS p{state}"""


def _grown_sql(state: int, after: str) -> str:
    line = turn_repair.ROLE_INTO[turn_repair.GROWN[state]] + ":"
    added = f"{{c: {after}.c + {turn_repair.INSERT}, a: 'I' || {after}.a, l: list_prepend('{line}', {after}.l)}}"
    return f"list_min([p{state}, {added}]) AS v{state}"


SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY b) AS crcs
  FROM (SELECT unnest(range(256)) AS b)
),
raw AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
),
rolled AS (
  SELECT raw.*, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
    lambda crc, b: xor(crc >> 8, crcs[(xor(crc, b) & 255) + 1])), 4294967295) % 20 AS dice
  FROM raw, crc_table
),
damaged AS (
  SELECT rid, conv_id, turn, CASE dice WHEN 4 THEN 'user' ELSE role END AS role,
         CASE dice WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE dice WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM rolled WHERE dice <> 0
),
placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER conv AS i, lag(role) OVER conv AS role_before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) > 1 AS again
  FROM damaged WINDOW conv AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), rid, copy)
),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{BLANK}') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN regexp_matches(text, '{CUT_OFF}') THEN 'truncated' END AS fault
  FROM placed
),
coded AS (
  SELECT *, fault IS NULL OR fault = 'truncated' AS stays, CASE fault WHEN 'truncated' THEN {turn_repair.TRUNCATED} ELSE 0 END AS more
  FROM faults
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, max(i) AS n,
         count(*) FILTER (role_before IS NOT NULL AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM coded GROUP BY conv_id
),
walked(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, {{c: 0, a: '', l: []::VARCHAR[]}}, {{c: 4, a: 'II', l: ['user:', 'assistant:']}},
         {{c: 2, a: 'I', l: ['assistant:']}}, {{c: 0, a: '', l: []::VARCHAR[]}}
  FROM counts
  UNION ALL
  SELECT conv_id, i, {_grown_sql(0, "v2")}, {_grown_sql(1, "v2")}, v2, v3
  FROM (
    SELECT conv_id, i, p0, p1, {_grown_sql(2, "p3")}, {_grown_sql(3, "p2")}
    FROM (
      SELECT conv_id, i, {", ".join(_plain_sql(state) for state in range(4))}
      FROM (
        SELECT r.conv_id, r.i, role, text, stays, more, v0, v1, v2, v3, {", ".join(_kept_sql(state) for state in range(4))}
        FROM walked w JOIN coded r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i - 1
      )
    )
  )
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0)::BIGINT AS cost,
       coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN walked ON walked.conv_id IS NOT DISTINCT FROM ids.conv_id AND walked.i = 1
"""
