"""Joins, gates, leases, mutations and streams over the event, order and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksymbols import bindings as B
from sparksymbols.operators import commits as C
from sparksymbols.operators import extract
from sparksymbols.operators import gates as G
from sparksymbols.operators import joins as J
from sparksymbols.operators import metrics as A
from sparksymbols.operators import mutations as M
from sparksymbols.operators.rules import Rule, RuleRegistry
from sparksymbols.plans import registry as R
from sparksymbols.plans.lookups import CUT, KEYS, LATEST, events_table
from sparksymbols.plans.registry import query
from sparksymbols.session import checkpointed, scratch_path
from sparksymbols.sources import landing
from sparksymbols.sources.tables import KeyedTable
from sparksymbols.streaming import index_stream as T

BEFORE, AFTER = f"ts < {CUT}", f"ts >= {CUT}"
SQL_BEFORE, SQL_AFTER = f"ts < TIMESTAMP '{R.CUT}'", f"ts >= TIMESTAMP '{R.CUT}'"
HOURLY = ["repoId", "filePath", "hour"]
NARROW = ["event_id", *KEYS, "fileHash", "ts"]


def hourly_changes(spark: SparkSession, folder: str) -> DataFrame:
    return B.events_as_changes(spark, folder).select(*NARROW, F.hour("ts").alias("hour"))


HOURLY_SQL = f"{R.CHANGES}, hourly AS (SELECT *, CAST(hour(ts) AS INT) AS hour FROM changes)"


def _snapshot_sql(name: str, test: str) -> str:
    return (
        f"{name} AS (SELECT repoId, filePath, hour, fileHash FROM hourly WHERE {test}"
        " QUALIFY row_number() OVER (PARTITION BY repoId, filePath, hour ORDER BY ts DESC, event_id DESC) = 1)"
    )


DIFF_SQL = (
    f"{HOURLY_SQL}, {_snapshot_sql('old', SQL_BEFORE)}, {_snapshot_sql('new', SQL_AFTER)},"
    " diff AS (SELECT repoId, filePath, hour, CASE WHEN old.fileHash IS NULL THEN 'A' WHEN new.fileHash IS NULL THEN 'D'"
    " WHEN old.fileHash <> new.fileHash THEN 'M' END AS change_type"
    " FROM old FULL JOIN new USING (repoId, filePath, hour))"
)


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    changes = hourly_changes(spark, folder)
    before, after = (M.latest_per_key(changes.where(F.expr(t)), HOURLY, ["ts", "event_id"]) for t in (BEFORE, AFTER))
    return J.snapshot_diff(before, after, HOURLY)


@query("J1_snapshot_diff", f"WITH {DIFF_SQL} SELECT * FROM diff WHERE change_type IS NOT NULL")
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots(spark, folder).select(*HOURLY, "change_type")


# The stored table: the last row of each key up to a later date, so that changes are older, equal or newer.
STORED_UNTIL = "2024-01-21 00:00:00"
GATE_SQL = (
    f"{R.CHANGES}, stored AS (SELECT repoId, filePath, fileHash AS stored_hash, ts AS stored_ts FROM changes"
    f" WHERE ts < TIMESTAMP '{STORED_UNTIL}' AND filePath <> 'signup' QUALIFY row_number() OVER"
    " (PARTITION BY repoId, filePath ORDER BY ts DESC, event_id DESC) = 1),"
    " joined AS (SELECT * FROM changes LEFT JOIN stored USING (repoId, filePath))"
)


def gated(spark: SparkSession, folder: str) -> DataFrame:
    changes = B.events_as_changes(spark, folder).select(*NARROW)
    known = changes.where(F.expr(f"ts < timestamp_ntz'{STORED_UNTIL}' and filePath <> 'signup'"))
    stored = M.latest_per_key(known, KEYS, ["ts", "event_id"])
    return J.with_stored(changes, stored, KEYS, ["event_id"], "fileHash", "ts")


@query(
    "J2_unchanged_gate",
    f"WITH {GATE_SQL} SELECT event_id, repoId, filePath FROM joined WHERE stored_hash IS NULL OR stored_hash <> fileHash",
)
def unchanged_gate(spark: SparkSession, folder: str) -> DataFrame:
    return J.unchanged_gate(gated(spark, folder)).select("event_id", *KEYS)


@query(
    "J3_stale_gate",
    f"WITH {GATE_SQL} SELECT event_id, repoId, filePath FROM joined WHERE stored_ts IS NULL OR ts >= stored_ts",
)
def stale_gate(spark: SparkSession, folder: str) -> DataFrame:
    return J.stale_gate(gated(spark, folder)).select("event_id", *KEYS)


@query(
    "J4_change_gate",
    f"WITH {GATE_SQL} SELECT event_id, repoId, filePath, CASE WHEN ts < stored_ts THEN 'stale'"
    " WHEN fileHash = stored_hash THEN 'unchanged' WHEN stored_hash IS NULL THEN 'new' ELSE 'changed' END AS reason"
    " FROM joined",
)
def change_gate(spark: SparkSession, folder: str) -> DataFrame:
    return J.gate_reason(gated(spark, folder)).select("event_id", *KEYS, "reason")


@query(
    "J5_missing_only",
    f"WITH {HOURLY_SQL} SELECT event_id, repoId, filePath, hour FROM hourly ANTI JOIN"
    f" (SELECT * FROM hourly WHERE {SQL_BEFORE}) stored USING (repoId, filePath, hour)",
)
def missing_only(spark: SparkSession, folder: str) -> DataFrame:
    changes = hourly_changes(spark, folder)
    missing = J.missing_only(changes, changes.where(F.expr(BEFORE)), HOURLY, ["event_id"])
    return missing.select("event_id", *HOURLY)


@query(
    "J6_initial_vs_commit",
    f"WITH {HOURLY_SQL}, {_snapshot_sql('old', SQL_BEFORE)} SELECT repoId, filePath, hour, fileHash FROM old ANTI JOIN"
    f" (SELECT * FROM hourly WHERE {SQL_AFTER}) newer USING (repoId, filePath, hour)",
)
def initial_vs_commit(spark: SparkSession, folder: str) -> DataFrame:
    changes = hourly_changes(spark, folder)
    initial = M.latest_per_key(changes.where(F.expr(BEFORE)), HOURLY, ["ts", "event_id"])
    kept = J.initial_without_changed(initial, changes.where(F.expr(AFTER)), HOURLY)
    return kept.select(*HOURLY, "fileHash")


@query(
    "J7_cascade_delete",
    f"WITH {R.LINES}, doomed AS (SELECT o_orderkey AS orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"
    " SELECT 'repository' AS kind, o_orderkey AS orderkey, -1 AS linenumber, CAST(-1 AS BIGINT) AS partkey FROM orders"
    " WHERE o_orderpriority <> '1-URGENT' UNION ALL"
    " SELECT 'file', orderkey, linenumber, partkey FROM lines ANTI JOIN doomed USING (orderkey)",
)
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    orders = B.load(spark, folder, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderpriority")
    files = B.lineitem_as_files(spark, folder).select("orderkey", "linenumber", "partkey", "suppkey")
    doomed = orders.where(F.col("o_orderpriority") == "1-URGENT")
    repositories, kept = J.cascade_delete(orders, files, doomed, "orderkey", ["linenumber", "partkey", "suppkey"])
    nothing = [F.lit(-1).alias("linenumber"), F.lit(-1).cast("bigint").alias("partkey")]
    return repositories.select(F.lit("repository").alias("kind"), "orderkey", *nothing).union(
        kept.select(F.lit("file").alias("kind"), "orderkey", "linenumber", "partkey")
    )


@query(
    "A5_commit_summary",
    f"WITH {DIFF_SQL} SELECT repoId, count(*) FILTER (WHERE change_type = 'A') AS added,"
    " count(*) FILTER (WHERE change_type = 'D') AS deleted, count(*) FILTER (WHERE change_type = 'M') AS modified,"
    " count(change_type) AS changed FROM diff WHERE change_type IS NOT NULL GROUP BY repoId",
)
def commit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.commit_summary(snapshots(spark, folder), ["repoId"])


@query("W6_changed_set", f"WITH {DIFF_SQL} SELECT DISTINCT repoId, filePath, hour FROM diff WHERE change_type IS NOT NULL")
def changed_set(spark: SparkSession, folder: str) -> DataFrame:
    return J.changed_set(snapshots(spark, folder), HOURLY)


@query(
    "A6_repo_rollup",
    f'WITH {R.CHANGES}, latest AS ({LATEST}) SELECT repoId, count(*) AS "processedFiles",'
    ' arg_max(fileHash, (ts, event_id)) AS "lastProcessedCommit", max(ts) AS "lastProcessedCommitTimestamp"'
    " FROM latest GROUP BY repoId",
)
def repo_rollup(spark: SparkSession, folder: str) -> DataFrame:
    index = M.latest_per_key(B.events_as_changes(spark, folder).select(*NARROW), KEYS, ["ts", "event_id"])
    return A.repo_rollup(index, "repoId", "fileHash", "ts", "event_id")


JSON_RULES = RuleRegistry([Rule("json", 1, '"k": (\\d+)', "variable")])


@query(
    "E3_commit_pipeline",
    f"WITH {DIFF_SQL.replace('SELECT repoId, filePath, hour, fileHash FROM hourly', 'SELECT repoId, filePath, hour, fileHash, content, ts, event_id FROM hourly')},"
    " changed AS (SELECT repoId, count(*) FILTER (WHERE change_type = 'A') AS added, count(*) FILTER (WHERE change_type = 'D') AS deleted,"
    " count(*) FILTER (WHERE change_type = 'M') AS modified FROM diff WHERE change_type IS NOT NULL GROUP BY repoId),"
    " index AS (SELECT new.repoId, new.fileHash, if(old.fileHash = new.fileHash, old.ts, new.ts) AS ts,"
    " if(old.fileHash = new.fileHash, old.event_id, new.event_id) AS event_id, new.content"
    " FROM new LEFT JOIN old USING (repoId, filePath, hour)),"
    " rolled AS (SELECT repoId, count(*) AS processed, arg_max(fileHash, (ts, event_id)) AS last_hash, max(ts) AS last_ts,"
    " sum(CAST(regexp_extract(content, '\"k\": (\\d+)', 1) AS BIGINT))::BIGINT AS named FROM index GROUP BY repoId)"
    ' SELECT repoId, coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted, coalesce(modified, 0) AS modified,'
    ' coalesce(processed, 0) AS "processedFiles", last_hash AS "lastProcessedCommit", last_ts AS "lastProcessedCommitTimestamp",'
    " coalesce(named, 0) AS named FROM rolled FULL JOIN changed USING (repoId)",
)
def commit_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """One commit from end to end: difference, gate, parsing of what passed, upserts and deletes, summary and roll-up."""
    changes = B.events_as_changes(spark, folder).select(*NARROW, "content", F.hour("ts").alias("hour"))
    before, after = (M.latest_per_key(changes.where(F.expr(t)), HOURLY, ["ts", "event_id"]) for t in (BEFORE, AFTER))

    def parse(files: DataFrame) -> DataFrame:
        return extract.dispatch(files.withColumn("language", F.lit("json")), JSON_RULES)

    index = checkpointed(parse(before).drop("content", "language"))
    commit = C.process_commit(index, before, after, parse, HOURLY, ["ts", "event_id"], ["event_id"])
    commit = commit._replace(index=checkpointed(commit.index), diff=checkpointed(commit.diff))
    report = C.commit_report(commit, "repoId", "fileHash", "ts", "event_id")
    named = commit.index.select("repoId", F.explode("symbols.name").alias("name")).groupBy("repoId").agg(F.sum(F.col("name").cast("bigint")).alias("named"))
    return report.join(named, "repoId", "left").select(
        "repoId", "added", "deleted", "modified", "processedFiles", "lastProcessedCommit", "lastProcessedCommitTimestamp",
        F.coalesce("named", F.lit(0)).alias("named"),
    )


@query("W3_latest_per_key", f"WITH {R.CHANGES} {LATEST}")
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = M.latest_per_key(B.events_as_changes(spark, folder).select(*NARROW), KEYS, ["ts", "event_id"])
    return rows.select(*KEYS, "event_id", "fileHash", "ts")


@query("M1_upsert", f"WITH {R.CHANGES} {LATEST}")
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    changes = B.events_as_changes(spark, folder).select(*NARROW)
    base = M.latest_per_key(changes.where(F.expr(BEFORE)), KEYS, ["ts", "event_id"])
    return M.upsert(base, changes.where(F.expr(AFTER)), KEYS, ["ts", "event_id"]).select(*KEYS, "event_id", "fileHash", "ts")


@query(
    "M2_patch",
    f"WITH {R.REPOSITORIES}, patches AS (SELECT CAST(orderkey AS VARCHAR) AS repoId, max(partkey) AS last_part FROM lines"
    " WHERE outcome = 'failed' GROUP BY orderkey) SELECT repoId, CASE WHEN last_part IS NULL THEN status ELSE 'paused' END"
    " AS status, coalesce(last_part, totalFiles) AS totalFiles, CASE WHEN last_part IS NULL THEN lastUpdated ELSE"
    " TIMESTAMP '2025-01-01' END AS lastUpdated FROM repositories LEFT JOIN patches USING (repoId)",
)
def patch(spark: SparkSession, folder: str) -> DataFrame:
    repositories = B.orders_as_repositories(spark, folder)
    failed = B.lineitem_as_files(spark, folder).where(F.col("outcome") == "failed")
    patches = failed.groupBy(F.col("orderkey").cast("string").alias("repoId")).agg(
        F.lit("paused").alias("status"), F.max("partkey").alias("totalFiles")
    )
    stamp = {"lastUpdated": F.expr("timestamp_ntz'2025-01-01 00:00:00'")}
    return M.patch(repositories, patches, ["repoId"], stamp).select("repoId", "status", "totalFiles", "lastUpdated")


DOOMED_SQL = (
    "doomed AS (SELECT DISTINCT CAST(user_id + 10 AS VARCHAR) AS repoId, event_type AS filePath FROM events"
    " WHERE event_type IN ('error', 'signup'))"
)


@query(
    "M3_delete_key",
    f"WITH {R.CHANGES}, latest AS ({LATEST}), {DOOMED_SQL} SELECT repoId, filePath, 'kept' AS outcome FROM latest"
    " ANTI JOIN doomed USING (repoId, filePath) UNION ALL SELECT repoId, filePath,"
    " CASE WHEN event_id IS NULL THEN 'not found' ELSE 'deleted' END FROM doomed LEFT JOIN latest USING (repoId, filePath)",
)
def delete_key(spark: SparkSession, folder: str) -> DataFrame:
    """Delete through the stored table, with a report of the keys that were there."""
    table, changes = events_table(spark, folder, "delete")
    table.append(changes.select(*NARROW))
    doomed = B.load(spark, folder, "events").where(F.col("event_type").isin("error", "signup"))
    doomed = doomed.select((F.col("user_id") + 10).cast("string").alias("repoId"), F.col("event_type").alias("filePath"))
    report = M.delete_report(table.current(), doomed, KEYS)
    report = report.select(*KEYS, F.when(F.col("found"), "deleted").otherwise("not found").alias("outcome"))
    report = checkpointed(report)
    table.delete(doomed)
    return table.current().select(*KEYS, F.lit("kept").alias("outcome")).union(report)


@query(
    "M4_status_transition",
    f"WITH {R.REPOSITORIES} SELECT repoId, CASE WHEN status <> 'processing' THEN status WHEN totalFiles = 0 THEN 'failed'"
    " WHEN processedFiles + failedFiles >= totalFiles THEN 'completed' ELSE status END AS status,"
    " CASE WHEN status = 'processing' AND totalFiles = 0 THEN 'no files' END AS errorMessage FROM repositories",
)
def status_transition(spark: SparkSession, folder: str) -> DataFrame:
    """Files that failed do not keep a load from completing; a load that found nothing broke."""
    broke = F.when(F.col("totalFiles") == 0, "no files")
    return M.status_transition(B.orders_as_repositories(spark, folder), broke).select("repoId", "status", "errorMessage")


@query(
    "A7_batch_progress",
    f"""WITH {R.LINES}, placed AS (SELECT *, row_number() OVER w AS position,
         sum(CASE WHEN outcome = 'processed' THEN 1 ELSE 0 END) OVER w AS done,
         sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER w AS bad,
         count(*) OVER (PARTITION BY suppkey) AS total
       FROM lines WINDOW w AS (PARTITION BY suppkey ORDER BY orderkey, linenumber, partkey ROWS UNBOUNDED PRECEDING))
       SELECT suppkey, (position - 1) // 50 AS batch, count(*) AS batch_files, CAST(max(done) AS BIGINT) AS processed,
         CAST(max(bad) AS BIGINT) AS failed, CAST(floor(max(done) / max(total) * 100) AS INT) AS percent
       FROM placed GROUP BY suppkey, batch""",
)
def batch_progress(spark: SparkSession, folder: str) -> DataFrame:
    return A.batch_progress(B.lineitem_as_files(spark, folder), "suppkey", ["orderkey", "linenumber", "partkey"])


@query(
    "A8_size_route",
    "SELECT CAST(user_id AS VARCHAR) AS repoId, count(*) AS files, CASE WHEN count(*) <= 65 THEN 'direct' ELSE 'batch' END"
    " AS route FROM events GROUP BY user_id",
)
def size_route(spark: SparkSession, folder: str) -> DataFrame:
    return A.size_route(B.events_as_changes(spark, folder), "repoId", 65)


def _gate_sql(arrival: str) -> str:
    return f"""{R.CHANGES}, placed AS (SELECT *, row_number() OVER (PARTITION BY repoId, filePath ORDER BY {arrival}, event_id)
         AS place FROM changes),
       walk AS (SELECT event_id, repoId, filePath, place, 'accepted' AS decision, ts AS last_ts, fileHash AS last_hash
         FROM placed WHERE place = 1
         UNION ALL SELECT p.event_id, p.repoId, p.filePath, p.place,
           CASE WHEN p.ts < w.last_ts THEN 'stale' WHEN p.fileHash = w.last_hash THEN 'unchanged' ELSE 'accepted' END,
           CASE WHEN p.ts >= w.last_ts AND p.fileHash <> w.last_hash THEN p.ts ELSE w.last_ts END,
           CASE WHEN p.ts >= w.last_ts AND p.fileHash <> w.last_hash THEN p.fileHash ELSE w.last_hash END
         FROM walk w JOIN placed p ON p.repoId = w.repoId AND p.filePath = w.filePath AND p.place = w.place + 1)"""


ARRIVAL = "(event_id * 7919) % 10007"


@query("T2_ordered_gate", f"WITH RECURSIVE {_gate_sql(ARRIVAL)} SELECT event_id, repoId, filePath, decision FROM walk")
def ordered_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Changes that arrive out of order."""
    changes = B.events_as_changes(spark, folder).select(*NARROW, F.expr(ARRIVAL).alias("arrival"))
    return G.ordered_gate(changes, KEYS, ["arrival", "event_id"]).select("event_id", *KEYS, "decision")


@query(
    "T1_change_stream_index",
    f"WITH RECURSIVE {_gate_sql('event_id')} SELECT event_id, repoId, filePath, last_hash AS fileHash FROM walk"
    " WHERE decision = 'accepted' QUALIFY row_number() OVER (PARTITION BY repoId, filePath ORDER BY place DESC) = 1",
)
def change_stream_index(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream of changes into a stored table; the table's final state."""
    schema = B.load(spark, folder, "events").schema
    events = landing.stream_changes(spark, folder, schema=schema, name_filter="events.parquet")
    table = KeyedTable(spark, scratch_path(spark, "stream"), KEYS, ["event_id"], buckets=4)
    stream = T.index_stream(B.changes_from_events(events), table, ["event_id"], scratch_path(spark, "offsets"))
    stream.awaitTermination()
    return table.current().select("event_id", *KEYS, "fileHash")


# Events from the middle on are streamed; cheap ones are deletions.
MIDDLE, KIND = "(SELECT max(event_id) // 2 FROM events)", "CASE WHEN value < 15 THEN 'D' ELSE 'M' END"


@query(
    "T1_load_then_stream",
    f"""WITH RECURSIVE marked AS (SELECT event_id, CAST(user_id AS VARCHAR) AS repoId, event_type AS filePath, ts,
         CASE WHEN event_id > {MIDDLE} AND {KIND} = 'D' THEN 'deleted' ELSE sha256(props) END AS fileHash,
         event_id > {MIDDLE} AS streamed FROM events),
       loaded AS (SELECT * FROM marked WHERE NOT streamed
         QUALIFY row_number() OVER (PARTITION BY repoId, filePath ORDER BY event_id DESC) = 1),
       placed AS (SELECT *, row_number() OVER (PARTITION BY repoId, filePath ORDER BY event_id) AS place
         FROM (SELECT * FROM loaded UNION ALL SELECT * FROM marked WHERE streamed)),
       walk AS (SELECT event_id, repoId, filePath, place, ts AS last_ts, fileHash AS last_hash, true AS taken FROM placed WHERE place = 1
         UNION ALL SELECT p.event_id, p.repoId, p.filePath, p.place,
           CASE WHEN p.ts >= w.last_ts AND p.fileHash <> w.last_hash THEN p.ts ELSE w.last_ts END,
           CASE WHEN p.ts >= w.last_ts AND p.fileHash <> w.last_hash THEN p.fileHash ELSE w.last_hash END,
           p.ts >= w.last_ts AND p.fileHash <> w.last_hash
         FROM walk w JOIN placed p ON p.repoId = w.repoId AND p.filePath = w.filePath AND p.place = w.place + 1)
       SELECT event_id, repoId, filePath, last_hash AS fileHash FROM (SELECT * FROM walk WHERE taken
         QUALIFY row_number() OVER (PARTITION BY repoId, filePath ORDER BY place DESC) = 1) WHERE last_hash <> 'deleted'""",
)
def load_then_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A first load, then a stream in several batches with deletions and late changes, then the stream once more from
    its beginning, in one batch, with a new checkpoint folder, which changes nothing."""
    events = B.load(spark, folder, "events")
    middle, last = events.agg(F.expr("max(event_id) div 2"), F.max("event_id")).first()
    rows = B.changes_from_events(events, "value").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    table = KeyedTable(spark, scratch_path(spark, "loaded"), KEYS, ["event_id"], buckets=4)
    table.append(rows.where(F.col("event_id") <= middle).select(*NARROW))
    feed = scratch_path(spark, "feed")
    streamed = rows.where(F.col("event_id") > middle).select(*NARROW, F.when(F.col("value") < 15, "D").otherwise("M").alias("kind"))

    def follow(offsets: str) -> None:
        changes = landing.stream_changes(spark, feed, schema=streamed.schema)
        T.index_stream(changes, table, ["event_id"], offsets, compact_every=2).awaitTermination()

    # All tasks write a part; the stream goes on after each, so that a part is a batch whatever the number of its files.
    offsets, step = scratch_path(spark, "offsets"), (last - middle) // 3 + 1
    for start in range(middle, last, step):
        part = streamed.where((F.col("event_id") > start) & (F.col("event_id") <= start + step))
        part.write.mode("append").parquet(feed)
        follow(offsets)
    follow(scratch_path(spark, "offsets"))
    return table.current().select("event_id", *KEYS, "fileHash")


LEASE_HOURS = 6


def lease_requests(spark: SparkSession, folder: str, kind: Column) -> DataFrame:
    return B.load(spark, folder, "events").select(
        F.col("event_id").alias("arrival"),
        F.col("user_id").cast("string").alias("lock_key"),
        F.col("ts").alias("requested_at"),
        kind.alias("kind"),
        F.lit(LEASE_HOURS * 3600).alias("ttl_seconds"),
    )


def _lease_sql(kind: str) -> str:
    ttl = f"INTERVAL {LEASE_HOURS} HOUR"
    step = """CASE WHEN p.kind = 'acquire' THEN CASE WHEN w.expires >= p.ts THEN 'refused' ELSE 'granted' END
           WHEN w.expires >= p.ts THEN CASE p.kind WHEN 'extend' THEN 'extended' ELSE 'released' END ELSE 'ignored' END"""
    return f"""placed AS (SELECT event_id AS arrival, CAST(user_id AS VARCHAR) AS lock_key, ts, {kind} AS kind,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
       walk AS (SELECT arrival, lock_key, place, ts, CASE kind WHEN 'acquire' THEN 'granted' ELSE 'ignored' END AS decision,
           CASE kind WHEN 'acquire' THEN ts + {ttl} END AS expires FROM placed WHERE place = 1
         UNION ALL SELECT p.arrival, p.lock_key, p.place, p.ts, {step},
           CASE {step} WHEN 'granted' THEN p.ts + {ttl} WHEN 'extended' THEN p.ts + {ttl} WHEN 'released' THEN NULL
           ELSE w.expires END
         FROM walk w JOIN placed p ON p.lock_key = w.lock_key AND p.place = w.place + 1)"""


@query("T3_lease_grant", f"WITH RECURSIVE {_lease_sql(repr('acquire'))} SELECT arrival, lock_key, decision FROM walk")
def lease_grant(spark: SparkSession, folder: str) -> DataFrame:
    requests = lease_requests(spark, folder, F.lit("acquire"))
    return G.lease_grants(requests).select("arrival", "lock_key", "decision")


KIND_SQL = "CASE event_type WHEN 'error' THEN 'release' WHEN 'view' THEN 'extend' ELSE 'acquire' END"


@query(
    "T4_lease_status",
    f"WITH RECURSIVE {_lease_sql(KIND_SQL)} SELECT lock_key, coalesce(expires >= TIMESTAMP '{R.CUT}', false) AS held,"
    f" greatest(coalesce(epoch_us(expires) - epoch_us(TIMESTAMP '{R.CUT}'), 0), 0) / 1000000 AS seconds_left FROM walk"
    f" WHERE decision IN ('granted', 'extended', 'released') AND ts <= TIMESTAMP '{R.CUT}'"
    " QUALIFY row_number() OVER (PARTITION BY lock_key ORDER BY place DESC) = 1",
)
def lease_status(spark: SparkSession, folder: str) -> DataFrame:
    """Leases that are taken, extended and released; who holds one at a given time."""
    kind = F.when(F.col("event_type") == "error", "release").when(F.col("event_type") == "view", "extend").otherwise("acquire")
    return G.lease_status(G.lease_grants(lease_requests(spark, folder, kind)), CUT)


OUTCOME_SQL = "CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 10 THEN 'skipped' ELSE 'processed' END"


@query(
    "T5_live_progress",
    f"WITH e AS (SELECT CAST(user_id AS VARCHAR) AS repoId, {OUTCOME_SQL} AS outcome FROM events) SELECT repoId,"
    " count(*) AS total, count(*) FILTER (WHERE outcome = 'processed') AS processed, count(*) FILTER (WHERE outcome ="
    " 'failed') AS failed, count(*) FILTER (WHERE outcome = 'skipped') AS skipped FROM e GROUP BY repoId",
)
def live_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Running counts over the event stream; the state after the last batch."""
    schema = B.load(spark, folder, "events").schema
    events = landing.stream_changes(spark, folder, schema=schema, name_filter="events.parquet")
    rows = events.withColumn("repoId", F.col("user_id").cast("string"))
    path = scratch_path(spark, "progress")
    T.write_progress(T.live_progress(rows, ["repoId"], F.expr(OUTCOME_SQL)), path, scratch_path(spark, "offsets")).awaitTermination()
    return T.read_progress(spark, path, ["repoId"])
