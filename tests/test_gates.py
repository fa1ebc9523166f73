import random

import pytest
from pyspark.sql import functions as F

from sparksymbols.operators import gates as G
from sparksymbols.operators import segments
from sparksymbols.streaming.index_stream import gate_batch


def histories(seed, count=4000, hashes=3, order="random"):
    """Half of all rows belong to one key."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(200)}"
        at = {"random": rng.randrange(500), "sorted": i, "near": i + rng.randrange(-40, 40) + 100}[order]
        rows.append((key, i, at, f"h{rng.randrange(hashes)}"))
    return rows


def gate_loop(rows, state=None):
    state, decided = dict(state or {}), {}
    for key, arrival, at, content in sorted(rows, key=lambda r: (r[0], r[1])):
        last = state.get(key)
        if last and at < last[0]:
            decided[arrival] = "stale"
        elif last and content == last[1]:
            decided[arrival] = "unchanged"
        else:
            decided[arrival] = "accepted"
            state[key] = (at, content)
    return decided, state


def changes(spark, rows):
    df = spark.createDataFrame(rows, "repoId string, arrival int, t int, fileHash string")
    return df.withColumn("ts", F.expr("timestamp_seconds(t)"))


@pytest.mark.parametrize(
    ("hashes", "order"), [(3, "random"), (2, "sorted"), (1, "sorted"), (50, "random"), (2, "near"), (1, "random")]
)
def test_gate_equals_a_loop(spark, hashes, order):
    rows = histories(7, hashes=hashes, order=order)
    gated = G.ordered_gate(changes(spark, rows), ["repoId"], ["arrival"], partitions=16).collect()
    assert {r.arrival: r.decision for r in gated} == gate_loop(rows)[0]


def test_changes_without_a_time_are_never_stale(spark):
    rng = random.Random(4)
    rows = [(k, i, None if rng.random() < 0.05 else t, h) for k, i, t, h in histories(4)]
    state, expected = {}, {}
    for key, arrival, at, content in rows:
        last = state.get(key)
        if last and at is not None and last[0] is not None and at < last[0]:
            expected[arrival] = "stale"
        elif last and content == last[1]:
            expected[arrival] = "unchanged"
        else:
            expected[arrival] = "accepted"
            state[key] = (at, content)
    gated = G.ordered_gate(changes(spark, rows), ["repoId"], ["arrival"], partitions=16).collect()
    assert {r.arrival: r.decision for r in gated} == expected


def test_a_key_with_most_rows_is_split(spark):
    frozen = segments.frozen_segments(changes(spark, histories(8)), ["repoId"], ["arrival"], 16)
    sizes = frozen.groupBy(segments.SEGMENT).count().collect()
    assert len(sizes) == 16
    assert max(r["count"] for r in sizes) < 4000 / 6
    assert [r.repoId for r in segments.spanning_keys(frozen, ["repoId"]).collect()].count("hot") == 1


@pytest.mark.parametrize(("rows", "cores", "count"), [(0, 8, 1), (10_000, 8, 1), (100_000, 8, 5), (10**6, 8, 8), (10**12, 4000, 500_000)])
def test_segment_count_follows_the_rows(rows, cores, count):
    assert segments.segment_count(rows, cores) == count


@pytest.mark.parametrize("seed", range(6))
def test_maps_equal_steps(seed):
    """A map of rows does to every state what the rows do one by one; maps of few rows are few pieces."""
    rng = random.Random(seed)
    times = lambda n: [rng.choice([G._EVER, *range(n)]) for _ in range(n)]
    for n in (0, 1, 2, 5, 40):
        changes = [(at, f"h{rng.randrange(3)}") for at in times(n)]
        requests = [(at, rng.choice(["acquire", "acquire", "extend", "release"]), rng.choice([0, 3, 20])) for at in times(n)]
        for fold, rows, contents in ((G.CHANGE_GATE, changes, ["h0", "h1", "h2", "h9"]), (G.LEASE, requests, [""])):
            made = fold.whole()
            for row in reversed(rows):
                made.prepend(row)
            for state in [None, *((at, content) for at in [G._EVER, *range(-1, n + 25)] for content in contents)]:
                end = state
                for row in rows:
                    end = fold.step(end, row)[1]
                assert made(state) == end, (rows, state)
            assert len(made) <= 2 * n + 1


def hot_requests(spark, count, ttl, kinds=("acquire",)):
    """One key only; several requests share a time."""
    rng = random.Random(ttl)
    rows = [("hot", i, i // 2, rng.choice(kinds), ttl) for i in range(count)]
    df = spark.createDataFrame(rows, "lock_key string, arrival int, t int, kind string, ttl_seconds int")
    return rows, df.withColumn("requested_at", F.expr("timestamp_seconds(t)"))


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return action(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("ttl", [1, 30, 4000])
def test_jobs_do_not_follow_the_segments(spark, ttl):
    """Leases shorter and longer than a segment of one hot key."""
    rows, df = hot_requests(spark, 1280, ttl)
    counts = []
    for partitions in (8, 32, 128):
        got, jobs = jobs_of(spark, f"lease-{ttl}-{partitions}", lambda: G.lease_grants(df, partitions=partitions).collect())  # noqa: B023
        assert {r.arrival: r.decision for r in got} == lease_loop(rows)
        counts.append(jobs)
    assert max(counts) <= min(counts) + 2 < 30, counts


@pytest.mark.parametrize(("ttl", "kinds"), [(0, ["acquire"]), (7, ["acquire"]), (300, ["acquire"]), (300, ["acquire", "extend"])])
def test_large_maps_are_followed_by_links(spark, monkeypatch, ttl, kinds):
    """Where no map is small enough to send, grants are found by doubled links, or by reading open segments."""
    monkeypatch.setattr(G, "LARGEST_MAP", 3)
    rows, df = hot_requests(spark, 600, ttl, kinds)
    plain, calls = G.linked_entries, []
    monkeypatch.setattr(G, "linked_entries", lambda *a: calls.append(1) or plain(*a))
    got = G.lease_grants(df, partitions=6).collect()
    assert {r.arrival: r.decision for r in got} == lease_loop(rows)
    assert len(calls) == (ttl > 0 and kinds == ["acquire"])


def test_batch_gate_continues_from_stored_state(spark):
    rows = histories(10)
    early, late = [r for r in rows if r[1] < 2000], [r for r in rows if r[1] >= 2000]
    _, state = gate_loop(early)
    stored = spark.createDataFrame([(k, "p", *s) for k, s in state.items()], "repoId string, filePath string, t int, fileHash string")
    batch = changes(spark, late).withColumn("filePath", F.lit("p"))
    decided = gate_batch(
        batch, stored.withColumn("ts", F.expr("timestamp_seconds(t)")), ["repoId", "filePath"], ["arrival"], 16
    )
    assert {r.arrival: r.decision for r in decided.collect()} == gate_loop(late, state)[0]


def lease_loop(rows):
    expiry, decided = {}, {}
    for key, arrival, at, kind, ttl in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        held = expiry.get(key) is not None and expiry[key] >= at
        if kind == "acquire":
            decided[arrival] = "refused" if held else "granted"
            expiry[key] = expiry.get(key) if held else at + ttl
        elif not held:
            decided[arrival] = "ignored"
        else:
            decided[arrival] = "extended" if kind == "extend" else "released"
            expiry[key] = at + ttl if kind == "extend" else None
    return decided


@pytest.mark.parametrize("ttl", [3, 50, 100_000])
@pytest.mark.parametrize("kinds", [["acquire"], ["acquire", "acquire", "extend", "release"]])
def test_lease_equals_a_loop(spark, ttl, kinds):
    rng = random.Random(ttl)
    rows = [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(200)}", i, i // 2, rng.choice(kinds), ttl) for i in range(4000)
    ]
    df = spark.createDataFrame(rows, "lock_key string, arrival int, t int, kind string, ttl_seconds int")
    granted = G.lease_grants(df.withColumn("requested_at", F.expr("timestamp_seconds(t)")), partitions=16).collect()
    assert {r.arrival: r.decision for r in granted} == lease_loop(rows)


def test_lease_status(spark):
    rows = [("a", 1, 0, "acquire", 100), ("a", 2, 50, "extend", 100), ("b", 3, 0, "acquire", 10), ("c", 4, 0, "acquire", 99), ("c", 5, 9, "release", 0)]
    df = spark.createDataFrame(rows, "lock_key string, arrival int, t int, kind string, ttl_seconds int")
    decided = G.lease_grants(df.withColumn("requested_at", F.expr("timestamp_seconds(t)")))
    status = G.lease_status(decided, "timestamp_seconds(60)").collect()
    assert {r.lock_key: (r.held, r.seconds_left) for r in status} == {"a": (True, 90.0), "b": (False, 0.0), "c": (False, 0.0)}


def test_clock_readings_ignore_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-31 02:30:00.000001' as ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(G.micros(df, "ts").alias("m")).first().m == 1711852200000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_running_sums_and_row_numbers(spark):
    rows = histories(11)
    frozen = segments.frozen_segments(changes(spark, rows), ["repoId"], ["arrival"], 16)
    summed = segments.running_sums(frozen, ["repoId"], ["arrival"], {"n": F.lit(1), "total": F.col("t")}).collect()
    seen = {}
    for r in sorted(summed, key=lambda r: r.arrival):
        n, total = seen.get(r.repoId, (0, 0))
        seen[r.repoId] = (n + 1, total + r.t)
        assert (r.n, r.total) == seen[r.repoId]


def test_lease_stream_equals_a_loop(spark, tmp_path):
    from sparksymbols.sources.tables import KeyedTable
    from sparksymbols.streaming import lease_stream as L

    rng = random.Random(12)
    kinds = ["acquire", "acquire", "extend", "release"]
    rows = [(f"k{rng.randrange(5)}", i, i, rng.choice(kinds), rng.choice([2, 9, 40])) for i in range(300)]
    df = spark.createDataFrame(rows, "lock_key string, arrival int, t int, kind string, ttl_seconds int")
    df = df.withColumn("requested_at", F.expr("timestamp_seconds(t)")).drop("t")
    for part in range(3):
        mine = df.where(f"arrival >= {part * 100} and arrival < {part * 100 + 100}")
        mine.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    leases = KeyedTable(spark, str(tmp_path / "leases"), ["lock_key"], ["requested_at", "arrival"], buckets=2)
    decisions = KeyedTable(spark, str(tmp_path / "decisions"), ["lock_key"], ["arrival"], buckets=2)
    L.lease_stream(stream, leases, decisions, str(tmp_path / "offsets"), partitions=4).awaitTermination()
    assert len(leases.batches()) == 3
    assert {r.arrival: r.decision for r in decisions.rows().collect()} == lease_loop(rows)
