import pytest
from pyspark.sql import functions as F

from sparksymbols.operators import extract
from sparksymbols.sources import landing
from sparksymbols.sources.tables import KeyedTable
from sparksymbols.streaming import index_stream as T

KEYS = ["repoId", "filePath"]
SCHEMA = "event_id int, repoId string, filePath string, content string, t int"


def changes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("ts", F.expr("timestamp_seconds(t)")).withColumn("fileHash", F.sha2("content", 256))


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "index"), KEYS, ["event_id"], buckets=4)


def state(table):
    return {(r.repoId, r.filePath): r.content for r in table.current().collect()}


def test_a_load_done_twice_gives_the_same_table(spark, table):
    rows = changes(spark, [(1, "r", "a/b", "x", 1), (2, "r", "a_b", "y", 1)])
    table.append(rows)
    once = state(table)
    table.append(rows)
    assert state(table) == once == {("r", "a/b"): "x", ("r", "a_b"): "y"}
    assert table.rows().count() == 4


def test_empty_batch_is_a_success(spark, table):
    assert table.write(changes(spark, []), 0) is True
    assert table.batches() == [0]
    assert table.rows() is None
    table.append(changes(spark, [(1, "r", "a", "x", 1)]))
    assert state(table) == {("r", "a"): "x"}


def test_delete_and_compact(spark, table):
    table.append(changes(spark, [(1, "r", "a", "x", 1), (2, "r", "b", "y", 1), (3, "s", "a", "z", 1)]))
    table.delete(spark.createDataFrame([("r", "a"), ("r", "none")], "repoId string, filePath string"))
    assert state(table) == {("r", "b"): "y", ("s", "a"): "z"}
    table.compact()
    assert table.rows().count() == 3 and state(table) == {("r", "b"): "y", ("s", "a"): "z"}
    table.append(changes(spark, [(4, "r", "a", "again", 2), (5, "s", "a", "new", 2)]))
    assert state(table) == {("r", "a"): "again", ("r", "b"): "y", ("s", "a"): "new"}
    assert table.batches() == [0, 1, 2]
    assert [r.filePath for r in table.lookup("r").orderBy("filePath").collect()] == ["a", "b"]


def test_a_batch_that_was_not_committed_does_not_count(spark, table):
    table.append(changes(spark, [(1, "r", "a", "x", 1)]))
    spark.createDataFrame([(1,)], "junk int").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{table.path}/batch=1/mark=lost.0"
    )
    assert table.batches() == [0]
    assert state(table) == {("r", "a"): "x"}


def test_look_up_reads_one_bucket(spark, table):
    table.append(changes(spark, [(i, f"r{i}", "a", "x", 1) for i in range(20)]))
    found = table.lookup("r7")
    assert [r.repoId for r in found.collect()] == ["r7"]
    assert "PartitionFilters: [isnotnull(repo_bucket" in found._jdf.queryExecution().executedPlan().toString()


def test_narrow_state_reads_narrow_columns(spark, table):
    table.append(changes(spark, [(1, "r", "a", "x", 1)]))
    plan = table.current("ts", "fileHash")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("content" not in line.split("ReadSchema")[1] for line in scans)


def gate_loop(rows):
    kept = {}
    for event_id, repo, path, content, at in sorted(rows):
        last = kept.get((repo, path))
        if not last or (at >= last[0] and content != last[1]):
            kept[repo, path] = (at, content, event_id)
    return {k: v[2] for k, v in kept.items()}


@pytest.fixture
def feed(spark, tmp_path):
    """Changes in five files, in arrival order, some late and some unchanged."""
    rows = [(i, f"r{i % 3}", f"p{i % 2}", f"c{i * 7 % 4}", (i * 37) % 50) for i in range(200)]
    for part in range(5):
        df = changes(spark, rows[part * 40 : part * 40 + 40]).drop("t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return rows, str(tmp_path / "feed")


def test_stream_equals_a_loop_and_survives_a_replay(spark, feed, table, tmp_path):
    rows, path = feed
    schema = spark.read.parquet(path).schema
    stream = landing.stream_changes(spark, path, schema=schema, files_per_batch=1)
    T.index_stream(stream, table, ["event_id"], str(tmp_path / "offsets"), compact_every=2).awaitTermination()
    expected = gate_loop(rows)
    assert len(table.batches()) > 1
    assert {(r.repoId, r.filePath): r.event_id for r in table.current().collect()} == expected
    assert table.rows().agg(F.min("batch")).first()[0] > 0
    # The same batches offered again, as after a restart before the offsets were stored.
    (stream,) = {mark.rpartition(".")[0] for mark in table.marks()}
    before, marks = table.rows().count(), table.marks()
    for n, part in enumerate(range(0, 200, 40)):
        if f"{stream}.{n}" in marks:
            T.index_batch(changes(spark, rows[part : part + 40]), n, table, ["event_id"], stream=stream)
    assert table.rows().count() == before and table.marks() == marks


def test_deleted_keys_stay_deleted(spark, table):
    """A change older than the deletion does not bring a row back, not even after compaction; a later one does."""
    def change(n, path, content, t, kind="M"):
        rows = changes(spark, [(n, "r", path, content, t)]).withColumn("kind", F.lit(kind))
        T.index_batch(rows, n, table, ["event_id"])

    table.append(changes(spark, [(1, "r", "a", "x", 100), (2, "r", "b", "y", 100)]))
    change(3, "a", "x", 120, "D")
    table.delete(spark.createDataFrame([("r", "b")], "repoId string, filePath string"))
    assert state(table) == {}
    change(4, "a", "late", 110)
    change(5, "b", "late", 50)
    assert state(table) == {}
    table.compact()
    change(6, "a", "later", 119)
    assert state(table) == {}
    change(7, "a", "x", 121)
    change(8, "never", "z", 10, "D")
    change(9, "never", "z", 9)
    assert state(table) == {("r", "a"): "x"}
    table.compact(forget_before=F.expr("timestamp_seconds(1000)"))
    assert table.rows().count() == 1


def test_batches_of_other_origin_do_not_stand_for_those_of_a_stream(spark, table):
    for _ in range(3):
        table.append(changes(spark, [(1, "r", "a", "x", 1)]))
    T.index_batch(changes(spark, [(2, "r", "a", "new", 2), (3, "r", "c", "z", 2)]), 0, table, ["event_id"])
    assert state(table) == {("r", "a"): "new", ("r", "c"): "z"}


def test_reads_cost_the_asked_buckets_and_folders_stay_few(spark, table):
    rows = changes(spark, [(i, f"r{i}", "a", "x", 1) for i in range(40)])
    table.append(rows)
    for n in range(60):
        table.append(rows.limit(1), f"s.{n}")
        if n % 10 == 9:
            table.compact()
    assert len(table.batches()) <= 24 and "s.59" in table.marks()
    plan = table.current("ts", keys=rows.where("repoId = 'r7'"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo_bucket" in plan or "PartitionFilters: [repo_bucket" in plan
    assert state(table).keys() == {(f"r{i}", "a") for i in range(40)}


def test_stream_of_source_files(spark, tmp_path):
    rows = [
        (1, "r", "src/a.ts", "export const a = 1;", 1),
        (2, "r", "src/a.ts", "export const a = 1; export const b = 2;", 2),
        (3, "r", "src/a.ts", "export const old = 1;", 1),
        (4, "r", "src/b.py", "def f(): pass", 1),
    ]
    changes(spark, rows).coalesce(1).write.parquet(str(tmp_path / "feed"))
    schema = spark.read.parquet(str(tmp_path / "feed")).schema
    table = KeyedTable(spark, str(tmp_path / "code"), KEYS, ["event_id"], buckets=2)
    stream = landing.stream_changes(spark, str(tmp_path / "feed"), schema=schema)
    parse = lambda df: extract.index_files(df.drop("fileHash"))
    T.index_stream(stream, table, ["event_id"], str(tmp_path / "offsets"), parse).awaitTermination()
    found = {r.filePath: [e.name for e in r.exports] for r in table.current().collect()}
    assert found == {"src/a.ts": ["a", "b"], "src/b.py": ["f"]}


def test_live_progress(spark, feed, tmp_path):
    rows, path = feed
    stream = landing.stream_changes(spark, path, schema=spark.read.parquet(path).schema, files_per_batch=2)
    outcome = F.expr("case content when 'c0' then 'failed' when 'c1' then 'skipped' else 'processed' end")
    progress = T.live_progress(stream, ["repoId"], outcome)
    T.write_progress(progress, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 3
    last = T.read_progress(spark, str(tmp_path / "out"), ["repoId"]).collect()
    assert {r.repoId for r in last} == {repo for _, repo, *_ in rows}
    # A later batch that touches one key writes that key only.
    new = [(9_000, rows[0][1], "src/z.ts", "c0", 1)]
    changes(spark, new).drop("t").coalesce(1).write.mode("append").parquet(path)
    T.write_progress(T.live_progress(landing.stream_changes(spark, path, schema=spark.read.parquet(path).schema), ["repoId"], outcome), str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r.repoId for r in out.where("batch = 3").collect()] == [rows[0][1]]
    rows = [*rows, *new]
    last = T.read_progress(spark, str(tmp_path / "out"), ["repoId"]).collect()
    for r in last:
        mine = [c for _, repo, _, c, _ in rows if repo == r.repoId]
        assert (r.total, r.failed, r.skipped) == (len(mine), mine.count("c0"), mine.count("c1"))


def test_checkpoint_folder_is_the_one_the_session_names(spark):
    from sparksymbols.session import scratch_path, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_a_users_own_extractor(spark):
    def words(batches):
        for batch in batches:
            rows = [(r.repoId, r.filePath, 1, 0, w, "word", None, 1) for r in batch.itertuples() for w in r.content.split()]
            columns = ["repoId", "filePath", "rule_no", "pos", "name", "type", "source", "line"]
            yield type(batch)(rows, columns=columns)

    files = spark.createDataFrame([("r", "a.txt", "one two")], "repoId string, filePath string, content string")
    assert [r.name for r in extract.apply_extractor(files, words).collect()] == ["one", "two"]


def test_tree_scan(spark, tmp_path):
    files = {
        "src/a.ts": b"export const a = 1;\r\n",
        "src/deep/__init__.py": b"",
        "src/bad.JS": b"ok\xff\xc3\xa9",
        "root.py": b"x = 1",
        "test/skip.ts": b"no",
        "src/notes.md": b"no",
    }
    for name, raw in files.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    roots = spark.createDataFrame([("r", str(tmp_path / "repo"))], "repoId string, root string")
    found = {r.filePath: r.content for r in landing.scan_trees(roots).collect()}
    assert found == {"src/a.ts": "export const a = 1;\r\n", "src/deep/__init__.py": "", "src/bad.JS": "oké", "root.py": "x = 1"}
    assert [r.filePath for r in landing.tree_scan(landing.scan_trees(roots)).collect()] == sorted(found)


def test_one_root_is_listed_by_many_tasks(spark, tmp_path):
    """Names that start with a dot or an underscore, folders deeper than the levels, links, empty folders, several roots."""
    want = set()
    for i in range(40):
        for name in (f"a{i % 5}/b{i}/f{i}.py", f"a{i % 5}/b{i}/c/d/_e/.g{i}.py", f".h{i}.py", f"_k/{i}.py"):
            path = tmp_path / "one" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("x")
            want.add(("r", name))
    (tmp_path / "one" / "empty").mkdir()
    (tmp_path / "one" / "a0" / "link").symlink_to(tmp_path / "one" / "a1")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "only.py").write_text("x")
    roots = spark.createDataFrame([("r", str(tmp_path / "one")), ("s", str(tmp_path / "two")), ("t", str(tmp_path / "none"))], "repoId string, root string")
    listed = landing.list_trees(roots, tasks=8)
    assert {(r.repoId, r.filePath) for r in listed.collect()} == want | {("s", "only.py"), ("r", "a0/link")}
    deep = listed.where("filePath like '%/c/d/%'").select(F.spark_partition_id().alias("p")).distinct()
    assert deep.count() > 3


def test_changes_from_json(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.json").write_text(
        '{"repo_url": "r", "file_path": "src/a.ts", "commit_sha": "abcdef1", "file_timestamp": "2024-01-02T03:04:05Z",'
        ' "file_content": "export const a = 1;", "language": "typescript"}\n'
    )
    batch = landing.read_changes(spark, str(tmp_path / "feed"), "json").first()
    assert (batch.file_path, batch.file_timestamp.isoformat()) == ("src/a.ts", "2024-01-02T03:04:05")
    stream = landing.stream_changes(spark, str(tmp_path / "feed"), "json")
    assert stream.isStreaming and stream.columns == batch.__fields__
