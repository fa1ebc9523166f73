import random

import pytest
from pyspark.sql import functions as F

from sparksymbols.operators import joins as J
from sparksymbols.operators import metrics as A
from sparksymbols.operators import mutations as M
from sparksymbols.operators.skew import first_rows, split_join


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_split_join_equals_a_plain_join(spark, how):
    rng = random.Random(3)
    many = [(i, None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}") for i in range(2000)]
    left = spark.createDataFrame(many, "id int, k string")
    right = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(20)), (None, 5)], "k string, v int")
    plain = left.join(right, "k", how)
    named = spark.createDataFrame([("hot",), ("k1",)], "k string")
    for split in (split_join(left, right, ["k"], how), split_join(left, right, ["k"], how, ["id"], named, 7)):
        assert rows_of(split.select(*plain.columns)) == rows_of(plain)


def test_both_sides_of_a_join_are_dealt_for_it(spark):
    """Only then can Spark split a large key at run time; the aggregate's own dealing must not be reused."""
    left = spark.range(1000).select("id", F.expr("id % 7 as k"))
    right = left.groupBy("k").agg(F.max("id").alias("last"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = split_join(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(k") == 3 and plan.count("_probe") > 0


def test_named_keys_are_cut_into_slices(spark):
    left = spark.range(10_000).select("id", F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    joined = split_join(left, right, ["k"], "left", ["id"], spark.createDataFrame([("hot",)], "k string"))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(id" in plan
    assert "rand(" not in plan


def test_first_rows(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i * 7919 % 2003) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(8)
    expected = sorted((k, v) for k in {k for k, _ in rows} for v in sorted(v for x, v in rows if x == k)[:5])
    assert sorted(tuple(r) for r in first_rows(df, ["k"], ["v"], 5).collect()) == expected


def test_snapshot_diff(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("old", "7")], "path string, fileHash string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("new", "7")], "path string, fileHash string")
    diff = J.snapshot_diff(before, after, ["path"]).select("path", "change_type")
    assert rows_of(diff) == [("b", "M"), ("new", "A"), ("old", "D")]
    first = J.snapshot_diff(before.limit(0), after, ["path"])
    assert {r.change_type for r in first.collect()} == {"A"}
    assert rows_of(J.changed_set(diff, ["path"])) == [("b",), ("new",), ("old",)]


def test_gates_against_stored_rows(spark):
    schema = "repoId string, t int, fileHash string"
    stored = spark.createDataFrame([("a", 10, "x")], schema).withColumn("ts", F.expr("timestamp_seconds(t)"))
    new = [("a", 10, "y"), ("a", 9, "x"), ("a", 10, "x"), ("b", 1, "x"), ("a", 11, "z")]
    changes = spark.createDataFrame(new, schema).withColumn("ts", F.expr("timestamp_seconds(t)"))
    joined = J.with_stored(changes, stored, ["repoId"], ["t", "fileHash"], "fileHash", "ts")
    reasons = {(r.repoId, r.t, r.fileHash): r.reason for r in J.gate_reason(joined).collect()}
    assert list(map(reasons.get, new)) == ["changed", "stale", "unchanged", "new", "changed"]
    assert J.stale_gate(joined).count() == 4
    assert J.unchanged_gate(joined).count() == 3


def test_missing_only(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    index = spark.createDataFrame([("a",), ("a",)], "path string")
    assert rows_of(J.missing_only(files, index, ["path"], ["path"])) == [("b",)]
    assert J.missing_only(files, index, ["path"], ["path"], force_reprocess=True).count() == 2


def test_import_paths(spark):
    exports = spark.createDataFrame(
        [
            ("r", "src/a/b.ts", "one", 3),
            ("r", "src/a/index.ts", "two", 5),
            ("r", "src/c.js", "three", 7),
            ("r", "src/c.js", "three", 9),
            ("other", "src/a/b.ts", "one", 1),
        ],
        "repoId string, filePath string, name string, lineNumber int",
    )
    imports = spark.createDataFrame(
        [
            ("r", "src/a/x.ts", "one", "./b", 1),
            ("r", "src/d/x.ts", "two", "../a", 2),
            ("r", "src/d/x.ts", "three", "../c.js", 3),
            ("r", "x.ts", "one", "./src/a/b", 4),
            ("r", "src/a/x.ts", "none", "./b", 5),
            ("r", "src/a/x.ts", "one", "library", 6),
        ],
        "repoId string, filePath string, name string, source string, lineNumber int",
    )
    resolved = J.resolve_imports(imports, exports).collect()
    assert {r.lineNumber: (r.targetPath, r.targetLine) for r in resolved} == {
        1: ("src/a/b.ts", 3),
        2: ("src/a/index.ts", 5),
        3: ("src/c.js", 7),
        4: ("src/a/b.ts", 3),
        5: (None, None),
        6: (None, None),
    }


def test_python_import_paths(spark):
    exports = spark.createDataFrame(
        [("r", "pkg/util.py", "one", 3), ("r", "pkg/lib/core.py", "two", 5), ("r", "pkg/__init__.py", "three", 7), ("r", "pkg/sub/util.py", "one", 9)],
        "repoId string, filePath string, name string, lineNumber int",
    )
    cases = [
        ("pkg/a.py", "one", ".util", "pkg/util.py"),
        ("pkg/sub/a.py", "two", "..lib.core", "pkg/lib/core.py"),
        ("pkg/a.py", "three", ".", "pkg/__init__.py"),
        ("main.py", "one", "pkg.util", "pkg/util.py"),
        ("main.py", "three", "pkg", "pkg/__init__.py"),
        ("pkg/sub/a.py", "one", ".util", "pkg/sub/util.py"),
        ("pkg/a.py", "one", "..util", None),
        ("pkg/a.ts", "one", "pkg.util", None),
    ]
    rows = [("r", path, name, source, i) for i, (path, name, source, _) in enumerate(cases)]
    imports = spark.createDataFrame(rows, "repoId string, filePath string, name string, source string, lineNumber int")
    found = {r.lineNumber: r.targetPath for r in J.resolve_imports(imports, exports).collect()}
    assert [found[i] for i in range(len(cases))] == [target for *_, target in cases]


def test_mutations(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, s string")
    changes = spark.createDataFrame([("b", 0, "z"), ("c", 2, "w"), ("c", 1, "u")], "k string, v int, s string")
    assert rows_of(M.upsert(base, changes, ["k"], ["v"])) == [("a", 1, "x"), ("b", 0, "z"), ("c", 2, "w")]
    patches = spark.createDataFrame([("a", "new")], "k string, s string")
    assert rows_of(M.patch(base, patches, ["k"], {"v": F.lit(9)})) == [("a", 9, "new"), ("b", 1, "y")]
    doomed = spark.createDataFrame([("a",), ("q",)], "k string")
    assert rows_of(M.delete_keys(base, doomed, ["k"])) == [("b", 1, "y")]
    assert rows_of(M.delete_report(base, doomed, ["k"])) == [("a", True), ("q", False)]


def test_cascade_delete(spark):
    repositories = spark.createDataFrame([("a",), ("b",)], "repoId string")
    files = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "repoId string, path string")
    left = J.cascade_delete(repositories, files, spark.createDataFrame([("a",)], "repoId string"), "repoId", ["path"])
    assert [rows_of(t) for t in left] == [[("b",)], [("b", "3")]]


def test_batch_progress_of_one_large_repository(spark):
    files = spark.range(1000).select(
        F.lit("r").alias("repo"), "id", F.expr("case when id % 4 = 0 then 'failed' else 'processed' end").alias("outcome")
    )
    rows = A.batch_progress(files, "repo", ["id"]).orderBy("batch").collect()
    assert len(rows) == 20
    for i, r in enumerate(rows):
        done = (i + 1) * 50
        failed = (done + 3) // 4
        assert (r.batch_files, r.processed, r.failed) == (50, done - failed, failed)
        assert r.percent == int((done - failed) / 1000 * 100)


@pytest.mark.parametrize(("count", "route"), [(99, "direct"), (100, "direct"), (101, "batch")])
def test_size_route(spark, count, route):
    assert A.size_route(spark.range(count).withColumn("r", F.lit("x")), "r").first().route == route


def test_reexports(spark):
    """Chains of 1, 2 and 9 modules, new names, stars over stars, own names first, cycles, dead ends, Python packages."""
    row = lambda path, name, original, source: ("r", path, name, original, source)
    exports = [("r", "src/z.ts", "z", 4), ("r", "src/z.ts", "default", 9), ("r", "src/y.ts", "own", 1), ("r", "lib/index.ts", "deep", 2), ("r", "pkg/core.py", "run", 7)]
    handed = [row(f"src/c{i}.ts", "z", "z", f"./c{i - 1}" if i > 1 else "./z") for i in range(1, 10)]
    handed += [
        row("src/y.ts", "*", "*", "./z"), row("src/x.ts", "*", "*", "./y"), row("src/w.ts", "renamed", "z", "./x"), row("src/y.ts", "own", "z", "./z"),
        row("src/a.ts", "loop", "loop", "./b"), row("src/b.ts", "loop", "loop", "./a"), row("src/p.ts", "*", "*", "./q"), row("src/q.ts", "*", "*", "./p"),
        row("src/d.ts", "gone", "gone", "./nowhere"), row("src/q.ts", "deep", "deep", "../lib"), row("src/e.ts", "other", "z", "package"),
        row("pkg/__init__.py", "start", "run", ".core"),
    ]
    asked = [("c1", "z"), ("c2", "z"), ("c9", "z"), ("y", "z"), ("x", "z"), ("x", "default"), ("w", "renamed"), ("x", "own"), ("a", "loop"), ("p", "deep"), ("d", "gone"), ("e", "other"), ("z", "z")]
    imports = [("r", "src/main.ts", name, f"./{module}", 1) for module, name in asked] + [("r", "app.py", "start", "pkg", 1)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    resolved = J.resolve_imports(
        df(imports, "repoId string, filePath string, name string, source string, lineNumber int"),
        df(exports, "repoId string, filePath string, name string, lineNumber int"),
        df(handed, "repoId string, filePath string, name string, original string, source string"),
    )
    got = {(r["source"], r["name"]): (r["targetPath"], r["hops"]) for r in resolved.collect()}
    assert got == {
        ("./c1", "z"): ("src/z.ts", 1), ("./c2", "z"): ("src/z.ts", 2), ("./c9", "z"): ("src/z.ts", 9), ("./y", "z"): ("src/z.ts", 1), ("./x", "z"): ("src/z.ts", 1),
        ("./x", "default"): (None, None), ("./w", "renamed"): ("src/z.ts", 2), ("./x", "own"): ("src/y.ts", 1), ("./a", "loop"): (None, None),
        ("./p", "deep"): ("lib/index.ts", 2), ("./d", "gone"): (None, None), ("./e", "other"): (None, None), ("./z", "z"): ("src/z.ts", 0), ("pkg", "start"): ("pkg/core.py", 1),
    }


def test_cascade_delete_sorts_no_files(spark):
    """Doomed keys are hashed, also where they are too many to be sent to all tasks; null keys stay."""
    files = spark.createDataFrame([(k, i) for i, k in enumerate([1, 1, 2, None, 3])], "key bigint, n int")
    orders = spark.createDataFrame([(1,), (2,), (None,)], "key bigint")
    _, kept = J.cascade_delete(orders, files, orders.where("key = 1 or key is null"), "key", ["n"])
    assert sorted(r.n for r in kept.collect()) == [2, 3, 4]
    assert "ShuffledHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
