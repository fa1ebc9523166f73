import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparksymbols import schemas
from sparksymbols.operators import filters as L
from sparksymbols.operators.mutations import status_transition


@pytest.mark.parametrize(
    ("status", "total", "processed", "expected"),
    [
        ("processing", 100, 85, (85.0, False, True)),
        ("completed", 100, 100, (100.0, True, False)),
        ("completed", 0, 0, (0.0, True, False)),
        ("failed", 0, 0, (0.0, False, True)),
    ],
)
def test_metrics(spark, status, total, processed, expected):
    df = spark.createDataFrame([(status, total, processed)], "status string, totalFiles long, processedFiles long")
    row = L.repo_metrics(df).first()
    assert (row.progress, row.is_complete, row.has_failures) == expected


@pytest.mark.parametrize(("processed", "total", "percent"), [(1, 3, 33), (2, 3, 66), (0, 0, 0), (3, 3, 100)])
def test_percent(one, processed, total, percent):
    assert one(L.progress_percent(F.lit(processed), F.lit(total))) == percent


def test_validation(spark):
    rows = [("abcdef1", "public", "paused", 0), ("abc", "invalid", "invalid", -1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "sha string, visibility string, status string, totalFiles int")
    rules = {
        "sha": L.sha_rule("sha"),
        "visibility": L.visibility_rule(),
        "status": L.status_rule(),
        "totalFiles": L.count_rule("totalFiles"),
    }
    valid, rejected = L.split_valid(L.validate(df, rules))
    assert valid.count() == 1
    assert [r.violations for r in rejected.collect()] == [list(rules)] * 2


INDEX = [
    ("r", "b.ts", ["getName", "other"]),
    ("r", "a.ts", ["name"]),
    ("r", "c.ts", ["NAMES"]),
    ("s", "a.ts", ["name"]),
]


@pytest.fixture
def index(spark):
    df = spark.createDataFrame(INDEX, "repoId string, filePath string, names array<string>")
    return df.select("repoId", "filePath", F.transform("names", lambda n: F.struct(n.alias("name"))).alias("exports"))


def test_search(index):
    found = L.search_exports(index, "Name", "r").collect()
    assert {r.filePath: [e["name"] for e in r.exports] for r in found} == {
        "a.ts": ["name"],
        "b.ts": ["getName"],
        "c.ts": ["NAMES"],
    }
    assert [r.filePath for r in L.search_exports(index, "other", "r", limit=1).collect()] == []
    assert L.search_exports(index, "name", limit=1).count() == 2


def test_look_ups(index):
    assert L.list_files(index, "r").count() == 3
    assert L.get_file(index, "r", "a.ts").count() == 1
    assert L.get_file(index, "r", "zzz").count() == 0


def test_malformed_documents_are_skipped_and_counted(spark):
    texts = ['{"name": "a", "lineNumber": 1}', '{"name": "b"', "", "[]", '{"name": "c", "lineNumber": "x"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("lineNumber", T.IntegerType())])
    assert [r.document.name for r in L.skip_malformed(df, "t", schema).collect()] == ["a"]
    assert L.parse_documents(df, "t", schema).where("malformed").count() == 4


def test_status_transition(spark):
    rows = [("processing", 5, 5, 0, None), ("processing", 5, 4, 1, None), ("processing", 5, 3, 1, None), ("pending", 5, 0, 2, "x"), ("processing", 5, 5, 0, "lost")]
    df = spark.createDataFrame(rows, "status string, totalFiles long, processedFiles long, failedFiles long, error string")
    assert [(r.status, r.errorMessage) for r in status_transition(df, F.col("error")).collect()] == [
        ("completed", None),
        ("completed", None),
        ("processing", None),
        ("pending", None),
        ("failed", "lost"),
    ]
    assert [r.status for r in status_transition(df).collect()][-1] == "completed"


def test_stored_schemas_are_bounded():
    member = schemas.CLASS_INFO["methods"].dataType.elementType
    assert "classInfo" not in member.fieldNames()
    assert "overloads" not in schemas.OVERLOAD.fieldNames()
