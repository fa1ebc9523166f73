"""Physical plans: no cross joins, filters and columns reach the scan, limits apply before the shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from sparksymbols.operators import extract, filters
from sparksymbols.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = plan_of(QUERIES[name](spark, FOLDER))
        return made[name]

    return get


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("T", "S4", "S5", "S6", "M3"))])
def test_no_cross_join_and_no_python(plans, name):
    plan = plans(name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas", plan)


@pytest.mark.parametrize("name", ["X1_ts_exports", "X11_rich_signature", "N6_assemble_file_index", "P8_file_summary", "G1_rule_registry"])
def test_extraction_needs_no_shuffle(plans, name):
    assert "Exchange" not in plans(name)


@pytest.mark.parametrize("name", ["W2_limit_n"])
def test_limits_apply_in_each_task_first(plans, name):
    assert re.search(r"WindowGroupLimit .*Partial", plans(name))


def test_only_needed_columns_are_read(plans):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plans("A1_language_distribution")).group(1)
    assert schema == "lang:string"
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plans("J4_change_gate"))
    assert schemas and all("value" not in s for s in schemas)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    spark.createDataFrame([("r", "src/a.ts", "x")], "repoId string, filePath string, fileHash string").write.parquet(path)
    plan = plan_of(filters.get_file(spark.read.parquet(path), "r", "src/a.ts"))
    assert "EqualTo(repoId,r)" in plan and "EqualTo(filePath,src/a.ts)" in plan


def test_one_scan_serves_all_languages(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.createDataFrame([("r", "src/a.ts", "x")], "repoId string, filePath string, content string").write.parquet(path)
    plan = plan_of(extract.index_files(spark.read.parquet(path)))
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan


def test_explodes_do_not_repeat_extraction(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.createDataFrame([("r", "src/a.ts", "x")], "repoId string, filePath string, content string").write.parquet(path)
    from sparksymbols.operators import nested

    index = extract.index_files(spark.read.parquet(path))
    rows = nested.flatten(index, "exports", ["filePath"], ["name"], outer=False)
    plan = rows._jdf.queryExecution().optimizedPlan()
    whole = index.select("filePath", F.posexplode_outer("exports"))._jdf.queryExecution().optimizedPlan()
    assert len(plan.toString()) < 1.5 * len(whole.toString())


@pytest.mark.parametrize("name", ["N3_flatten_members", "N4_flatten_params", "N5_flatten_overloads", "X12_member_forms"])
def test_only_the_asked_kind_of_export_is_read(spark, tmp_path, monkeypatch, name):
    """A query over one kind of export does not build the details of the others."""
    asked, build = [], extract.typescript.with_declarations

    def seen(files, functions=True, classes=True, interfaces=True):
        asked.append(functions + classes + interfaces)
        return build(files, functions, classes, interfaces)

    monkeypatch.setattr(extract.typescript, "with_declarations", seen)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(1, "x", "en", "s", 1)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() > 0
    assert asked == [1]
