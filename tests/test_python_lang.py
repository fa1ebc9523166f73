import pytest
from pyspark.sql import functions as F

from sparksymbols.operators import extract, mask, python_lang

MODULE = '''\
"""def no(): class No:"""
import os.path as p, sys
from a.b import (
    c,  # first
    d as e,
)


class Outer(Base):
    """class Hidden:"""

    size: int = 3

    def first(self, a: int, b: str = "x, y") -> Dict[str, int]:
        text = """
def not_a_def():
"""
        def helper(z: int): return z

    class Inner:
        async def second(self): ...


def after(x: List[int]) -> None:
    local = 1


LIMIT = 10
'''


@pytest.fixture
def parse(spark):
    def rows(content, array, build=lambda df: df):
        files = spark.createDataFrame([(content,)], "content string")
        found = build(mask.with_code(files, "python")).select(F.expr(f"inline({array})"))
        return [r.asDict(True) for r in found.collect()]

    return rows


def test_exports(parse):
    rows = parse(MODULE, python_lang.exports())
    assert [(r["name"], r["type"], r["line"]) for r in rows] == [("after", "function", 24), ("Outer", "class", 9), ("LIMIT", "variable", 28)]


def test_one_line_module(parse):
    rows = parse("async def ping(host): pass\nRETRIES = ping\n", python_lang.exports())
    assert [(r["name"], r["type"]) for r in rows] == [("ping", "function"), ("RETRIES", "variable")]


def test_imports(parse):
    rows = parse(MODULE, python_lang.imports())
    assert [(r["source"], r["line"]) for r in rows] == [("os", 2), ("a.b", 3)]
    rows = parse(MODULE, python_lang.named_imports())
    assert [(r["name"], r["alias"], r["source"]) for r in rows] == [
        ("os.path", "p", "os.path"),
        ("sys", None, "sys"),
        ("c", None, "a.b"),
        ("d", "e", "a.b"),
    ]


def test_typed_defs(parse):
    rows = parse(MODULE, "functions", python_lang.with_functions)
    params = {r["name"]: [(p["name"], p["type"], p["defaultValue"]) for p in r["signature"]["parameters"]] for r in rows}
    assert params == {
        "first": [("a", "int", None), ("b", "str", '"x, y"')],
        "helper": [("z", "int", None)],
        "second": [],
        "after": [("x", "List[int]", None)],
    }
    returns = {r["name"]: r["signature"]["returnType"] for r in rows}
    assert returns == {"first": "Dict[str, int]", "helper": "any", "second": "any", "after": "None"}


def test_untyped_parameters_on_request(parse):
    rows = parse("def f(self, *args, a=1): pass", "functions", lambda df: python_lang.with_functions(df, typed_only=False))
    params = rows[0]["signature"]["parameters"]
    assert [(p["name"], p["required"]) for p in params] == [("self", True), ("args", False), ("a", False)]


def test_classes_own_all_defs_inside(parse):
    rows = parse(MODULE, "classes", python_lang.with_classes)
    assert {r["name"]: [m["name"] for m in r["methods"]] for r in rows} == {
        "Outer": ["first", "helper", "second"],
        "Inner": ["second"],
    }


def test_index_row(spark):
    files = spark.createDataFrame([("r", "src/__init__.py", MODULE)], "repoId string, filePath string, content string")
    row = extract.index_files(files).first().asDict(True)
    assert [e["name"] for e in row["exports"]] == ["after", "Outer", "LIMIT"]
    assert [i["name"] for i in row["imports"]] == ["os.path", "sys", "c", "d"]
    assert (row["language"], row["parseErrors"]) == ("python", [])
