import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sparksymbols.functions import text as X


def random_texts(seed, alphabet, count=200, longest=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(count)]


@pytest.mark.parametrize("pattern", ["a+b", "\\n[a-c]", "é.", "[{}]"])
def test_find_all_equals_re(spark, pattern):
    texts = random_texts(1, "abcé{} \n")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", F.expr(f"to_json({X.find_all('t', pattern)})").alias("m")).collect()
    for row in found:
        expected = [
            {"start": m.start(), "line": row.t[: m.start()].count("\n") + 1, "text": m.group()}
            for m in re.finditer(pattern, row.t)
        ]
        got = [{k: m[k] for k in ("start", "line", "text")} for m in json.loads(row.m)]
        assert got == expected


def test_find_all_tails_rebuild_the_text(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(2, "ab\n")], "t string")
    joined = F.expr(f"array_join(transform({X.find_all('t', 'ab')}, m -> concat(m.text, m.tail)), '')")
    for row in df.select("t", joined.alias("j")).collect():
        at = row.t.find("ab")
        assert row.j == ("" if at < 0 else row.t[at:])


@pytest.mark.parametrize("length", [0, 1, 63, 64, 65, 128, 1000])
def test_running_sum(one, length):
    values = [random.Random(length).randrange(-5, 9) for _ in range(length)]
    listed = f"array({', '.join(map(str, values))})" if values else X.no_items("int")
    expected = [sum(values[: i + 1]) for i in range(length)]
    assert one(X.running_sum(listed)) == expected


def block_of(text):
    """Text up to the brace that closes the block ``text`` starts in."""
    depth = 0
    for i, c in enumerate(text):
        depth += {"{": 1, "}": -1}.get(c, 0)
        if depth < 0:
            return text[:i]
    return ""


def outer_of(text):
    depth, out = 0, []
    for c in text:
        before = depth
        depth += {"{": 1, "}": -1}.get(c, 0)
        if c in "{}":
            out.append(c if min(before, depth) <= 0 else " ")
        else:
            out.append(c if before <= 0 or c == "\n" else " ")
    return "".join(out)


def test_blocks_equal_a_counter(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(3, "{}ab\n")], "t string")
    rows = df.select("t", F.expr(X.brace_block("t")).alias("block"), F.expr(X.top_level("t")).alias("outer"))
    for row in rows.collect():
        assert row.block == block_of(row.t)
        assert row.outer == outer_of(row.t)


def test_first_block(one):
    assert one(X.first_block("t"), t="a { b {c} } d") == " b {c} "
    assert one(X.first_block("t"), t="a { b {c} d") == ""
    assert one(X.first_block("t"), t="none") == ""


def test_split_at_keeps_nested_separators(one):
    shape = X.top_level("t", "[()]", "(")
    assert one(X.split_at(shape, "t", ","), t="a, f(b, c), d") == ["a", " f(b, c)", " d"]


def test_long_strings_do_not_overflow_the_stack(spark):
    from sparksymbols.operators import mask

    body = "x" * 1_000_000 + "\\n" * 100_000
    content = f'const a = "{body}"; /* {body} */ export const b = `{body}`;'
    df = mask.with_code(spark.createDataFrame([(content,)], "content string"), "typescript")
    row = df.select(F.length("code").alias("n"), F.expr("instr(code, 'export')").alias("at")).first()
    assert (row.n, row.at) == (len(content), content.index("export") + 1)


def test_brackets_are_walked_in_one_pass(spark):
    """Many more brackets than one run holds; sums over the brackets before each would take work that grows with runs."""
    assert X.closing_offset("t", "[{}]", "{").count("aggregate(") == 2  # the walk, and the lengths up to its end
    rng = random.Random(7)
    texts = ["{" * 300 + "x\n" + "}" * 299, "a{b}" * 500 + "}", *("".join(rng.choice("{{}}a\n") for _ in range(n)) for n in range(0, 900, 13))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.expr(X.brace_end("t")).alias("end"), F.expr(X.top_level("t")).alias("top")).collect()
    for row in rows:
        depth, end, top = 0, None, []
        for i, c in enumerate(row.t):
            after = depth + (c == "{") - (c == "}")
            top.append(c if c == "\n" or min(depth, after) <= 0 else " ")
            depth = after
            end = i if end is None and depth < 0 else end
        assert row.end == end
        assert row.top == "".join(top)


def test_running_sum_over_runs(spark):
    df = spark.createDataFrame([([(i * 7) % 5 - 2 for i in range(n)],) for n in (0, 1, 63, 64, 65, 1000)], "v array<int>")
    for v, sums in df.select("v", F.expr(X.running_sum("v"))).collect():
        assert sums == [sum(v[: i + 1]) for i in range(len(v))]
