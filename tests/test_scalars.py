import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from sparksymbols.functions import scalars as S


@pytest.mark.parametrize(
    ("path", "allowed"),
    [("test/a.ts", False), ("a.ts", True), ("src/a.ts", True), ("packages/x/y.py", True), ("srcs/a.ts", False), ("", False)],
)
def test_allowed_folder(one, path, allowed):
    assert one(S.in_allowed_folder(F.col("p")), p=path) is allowed


@pytest.mark.parametrize(
    ("path", "suffix"), [("a/b.TS", ".ts"), (".ts", ""), ("a/.ts", ""), ("a.d.ts", ".ts"), ("a.b/c", ""), ("x.", "")]
)
def test_extension(one, path, suffix):
    assert one(S.extension(F.col("p")), p=path) == suffix


@pytest.mark.parametrize("text", ["", "hello\n", "naïve – 文字 🎈\r\n"])
def test_hashes(one, text):
    raw = text.encode()
    assert one(S.content_hash(F.col("t")), t=text) == hashlib.sha256(raw).hexdigest()
    blob = b"blob " + str(len(raw)).encode() + b"\0" + raw
    assert one(S.git_blob_id(F.col("t")), t=text) == hashlib.sha1(blob).hexdigest()


@pytest.mark.parametrize("raw", ["a\ufffdb\u0001b\u0001a".encode() + b"\xff", b"ok", b"\xffabc", b"a\xc3", b"\xe2\x82", "é文".encode() + b"\x80x", b""])
def test_tolerant_decode(spark, raw):
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    assert df.select(S.tolerant_decode(F.col("b"))).first()[0] == raw.decode("utf-8", errors="ignore")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05.25+02:00", dt.datetime(2024, 1, 2, 1, 4, 5, 250000)),
        ("2024-01-02T03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("soon", None),
    ],
)
def test_parse_iso(one, text, expected):
    assert one(S.parse_iso_ts(F.col("t")), t=text) == expected


def test_format_iso_keeps_micros(one):
    assert one(S.format_iso_ts(F.col("t")), t=dt.datetime(2024, 1, 2, 3, 4, 5)) == "2024-01-02T03:04:05.000000Z"


def test_small_functions(one):
    assert one(S.short_key(F.col("u")), u="https://x/y") == hashlib.md5(b"https://x/y").hexdigest()[:8]
    assert one(S.doc_key(F.lit("r"), F.lit("a/b.ts"))) == "r_a_b.ts"
    assert one(S.lock_key(F.lit("r"), F.lit("a/b.ts"))) == "r:a/b.ts"
    assert one(S.strip_quotes(F.lit(" './x' "))) == "./x"
    assert one(S.split_params(F.lit("a: string, b , , c:number"))) == ["a", "b", "c"]
    assert one(S.icontains(F.lit("getName"), F.lit("NAME"))) is True


@pytest.mark.parametrize(
    ("folder", "source", "expected"),
    [("src/a", "./b", "src/a/b"), ("src/a", "../b", "src/b"), ("src", "../../b", "b"), ("", "./b", "b"), ("a/b", ".", "a/b")],
)
def test_resolve_path(one, folder, source, expected):
    assert one(S.resolve_path(F.lit(folder), F.lit(source))) == expected
