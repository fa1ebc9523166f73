"""Blank out comments and strings, so that rules do not see code inside them. Offsets and lines stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparksymbols.functions.text import bind, blank, each, lit

_DOUBLE = '"[^"\\\\\\n]*+(?:\\\\.[^"\\\\\\n]*+)*+"'
_SINGLE = "'[^'\\\\\\n]*+(?:\\\\.[^'\\\\\\n]*+)*+'"
_TEMPLATE = "`[^`\\\\]*+(?:\\\\(?s:.)[^`\\\\]*+)*+`"

# The look-ahead lets a search pass over all other characters with one test.
TOKENS = {
    "typescript": "(?=[/\"'`])(?:" + "|".join(("//[^\\n]*+", "/\\*(?s:.*?)\\*/", _DOUBLE, _SINGLE, _TEMPLATE)) + ")",
    "python": "(?=[#\"'])(?:"
    + "|".join(("#[^\\n]*+", '"""(?s:.*?)"""', "'''(?s:.*?)'''", _DOUBLE, _SINGLE))
    + ")",
}


def masked(content: str, language: str) -> str:
    """``struct<code, plain>``: comments blanked in both; in ``code`` strings keep only their quotes."""
    pattern = lit(TOKENS[language])

    def blanked(m: str) -> str:
        inner = blank(f"substring({m}, 2, length({m}) - 2)")
        return f"if({_is_comment(m)}, {blank(m)}, concat(left({m}, 1), {inner}, right({m}, 1)))"

    def texts(gaps: str, found: str, blanks: str) -> str:
        def joined(tokens: str) -> str:
            return f"array_join({each(gaps, lambda g, i: f"concat({g}, coalesce(get({tokens}, {i}), ''))")}, '')"

        kept = each(found, lambda m, i: f"if({_is_comment(m)}, {blanks}[{i}], {m})")
        return f"named_struct('code', {joined(blanks)}, 'plain', {bind(kept, joined)})"

    return bind(
        f"split({content}, {pattern}, -1)",
        lambda gaps: bind(
            f"regexp_extract_all({content}, {pattern}, 0)",
            lambda found: bind(each(found, lambda m, _: blanked(m)), lambda blanks: texts(gaps, found, blanks)),
        ),
    )


def _is_comment(token: str) -> str:
    return f"left({token}, 1) in ('/', '#')"


def with_code(files: DataFrame, language: str, content: str = "content") -> DataFrame:
    """Add ``code`` and ``plain``, both with the offsets and lines of the content."""
    return files.withColumn("masked", F.expr(masked(content, language))).selectExpr(
        *files.columns, "masked.code as code", "masked.plain as plain"
    )
