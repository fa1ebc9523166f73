"""Python symbols: module-level names, imports, typed functions and classes with their methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparksymbols.functions.text import MULTILINE, UNICODE, bind, each, find_all, group, keep, lit
from sparksymbols.operators import rules as R
from sparksymbols.operators.signatures import Grammar, trimmed, with_signatures

_DEF = MULTILINE + "^([ \\t]*)(async[ \\t]+)?def\\s+(\\w+)\\s*\\("
_CLASS = MULTILINE + "^([ \\t]*)class\\s+(\\w+)[^\\n]*"
# The lines of a class: deeper than its own line, empty, or closing a bracket.
_CLASS_BLOCK = "(?Ud)^([ \\t]*)class[^\\n]*(?:\\n(?:\\1[ \\t]+[^\\n]*+|[ \\t]*+(?=\\n|$)|[ \\t]*+[)\\]}][^\\n]*+))*+"
GRAMMAR = Grammar(
    delimiters="[()\\[\\]{}]",
    openers="([{",
    param="(?Uds)^\\s*+(\\*{0,2})(\\w+)\\s*+(?::([^=]++))?(?:=(.*))?$",
    optional_groups=(1,),
    name_group=2,
    type_group=3,
    default_group=4,
    returns="(?Uds)^\\)\\s*+->\\s*+([^:]++):",
    body="(?Uds)^\\)[^:]*:",
    after_type=":",
)
_IMPORT = MULTILINE + "^[ \\t]*import[ \\t]+([^\\n;]+)"
_FROM = MULTILINE + "^[ \\t]*from\\s+([\\w.]+)\\s+import\\s+(\\([^)]*\\)|[^\\n;]+)"
_AS = UNICODE + "^\\s*([\\w.*]+)(?:\\s+as\\s+(\\w+))?\\s*$"


def exports(code: str = "code", all_levels: bool = False) -> str:
    """Symbols of the rule set; module level only unless ``all_levels``."""
    return R.apply_rules(code, R.PY_EXPORTS_ALL_LEVELS if all_levels else R.PY_EXPORTS)


def imports(code: str = "code") -> str:
    return R.apply_rules(code, R.PY_IMPORTS)


def named_imports(code: str = "code") -> str:
    """One entry per imported name: ``array<struct<name, alias, kind, source, line>>``."""

    def entries(items: str, source: str, line: str) -> str:
        bare = f"regexp_replace({items}, r'[()\\\\]', ' ')"
        listed = keep(f"split({bare}, ',')", lambda e: f"{trimmed(e)} <> ''")

        def entry(e: str) -> str:
            name = f"regexp_extract({e}, {lit(_AS)}, 1)"
            return (
                f"named_struct('name', {name}, 'alias', {group(e, _AS, 2)}, 'kind', {lit('named')},"
                f" 'source', {source or name}, 'line', {line})"
            )

        return each(listed, lambda e, _: entry(e))

    plain = each(
        find_all(code, _IMPORT),
        lambda m, _: entries(f"regexp_extract({m}.text, {lit(_IMPORT)}, 1)", "", f"{m}.line"),
    )
    from_ = each(
        find_all(code, _FROM),
        lambda m, _: entries(
            f"regexp_extract({m}.text, {lit(_FROM)}, 2)", f"regexp_extract({m}.text, {lit(_FROM)}, 1)", f"{m}.line"
        ),
    )
    return f"concat(flatten({plain}), flatten({from_}))"


def with_functions(files: DataFrame, typed_only: bool = True) -> DataFrame:
    """Add ``functions``: ``array<struct<name, line, pos, indent, signature>>`` for every ``def``, nested ones included."""

    def one(p: str, d: str) -> str:
        return (
            f"named_struct('name', regexp_extract({d}.text, {lit(_DEF)}, 3), 'line', {d}.line, 'pos', {d}.start,"
            f" 'indent', length(regexp_extract({d}.text, {lit(_DEF)}, 1)),"
            f" 'is_async', {group(f'{d}.text', _DEF, 2)} is not null, 'is_generator', false, 'after', {d}.tail,"
            f" 'same', substring({p}, {d}.start + length({d}.text) + 1, length({d}.tail)))"
        )

    spans = bind("plain", lambda p: each(find_all("code", _DEF), lambda d, _: one(p, d)))
    return with_signatures(
        files.withColumn("functions", F.expr(spans)),
        "functions",
        ("name", "line", "pos", "indent"),
        GRAMMAR,
        typed_only=typed_only,
    )


def with_classes(files: DataFrame, typed_only: bool = True) -> DataFrame:
    """Add ``functions`` and ``classes``: ``array<struct<name, line, pos, indent, methods>>``; the methods of a class
    are all defs inside its block."""

    def one(c: str, t: str, defs: str) -> str:
        end = f"({c}.start + length(regexp_extract(substring({t}, {c}.start + 1), {lit(_CLASS_BLOCK)}, 0)))"
        inside = bind(end, lambda e: keep(defs, lambda d: f"{d}.pos > {c}.start and {d}.pos < {e}"))
        return (
            f"named_struct('name', regexp_extract({c}.text, {lit(_CLASS)}, 2), 'line', {c}.line, 'pos', {c}.start,"
            f" 'indent', length(regexp_extract({c}.text, {lit(_CLASS)}, 1)), 'methods', {inside})"
        )

    found = bind("code", lambda t: bind("functions", lambda defs: each(find_all(t, _CLASS), lambda c, _: one(c, t, defs))))
    return with_functions(files, typed_only).withColumn("classes", F.expr(found))
