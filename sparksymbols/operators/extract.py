"""Files to index rows: choose the rules by language, read the symbols, assemble one nested row per file.

Symbols are built as arrays in the file's own row. The content meets no shuffle, no file is repeated per
rule, and a file's symbols are never collected from other rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksymbols import schemas
from sparksymbols.functions import scalars as S
from sparksymbols.functions.text import bind, each, keep, lit, no_items
from sparksymbols.operators import mask, python_lang, typescript
from sparksymbols.operators.rules import SYMBOL, RuleRegistry

_FUNCTION_SIGNATURE = schemas.FUNCTION_SIGNATURE.simpleString()
_OVERLOAD = schemas.OVERLOAD.simpleString()
_MEMBER = schemas.MEMBER.simpleString()
_CLASS_INFO = schemas.CLASS_INFO.simpleString()
_INTERFACE_INFO = schemas.INTERFACE_INFO.simpleString()


Languages = tuple[tuple[str, str, str | None], ...]


def language_of(path: Column, rules: bool = False, languages: Languages = S.LANGUAGES) -> Column:
    """Language tag of a path (``text`` if unknown), or the rule set that reads it (null if none)."""
    entries = [F.lit(x) for suffix, tag, rule_set in languages for x in (suffix, rule_set if rules else tag)]
    found = F.try_element_at(F.create_map(*entries), S.extension(path))
    return found if rules else F.coalesce(found, F.lit("text"))


def with_language(files: DataFrame, languages: Languages = S.LANGUAGES) -> DataFrame:
    """Add ``language`` and ``rules`` by a join with the extension table, a fixed list of a dozen rows."""
    table = files.sparkSession.createDataFrame(languages, "extension string, language string, rules string")
    joined = files.withColumn("extension", S.extension(F.col("filePath"))).join(F.broadcast(table), "extension", "left")
    return joined.withColumn("language", F.coalesce("language", F.lit("text"))).drop("extension")


def unsupported(path: Column) -> Column:
    return F.concat(F.lit("Unsupported language for file: "), path)


def dispatch(files: DataFrame, registry: RuleRegistry, language: str = "language") -> DataFrame:
    """Add ``symbols`` and ``parseErrors`` under a rule registry; no rule set gives no symbols and one error."""
    return files.withColumn("symbols", F.expr(registry.symbols("content", language))).select(
        *files.columns,
        F.coalesce("symbols", F.expr(no_items(SYMBOL))).alias("symbols"),
        F.when(F.col("symbols").isNull(), F.array(unsupported(F.col("filePath"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("parseErrors"),
    )


def with_fallback(files: DataFrame, primary: str, fallback: str) -> DataFrame:
    """Add ``symbols`` from ``primary``, or from ``fallback`` where that finds none, and ``source_rule``."""
    found = files.withColumn("primary_symbols", F.expr(primary))
    use_primary = "size(primary_symbols) > 0"
    return found.select(
        *files.columns,
        F.expr(f"if({use_primary}, primary_symbols, {fallback})").alias("symbols"),
        F.expr(f"if({use_primary}, 'primary', 'fallback')").alias("source_rule"),
    )


SYMBOL_ROW = "repoId string, filePath string, rule_no int, pos int, name string, type string, source string, line int"


def apply_extractor(files: DataFrame, extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Symbol rows from a user's own extractor over batches of files (repoId, filePath, content)."""
    return files.select("repoId", "filePath", "content").mapInPandas(extractor, SYMBOL_ROW)


def _signature(sig: str, of: str = _OVERLOAD) -> str:
    extra = f", 'overloads', {no_items(_OVERLOAD)}" if of == _FUNCTION_SIGNATURE else ""
    return (
        f"cast(named_struct('parameters', {sig}.parameters, 'returnType', {sig}.returnType,"
        f" 'isAsync', {sig}.isAsync, 'isGenerator', {sig}.isGenerator{extra}) as {of})"
    )


def _member(m: str, type_: str, signature: str, required: str = "cast(null as boolean)") -> str:
    return (
        f"cast(named_struct('name', {m}.name, 'type', {type_}, 'visibility', {m}.visibility,"
        f" 'lineNumber', {m}.line, 'functionSignature', {signature}, 'required', {required}) as {_MEMBER})"
    )


def _members(items: str, owner: str, test: str = "true") -> str:
    """Methods of an owner; of several declarations of one name those without a body are overloads of the others."""
    mine = keep(items, lambda m: f"{m}.owner_pos = {owner}.pos and ({test.format(m=m)})")

    def declared(all_: str) -> str:
        return bind(
            f"array_distinct(transform({keep(all_, lambda m: f'{m}.signature.hasBody')}, m -> m.name))",
            lambda bodies: keep(all_, lambda m: f"{m}.signature.hasBody or not array_contains({bodies}, {m}.name)"),
        )

    return each(bind(mine, declared), lambda m, _: _member(m, "'function'", _signature(f"{m}.signature")))


def _fields(items: str, owner: str, test: str = "true") -> str:
    """Properties of an owner with their declared type (``any`` without one) and whether they must be set."""
    mine = keep(items, lambda m: f"{m}.owner_pos = {owner}.pos and ({test.format(m=m)})")
    return each(mine, lambda m, _: _member(m, f"{m}.type", f"cast(null as {_OVERLOAD})", f"{m}.required"))


def _export(e: str, info: str, signature: str, class_info: str, interface_info: str) -> str:
    return (
        f"cast(named_struct('name', {e}.name, 'type', {info}, 'visibility', 'public', 'lineNumber', {e}.line,"
        f" 'functionSignature', {signature}, 'classInfo', {class_info}, 'interfaceInfo', {interface_info})"
        f" as {schemas.EXPORT.simpleString()})"
    )


def _plain(kind: str) -> str:
    return f"cast(null as {kind})"


#: Kinds of exports that have details.
KINDS = ("function", "class", "interface")


def typescript_exports(files: DataFrame, content: str = "content", only: str | None = None) -> DataFrame:
    """Add ``exports`` with signatures, class and interface details, and ``imports``; with ``only`` just the exports of
    that kind that have details."""
    asked = {kind: only in (None, kind) for kind in KINDS}
    parsed = typescript.with_declarations(typescript.with_code(files, content), *asked.values())
    if asked["function"]:
        parsed = parsed.withColumn("grouped", F.expr(typescript.with_overloads("functions")))
    if only is None:
        parsed = parsed.withColumn("symbols", F.expr(typescript.exports()))

    def class_info(c: str) -> str:
        return (
            f"named_struct('extends', {c}.extends, 'implements', {c}.implements,"
            f" 'methods', {_members('methods', c, lit('constructor') + ' <> {m}.name')},"
            f" 'properties', {_fields('properties', c, '{m}.visibility = ' + lit('public'))},"
            f" 'constructors', {_members('methods', c, lit('constructor') + ' = {m}.name')})"
        )

    def interface_info(c: str) -> str:
        dicts = "cast(array() as array<map<string,string>>)"
        return (
            f"named_struct('extends', {c}.extends, 'methods', {_members('interface_methods', c)},"
            f" 'properties', {_fields('interface_properties', c)},"
            f" 'indexSignatures', {dicts}, 'callSignatures', {dicts})"
        )

    def function_signature(f: str) -> str:
        overloads = each(f"{f}.overloads", lambda o, _: _signature(o))
        return (
            f"cast(named_struct('parameters', {f}.signature.parameters, 'returnType', {f}.signature.returnType,"
            f" 'isAsync', {f}.signature.isAsync, 'isGenerator', {f}.signature.isGenerator,"
            f" 'overloads', {overloads}) as {_FUNCTION_SIGNATURE})"
        )

    nothing = (_plain(_FUNCTION_SIGNATURE), _plain(_CLASS_INFO), _plain(_INTERFACE_INFO))
    functions = each("grouped", lambda f, _: _export(f, "'function'", function_signature(f), *nothing[1:]))
    classes = each("classes", lambda c, _: _export(c, "'class'", nothing[0], f"cast({class_info(c)} as {_CLASS_INFO})", nothing[2]))
    interfaces = each(
        "interfaces", lambda c, _: _export(c, "'interface'", *nothing[:2], f"cast({interface_info(c)} as {_INTERFACE_INFO})")
    )

    # Declarations the detailed steps cannot read (no block, no parentheses) keep their plain row.
    known = "concat(transform(functions, x -> x.pos), transform(classes, x -> x.pos), transform(interfaces, x -> x.pos))"
    rest = bind(
        known,
        lambda k: each(
            keep("symbols", lambda s: f"not array_contains({k}, {s}.pos)"), lambda s, _: _export(s, f"{s}.type", *nothing)
        ),
    )
    parts = [made for made, kind in zip((functions, classes, interfaces), KINDS, strict=True) if asked[kind]]
    parts += [rest] if only is None else []
    return (
        parsed.withColumn("exports", F.expr(f"concat({', '.join(parts)})"))
        .withColumn("imports", F.expr(_imports(typescript.named_imports("plain"))))
        .drop(
            "functions", "grouped", "classes", "methods", "properties", "simple_properties", "interfaces",
            "interface_methods", "interface_properties", "symbols",
        )
    )


def _imports(named: str) -> str:
    return each(
        named,
        lambda m, _: f"cast(named_struct('name', {m}.name, 'source', {m}.source, 'lineNumber', {m}.line)"
        f" as {schemas.IMPORT.simpleString()})",
    )


def python_exports(files: DataFrame, content: str = "content", only: str | None = None) -> DataFrame:
    """Add ``exports`` (functions, classes with their methods, module variables) and ``imports``; with ``only`` just the
    exports of that kind."""
    parsed = python_lang.with_classes(mask.with_code(files, "python", content))
    nothing = (_plain(_FUNCTION_SIGNATURE), _plain(_CLASS_INFO), _plain(_INTERFACE_INFO))

    def method(m: str) -> str:
        return (
            f"cast(named_struct('name', {m}.name, 'type', 'function', 'visibility', 'public', 'lineNumber', {m}.line,"
            f" 'functionSignature', {_signature(f'{m}.signature')}, 'required', cast(null as boolean)) as {_MEMBER})"
        )

    def class_info(c: str) -> str:
        none = no_items(_MEMBER)
        return (
            f"cast(named_struct('extends', cast(null as string), 'implements', {no_items('string')},"
            f" 'methods', {each(f'{c}.methods', lambda m, _: method(m))}, 'properties', {none},"
            f" 'constructors', {none}) as {_CLASS_INFO})"
        )

    functions = each(
        keep("functions", lambda f: f"{f}.indent = 0"),
        lambda f, _: _export(f, "'function'", _signature(f"{f}.signature", _FUNCTION_SIGNATURE), *nothing[1:]),
    )
    classes = each(
        keep("classes", lambda c: f"{c}.indent = 0"),
        lambda c, _: _export(c, "'class'", nothing[0], class_info(c), nothing[2]),
    )
    variables = each(
        keep(python_lang.exports(), lambda s: f"{s}.type = 'variable'"),
        lambda s, _: _export(s, f"{s}.type", *nothing),
    )
    kinds = {"function": functions, "class": classes, "variable": variables}
    parts = [made for kind, made in kinds.items() if only in (None, kind)]
    nothing_read = f"cast(array() as array<{schemas.EXPORT.simpleString()}>)"
    return (
        parsed.withColumn("exports", F.expr(f"concat({', '.join(parts)})" if parts else nothing_read))
        .withColumn("imports", F.expr(_imports(python_lang.named_imports())))
        .drop("functions", "classes")
    )


def unclosed(code: str = "code") -> str:
    """Which kinds of brackets of a text without comments and strings do not add up; null if all do."""
    counts = [f"length(replace({code}, '{x}', ''))" for x in "{}()[]"]
    kinds = [f"if({a} <> {b}, '{name}', null)" for a, b, name in zip(counts[::2], counts[1::2], ("block", "parenthesis", "bracket"), strict=True)]
    return f"nullif(concat_ws(', ', {', '.join(kinds)}), '')"


def problems(path: Column, rules: str, content: str, open_kinds: str) -> list[Column]:
    """Parse errors of a file, null where there is none."""
    return [
        F.when(F.col(rules).isNull(), unsupported(path)),
        F.when(F.col(rules).isNotNull() & F.col(content).isNull(), F.concat(F.lit("Unreadable file: "), path)),
        F.when(F.col(open_kinds).isNotNull(), F.concat(F.lit("Unclosed "), F.col(open_kinds), F.lit(" in file: "), path)),
    ]


def index_files(files: DataFrame, only: str | None = None) -> DataFrame:
    """Index rows ``(repoId, filePath, fileHash, language, exports, imports, parseErrors)`` of files
    ``(repoId, filePath, content, ...)``; other input columns are kept, ``content`` is not.

    With ``only``, one of ``KINDS``, ``exports`` holds just those of that kind that have details: Spark cannot leave out
    the steps that build the others, as all are entries of one array. One scan serves all languages: each rule set sees the content of its own files and an empty text for others.
    """
    kept = [c for c in files.columns if c not in ("content", "language")]
    rows = files.select(
        *kept,
        "content",
        S.content_hash(F.col("content")).alias("fileHash"),
        language_of(F.col("filePath")).alias("language"),
        language_of(F.col("filePath"), rules=True).alias("rules"),
    )
    columns = [*kept, "fileHash", "language", "rules", "content"]
    found: dict[str, list[str]] = {"exports": [], "imports": []}
    open_kinds = []
    for name, parse in (("typescript", typescript_exports), ("python", python_exports)):
        own = rows.withColumn("own_content", F.when(F.col("rules") == name, F.col("content")).otherwise(""))
        parsed = parse(own, "own_content", only)
        made = {kind: f"{name}_{kind}" for kind in found}
        open_kinds.append(f"{name}_unclosed")
        rows = parsed.select(
            *columns,
            *(F.col(kind).alias(column) for kind, column in made.items()),
            F.expr(unclosed()).alias(open_kinds[-1]),
        )
        columns += [*made.values(), open_kinds[-1]]
        for kind, column in made.items():
            found[kind].append(column)
    rows = rows.withColumn("unclosed", F.coalesce(*open_kinds))
    return rows.select(
        *kept,
        "fileHash",
        "language",
        *(F.concat(*parts).alias(kind) for kind, parts in found.items()),
        F.filter(F.array(*problems(F.col("filePath"), "rules", "content", "unclosed")), lambda e: e.isNotNull()).alias("parseErrors"),
    )
