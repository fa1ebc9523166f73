"""Signatures read from the text after an opening parenthesis, one shallow step per column.

Each step names the step before it once, as the argument of ``transform``: Spark may fold the steps into one
projection, and no work is repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksymbols.functions.text import bind, closing_offset, each, group, keep, lit, shape, split_at

BLANKS = "' \\n\\t\\r'"
PARAMETER = "struct<name:string,type:string,required:boolean,defaultValue:string,description:string>"
SIGNATURE = (
    f"struct<parameters:array<{PARAMETER}>,returnType:string,isAsync:boolean,isGenerator:boolean,hasBody:boolean>"
)


class Grammar(NamedTuple):
    """How a language writes parameters: groups are (marks that make it optional, name, type, default).

    ``lead`` is what may stand before a parameter and ``pattern`` one that takes a value apart; both are read, as
    ``returns`` and ``body``, in the shape of the text, where brackets hold nothing.
    """

    delimiters: str
    openers: str
    param: str
    optional_groups: tuple[int, ...]
    name_group: int
    type_group: int
    default_group: int
    returns: str
    body: str
    after_type: str = ""
    lead: str = ""
    pattern: str = ""


def extend(column: str, fields: tuple[str, ...], new: Callable[[str], dict[str, str]]) -> Column:
    """The structs of an array column with the given fields kept and new ones added."""

    def entry(x: str) -> str:
        values = {name: f"{x}.{name}" for name in fields} | new(x)
        return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in values.items()) + ")"

    return F.expr(each(column, lambda x, _: entry(x)))


def trimmed(text: str) -> str:
    return f"btrim({text}, {BLANKS})"


def _parameter(text: str, g: Grammar) -> str:
    """A parameter from ``struct<text, name>``; ``name`` is a pattern that stands as one word in the text."""
    p = f"{text}.text"
    marks = (*g.optional_groups, g.default_group)
    required = " and ".join(f"{group(p, g.param, n)} is null" for n in marks)
    return (
        f"named_struct('name', coalesce({text}.name, regexp_extract({p}, {lit(g.param)}, {g.name_group})),"
        f" 'type', coalesce({trimmed(group(p, g.param, g.type_group))}, 'any'), 'required', {required},"
        f" 'defaultValue', {trimmed(group(p, g.param, g.default_group))}, 'description', cast(null as string))"
    )


def with_signatures(
    files: DataFrame, column: str, fields: tuple[str, ...], grammar: Grammar, typed_only: bool = False
) -> DataFrame:
    """Replace ``after`` and ``same`` (text from just after ``(``, blanked and plain) and the flags ``is_async`` and
    ``is_generator`` in the structs of ``column`` by ``signature``; null where the parenthesis never closes."""
    flags = ("is_async", "is_generator")

    def piece(text: str, form: str) -> str:
        """A parameter without what stands before it; a pattern is taken out, and a word stands for it."""
        if not grammar.lead:
            return f"named_struct('text', {text}, 'name', cast(null as string))"

        def whole(from_: str) -> str:
            size = f"length(regexp_extract(substring({form}, {from_}), {lit(grammar.pattern)}, 0))"
            return bind(
                size,
                lambda n: f"if({n} = 0, named_struct('text', substring({text}, {from_}), 'name', cast(null as string)),"
                f" named_struct('text', concat('_', substring({text}, {from_} + {n})), 'name', substring({text}, {from_}, {n})))",
            )

        return bind(f"length(regexp_extract({form}, {lit(grammar.lead)}, 0)) + 1", whole)

    def pieces(x: str) -> dict[str, str]:
        texts, forms = split_at(f"{x}.shape", f"{x}.text", ","), f"split({x}.shape, ',', -1)"
        joined = bind(forms, lambda f: each(texts, lambda t, i: piece(t, f"{f}[{i}]")))
        return {"pieces": joined, "type_at": f"length(regexp_extract({x}.rest_shape, {lit(grammar.returns)}, 0))"}

    def signature(x: str) -> dict[str, str]:
        test = (lambda p: f"{group(f'{p}.text', grammar.param, grammar.type_group)} is not null") if typed_only else (
            lambda p: f"{p}.text rlike {lit(grammar.param)}"
        )
        size = f"length(regexp_extract({x}.rest_shape, {lit(grammar.returns)}, 1))"
        returned = bind(size, lambda n: f"nullif({trimmed(f'substring({x}.rest, {x}.type_at - {n} + 1 - {len(grammar.after_type)}, {n})')}, '')")
        params = each(keep(f"{x}.pieces", test), lambda p, _: _parameter(p, grammar))
        return {
            "signature": f"if({x}.end is null, cast(null as {SIGNATURE}), named_struct('parameters', {params},"
            f" 'returnType', coalesce({returned}, 'any'),"
            f" 'isAsync', {x}.is_async, 'isGenerator', {x}.is_generator,"
            f" 'hasBody', {x}.rest_shape rlike {lit(grammar.body)}))"
        }

    return (
        files.withColumn(
            column,
            extend(
                column,
                (*fields, *flags, "after", "same"),
                lambda x: {"end": closing_offset(f"{x}.after", "[()]", "(")},
            ),
        )
        .withColumn(
            column,
            extend(
                column,
                (*fields, *flags, "end"),
                lambda x: {
                    "shape": shape(f"substring({x}.after, 1, {x}.end)", grammar.delimiters, grammar.openers),
                    "text": f"substring({x}.same, 1, {x}.end)",
                    "rest": f"substring({x}.same, {x}.end + 1)",
                    "rest_shape": f"concat(')', {shape(f'substring({x}.after, {x}.end + 2)', grammar.delimiters, grammar.openers)})",
                },
            ),
        )
        .withColumn(column, extend(column, (*fields, *flags, "end", "rest", "rest_shape"), pieces))
        .withColumn(column, extend(column, fields, signature))
    )
