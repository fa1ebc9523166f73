"""TypeScript and JavaScript symbols: exports, imports, signatures, class and interface members.

Every ``export`` word starts a span that runs to the next one, so a declaration is read from its own span
and the file is scanned once, however many declarations it has. ``code`` is the text with comments and
strings blanked, ``plain`` the text with comments blanked; both keep all offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksymbols.functions.text import ARROW, UNICODE, bind, brace_block, closing_offset, each, find_all, group, keep, lit
from sparksymbols.functions.text import newlines, no_items, shape, split_at, top_level, unarrowed
from sparksymbols.operators import mask
from sparksymbols.operators import rules as R
from sparksymbols.operators.signatures import Grammar, extend, trimmed, with_signatures

_EXPORT_WORD = len("export")
_MODIFIERS = "((?:(?:public|private|protected|static|async|abstract|readonly|override|declare|get|set)\\s+)*+)"
_ACCESS = "\\b(?:private|protected)\\b"
# Heads are read in the shape of a span: generics are a pair of brackets there.
_FUNCTION_START = UNICODE + "^\\s+(?:default\\s+)?(?:declare\\s+)?(?:async\\s+)?function\\b"
_FUNCTION_HEAD = UNICODE + (
    f"^\\s+(?:default\\s+)?(?:declare\\s+)?(async\\s+)?function\\b\\s*(\\*)?\\s*({R.NAME})\\s*(?:{R.GENERIC})?\\s*\\("
)
_CLASS_HEAD = UNICODE + f"{R.TS_CLASS}\\s*(?:{R.GENERIC})?([^{{]*+)\\{{"
_INTERFACE_HEAD = UNICODE + f"{R.TS_INTERFACE}\\s*(?:{R.GENERIC})?([^{{]*+)\\{{"
# A type in the shape of a text: an object literal where one may start, generics, parentheses, arrows, plain characters.
_TYPE = f"(?:{R.BRACES})?+(?:{R.GENERIC}|{R.PARENTHESES}|(?:{ARROW}|[|&])\\s*+{R.BRACES}|{ARROW}|[^{{}};=<>()\\n])*+"
# Decorators before a member or a parameter; in a shape their arguments are blanked.
_DECORATORS = f"(?:@[\\w$.]++\\s*+(?:{R.PARENTHESES}\\s*+)?+)*+"
GRAMMAR = Grammar(
    delimiters="[()\\[\\]{}<>]",
    openers="([{<",
    param="(?Uds)^(\\.{3})?\\s*+([\\w$]+)\\s*+(\\?)?\\s*+(?::((?:=>|[^=])++))?(?:=(.*))?$",
    optional_groups=(1, 3),
    name_group=2,
    type_group=4,
    default_group=5,
    returns=UNICODE + f"^\\)\\s*+:\\s*+({_TYPE})",
    body=UNICODE + f"^\\)\\s*+(?::\\s*+{_TYPE})?\\s*+\\{{",
    lead=f"(?Uds)^\\s*+{_DECORATORS}(?:(?:public|private|protected|readonly|override)\\s++)*+",
    pattern="^(?:\\{[^{}]*+\\}|\\[[^\\[\\]]*+\\])",
)
_MEMBER_START = f"(?:^|(?<=[;}}\\n]))\\s*+{_DECORATORS}"
# A method's parameters are blank in the outer level of a block; its generics are not, and are passed by their depth.
_METHOD_OPEN = "(?:\\((?=\\s*+\\))|<)"
_METHOD = "(?Ud)" + f"{_MEMBER_START}{_MODIFIERS}(\\*\\s*+)?(#?{R.NAME})\\s*+\\??\\s*+{_METHOD_OPEN}"
# The type of a field in the outer level of a block, where braces and parentheses hold blanks only.
_FIELD_TYPE = f"((?:{R.BRACES}|{R.PARENTHESES}|=>|[^=;\\n{{])++)"
# A field has a type, a value, or ends after its name.
_PROPERTY = "(?Ud)" + (
    f"{_MEMBER_START}{_MODIFIERS}(#?{R.NAME})[ \\t]*+(?:(\\?)|!)?[ \\t]*+(?::\\s*+{_FIELD_TYPE}|(?=\\s*+=(?![=>]))|(?=;|\\n|$))"
)
_PROPERTY_FORM = f"{_MEMBER_START}{_MODIFIERS}({R.NAME})\\s*+:\\s*+"
_SIMPLE_PROPERTY = "(?Ud)" + f"{_PROPERTY_FORM}(\\w+)(?:\\s*+=\\s*+[^;]+)?;"
_ARRAY_PROPERTY = "(?Ud)" + f"{_PROPERTY_FORM}(\\w+\\[\\s*+\\])"
_FIELD_START = "(?:^|(?<=[;,}\\n]))\\s*+"
_FIELD_METHOD = "(?Ud)" + f"{_FIELD_START}()()({R.NAME})\\s*+\\??\\s*+{_METHOD_OPEN}"
_FIELD_PROPERTY = "(?Ud)" + f"{_FIELD_START}(?:readonly\\s++)?({R.NAME})\\s*+(\\?)?\\s*+:\\s*+((?:{R.BRACES}|{R.PARENTHESES}|=>|[^=;,\\n{{])++)"

_EXPORT_ROW = "struct<rule_no:int,pos:int,name:string,type:string,visibility:string,line:int>"


def with_code(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``code``, ``plain`` and ``heads``, the spans that start with the word ``export``."""
    return mask.with_code(files, "typescript", content).withColumn("heads", F.expr(find_all("code", R.TS_EXPORT_HEAD)))


def exports(heads: str = "heads") -> str:
    """``array<struct<rule_no, pos, name, type, visibility, line>>`` in rule order, then text order."""

    def symbol(h: str, rule_no: int, kind: str, name: str) -> str:
        return (
            f"named_struct('rule_no', {rule_no}, 'pos', {h}.start, 'name', {name}, 'type', '{kind}',"
            f" 'visibility', 'public', 'line', {h}.line)"
        )

    def names(h: str, rule_no: int, kind: str, pattern: str) -> str:
        found = f"regexp_extract({h}.tail, {lit(UNICODE + pattern)}, 1)"
        if pattern in (R.TS_VARIABLE, R.TS_PATTERN):
            several = each(_declared(f"{h}.tail"), lambda name, _: symbol(h, rule_no, kind, name))
            if pattern == R.TS_PATTERN:
                return several
            plain = f"{h}.tail rlike {lit(UNICODE + _ONE_NAME)}"
            return f"if({plain}, array({symbol(h, rule_no, kind, found)}), {several})"
        if pattern != R.TS_LIST:
            return f"array({symbol(h, rule_no, kind, found)})"
        entries = keep(f"split({found}, ',')", lambda e: f"{trimmed(e)} <> ''")
        last_word = lit(UNICODE + "([\\w$]+)\\s*$")
        return each(entries, lambda e, _: symbol(h, rule_no, kind, f"regexp_extract({e}, {last_word}, 1)"))

    def cases(h: str) -> str:
        arms = " ".join(
            f"when {h}.tail rlike {lit(UNICODE + pattern)} then {names(h, rule_no, kind, pattern)}"
            for rule_no, kind, pattern in R.TS_EXPORTS
        )
        return f"case {arms} else {no_items(_EXPORT_ROW)} end"

    return f"array_sort(flatten({each(heads, lambda h, _: cases(h))}))"


# A declaration without a comma up to the end of its first line declares one name.
_ONE_NAME = f"^\\s+(?:declare\\s+)?(?:const|let|var)\\s+{R.NAME}[^,\\n(\\[{{<]*+(?:;|=\\s*+[^,\\n(\\[{{<]*+$|\\n|$)"


def _declared(tail: str) -> str:
    """Names that a ``const``, ``let`` or ``var`` declares: several declarators, and the names inside patterns."""
    word = UNICODE + f"^\\s*+({R.NAME})"
    pattern = UNICODE + f"^\\s*+({R.BRACES}|\\[[^\\[\\]]*+\\])"
    # The name that an entry of a pattern binds: the last one before a default or the end, whatever it is nested in.
    bound = UNICODE + f"^[^=]*?({R.NAME})[\\s}}\\]]*+(?:=|$)"

    def of_piece(piece: str, form: str) -> str:
        whole, size = f"regexp_extract({form}, {lit(pattern)}, 0)", f"regexp_extract({form}, {lit(pattern)}, 1)"
        inner = f"substring({piece}, length({whole}) - length({size}) + 1, length({size}))"
        entries = keep(f"split(substring({inner}, 2, length({inner}) - 2), ',')", lambda e: f"{e} rlike {lit(bound)}")
        inside = each(entries, lambda e, _: f"regexp_extract({e}, {lit(bound)}, 1)")
        return f"if({form} rlike {lit(pattern)}, {inside}, filter(array(regexp_extract({piece}, {lit(word)}, 1)), n -> n <> ''))"

    def of_text(text: str) -> str:
        def of_shape(form: str) -> str:
            pieces = bind(f"split({form}, ',', -1)", lambda f: each(split_at(form, text, ","), lambda piece, i: of_piece(piece, f"{f}[{i}]")))
            return f"flatten({pieces})"

        return bind(f"split({shape(text)}, ';')[0]", of_shape)

    return bind(f"regexp_extract({tail}, {lit(UNICODE + R.TS_DECLARATORS)}, 1)", of_text)


def imports(plain: str = "plain") -> str:
    """``array<struct<name, source, line>>``; the name is the word ``import``."""
    return each(
        find_all(plain, R.TS_IMPORT),
        lambda m, _: f"named_struct('name', 'import', 'source', regexp_extract({m}.text, {lit(R.TS_IMPORT)}, 1),"
        f" 'line', {m}.line)",
    )


def named_imports(plain: str = "plain") -> str:
    """One entry per imported name: ``array<struct<name, alias, kind, source, line>>``."""
    pattern = lit(R.TS_NAMED_IMPORT)

    def entry(m: str, name: str, alias: str, kind: str) -> str:
        return (
            f"named_struct('name', {name}, 'alias', {alias}, 'kind', {kind},"
            f" 'source', regexp_extract({m}.text, {pattern}, 2), 'line', {m}.line)"
        )

    def names(m: str, clause: str) -> str:
        inner = f"split(regexp_extract({clause}, r'\\{{([^}}]*)\\}}', 1), ',')"
        outer = f"split(regexp_replace({clause}, r'\\{{[^}}]*\\}}', ''), ',')"
        as_form = UNICODE + "^\\s*(?:type\\s+)?([\\w$]+)(?:\\s+as\\s+([\\w$]+))?\\s*$"
        named = each(
            keep(inner, lambda e: f"{trimmed(e)} <> ''"),
            lambda e, _: entry(m, f"regexp_extract({e}, {lit(as_form)}, 1)", group(e, as_form, 2), "'named'"),
        )
        star = "\\*\\s*as\\s+([\\w$]+)"
        others = each(
            keep(outer, lambda e: f"{trimmed(e)} <> ''"),
            lambda e, _: entry(
                m,
                f"coalesce({group(e, star)}, {trimmed(e)})",
                "cast(null as string)",
                f"if({e} like '%*%', 'namespace', 'default')",
            ),
        )
        return f"concat({others}, {named})"

    found = find_all(plain, R.TS_NAMED_IMPORT)
    clauses = each(found, lambda m, _: bind(f"regexp_extract({m}.text, {pattern}, 1)", lambda c: names(m, c)))
    return f"flatten({clauses})"


def reexports(plain: str = "plain") -> str:
    """Names handed on from another module: ``array<struct<name, original, source, line>>``; ``*`` stands for all."""
    pattern = lit(R.TS_REEXPORT)
    as_form = UNICODE + "^\\s*(?:type\\s+)?([\\w$]+)(?:\\s+as\\s+([\\w$]+))?\\s*$"

    def entry(m: str, name: str, original: str) -> str:
        return (
            f"named_struct('name', {name}, 'original', {original},"
            f" 'source', regexp_extract({m}.text, {pattern}, 2), 'line', {m}.line)"
        )

    def names(m: str, clause: str) -> str:
        listed = keep(f"split(regexp_replace({clause}, r'[{{}}]', ''), ',')", lambda e: f"{trimmed(e)} <> ''")
        original = lambda e: f"regexp_extract({e}, {lit(as_form)}, 1)"
        named = each(listed, lambda e, _: entry(m, f"coalesce({group(e, as_form, 2)}, {original(e)})", original(e)))
        return f"if({clause} = '*', array({entry(m, "'*'", "'*'")}), {named})"

    found = find_all(plain, R.TS_REEXPORT)
    return f"flatten({each(found, lambda m, _: bind(f'regexp_extract({m}.text, {pattern}, 1)', lambda c: names(m, c)))})"


def _spans(start: str, pattern: str, body: Callable[[str, str, str, str], str]) -> str:
    """``body(head, text after the header, same text of plain, header)`` for each export whose shape fits the pattern.

    ``start`` tells cheaply which spans to look at; the shape of these is made once.
    """
    found = keep("heads", lambda h: f"{h}.tail rlike {lit(start)}")

    def one(p: str, h: str) -> str:
        def with_header(header: str) -> str:
            after = f"substring({h}.tail, length({header}) + 1)"
            same = (
                f"substring({p}, {h}.start + {_EXPORT_WORD} + length({header}) + 1,"
                f" length({h}.tail) - length({header}))"
            )
            return f"if({header} = '', null, {body(h, after, same, header)})"

        return bind(f"regexp_extract({shape(f'{h}.tail')}, {lit(pattern)}, 0)", with_header)

    return keep(bind("plain", lambda p: each(found, lambda h, _: one(p, h))), lambda x: f"{x} is not null")


_CALLABLE_FIELDS = ("owner", "owner_pos", "owner_kind", "name", "visibility", "pos", "line")


def _function_spans() -> str:
    """Exported functions, overloads included, as callables of the file."""

    def body(h: str, after: str, same: str, header: str) -> str:
        return (
            f"named_struct('owner', '', 'owner_pos', -1, 'owner_kind', 'file',"
            f" 'name', regexp_extract({header}, {lit(_FUNCTION_HEAD)}, 3), 'visibility', 'public', 'pos', {h}.start,"
            f" 'line', {h}.line, 'is_async', {group(header, _FUNCTION_HEAD, 1)} is not null,"
            f" 'is_generator', {group(header, _FUNCTION_HEAD, 2)} is not null, 'after', {after}, 'same', {same})"
        )

    return _spans(_FUNCTION_START, _FUNCTION_HEAD, body)


def with_overloads(functions: str = "functions") -> str:
    """Group declarations of one name: the one with a body (else the first) is the function, the others its overloads."""

    def others(f: str, all_: str) -> str:
        return f"transform({keep(all_, lambda o: f'{o}.name = {f}.name and {o}.pos <> {f}.pos')}, o -> o.signature)"

    def is_main(f: str, all_: str) -> str:
        same = keep(all_, lambda o: f"{o}.name = {f}.name")
        with_body = keep(all_, lambda o: f"{o}.name = {f}.name and {o}.signature.hasBody")
        return f"{f}.pos = coalesce(get({with_body}, 0).pos, get({same}, 0).pos)"

    def grouped(all_: str, names: str, several: str) -> str:
        """Only declarations whose name comes again look at each other; ``names`` and ``several`` are these."""
        again = lambda f: f"array_contains({names}, {f}.name)"
        return each(
            keep(all_, lambda f: f"not {again(f)} or {is_main(f, several)}"),
            lambda f, _: f"named_struct('name', {f}.name, 'line', {f}.line, 'pos', {f}.pos, 'signature', {f}.signature,"
            f" 'overloads', {others(f, several)})",
        )

    def with_names(all_: str, names: str) -> str:
        return bind(keep(all_, lambda f: f"array_contains({names}, {f}.name)"), lambda several: grouped(all_, names, several))

    def repeated(all_: str) -> str:
        """Names that more than one declaration has: equal neighbours once they are sorted."""
        twice = lambda s: f"array_distinct(filter({s}, (x, i) -> i > 0 and x = {s}[i - 1]))"
        return bind(f"array_sort(transform({all_}, f -> f.name))", twice)

    return bind(functions, lambda all_: bind(repeated(all_), lambda names: with_names(all_, names)))


def simple_signatures(functions: str = "functions") -> str:
    """``array<struct<name, line, params, returnType, isAsync, isGenerator>>``: parameter names, first word of the type."""
    first_word = UNICODE + f"^({R.NAME})"
    return each(
        functions,
        lambda f, _: f"named_struct('name', {f}.name, 'line', {f}.line, 'params', {f}.signature.parameters.name,"
        f" 'returnType', coalesce({group(f'{f}.signature.returnType', first_word)}, 'any'),"
        f" 'isAsync', {f}.signature.isAsync, 'isGenerator', {f}.signature.isGenerator)",
    )


def _bare_names(items: str) -> str:
    """Entries of a comma list."""
    return each(keep(f"split({items}, ',')", lambda e: f"{trimmed(e)} <> ''"), lambda e, _: trimmed(e))


def _without_generics(clause: str) -> str:
    return f"regexp_replace({shape(clause, '[<>]', '<')}, {lit(R.GENERIC)}, '')"


def _heritage(clause: str) -> dict[str, str]:
    bare = _without_generics(clause)
    implements = lit("(?Uds)\\bimplements\\s+(.*)$")
    return {
        "extends": trimmed(group(bare, "(?Uds)\\bextends\\s+(.*?)(?=\\bimplements\\b|$)")),
        "implements": _bare_names(f"regexp_extract({bare}, {implements}, 1)"),
    }


_BLOCK_FIELDS = ("kind", "name", "clause", "line", "pos", "block_line", "same")


def _block_spans(kind: str, pattern: str) -> str:
    """Declarations that open a block, with the text after the brace."""

    def body(h: str, after: str, same: str, header: str) -> str:
        size = f"length(regexp_extract({header}, {lit(pattern)}, 2))"
        clause = bind(size, lambda n: f"substring({h}.tail, length({header}) - {n}, {n})")
        return (
            f"named_struct('kind', '{kind}', 'name', regexp_extract({header}, {lit(pattern)}, 1),"
            f" 'clause', {clause}, 'line', {h}.line, 'pos', {h}.start,"
            f" 'block_line', {h}.line + {newlines(header)}, 'same', {same}, 'after', {after})"
        )

    return _spans(UNICODE + (R.TS_CLASS if kind == "class" else R.TS_INTERFACE), pattern, body)


def _with_blocks(files: DataFrame, spans: list[str]) -> DataFrame:
    """Add ``blocks``: declarations with the text of their block (``block``, ``same``) and its outer level (``outer``)."""
    return (
        files.withColumn("blocks", F.expr(f"concat({', '.join(spans)})"))
        .withColumn("blocks", extend("blocks", _BLOCK_FIELDS, lambda c: {"block": brace_block(f"{c}.after")}))
        .withColumn(
            "blocks",
            extend("blocks", (*_BLOCK_FIELDS, "block"), lambda c: {"outer": top_level(f"{c}.block", "[(){}]", "({")}),
        )
    )


def _line(c: str, m: str) -> str:
    """Line of a member, not counting the blank lines and decorators its match starts with."""
    lead = f"regexp_extract({m}.text, {lit(f'^\\s*+{_DECORATORS}')}, 0)"
    return f"{c}.block_line + {m}.line - 1 + {newlines(lead)}"


def _visibility(modifiers: str, name: str) -> str:
    """Private by a modifier or by the mark that starts the name."""
    return f"if({modifiers} rlike {lit(_ACCESS)} or {name} like '#%', 'private', 'public')"


def _method_spans(kind: str, pattern: str) -> str:
    """Methods (and constructors) of all blocks of a kind."""
    words = ", ".join(f"'{w}'" for w in R.CONTROL_WORDS)

    def one(c: str, m: str) -> str:
        """A method, null if what follows the generics is no parameter list."""

        def passed(skipped: str) -> str:
            at = f"{m}.start + length({m}.text) + 1 + {skipped}"
            head = f"regexp_replace({m}.text, '[(<]\\\\z', '()')"
            return bind(head, lambda h: method(h, at, f"length({m}.tail) - {skipped}"))

        def method(head: str, at: str, size: str) -> str:
            modifiers = f"regexp_extract({head}, {lit(pattern)}, 1)"
            return (
                f"named_struct('owner', {c}.name, 'owner_pos', {c}.pos, 'owner_kind', {c}.kind,"
                f" 'name', regexp_extract({head}, {lit(pattern)}, 3),"
                f" 'visibility', {_visibility(modifiers, f'regexp_extract({head}, {lit(pattern)}, 3)')},"
                f" 'pos', {m}.start, 'line', {_line(c, m)}, 'is_async', {modifiers} rlike r'\\basync\\b',"
                f" 'is_generator', {group(head, pattern, 2)} is not null,"
                f" 'after', substring({c}.block, {at}, {size}), 'same', substring({c}.same, {at}, {size}))"
            )

        def opened(end: str) -> str:
            """Characters up to the parameters, behind generics that end at an offset of the tail; -1 without any."""
            gap = f"length(regexp_extract(substring({m}.tail, {end} + 2), {lit(UNICODE + '^\\s*+\\((?=\\s*+\\))')}, 0))"
            return bind(gap, lambda g: f"if({end} is null or {g} = 0, -1, {end} + 1 + {g})")

        generic = bind(closing_offset(unarrowed(f"{m}.tail"), "[<>]", "<"), opened)
        skipped = f"if(right({m}.text, 1) = '<', {generic}, 0)"
        return bind(skipped, lambda n: f"if({n} < 0, null, {passed(n)})")

    found = each(_of_kind(kind), lambda c, _: each(find_all(f"{c}.outer", pattern), lambda m, _: one(c, m)))
    return keep(f"flatten({found})", lambda m: f"{m}.name not in ({words})")


def _of_kind(kind: str) -> str:
    return keep("blocks", lambda c: f"{c}.kind = '{kind}'")


def _callables(owner_kind: str) -> str:
    return keep("callables", lambda c: f"{c}.owner_kind = '{owner_kind}'")


def _fields(kind: str, pattern: str, visibility_group: int, name_group: int, optional_group: int, type_group: int) -> str:
    """Properties of all blocks of a kind; a group number 0 stands for none.

    ``array<struct<owner, owner_pos, name, visibility, pos, line, type, required>>``
    """
    words = ", ".join(f"'{w}'" for w in R.RESERVED_WORDS)

    def one(c: str, m: str) -> str:
        def part(number: int) -> str:
            return f"regexp_extract({m}.text, {lit(pattern)}, {number})"

        # Blanks stand in the outer level where the text has more; the type is what a match ends with.
        size = f"length({part(type_group)})"
        written = bind(size, lambda n: f"substring({c}.same, {m}.start + length({m}.text) - {n} + 1, {n})")
        written = written if pattern in (_PROPERTY, _FIELD_PROPERTY) else part(type_group)
        visibility = _visibility(part(visibility_group), part(name_group)) if visibility_group else "'public'"
        required = f"{part(optional_group)} = ''" if optional_group else "true"
        return (
            f"named_struct('owner', {c}.name, 'owner_pos', {c}.pos, 'name', {part(name_group)},"
            f" 'visibility', {visibility}, 'pos', {m}.start, 'line', {_line(c, m)},"
            f" 'type', coalesce(nullif({trimmed(written)}, ''), 'any'), 'required', {required})"
        )

    found = each(_of_kind(kind), lambda c, _: each(find_all(f"{c}.outer", pattern), lambda m, _: one(c, m)))
    return keep(f"flatten({found})", lambda f: f"{f}.name not in ({words})")


def with_declarations(
    files: DataFrame, functions: bool = True, classes: bool = True, interfaces: bool = True
) -> DataFrame:
    """Add the wanted arrays.

    ``functions`` (name, line, pos, signature; overloads included); ``classes`` (name, line, pos, extends, implements)
    with ``methods`` (constructors too), ``properties`` (any type) and ``simple_properties`` (plain types, then arrays);
    ``interfaces`` (name, line, pos, extends) with ``interface_methods`` and ``interface_properties``.

    All blocks go through one set of steps, and all callables through one.
    """
    kinds = {"class": (classes, _CLASS_HEAD, _METHOD), "interface": (interfaces, _INTERFACE_HEAD, _FIELD_METHOD)}
    wanted = {kind: (head, method) for kind, (asked, head, method) in kinds.items() if asked}
    parsed = files
    spans = [_function_spans()] if functions else []
    if wanted:
        parsed = _with_blocks(parsed, [_block_spans(kind, head) for kind, (head, _) in wanted.items()])
        spans += [_method_spans(kind, method) for kind, (_, method) in wanted.items()]
    parsed = parsed.withColumn("callables", F.expr(f"concat({', '.join(spans)})"))
    parsed = with_signatures(parsed, "callables", _CALLABLE_FIELDS, GRAMMAR)

    made: dict[str, Column] = {}
    if functions:
        made["functions"] = F.expr(_callables("file"))
    if classes:
        simple = f"concat({_fields('class', _SIMPLE_PROPERTY, 1, 2, 0, 3)}, {_fields('class', _ARRAY_PROPERTY, 1, 2, 0, 3)})"
        made["classes"] = extend(_of_kind("class"), ("name", "line", "pos"), lambda c: _heritage(f"{c}.clause"))
        made["methods"] = F.expr(_callables("class"))
        made["properties"] = F.expr(_fields("class", _PROPERTY, 1, 2, 3, 4))
        made["simple_properties"] = F.expr(simple)
    if interfaces:
        made["interfaces"] = extend(_of_kind("interface"), ("name", "line", "pos"), lambda c: _parents(f"{c}.clause"))
        made["interface_methods"] = F.expr(_callables("interface"))
        made["interface_properties"] = F.expr(_fields("interface", _FIELD_PROPERTY, 0, 1, 2, 3))
    return parsed.select(*files.columns, *(column.alias(name) for name, column in made.items()))


def with_functions(files: DataFrame) -> DataFrame:
    return with_declarations(files, classes=False, interfaces=False)


def with_classes(files: DataFrame) -> DataFrame:
    return with_declarations(files, functions=False, interfaces=False)


def with_interfaces(files: DataFrame) -> DataFrame:
    return with_declarations(files, functions=False, classes=False)


def _parents(clause: str) -> dict[str, str]:
    bare = _without_generics(clause)
    return {"extends": _bare_names(f"regexp_extract({bare}, {lit('(?Uds)^\\s*extends\\s+(.*)$')}, 1)")}


def class_members(methods: str = "methods", simple: str = "simple_properties") -> str:
    """``array<struct<owner, name, kind, visibility, line>>``: first methods of a name with a body, simple properties
    that are not also methods, the first constructor."""

    def first(members: str) -> str:
        return bind(
            members,
            lambda a: bind(
                f"transform({a}, x -> concat(x.owner_pos, ' ', x.name))",
                lambda keys: f"filter({a}, (x, i) -> array_position({keys}, {keys}[i]) = i + 1)",
            ),
        )

    def row(x: str, kind: str) -> str:
        return (
            f"named_struct('owner', {x}.owner, 'name', {x}.name, 'kind', {kind}, 'visibility', {x}.visibility,"
            f" 'line', {x}.line)"
        )

    def rows(called: str) -> str:
        fields = keep(simple, lambda f: f"not exists({called}, c -> c.owner_pos = {f}.owner_pos and c.name = {f}.name)")
        made = each(first(called), lambda x, _: row(x, f"if({x}.name = 'constructor', 'constructor', 'method')"))
        return f"concat({made}, {each(first(fields), lambda x, _: row(x, lit('property')))})"

    return bind(keep(methods, lambda m: f"{m}.signature.hasBody and {m}.name <> {m}.owner"), rows)
