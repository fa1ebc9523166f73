"""SQL builders for text spans, running sums and line numbers, all inside Catalyst.

Each function takes and returns SQL expression text (use it with ``F.expr``): one parse by Spark is much
cheaper than one driver round trip for each node of a nested expression.

A rule match is found with one ``split`` (the gaps) and one ``regexp_extract_all`` (the matches) over the
content; offsets and line numbers are running sums over the lengths of those pieces. Nothing is exploded,
so the content never crosses a shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

# Java: \w and \s follow Unicode, ^ and $ see only "\n" as the end of a line.
UNICODE = "(?Ud)"
MULTILINE = "(?Udm)"

#: Values that are summed up, and brackets that are walked over, in one go.
_RUN = 64
#: Of two counts in one long, one of the upper.
_ONE = 1 << 32
_names = itertools.count()


def fresh(prefix: str) -> str:
    """A lambda variable name that no other expression uses."""
    return f"{prefix}{next(_names)}"


def lit(text: str) -> str:
    """A SQL string literal; quotes inside a regular expression are written as code points."""
    return "r'" + text.replace("'", "\\x27") + "'"


def bind(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    v = fresh("v")
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def each(items: str, body: Callable[[str, str], str]) -> str:
    """``transform`` with an element and its index."""
    x, i = fresh("x"), fresh("i")
    return f"transform({items}, ({x}, {i}) -> {body(x, i)})"


def keep(items: str, test: Callable[[str], str]) -> str:
    x = fresh("x")
    return f"filter({items}, {x} -> {test(x)})"


def newlines(text: str) -> str:
    """Number of line breaks in ``text``."""
    return f"if(contains({text}, '\\n'), length({text}) - length(replace({text}, '\\n', '')), 0)"


def blank(text: str) -> str:
    """``text`` with every character but line breaks turned into a blank (offsets and lines stay)."""
    lines = f"array_join({each(f"split({text}, '\\n', -1)", lambda line, _: f"repeat(' ', length({line}))")}, '\\n')"
    return f"if(contains({text}, '\\n'), {lines}, repeat(' ', length({text})))"


def no_items(of: str) -> str:
    """An empty array of the given element type."""
    return f"cast(array() as array<{of}>)"


def indices(n: str) -> str:
    """0 .. n-1; empty for n = 0 (``sequence`` would count down)."""
    return f"if({n} > 0, sequence(0, {n} - 1), {no_items('int')})"


def total(items: str, none: str = "0") -> str:
    a, v = fresh("a"), fresh("n")
    return f"aggregate({items}, {none}, ({a}, {v}) -> {a} + {v})"


def running_sum(values: str, none: str = "0") -> str:
    """Inclusive running sums of an array of ints (of longs with ``none`` = ``0L``).

    Runs of bounded length start with the sum of what comes before them, so the work is near-linear: one ``aggregate``
    that appends to an array copies the array for each element.
    """

    def summed(run: str, start: str) -> str:
        a, x = fresh("a"), fresh("x")
        return f"slice(aggregate({run}, array({start}), ({a}, {x}) -> array_append({a}, element_at({a}, -1) + {x})), 2, {_RUN})"

    def of_runs(v: str) -> str:
        count = f"cast((size({v}) + {_RUN - 1}) div {_RUN} as int)"
        sums = each(indices(count), lambda r, _: total(f"slice({v}, {r} * {_RUN} + 1, {_RUN})", none))
        starts = bind(sums, lambda s: each(s, lambda _, r: total(f"slice({s}, 1, {r})", none)))
        return f"flatten({each(starts, lambda start, r: summed(f'slice({v}, {r} * {_RUN} + 1, {_RUN})', start))})"

    return bind(values, lambda v: f"if(size({v}) <= {_RUN}, {summed(v, none)}, {of_runs(v)})")


SPAN = "struct<start:int,line:int,text:string,tail:string>"


def find_all(content: str, pattern: str) -> str:
    """All matches in text order: ``array<struct<start, line, text, tail>>``.

    ``start`` is a 0-based character offset, ``line`` is 1-based, ``tail`` is the text between this match
    and the next one (or the end).
    """

    def spans(gaps: str, found: str) -> str:
        # Characters in the upper half of a number, lines in the lower one.
        sizes = each(
            found,
            lambda m, i: f"(length({gaps}[{i}]) + length({m})) * {_ONE}L + {newlines(f'{gaps}[{i}]')} + {newlines(m)}",
        )
        rows = bind(
            running_sum(sizes, "0L"),
            lambda ends: each(
                found,
                lambda m, i: f"named_struct('start', cast({ends}[{i}] div {_ONE}L as int) - length({m}),"
                f" 'line', cast({ends}[{i}] % {_ONE}L as int) - {newlines(m)} + 1, 'text', {m}, 'tail', {gaps}[{i} + 1])",
            ),
        )
        return f"if(size({found}) > 0, {rows}, {no_items(SPAN)})"

    return bind(
        f"split({content}, {lit(pattern)}, -1)",
        lambda gaps: bind(f"regexp_extract_all({content}, {lit(pattern)}, 0)", lambda found: spans(gaps, found)),
    )


def rebuild(content: str, pattern: str, replace: Callable[[str], str]) -> str:
    """``content`` with each match of ``pattern`` replaced by ``replace(match)``."""

    def joined(gaps: str, found: str) -> str:
        pieces = each(gaps, lambda g, i: f"concat({g}, coalesce({replace(f'get({found}, {i})')}, ''))")
        return f"array_join({pieces}, '')"

    return bind(
        f"split({content}, {lit(pattern)}, -1)",
        lambda gaps: bind(f"regexp_extract_all({content}, {lit(pattern)}, 0)", lambda found: joined(gaps, found)),
    )


def group(text: str, pattern: str, number: int = 1) -> str:
    """One capture group of the first match; null if the group is empty."""
    return f"nullif(regexp_extract({text}, {lit(pattern)}, {number}), '')"


def brace_end(text: str) -> str:
    """Offset of the ``}}`` that closes a block whose ``{{`` came just before ``text``; null if none does."""
    return closing_offset(text, "[{}]", "{")


def closing_offset(text: str, delimiters: str, openers: str) -> str:
    """Offset of the delimiter that brings the depth below that of the start of ``text``; null if none does.

    One pass counts delimiters and the depth, which starts at one; at none it stays as it is.
    """
    opening = ", ".join(f"'{o}'" for o in openers)

    def at(t: str) -> str:
        a, d = fresh("a"), fresh("d")
        step = f"if({d} in ({opening}), {_ONE + 1}L, {_ONE - 1}L)"
        found = f"regexp_extract_all({t}, {lit(delimiters)}, 0)"
        walked = f"aggregate({found}, 1L, ({a}, {d}) -> if({a} % {_ONE}L = 0L, {a}, {a} + {step}))"
        place = bind(walked, lambda w: f"if({w} % {_ONE}L = 0L, cast({w} div {_ONE}L as int), 0)")
        lengths = lambda k: each(f"slice(split({t}, {lit(delimiters)}, {k} + 1), 1, {k})", lambda g, _: f"length({g})")
        return bind(place, lambda k: f"if({k} = 0, null, {total(lengths(k))} + {k} - 1)")

    return bind(text, at)


def brace_block(text: str) -> str:
    """Text up to the matching ``}}`` of a block opened just before ``text``; empty if unbalanced."""
    return bind(text, lambda t: bind(brace_end(t), lambda end: f"if({end} is null, '', substring({t}, 1, {end}))"))


def first_block(text: str) -> str:
    """Text inside the first ``{{...}}`` of ``text``; empty if there is none or it never closes."""
    return bind(
        text,
        lambda t: bind(
            f"locate('{{', {t})", lambda p: f"if({p} = 0, '', {brace_block(f'substring({t}, {p} + 1)')})"
        ),
    )


def split_at(shape: str, original: str, separator: str) -> str:
    """Split ``original`` where ``shape`` (same length, nested parts blanked) has ``separator``."""

    def pieces(gaps: str) -> str:
        ends = running_sum(each(gaps, lambda g, _: f"length({g}) + 1"))
        return bind(
            ends, lambda e: each(gaps, lambda g, i: f"substring({original}, {e}[{i}] - length({g}), length({g}))")
        )

    return bind(f"split({shape}, {lit(separator)}, -1)", pieces)


def top_level(text: str, delimiters: str = "[{}]", openers: str = "{") -> str:
    """``text`` with everything inside nested blocks blanked; the outer delimiters stay.

    Runs of delimiters are walked in one pass each, from the depth that the runs before them lead to.
    """
    opening = ", ".join(f"'{o}'" for o in openers)

    def depths(found: str) -> str:
        """The depth at which each run starts."""
        step = lambda d, _: f"if({d} in ({opening}), 1, -1)"
        runs = each(indices(f"cast(size({found}) div {_RUN} as int) + 1"), lambda r, _: total(each(f"slice({found}, {r} * {_RUN} + 1, {_RUN})", step)))
        several = bind(runs, lambda sums: each(sums, lambda _, r: total(f"slice({sums}, 1, {r})")))
        return f"if(size({found}) < {_RUN}, array(0), {several})"

    def walked(gaps: str, found: str, start: str, run: str) -> str:
        a, i, x = fresh("a"), fresh("i"), fresh("x")
        gap, delimiter = f"{gaps}[{i}]", f"{found}[{i}]"
        after = f"{a}.depth + if({delimiter} in ({opening}), 1, -1)"
        kept = f"if({a}.depth <= 0, {gap}, {blank(gap)})"
        step = (
            f"if({i} >= size({found}), named_struct('depth', {a}.depth, 'text', concat({a}.text, {kept})),"
            f" named_struct('depth', {after}, 'text', concat({a}.text, {kept}, if(least({a}.depth, {after}) <= 0, {delimiter}, ' '))))"
        )
        places = f"sequence({run} * {_RUN}, least(size({found}), {run} * {_RUN} + {_RUN - 1}))"
        return f"aggregate({places}, named_struct('depth', {start}, 'text', ''), ({a}, {i}) -> {step}, {x} -> {x}.text)"

    def joined(gaps: str, found: str) -> str:
        runs = each(depths(found), lambda start, run: walked(gaps, found, start, run))
        return f"if(size({found}) = 0, {gaps}[0], array_join({runs}, ''))"

    return bind(
        text,
        lambda t: bind(
            f"split({t}, {lit(delimiters)}, -1)",
            lambda gaps: bind(f"regexp_extract_all({t}, {lit(delimiters)}, 0)", lambda found: joined(gaps, found)),
        ),
    )


ARROW = "\u21d2\u21d2"
BRACKETS, OPENERS = "[()\\[\\]{}<>]", "([{<"


def unarrowed(text: str) -> str:
    """``text`` with ``=>`` written as two other characters, so that its bracket closes nothing."""
    return f"replace({text}, '=>', '{ARROW}')"


def shape(text: str, delimiters: str = BRACKETS, openers: str = OPENERS) -> str:
    """``text`` with all that stands inside brackets blanked, whatever the depth; offsets and lines stay.

    One scan over the brackets gives the depth of every piece between them. On the result a balanced group is an
    opening, blanks and a closing bracket, so patterns need no nesting.
    """
    return top_level(unarrowed(text), delimiters, openers)
