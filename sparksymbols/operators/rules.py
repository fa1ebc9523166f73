"""Extraction rules. A rule set is a short list of rows; it is compiled into column expressions, so a file's
content is read by each rule in place and never repeated per rule."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from sparksymbols.functions.text import MULTILINE, UNICODE, each, find_all, lit, no_items


class Rule(NamedTuple):
    """One pattern: ``name_group`` holds the symbol name, ``source_group`` (0 = none) an import source."""

    language: str
    rule_no: int
    pattern: str
    kind: str
    name_group: int = 1
    source_group: int = 0


SYMBOL = "struct<rule_no:int,pos:int,name:string,type:string,visibility:string,source:string,line:int>"

# Generics, parentheses and braces in the shape of a text (``text.shape``), where nothing stands inside them.
GENERIC, PARENTHESES, BRACES = "<[^<>]*+>", "\\([^()]*+\\)", "\\{[^{}]*+\\}"
NAME = "[\\w$]+"

# The forms of an export statement, as the text after the word "export".
TS_EXPORT_HEAD = UNICODE + (
    "export(?<![\\w.$]export)(?=\\s*[{*]|\\s+(?:default|declare|async|abstract|function|class|interface|const|let|var|type|"
    "enum|namespace|module|[\\w$]+\\s*=))"
)
TS_FUNCTION = f"^\\s+(?:default\\s+)?(?:declare\\s+)?(?:async\\s+)?function\\b\\s*\\*?\\s*({NAME})"
TS_CLASS = f"^\\s+(?:default\\s+)?(?:declare\\s+)?(?:abstract\\s+)?class\\s+(?!extends\\b)({NAME})"
TS_INTERFACE = f"^\\s+(?:default\\s+)?(?:declare\\s+)?interface\\s+({NAME})"
TS_VARIABLE = f"^\\s+(?:declare\\s+)?(?:const|let|var)\\s+(?!enum\\b)({NAME})"
TS_TYPE = f"^\\s+(?:declare\\s+)?type\\s+({NAME})"
TS_LIST = "^\\s*(?:type\\s+)?\\{([^}]*)\\}"
TS_DEFAULT = f"^\\s+default\\s+(?!(?:function|class|abstract|async|interface|new|await)\\b)(?!\\d)({NAME})"
TS_ASSIGN = f"^\\s+(?!(?:default|const|let|var|type|async|declare)\\b)({NAME})\\s*=\\s*\\w+"
# Forms beyond the fixed ones. What has no name of its own is called "default" or "*".
TS_PATTERN = "^\\s+(?:declare\\s+)?(?:const|let|var)\\s*(?=[{\\[])()"
TS_ENUM = f"^\\s+(?:declare\\s+)?(?:const\\s+)?enum\\s+({NAME})"
TS_NAMESPACE = f"^\\s+(?:declare\\s+)?(?:namespace|module)\\s+({NAME}(?:\\.{NAME})*)"
TS_STAR_AS = f"^\\s*\\*\\s*as\\s+({NAME})"
TS_STAR = "^\\s*(\\*)(?!\\s*as\\b)"
TS_DEFAULT_FUNCTION = "^\\s+(default)\\s+(?:async\\s+)?function\\s*\\*?\\s*(?=\\()"
TS_DEFAULT_CLASS = "^\\s+(default)\\s+(?:abstract\\s+)?class\\s*(?=\\{|extends\\b)"
TS_DEFAULT_VALUE = "^\\s+(default)(?:\\s*[\\[{(\"'`!~+-]|\\s+\\d|\\s+(?:new|await)\\b|\\s+async\\s*(?!\\s*function\\b)[\\w$(])"
TS_EXPORTS = (
    (1, "function", TS_FUNCTION),
    (2, "class", TS_CLASS),
    (3, "interface", TS_INTERFACE),
    (4, "variable", TS_VARIABLE),
    (5, "type", TS_TYPE),
    (6, "variable", TS_LIST),
    (7, "variable", TS_DEFAULT),
    (8, "variable", TS_ASSIGN),
    (9, "variable", TS_PATTERN),
    (10, "variable", TS_ENUM),
    (11, "variable", TS_NAMESPACE),
    (12, "variable", TS_STAR_AS),
    (13, "variable", TS_STAR),
    (14, "function", TS_DEFAULT_FUNCTION),
    (15, "class", TS_DEFAULT_CLASS),
    (16, "variable", TS_DEFAULT_VALUE),
)
# A declaration with all its lines: those that start with a blank or a closing bracket go on.
TS_DECLARATORS = "^\\s+(?:declare\\s+)?(?:const|let|var)\\b((?:[^\\n]|\\n(?=[ \\t)\\]},]))*+)"

# The forms of an import statement.
TS_IMPORT = UNICODE + f"import(?<!\\wimport)\\s+(?:\\{{[^}}]*\\}}|{NAME})\\s+from\\s+[\"']([^\"']+)[\"']"
# Words up to a "from" that a quote follows; each word is taken whole, so a search never goes back over blanks.
TS_NAMED_IMPORT = UNICODE + (
    "import(?<!\\wimport)\\s++(?:type\\s++)?((?:(?!from\\s*+[\"'])[\\w$*{},]++\\s*+)++)from\\s*+[\"']([^\"']++)[\"']"
)

# Names handed on from another module.
TS_REEXPORT = UNICODE + "export(?<![\\w.$]export)\\s*+(?:type\\s*+)?(\\*(?!\\s*+as\\b)|\\{[^}]*+\\})\\s*+from\\s*+[\"']([^\"']++)[\"']"

# Definitions and imports of Python modules.
PY_EXPORTS = (
    Rule("python", 1, MULTILINE + "^(?:async[ \\t]+)?def\\s+(\\w+)\\s*\\(", "function"),
    Rule("python", 2, MULTILINE + "^class\\s+(\\w+)", "class"),
    Rule("python", 3, MULTILINE + "^(\\w+)\\s*=\\s*\\w+", "variable"),
)
PY_EXPORTS_ALL_LEVELS = (
    Rule("python", 1, UNICODE + "\\bdef\\s+(\\w+)\\s*\\(", "function"),
    Rule("python", 2, UNICODE + "\\bclass\\s+(\\w+)", "class"),
    Rule("python", 3, UNICODE + "(\\w+)\\s*=\\s*\\w+", "variable"),
)
PY_IMPORTS = (
    Rule("python", 1, MULTILINE + "^[ \\t]*import\\s+(\\w+)", "import", 0, 1),
    Rule("python", 2, MULTILINE + "^[ \\t]*from\\s+([\\w.]+)\\s+import", "import", 0, 1),
)

# Words that look like a call or a method but are statements.
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "return", "function", "with", "await", "super", "new", "throw")
RESERVED_WORDS = ("extends", "implements")

# Rules for links and variables in web pages.
PAGE_RULES = (
    Rule("html", 1, '<a href="([^"]*)">([^<]*)</a>', "import", 2, 1),
    Rule("html", 2, "\\bvar ([A-Za-z_]+)=", "variable"),
)


def rule_matches(content: str, rule: Rule) -> str:
    """All symbols one rule finds, as ``array<SYMBOL>``."""
    pattern = lit(rule.pattern)
    name = f"regexp_extract(m, {pattern}, {rule.name_group})" if rule.name_group else lit(rule.kind)
    source = f"regexp_extract(m, {pattern}, {rule.source_group})" if rule.source_group else "cast(null as string)"
    return each(
        find_all(content, rule.pattern),
        lambda m, _: f"named_struct('rule_no', {rule.rule_no}, 'pos', {m}.start,"
        f" 'name', {name.replace('(m,', f'({m}.text,')}, 'type', {lit(rule.kind)}, 'visibility', 'public',"
        f" 'source', {source.replace('(m,', f'({m}.text,')}, 'line', {m}.line)",
    )


def apply_rules(content: str, rules: Iterable[Rule]) -> str:
    """Results of all rules, in rule order and then text order."""
    found = [rule_matches(content, rule) for rule in sorted(rules, key=lambda r: r.rule_no)]
    return f"concat({', '.join(found)})" if found else no_items(SYMBOL)


class RuleRegistry:
    """Rule sets by language; users add their own rows."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self.rules: dict[str, list[Rule]] = {}
        self.add(*rules)

    def add(self, *rules: Rule) -> RuleRegistry:
        for rule in rules:
            self.rules.setdefault(rule.language, []).append(rule)
        return self

    @property
    def languages(self) -> list[str]:
        return sorted(self.rules)

    def symbols(self, content: str, language: str) -> str:
        """Symbols under the rules of the row's language; null where no rule set covers it."""
        cases = " ".join(
            f"when {language} = {lit(name)} then {apply_rules(content, rules)}" for name, rules in self.rules.items()
        )
        return f"case {cases} else cast(null as array<{SYMBOL}>) end" if cases else f"cast(null as array<{SYMBOL}>)"
