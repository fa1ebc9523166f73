"""Symbol extraction, nested rows and counts over pages, texts and generated source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksymbols import bindings as B
from sparksymbols.functions import scalars as S
from sparksymbols.operators import extract, mask, nested, python_lang, typescript
from sparksymbols.operators import filters as L
from sparksymbols.operators import joins as J
from sparksymbols.operators import metrics as A
from sparksymbols.operators import mutations as M
from sparksymbols.operators.rules import Rule
from sparksymbols.operators.skew import first_rows
from sparksymbols.plans import registry as R
from sparksymbols.plans.lookups import KEYS, PAGES, WEB_LANGUAGES, page_index
from sparksymbols.plans.registry import facts, fill, query
from sparksymbols.session import checkpointed


def ts_code(spark: SparkSession, folder: str) -> DataFrame:
    return typescript.with_code(B.spread(B.typescript_files(spark, folder)))


def py_code(spark: SparkSession, folder: str) -> DataFrame:
    return mask.with_code(B.spread(B.python_files(spark, folder)), "python")


def ts_index(spark: SparkSession, folder: str, only: str | None = None) -> DataFrame:
    return extract.index_files(B.spread(B.typescript_files(spark, folder)), only)


def rows_of(files: DataFrame, array: str, **columns: str) -> DataFrame:
    """One row per array entry with the given expressions over its fields."""
    listed = nested.entries(files, F.expr(array), ["filePath"])
    return listed.selectExpr("filePath", *(f"{expr} as {name}" for name, expr in columns.items()))


def ts_sql(columns: str, rows: list[tuple], select: str, methods: str = "") -> str:
    """Expected rows of the TypeScript files: facts per file, plus one row per generated method."""
    return f"WITH {R.TS_DOCS} SELECT {select} FROM docs, {facts(columns, rows)}" + (f" UNION ALL {methods}" if methods else "")


def py_sql(columns: str, rows: list[tuple], select: str, methods: str = "") -> str:
    return ts_sql(columns, rows, select, methods).replace(R.TS_DOCS, R.PY_DOCS)


# Lines of the templates in bindings, counted from the last line of the text. after = 1: below the generated methods.
TS_EXPORTS = [
    (5, 0, 1, "function", "fn<n>"),
    (9, 0, 1, "function", "gen<n>"),
    (11, 0, 1, "function", "over<n>"),
    (12, 0, 1, "function", "over<n>"),
    (13, 0, 1, "function", "over<n>"),
    (14, 0, 3, "interface", "Shape<n>"),
    (19, 0, 5, "type", "Alias<n>"),
    (20, 0, 4, "variable", "value<n>"),
    (21, 0, 6, "variable", "one<n>"),
    (21, 0, 6, "variable", "three<n>"),
    (22, 0, 2, "class", "Svc<n>"),
    (31, 1, 7, "variable", "Svc<n>"),
]
PY_EXPORTS = [
    (7, 0, 1, "function", "load<n>"),
    (11, 0, 1, "function", "fetch<n>"),
    (22, 1, 1, "function", "tail<n>"),
    (13, 0, 2, "class", "Store<n>"),
    (6, 0, 3, "variable", "LIMIT<n>"),
]
EXPORT_SELECT = f"filePath, rule_no, type, {fill('name')} AS name, CAST(base + j + after_methods * k AS INT) AS line"
EXPORT_COLUMNS = "j, after_methods, rule_no, type, name"


@query("X1_ts_exports", ts_sql(EXPORT_COLUMNS, TS_EXPORTS, EXPORT_SELECT))
def ts_exports(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(
        ts_code(spark, folder), typescript.exports(), rule_no="rule_no", type="type", name="name", line="line"
    )


FORM_EXPORTS = [
    (2, 0, 10, "variable", "Color<n>"),
    (3, 0, 10, "variable", "Size<n>"),
    (4, 0, 11, "variable", "Space<n>"),
    (5, 0, 13, "variable", "*"),
    (6, 0, 12, "variable", "all<n>"),
    (7, 0, 9, "variable", "left<n>"),
    (7, 0, 9, "variable", "east<n>"),
    (7, 0, 9, "variable", "rest<n>"),
    (8, 0, 4, "variable", "one<n>"),
    (8, 0, 4, "variable", "two<n>"),
    (8, 0, 4, "variable", "three<n>"),
    (9, 0, 16, "variable", "default"),
    (11, 0, 2, "class", "Form<n>"),
]


@query("X1_export_forms", ts_sql(EXPORT_COLUMNS, FORM_EXPORTS, EXPORT_SELECT))
def export_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Exports without a plain name, several names in one statement, names inside patterns."""
    code = typescript.with_code(B.spread(B.typescript_forms(spark, folder)))
    return rows_of(code, typescript.exports(), rule_no="rule_no", type="type", name="name", line="line")


FORM_MEMBERS = [
    ("properties", "label", "string", 12, "", ""),
    ("properties", "changed", "any", 14, "", ""),
    ("properties", "count", "any", 15, "", ""),
    ("properties", "MAX", "any", 16, "", ""),
    ("properties", "handler", "any", 17, "", ""),
    ("constructors", "constructor", "function", 18, "token,log", "any"),
    ("methods", "fetch", "function", 20, "id", "One"),
    ("methods", "onEvent", "function", 22, "e", "{ a: string }"),
]


@query(
    "X12_member_forms",
    ts_sql(
        'kind, name, type, j, params, "returnType"',
        FORM_MEMBERS,
        "filePath, 'Form' || n AS owner, 'Base' AS extends, kind, name, type, CAST(base + j AS INT) AS line, params, \"returnType\"",
    ),
)
def member_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Members with decorators, without types, with initial values, and overloads, out of the index rows."""
    index = extract.index_files(B.spread(B.typescript_forms(spark, folder)), "class")
    kinds = ", ".join(
        f"transform(e.classInfo.{kind}, m -> named_struct('owner', e.name, 'extends', e.classInfo.extends, 'kind', '{kind}',"
        " 'name', m.name, 'type', m.type, 'line', m.lineNumber, 'params', coalesce(array_join(m.functionSignature.parameters.name, ','), ''),"
        " 'returnType', coalesce(m.functionSignature.returnType, '')))"
        for kind in ("properties", "constructors", "methods")
    )
    members = f"flatten(transform(filter(exports, e -> e.classInfo is not null), e -> concat({kinds})))"
    rows = nested.entries(index, F.expr(members), ["filePath"])
    return rows.select("filePath", "owner", "extends", "kind", "name", "type", "line", "params", "returnType")


@query(
    "X2_ts_imports",
    ts_sql("j, source", [(3, "./doc<m>")], f"filePath, 'import' AS name, {fill('source')} AS source, CAST(base + j AS INT) AS line"),
)
def ts_imports(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(ts_code(spark, folder), typescript.imports(), name="name", source="source", line="line")


@query(
    "X2_page_links",
    f"WITH {R.SYMBOLS} SELECT page_id, name, source, line FROM symbols WHERE type = 'import'",
)
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten(page_index(spark, folder), "imports", ["page_id"], ["name", "source", "line"], outer=False).drop("pos")


@query("X3_py_exports", py_sql(EXPORT_COLUMNS, PY_EXPORTS, EXPORT_SELECT))
def py_exports(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(py_code(spark, folder), python_lang.exports(), rule_no="rule_no", type="type", name="name", line="line")


PY_ALL = [
    *PY_EXPORTS,
    (9, 0, 1, "function", "inner"),
    (15, 0, 1, "function", "__init__"),
    (17, 0, 1, "function", "get"),
    (20, 0, 1, "function", "tag"),
    (19, 0, 2, "class", "Meta"),
    (8, 0, 3, "variable", "value"),
    (14, 0, 3, "variable", "size"),
    (16, 0, 3, "variable", "root"),
    (17, 0, 3, "variable", "int"),
]


@query(
    "X3_py_exports_all_levels",
    py_sql(
        EXPORT_COLUMNS,
        PY_ALL,
        EXPORT_SELECT,
        "SELECT filePath, 1, 'function', 'm' || i, CAST(base + 22 + i AS INT) FROM (SELECT *, unnest(range(k)) AS i FROM docs)",
    ),
)
def py_exports_all_levels(spark: SparkSession, folder: str) -> DataFrame:
    found = python_lang.exports(all_levels=True)
    return rows_of(py_code(spark, folder), found, rule_no="rule_no", type="type", name="name", line="line")


@query(
    "X4_py_imports",
    py_sql(
        "j, source",
        [(3, "os"), (4, "pkg.mod<n>"), (5, ".")],
        f"filePath, 'import' AS name, {fill('source')} AS source, CAST(base + j AS INT) AS line",
    ),
)
def py_imports(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(py_code(spark, folder), python_lang.imports(), name="name", source="source", line="line")


CLASS_MEMBERS = [
    (23, "property", "secret", "private"),
    (24, "property", "count", "public"),
    (26, "constructor", "constructor", "public"),
    (27, "method", "find", "public"),
    (28, "method", "hide", "private"),
    (29, "method", "size", "public"),
]


@query(
    "X5_class_members",
    ts_sql(
        "j, kind, name, visibility",
        CLASS_MEMBERS,
        "filePath, 'Svc' || n AS owner, kind, name, visibility, CAST(base + j AS INT) AS line",
        "SELECT filePath, 'Svc' || n, 'method', 'm' || i, 'public', CAST(base + 30 + i AS INT)"
        " FROM (SELECT *, unnest(range(k)) AS i FROM docs)",
    ),
)
def class_members(spark: SparkSession, folder: str) -> DataFrame:
    classes = typescript.with_classes(ts_code(spark, folder))
    columns = {c: c for c in ("owner", "kind", "name", "visibility", "line")}
    return rows_of(classes, typescript.class_members(), **columns)


@query(
    "X6_fn_signature",
    ts_sql(
        'j, name, params, "returnType", "isAsync", "isGenerator"',
        [
            (5, "fn<n>", "a,b,opts,rest", "Promise", True, False),
            (9, "gen<n>", "cb", "Iterator", False, True),
            (11, "over<n>", "x", "void", False, False),
            (12, "over<n>", "x,y", "void", False, False),
            (13, "over<n>", "x,y", "any", False, False),
        ],
        f'filePath, {fill("name")} AS name, params, "returnType", "isAsync", "isGenerator", CAST(base + j AS INT) AS line',
    ),
)
def fn_signature(spark: SparkSession, folder: str) -> DataFrame:
    functions = typescript.with_functions(ts_code(spark, folder))
    columns = {c: c for c in ("name", "returnType", "isAsync", "isGenerator", "line")}
    return rows_of(functions, typescript.simple_signatures(), params="array_join(params, ',')", **columns)


@query(
    "X7_parse_dispatch",
    f"WITH {R.SYMBOLS}, counted AS (SELECT page_id, count(*) AS found FROM symbols GROUP BY page_id)"
    f" SELECT page_id, CASE WHEN {R.EXTENSION} = '.html' THEN 'html' ELSE 'text' END AS language,"
    f" CASE WHEN {R.EXTENSION} = '.html' THEN coalesce(found, 0) ELSE 0 END AS symbols,"
    f" CASE WHEN {R.EXTENSION} = '.html' THEN '' ELSE 'Unsupported language for file: ' || filePath END AS errors"
    " FROM files LEFT JOIN counted USING (page_id)",
)
def parse_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a suffix are read by the page rules; the others get a parse error."""
    tagged = extract.with_language(B.spread(B.pages_as_files(spark, folder)), WEB_LANGUAGES)
    parsed = extract.dispatch(tagged, PAGES)
    return parsed.select(
        "page_id",
        "language",
        F.size("symbols").cast("bigint").alias("symbols"),
        F.array_join("parseErrors", ",").alias("errors"),
    )


@query(
    "X7_damaged_files",
    f"WITH {R.TS_DOCS} SELECT filePath, CAST(n % 5 AS INT) AS damage, CASE n % 5 WHEN 1 THEN 'Unreadable file: ' || filePath"
    " WHEN 2 THEN 'Unclosed block in file: ' || filePath WHEN 3 THEN 'Unclosed parenthesis in file: ' || filePath"
    " WHEN 4 THEN 'Unclosed block, bracket in file: ' || filePath ELSE '' END AS errors,"
    " CASE WHEN n % 5 = 1 THEN 0 ELSE 1 END AS exports FROM docs",
)
def damaged_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that cannot be read or end too early keep a row, with an error and what could be found."""
    files = B.documents_as_files(spark, folder).withColumn("damage", (F.col("doc_id") % 5).cast("int"))
    path = F.concat(F.lit("src/"), F.col("language"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".ts"))
    comment = F.concat(F.lit("/* "), F.regexp_replace("content", r"\*/", " "), F.lit(" */ export const a = 1;\n"))
    ends = F.element_at(F.array(*(F.lit(x) for x in ("", "", "function f() { [1] ", "call(", "{ [ "))), F.col("damage") + 1)
    content = F.when(F.col("damage") != 1, F.concat(comment, ends))
    index = extract.index_files(files.select("repoId", path.alias("filePath"), content.alias("content"), "damage"))
    return index.select("filePath", "damage", F.array_join("parseErrors", ",").alias("errors"), F.size("exports").alias("exports"))


@query(
    "X8_fallback_choice",
    f"WITH {R.CODE} SELECT replace(filePath, '{{suffix}}', '.ts') AS filePath, 'primary' AS source_rule, {fill('name')} AS name, type,"
    f" CAST(base + j + after_methods * k AS INT) AS line FROM docs, {facts(EXPORT_COLUMNS, TS_EXPORTS)}"
    " UNION ALL SELECT replace(filePath, '{suffix}', '.py'), 'fallback',"
    f" {fill('name')}, type, CAST(base + j + after_methods * k AS INT) FROM docs, {facts(EXPORT_COLUMNS, PY_EXPORTS)}",
)
def fallback_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Read every file with the TypeScript rules first, and with the Python rules where those find nothing."""
    files = B.typescript_files(spark, folder).unionByName(B.python_files(spark, folder))
    code = mask.with_code(typescript.with_code(B.spread(files)).drop("code", "plain"), "python")
    same = "transform({}, s -> named_struct('name', s.name, 'type', s.type, 'line', s.line))"
    chosen = extract.with_fallback(code, same.format(typescript.exports()), same.format(python_lang.exports()))
    return nested.entries(chosen, "symbols", ["filePath", "source_rule"]).select("filePath", "source_rule", "name", "type", "line")


@query(
    "X9_class_heritage",
    ts_sql(
        "j", [(22,)], "filePath, 'Svc' || n AS name, 'Base' AS extends, 'IA,IB' AS implements, CAST(base + j AS INT) AS line"
    ),
)
def class_heritage(spark: SparkSession, folder: str) -> DataFrame:
    classes = typescript.with_classes(ts_code(spark, folder))
    return rows_of(classes, "classes", name="name", extends="extends", implements="array_join(implements, ',')", line="line")


@query(
    "X10_interface_members",
    ts_sql(
        "j, kind, name, type, required",
        [
            (15, "property", "version", "string", True),
            (16, "property", "label", "string", False),
            (17, "method", "area", "number", True),
        ],
        "filePath, 'Shape' || n AS owner, 'IBase,IOther' AS parents, kind, name, type, required, CAST(base + j AS INT) AS line",
    ),
)
def interface_members(spark: SparkSession, folder: str) -> DataFrame:
    found = typescript.with_interfaces(ts_code(spark, folder))
    members = """concat(
        transform(interface_properties, p -> named_struct('owner', p.owner, 'owner_pos', p.owner_pos, 'kind', 'property',
            'name', p.name, 'type', p.type, 'required', p.required, 'line', p.line)),
        transform(interface_methods, m -> named_struct('owner', m.owner, 'owner_pos', m.owner_pos, 'kind', 'method',
            'name', m.name, 'type', m.signature.returnType, 'required', true, 'line', m.line)))"""
    parents = "array_join(filter(interfaces, i -> i.pos = owner_pos)[0].extends, ',')"
    rows = nested.entries(found, F.expr(members), ["filePath", "interfaces"])
    columns = ("owner", "kind", "name", "type", "required", "line")
    return rows.select("filePath", F.expr(parents).alias("parents"), *columns)


PARAMS = [
    (5, "fn<n>", 0, "a", "string", True, "", "Promise<User>", True, False, 0),
    (5, "fn<n>", 1, "b", "number", False, "", "Promise<User>", True, False, 0),
    (5, "fn<n>", 2, "opts", "Map<string, number>", False, "new Map()", "Promise<User>", True, False, 0),
    (5, "fn<n>", 3, "rest", "any[]", False, "", "Promise<User>", True, False, 0),
    (9, "gen<n>", 0, "cb", "(x: number) => void", False, "noop", "Iterator<{ a: string }>", False, True, 0),
    (13, "over<n>", 0, "x", "any", True, "", "any", False, False, 2),
    (13, "over<n>", 1, "y", "any", False, "", "any", False, False, 2),
]
PARAM_COLUMNS = 'j, name, pos, param, type, required, "defaultValue", "returnType", "isAsync", "isGenerator", overloads'


@query(
    "X11_rich_signature",
    ts_sql(
        PARAM_COLUMNS,
        PARAMS,
        f'filePath, {fill("name")} AS name, CAST(pos AS INT) AS pos, param, type, required, "defaultValue", "returnType",'
        ' "isAsync", "isGenerator", overloads, CAST(base + j AS INT) AS line',
    ),
)
def rich_signature(spark: SparkSession, folder: str) -> DataFrame:
    functions = typescript.with_functions(ts_code(spark, folder))
    grouped = nested.entries(functions, F.expr(typescript.with_overloads()), ["filePath"])
    rows = grouped.select("*", F.posexplode_outer("signature.parameters").alias("param_pos", "p")).where("param_pos >= 0")
    return rows.select(
        "filePath",
        "name",
        F.col("param_pos").alias("pos"),
        F.col("p.name").alias("param"),
        "p.type",
        "p.required",
        F.coalesce("p.defaultValue", F.lit("")).alias("defaultValue"),
        "signature.returnType",
        "signature.isAsync",
        "signature.isGenerator",
        F.size("overloads").alias("overloads"),
        "line",
    )


VISIBLE_MEMBERS = [
    (24, "property", "count", "public", "", "number"),
    (25, "property", "name", "public", "", "string"),
    (26, "constructor", "constructor", "public", "repo:Repo,size:number", "any"),
    (27, "method", "find", "public", "id:string", "Promise<User | null>"),
    (28, "method", "hide", "private", "", "void"),
    (29, "method", "size", "public", "", "number"),
]


@query(
    "X12_class_member_visibility",
    ts_sql(
        "j, kind, name, visibility, params, type",
        VISIBLE_MEMBERS,
        "filePath, 'Svc' || n AS owner, kind, name, visibility, params, type, CAST(base + j AS INT) AS line",
        "SELECT filePath, 'Svc' || n, 'method', 'm' || i, 'public', 'p' || i || ':T', 'T', CAST(base + 30 + i AS INT)"
        " FROM (SELECT *, unnest(range(k)) AS i FROM docs)",
    ),
)
def class_member_visibility(spark: SparkSession, folder: str) -> DataFrame:
    """Public properties, methods of any visibility with their signature, constructors."""
    classes = typescript.with_classes(ts_code(spark, folder))
    params = "array_join(transform(m.signature.parameters, p -> concat(p.name, ':', p.type)), ',')"
    members = f"""concat(
        transform(filter(properties, p -> p.visibility = 'public'), p -> named_struct('owner', p.owner, 'kind', 'property',
            'name', p.name, 'visibility', p.visibility, 'params', '', 'type', p.type, 'line', p.line)),
        transform(methods, m -> named_struct('owner', m.owner, 'kind', if(m.name = 'constructor', 'constructor', 'method'),
            'name', m.name, 'visibility', m.visibility, 'params', {params}, 'type', m.signature.returnType, 'line', m.line)))"""
    columns = {c: c for c in ("owner", "kind", "name", "visibility", "params", "type", "line")}
    return rows_of(classes, members, **columns)


TYPED_DEFS = [
    (7, 0, "", "load<n>", "path:str,mode:str", "List[Dict[str, int]]"),
    (9, 0, "", "inner", "z:int", "any"),
    (11, 0, "", "fetch<n>", "", "any"),
    (22, 1, "", "tail<n>", "", "None"),
    (15, 0, "Store<n>", "__init__", "root:Path", "any"),
    (17, 0, "Store<n>", "get", "key:str,default:int", "int"),
    (20, 0, "Store<n>", "tag", "", "str"),
    (20, 0, "Meta", "tag", "", "str"),
]


@query(
    "X13_py_typed_defs",
    py_sql(
        'j, after_methods, owner, name, params, "returnType"',
        TYPED_DEFS,
        f'filePath, {fill("owner")} AS owner, {fill("name")} AS name, params, "returnType",'
        " CAST(base + j + after_methods * k AS INT) AS line",
        "SELECT filePath, 'Store' || n, 'm' || i, '', 'int', CAST(base + 22 + i AS INT)"
        " FROM (SELECT *, unnest(range(k)) AS i FROM docs)",
    ),
)
def py_typed_defs(spark: SparkSession, folder: str) -> DataFrame:
    """Functions with typed parameters; a def inside classes appears once per class it is in."""
    found = python_lang.with_classes(py_code(spark, folder))
    row = (
        "named_struct('owner', {owner}, 'name', f.name, 'params',"
        " array_join(transform(f.signature.parameters, p -> concat(p.name, ':', p.type)), ','),"
        " 'returnType', f.signature.returnType, 'line', f.line)"
    )
    inside = "exists(classes, c -> exists(c.methods, m -> m.pos = f.pos))"
    free = f"transform(filter(functions, f -> not {inside}), f -> {row.format(owner=repr(''))})"
    owned = f"flatten(transform(classes, c -> transform(c.methods, f -> {row.format(owner='c.name')})))"
    columns = {c: c for c in ("owner", "name", "params", "returnType", "line")}
    return rows_of(found, f"concat({free}, {owned})", **columns)


TS_NAMED = [
    (2, "Def<n>", "", "default", "./doc<m>"),
    (2, "Left<n>", "", "named", "./doc<m>"),
    (2, "right", "Right<n>", "named", "./doc<m>"),
    (3, "fn<m>", "", "named", "./doc<m>"),
    (4, "ns<n>", "", "namespace", "../<lang>/util"),
]
PY_NAMED = [
    (3, "os.path", "", "named", "os.path"),
    (3, "re", "rx", "named", "re"),
    (4, "alpha<n>", "", "named", "pkg.mod<n>"),
    (4, "beta", "gamma<n>", "named", "pkg.mod<n>"),
    (5, "sibling<n>", "", "named", "."),
]
NAMED_COLUMNS = "j, name, alias, kind, source"
NAMED_SELECT = (
    f"{fill('name')} AS name, {fill('alias')} AS alias, kind, {fill('source')} AS source, CAST(base + j AS INT) AS line"
)


@query(
    "X14_named_imports",
    f"WITH {R.CODE} SELECT replace(filePath, '{{suffix}}', '.ts') AS filePath, {NAMED_SELECT} FROM docs,"
    f" {facts(NAMED_COLUMNS, TS_NAMED)} UNION ALL SELECT replace(filePath, '{{suffix}}', '.py'), {NAMED_SELECT} FROM docs,"
    f" {facts(NAMED_COLUMNS, PY_NAMED)}",
)
def named_imports(spark: SparkSession, folder: str) -> DataFrame:
    columns = {"name": "name", "alias": "coalesce(alias, '')", "kind": "kind", "source": "source", "line": "line"}
    ts = rows_of(ts_code(spark, folder), typescript.named_imports(), **columns)
    return ts.unionByName(rows_of(py_code(spark, folder), python_lang.named_imports(), **columns))


TITLE = "<title>([^<]*)</title>"


@query(
    "G1_rule_registry",
    f"WITH {R.FILES} SELECT page_id, regexp_extract(found, '{TITLE}', 1) AS name, 'title' AS type, line"
    f" FROM {R.matches('files', 'page_id', TITLE)} UNION ALL SELECT page_id, regexp_extract(found, '{R.LINK}', 2), 'import',"
    f" line FROM {R.matches('files', 'page_id', R.LINK)} UNION ALL SELECT page_id,"
    f" regexp_extract(found, '{R.VARIABLE}', 1), 'variable', line FROM {R.matches('files', 'page_id', R.VARIABLE)}",
)
def rule_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The page rules and a rule a user adds."""
    registry = type(PAGES)(rule for rules in PAGES.rules.values() for rule in rules).add(Rule("html", 3, TITLE, "title"))
    files = B.spread(B.pages_as_files(spark, folder)).withColumn("language", F.lit("html"))
    return nested.entries(extract.dispatch(files, registry), "symbols", ["page_id"]).select("page_id", "name", "type", "line")


@query(
    "W5_rule_union",
    f"WITH {R.SYMBOLS} SELECT page_id, rule_no, row_number() OVER (PARTITION BY page_id ORDER BY rule_no, i) AS place, name"
    " FROM symbols",
)
def rule_union(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of all rules in rule order, then text order."""
    files = B.spread(B.pages_as_files(spark, folder)).withColumn("language", F.lit("html"))
    rows = nested.entries(extract.dispatch(files, PAGES), "symbols", ["page_id"])
    return rows.select("page_id", "rule_no", (F.col("place") + 1).cast("bigint").alias("place"), "name")


@query(
    "W4_first_occurrence",
    f"WITH {R.SYMBOLS} SELECT page_id, name, min(i) AS place FROM symbols WHERE type = 'import' GROUP BY page_id, name",
)
def first_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    links = nested.flatten(page_index(spark, folder), "imports", ["page_id"], ["name", "source"], outer=False)
    first = M.first_per_key(links, ["page_id", "name"], ["pos"])
    return first.select("page_id", "name", (F.col("pos") + 1).cast("bigint").alias("place"))


@query("W1_path_sort", f"WITH {R.FILES} SELECT page_id, repoId, filePath FROM files ORDER BY repoId, filePath")
def path_sort(spark: SparkSession, folder: str) -> DataFrame:
    return B.pages_as_files(spark, folder).select("page_id", *KEYS).orderBy(*KEYS)


@query(
    "W2_limit_n",
    f"WITH {R.SYMBOLS}, firsts AS (SELECT page_id, repoId, filePath FROM files QUALIFY row_number() OVER"
    " (PARTITION BY repoId ORDER BY filePath) <= 5) SELECT page_id, repoId, filePath, string_agg(name, ',' ORDER BY i)"
    " AS names FROM firsts JOIN symbols USING (page_id, repoId, filePath) WHERE type = 'import' AND i <= 3 GROUP BY ALL",
)
def limit_n(spark: SparkSession, folder: str) -> DataFrame:
    """The first three links of the first five files of every host."""
    first = first_rows(page_index(spark, folder), ["repoId"], ["filePath"], 5).where(F.size("imports") > 0)
    return first.select("page_id", *KEYS, F.array_join(F.slice("imports.name", 1, 3), ",").alias("names"))


@query(
    "N1_flatten_exports",
    f"WITH {R.SYMBOLS}, e AS (SELECT * FROM symbols WHERE type = 'variable') SELECT f.page_id, coalesce(i - 1, -1) AS pos,"
    " coalesce(name, '') AS name, coalesce(line, 0) AS line FROM files f LEFT JOIN e ON e.page_id = f.page_id",
)
def flatten_exports(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested.flatten(page_index(spark, folder), "exports", ["page_id"], ["name", "line"])
    return rows.select(
        "page_id",
        F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("line", F.lit(0)).alias("line"),
    )


@query(
    "N2_flatten_imports",
    f"WITH {R.SYMBOLS}, e AS (SELECT * FROM symbols WHERE type = 'import') SELECT f.page_id, coalesce(i - 1, -1) AS pos,"
    " coalesce(name, '') AS name, coalesce(source, '') AS source FROM files f LEFT JOIN e ON e.page_id = f.page_id",
)
def flatten_imports(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested.flatten(page_index(spark, folder), "imports", ["page_id"], ["name", "source"])
    return rows.select(
        "page_id",
        F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("source", F.lit("")).alias("source"),
    )


@query(
    "N3_flatten_members",
    ts_sql(
        "j, kind, name, visibility",
        [(j, kind, name, visibility) for j, kind, name, visibility, _, _ in VISIBLE_MEMBERS],
        'filePath, \'Svc\' || n AS owner, kind, name, visibility, CAST(base + j AS INT) AS "lineNumber"',
        "SELECT filePath, 'Svc' || n, 'method', 'm' || i, 'public', CAST(base + 30 + i AS INT)"
        " FROM (SELECT *, unnest(range(k)) AS i FROM docs)",
    ),
)
def flatten_members(spark: SparkSession, folder: str) -> DataFrame:
    exports = nested.flatten(ts_index(spark, folder, "class"), "exports", ["filePath"], ["name", "classInfo"], outer=False)
    classes = exports.where(F.col("classInfo").isNotNull()).withColumnRenamed("name", "owner")
    arrays = {kind: f"classInfo.{column}" for kind, column in
              (("method", "methods"), ("property", "properties"), ("constructor", "constructors"))}
    rows = nested.flatten_members(classes, ["filePath", "owner"], arrays, ["name", "visibility", "lineNumber"])
    return rows.drop("position")


@query(
    "N4_flatten_params",
    ts_sql(
        PARAM_COLUMNS,
        PARAMS,
        f'filePath, {fill("name")} AS function, CAST(pos AS INT) AS pos, param AS name, type, required',
    ),
)
def flatten_params(spark: SparkSession, folder: str) -> DataFrame:
    exports = nested.flatten(ts_index(spark, folder, "function"), "exports", ["filePath"], ["name", "functionSignature"], outer=False)
    functions = exports.withColumnRenamed("name", "function").withColumn("params", F.col("functionSignature.parameters"))
    return nested.flatten(functions, "params", ["filePath", "function"], ["name", "type", "required"], outer=False)


@query(
    "N5_flatten_overloads",
    ts_sql(
        'function, pos, params, "returnType"',
        [("fn<n>", -1, "", ""), ("gen<n>", -1, "", ""), ("over<n>", 0, "x:string", "void"), ("over<n>", 1, "x:number,y:string", "void")],
        f'filePath, {fill("function")} AS function, CAST(pos AS INT) AS pos, params, "returnType"',
    ),
)
def flatten_overloads(spark: SparkSession, folder: str) -> DataFrame:
    """Overloads of every function; a function without any gives one row."""
    exports = nested.flatten(ts_index(spark, folder, "function"), "exports", ["filePath"], ["name", "functionSignature"], outer=False)
    functions = exports.where(F.col("functionSignature").isNotNull()).withColumnRenamed("name", "function")
    functions = functions.withColumn("overloads", F.col("functionSignature.overloads"))
    rows = nested.flatten(functions, "overloads", ["filePath", "function"], ["parameters", "returnType"])
    params = F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",")
    return rows.select(
        "filePath",
        "function",
        F.coalesce("pos", F.lit(-1)).alias("pos"),
        F.coalesce(params, F.lit("")).alias("params"),
        F.coalesce("returnType", F.lit("")).alias("returnType"),
    )


@query(
    "N6_assemble_file_index",
    f"WITH {R.SYMBOLS} SELECT f.page_id, f.repoId, f.filePath, coalesce(string_agg(name || '@' || line, ',' ORDER BY i)"
    " FILTER (WHERE type = 'variable'), '') AS exports, coalesce(string_agg(name || '@' || source, ',' ORDER BY i)"
    " FILTER (WHERE type = 'import'), '') AS imports FROM files f LEFT JOIN symbols s ON s.page_id = f.page_id GROUP BY ALL",
)
def assemble_file_index(spark: SparkSession, folder: str) -> DataFrame:
    index = page_index(spark, folder)
    exports = F.transform("exports", lambda e: F.concat(e["name"], F.lit("@"), e["line"].cast("string")))
    imports = F.transform("imports", lambda e: F.concat(e["name"], F.lit("@"), e["source"]))
    return index.select(
        "page_id", *KEYS, F.array_join(exports, ",").alias("exports"), F.array_join(imports, ",").alias("imports")
    )


@query("A1_language_distribution", "SELECT lang AS language, count(*) AS files FROM documents GROUP BY lang ORDER BY lang")
def language_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return A.language_distribution(B.documents_as_files(spark, folder))


@query(
    "A2_symbol_totals",
    f"WITH {R.SYMBOLS} SELECT (SELECT count(*) FROM files) AS files, count(*) FILTER (WHERE type = 'variable') AS exports,"
    " count(*) FILTER (WHERE type = 'import') AS imports FROM symbols",
)
def symbol_totals(spark: SparkSession, folder: str) -> DataFrame:
    return A.symbol_totals(page_index(spark, folder))


@query(
    "A3_store_stats",
    "SELECT (SELECT count(*) FROM orders) AS total_repositories, (SELECT count(*) FROM lineitem) AS total_file_indexes",
)
def store_stats(spark: SparkSession, folder: str) -> DataFrame:
    return A.store_stats(B.load(spark, folder, "orders"), B.load(spark, folder, "lineitem"))


OUTCOME_SQL = (
    f"CASE WHEN NOT {R.allowed('en', 'fr', 'de')} OR filePath LIKE '%/' THEN 'skipped'"
    " WHEN content = '' OR length(content) < 2000 THEN 'failed' ELSE 'processed' END"
)
TALLY = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("processed", "failed", "skipped"))


def page_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    outcome = A.outcome(
        allowed=S.in_allowed_folder(F.col("filePath"), ("en", "fr", "de")),
        deleted=F.col("filePath").endswith("/"),
        missing=F.col("content") == "",
        failed=F.length("content") < 2000,
    )
    return B.pages_as_files(spark, folder).select(*KEYS, outcome.alias("outcome"))


@query(
    "A4_outcome_tally",
    f"WITH {R.FILES}, o AS (SELECT repoId, {OUTCOME_SQL} AS outcome FROM files) SELECT repoId, count(*) AS total_files,"
    f" {TALLY} FROM o GROUP BY repoId",
)
def outcome_tally(spark: SparkSession, folder: str) -> DataFrame:
    return A.outcome_tally(page_outcomes(spark, folder), ["repoId"])


@query(
    "P14_index_report",
    f"WITH {R.FILES}, o AS (SELECT repoId, {OUTCOME_SQL} AS outcome FROM files) SELECT repoId, count(*) AS total_files,"
    f" {TALLY} FROM o GROUP BY repoId",
)
def index_report(spark: SparkSession, folder: str) -> DataFrame:
    return L.index_report(A.outcome_tally(page_outcomes(spark, folder), ["repoId"]))


@query(
    "J8_import_resolution",
    f"WITH {R.TS_DOCS}, imports AS (SELECT *, {fill('name')} AS imported FROM docs, {facts(NAMED_COLUMNS, TS_NAMED)}),"
    " wanted AS (SELECT i.*, d.filePath AS target_file, d.base AS target_base FROM imports i LEFT JOIN docs d"
    " ON d.n = i.m AND d.lang = i.lang AND d.repoId = i.repoId AND i.name = 'fn<m>')"
    " SELECT filePath, imported AS name, CAST(base + j AS INT) AS \"lineNumber\", coalesce(target_file, '') AS \"targetPath\","
    " CAST(coalesce(target_base + 5, 0) AS INT) AS \"targetLine\" FROM wanted",
)
def import_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Imports of every generated file, resolved to the export they name in the file they name."""
    keys = ["repoId", "filePath"]
    code = ts_code(spark, folder)
    found = {"exported": F.expr(typescript.exports()), "imported": F.expr(typescript.named_imports())}
    # The join looks at its input twice; the symbols are written once so that no file is read again for it.
    files = checkpointed(code.select(*keys, *(column.alias(name) for name, column in found.items())))
    exports = nested.entries(files, "exported", keys).select(
        *keys, "name", F.col("line").alias("lineNumber"))
    imports = nested.entries(files, "imported", keys).select(
        *keys, "name", "source", F.col("line").alias("lineNumber")
    )
    resolved = J.resolve_imports(imports, exports)
    return resolved.select(
        "filePath",
        "name",
        "lineNumber",
        F.coalesce("targetPath", F.lit("")).alias("targetPath"),
        F.coalesce("targetLine", F.lit(0)).alias("targetLine"),
    )


@query(
    "J8_reexports",
    "WITH RECURSIVE docs AS (SELECT doc_id AS n, CAST(3 + length(text) - length(replace(text, chr(10), '')) AS INT) AS line FROM documents),"
    " walk(n, seen, hops) AS (SELECT n, n, 0 FROM docs WHERE n % 10 <> 9"
    " UNION ALL SELECT w.n, d.n, hops + 1 FROM walk w JOIN docs d ON d.n = w.seen - 1 WHERE w.seen % 10 <> 0),"
    " ends AS (SELECT w.n, w.seen, hops, d.line FROM walk w JOIN docs d ON d.n = w.seen WHERE w.seen % 10 = 0)"
    " SELECT 'src/doc' || docs.n || '.ts' AS \"filePath\", coalesce('src/doc' || seen || '.ts', '') AS \"targetPath\","
    " coalesce(ends.line, 0) AS \"targetLine\", coalesce(hops, -1) AS hops FROM docs LEFT JOIN ends USING (n)",
)
def reexports(spark: SparkSession, folder: str) -> DataFrame:
    """Imports through chains of modules that hand a name on, up to eight of them, and names that lead to themselves."""
    keys = ["repoId", "filePath"]
    code = typescript.with_code(B.spread(B.typescript_barrels(spark, folder)))
    found = {"exported": typescript.exports(), "imported": typescript.named_imports(), "handed": typescript.reexports()}
    files = checkpointed(code.select(*keys, *(F.expr(column).alias(name) for name, column in found.items())))
    handed = nested.entries(files, "handed", keys).select(*keys, "name", "original", "source")
    exports = nested.entries(files, "exported", keys).where("type = 'function'").select(*keys, "name", F.col("line").alias("lineNumber"))
    imports = nested.entries(files, "imported", keys).select(*keys, "name", "source", F.col("line").alias("lineNumber"))
    resolved = J.resolve_imports(imports, exports, handed)
    return resolved.select(
        "filePath", F.coalesce("targetPath", F.lit("")).alias("targetPath"),
        F.coalesce("targetLine", F.lit(0)).alias("targetLine"), F.coalesce("hops", F.lit(-1)).alias("hops"),
    )


PY_TARGETS = [("load<m>", 2, 8), ("Store<m>", 3, 9), ("LIMIT<m>", 4, 7), ("gone<n>", 5, 0), ("thing<n>", 6, 0)]


@query(
    "J8_python_modules",
    f"WITH {R.PY_DOCS}, imports AS (SELECT *, {fill('name')} AS imported FROM docs, {facts('name, j, offs', PY_TARGETS)}),"
    " wanted AS (SELECT i.*, d.filePath AS target_file, d.base AS target_base FROM imports i LEFT JOIN docs d"
    " ON d.n = i.m AND d.lang = i.lang AND d.repoId = i.repoId AND i.offs > 0)"
    " SELECT filePath, imported AS name, CAST(base + j AS INT) AS \"lineNumber\", coalesce(target_file, '') AS \"targetPath\","
    " CAST(coalesce(target_base + offs, 0) AS INT) AS \"targetLine\" FROM wanted",
)
def python_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Relative and absolute imports of Python files, resolved through their modules."""
    keys = ["repoId", "filePath"]
    code = mask.with_code(B.spread(B.python_modules(spark, folder)), "python")
    found = {"exported": python_lang.exports(), "imported": python_lang.named_imports()}
    files = checkpointed(code.select(*keys, *(F.expr(column).alias(name) for name, column in found.items())))
    exports, imports = nested.entries(files, "exported", keys), nested.entries(files, "imported", keys)
    resolved = J.resolve_imports(
        imports.select(*keys, "name", "source", F.col("line").alias("lineNumber")),
        exports.select(*keys, "name", F.col("line").alias("lineNumber")),
    )
    target = (F.coalesce("targetPath", F.lit("")).alias("targetPath"), F.coalesce("targetLine", F.lit(0)).alias("targetLine"))
    return resolved.select("filePath", "name", "lineNumber", *target)


@query(
    "J8_name_resolution",
    f"WITH {R.SYMBOLS}, titles AS (SELECT page_id, lower(regexp_extract(content, '<title>([^ <]*)', 1)) AS folded FROM files),"
    " named AS (SELECT folded, min(page_id) AS target, count(*) AS candidates FROM titles GROUP BY folded)"
    " SELECT page_id, i - 1 AS pos, name, coalesce(target, -1) AS target, coalesce(candidates, 0) AS candidates"
    " FROM symbols LEFT JOIN named ON folded = lower(name) WHERE type = 'import'",
)
def name_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Links whose word starts the title of a page: the first such page and how many there are."""
    links = checkpointed(nested.flatten(page_index(spark, folder), "imports", ["page_id"], ["name"], outer=False))
    titles = B.pages_as_files(spark, folder).select(
        "page_id", F.regexp_extract("content", "<title>([^ <]*)", 1).alias("name")
    )
    found = J.resolve_names(links, titles, "name", ["page_id"], ["page_id", "pos"])
    return found.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        "name",
        F.coalesce("target.page_id", F.lit(-1)).alias("target"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


INDEX_ROWS = [
    (5, 0, "function", "fn<n>", False), (9, 0, "function", "gen<n>", False), (13, 0, "function", "over<n>", False),
    (14, 0, "interface", "Shape<n>", False), (19, 0, "type", "Alias<n>", False), (20, 0, "variable", "value<n>", False),
    (21, 0, "variable", "one<n>", False), (21, 0, "variable", "three<n>", False), (22, 0, "class", "Svc<n>", True),
    (31, 1, "variable", "Svc<n>", False),
]
PY_INDEX_ROWS = [(j, after, kind, name, kind == "class") for j, after, _, kind, name in PY_EXPORTS]


def _index_sql(suffix: str, language: str, members: int, rows: list[tuple]) -> str:
    return (
        f"SELECT replace(filePath, '{{suffix}}', '{suffix}') AS filePath, '{language}' AS language, {fill('name')} AS name, type,"
        f" CAST(base + j + after_methods * k AS INT) AS line, 5 AS imports, if(owner, {members} + k, 0) AS members"
        f" FROM docs, {facts('j, after_methods, type, name, owner', rows)}"
    )


@query(
    "E1_index_files",
    f"WITH {R.CODE} {_index_sql('.ts', 'typescript', 6, INDEX_ROWS)} UNION ALL {_index_sql('.py', 'python', 3, PY_INDEX_ROWS)}",
)
def index_files(spark: SparkSession, folder: str) -> DataFrame:
    """The full load: generated files of both languages to nested index rows; every export with its name, type and line."""
    files = B.typescript_files(spark, folder).unionByName(B.python_files(spark, folder))
    index = extract.index_files(B.spread(files))
    exports = nested.entries(index.withColumn("n_imports", F.size("imports")), "exports", ["filePath", "language", "n_imports"])
    members = "coalesce(size(classInfo.methods) + size(classInfo.constructors) + size(classInfo.properties), 0)"
    return exports.selectExpr("filePath", "language", "name", "type", "lineNumber as line", "n_imports as imports", f"{members} as members")
