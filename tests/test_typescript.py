import pytest
from pyspark.sql import functions as F

from sparksymbols.operators import extract, typescript

CLASS = """\
export class Ledger {
    static open = 0;
    protected entries: Map<string, Entry[]> = new Map();
    constructor(readonly owner: Account, private clock = Date) { Ledger.open += 1; }
    async settle(day: Day): Promise<void> {
        while (day.pending()) { await day.next(); }
        if (this.entries.size) { return; }
    }
    protected audit(): Report { return new Report(this); }
}
"""

GENERIC = """\
// export class Hidden { }
@Injectable({ scope: "root" })
export class RouteTable<K extends Key<K>, V> extends Registry<K>
  implements Lookup, Sink<Event<K, V[]>> {
    /* match(path) { } */
    @Input() prefix!: string;
    @Output()
    changed = new EventEmitter<string>();
    hits = 0;
    static readonly MAX: number = 64;
    private cache: Map<K, V> = new Map();
    fallback = (path: string) => { return this.match(path); };
    constructor(@Inject(TOKEN) private source: Source, @Optional() log?: Log) { super(); }
    match(
        path: K,
        strict?: boolean,
    ): V | null {
        return this.cache.get(path);
    }
    fetch(id: number): V;
    fetch(id: string): V;
    fetch(id: any): V { return this.cache.get(id); }
    @HostListener("window:resize", ["$event"])
    onResize(e) { }
    get size(): number { return this.cache.size; }
    async *scan(): AsyncIterator<V> { yield* this.cache.values(); }
}
export default RouteTable;
"""


@pytest.fixture
def parse(spark):
    def rows(content, array, build=lambda df: df):
        files = spark.createDataFrame([("r", "src/a.ts", content)], "repoId string, filePath string, content string")
        return [r.asDict(True) for r in build(typescript.with_code(files)).select(F.expr(f"inline({array})")).collect()]

    return rows


@pytest.fixture
def index(spark):
    def first(content, path="src/a.ts"):
        files = spark.createDataFrame([("r", path, content)], "repoId string, filePath string, content string")
        return extract.index_files(files).first().asDict(True)

    return first


def names(rows, *fields):
    return [tuple(r[f] for f in fields) for r in rows]


@pytest.mark.parametrize(
    ("code", "expected"),
    [
        ("export function total(xs) { return xs.length; }", [("total", "function")]),
        ("export async function go() {}", [("go", "function")]),
        ("export default function main() {}", [("main", "function")]),
        ("export default function () {}", [("default", "function")]),
        ("export default class extends Base {}", [("default", "class")]),
        ("export default { a: 1 };", [("default", "variable")]),
        ("export default new Store();", [("default", "variable")]),
        ("export default () => 1;", [("default", "variable")]),
        ("export enum Color { Red }\nexport const enum Size { S }\nexport declare enum E {}", [("Color", "variable"), ("Size", "variable"), ("E", "variable")]),
        ("export namespace A.B { export const inner = 1; }", [("inner", "variable"), ("A.B", "variable")]),
        ("export * from './x';\nexport * as all from './y';\nexport{z}", [("z", "variable"), ("all", "variable"), ("*", "variable")]),
        ("export const { p, q: r, ...rest } = load(), [s, , t = 2] = more;", [("p", "variable"), ("r", "variable"), ("rest", "variable"), ("s", "variable"), ("t", "variable")]),
        ("export const f = (a, b = 1) => a,\n  g: Map<string, number> = new Map<string, number>(),\n  h = [1, 2];\nlet i = 1, j = 2;", [("f", "variable"), ("g", "variable"), ("h", "variable")]),
        ("export abstract class A {}", [("A", "class")]),
        ("export interface I { }", [("I", "interface")]),
        ("export const a = 1, b = 2;\nexport let c;\nexport var d;", [("a", "variable"), ("b", "variable"), ("c", "variable"), ("d", "variable")]),
        ("export type T = string;", [("T", "type")]),
        ("export { a, b as c, };", [("a", "variable"), ("c", "variable")]),
        ("export default thing;", [("thing", "variable")]),
        ("export alias = other;", [("alias", "variable")]),
        ("// export const no = 1;\nconst s = 'export const no = 1';", []),
        ("const x = module.export; exported();", []),
        ("export const größe = 1;", [("größe", "variable")]),
        ("", []),
    ],
)
def test_exports(parse, code, expected):
    assert names(parse(code, typescript.exports()), "name", "type") == expected


def test_export_order_is_rule_then_text(parse):
    code = "export const z = 1;\nexport class B {}\nexport function f() {}\nexport class A {}\n"
    rows = parse(code, typescript.exports())
    assert names(rows, "name", "line") == [("f", 3), ("B", 2), ("A", 4), ("z", 1)]


def test_line_ends(parse):
    assert names(parse("a;\r\nexport const b = 1;\r\n", typescript.exports()), "name", "line") == [("b", 2)]


def test_imports(parse):
    code = "import { a, b as c } from './x';\nimport d from \"./y\";\nimport * as e from './z';\nimport './side';\n"
    assert names(parse(code, typescript.imports()), "name", "source", "line") == [("import", "./x", 1), ("import", "./y", 2)]
    assert names(parse(code, typescript.named_imports()), "name", "alias", "kind", "source") == [
        ("a", None, "named", "./x"),
        ("b", "c", "named", "./x"),
        ("d", None, "default", "./y"),
        ("e", None, "namespace", "./z"),
    ]


def test_import_over_several_lines(parse):
    rows = parse("\nimport type {\n  A, // first\n  B as C,\n} from './types';", typescript.named_imports())
    assert names(rows, "name", "alias", "line") == [("A", None, 2), ("B", "C", 2)]


def test_a_name_that_is_a_keyword_of_the_import(parse):
    rows = parse("import { from, of } from 'rxjs';\nimport type { Type } from \"./t\";", typescript.named_imports())
    assert names(rows, "name", "source") == [("from", "rxjs"), ("of", "rxjs"), ("Type", "./t")]


def test_long_comments_cost_linear_time(parse):
    """Blanked comments leave long runs of blanks in every place a rule may look at."""
    long = "/*" + "x" * 200_000 + "*/"
    code = (
        f"import {long} {{ a }} {long} from './x';\nexport {long} function f(a {long} : string {long}) {long} : void {{}}\n"
        f"export class C {long} {{ private a {long} : string; m {long} (b {long}) {long} {{ }} }}\nimport {long} nothing;"
    )
    assert names(parse(code, typescript.named_imports()), "name") == [("a",)]
    assert names(parse(code, typescript.exports()), "name") == [("f",), ("C",)]
    (f,) = parse(code, "functions", typescript.with_functions)
    assert names(f["signature"]["parameters"], "name", "type") == [("a", "string")]
    rows = parse(code, typescript.class_members(), typescript.with_classes)
    assert names(rows, "name", "kind") == [("m", "method"), ("a", "property")]


def test_class_members(parse):
    rows = parse(CLASS, typescript.class_members(), typescript.with_classes)
    assert names(rows, "name", "kind", "visibility", "line") == [
        ("constructor", "constructor", "public", 4),
        ("settle", "method", "public", 5),
        ("audit", "method", "private", 9),
    ]
    rows = parse(CLASS, "properties", typescript.with_classes)
    assert names(rows, "name", "visibility", "type", "line") == [
        ("open", "public", "any", 2),
        ("entries", "private", "Map<string, Entry[]>", 3),
    ]


def test_generic_class(index):
    found = {e["name"]: e for e in index(GENERIC)["exports"] if e["type"] == "class"}
    assert list(found) == ["RouteTable"]
    info = found["RouteTable"]["classInfo"]
    assert info["extends"] == "Registry"
    assert info["implements"] == ["Lookup", "Sink"]
    lines = [("match", 14), ("fetch", 22), ("onResize", 24), ("size", 25), ("scan", 26)]
    assert names(info["methods"], "name", "lineNumber") == lines
    fields = [("prefix", 6), ("changed", 8), ("hits", 9), ("MAX", 10), ("fallback", 12)]
    assert names(info["properties"], "name", "lineNumber") == fields
    match, _, _, size, scan = (m["functionSignature"] for m in info["methods"])
    assert names(match["parameters"], "name", "type", "required") == [("path", "K", True), ("strict", "boolean", False)]
    assert (match["returnType"], size["returnType"]) == ("V | null", "number")
    assert (scan["isAsync"], scan["isGenerator"]) == (True, True)
    (made,) = (m["functionSignature"] for m in info["constructors"])
    assert names(made["parameters"], "name", "type", "required") == [("source", "Source", True), ("log", "Log", False)]


def test_deep_generics_and_long_blanks(index):
    deep = "A<B<C<D<E<F<G<H>>>>>>>"
    code = f"export class Deep<T extends {deep}> extends Base<{deep}> {{\n  go(x: {deep}):{' ' * 40}{{ a: string }} {{ return x; }}\n}}\n"
    (deep_class,) = index(code)["exports"]
    info = deep_class["classInfo"]
    assert info["extends"] == "Base"
    assert [(m["name"], m["functionSignature"]["returnType"]) for m in info["methods"]] == [("go", "{ a: string }")]


def nested_type(depth):
    """A type of braces, generics, parentheses and arrows in turn, so deep."""
    out = "string"
    for i in range(depth):
        out = (f"{{ a: {out} }}", f"Box<{out}>", f"({out})", f"(x: {out}) => void")[i % 4]
    return out


def test_brackets_of_any_depth(index):
    """Types, generics, parameters, decorators, patterns and parent types, forty deep."""
    deep = nested_type(40)
    assert deep.count("{") == deep.count("}") == 10
    code = f"""export function walk<T extends {deep}>(first: {deep}, @Mark({deep}) {{ a: {{ b: [c, {{ d }}] }} }}: {deep} = {{}}): {deep} {{ return 1; }}
export class Deep<T extends {deep}> extends Base<{deep}> implements First<{deep}>, Second {{
  @Input({deep}) field: {deep};
  @On({{ a: [({{}})] }}) go<K extends {deep}, V>(x: {deep}, y?: K): {deep} {{ return x; }}
  late<K>(): void {{}}
  less = 1 < 2;
  after(): {{ a: {{ b: {{ c: {{ d: number }} }} }} }} {{ return less<3; }}
}}
export interface Wide<T extends {deep}> extends Base<{deep}> {{
  call<K extends {deep}>(a: {deep}): {deep};
  plain(): void;
}}
export const {{ p: {{ q: {{ r }} }}, s: [[t]] }} = {{}}, u = 1;
"""
    rows = {(e["name"], e["type"]): e for e in index(code)["exports"]}
    assert {name for name, _ in rows} == {"walk", "Deep", "Wide", "r", "t", "u"}
    walk = rows["walk", "function"]["functionSignature"]
    assert names(walk["parameters"], "name", "type", "required") == [("first", deep, True), ("{ a: { b: [c, { d }] } }", deep, False)]
    assert walk["returnType"] == deep
    info = rows["Deep", "class"]["classInfo"]
    assert (info["extends"], info["implements"]) == ("Base", ["First", "Second"])
    assert [m["name"] for m in info["methods"]] == ["go", "late", "after"] and [m["name"] for m in info["properties"]] == ["field", "less"]
    go, _, after = (m["functionSignature"] for m in info["methods"])
    assert names(go["parameters"], "name", "type", "required") == [("x", deep, True), ("y", "K", False)]
    assert (go["returnType"], after["returnType"]) == (deep, "{ a: { b: { c: { d: number } } } }")
    (call, _) = rows["Wide", "interface"]["interfaceInfo"]["methods"]
    assert call["functionSignature"]["returnType"] == deep and rows["Wide", "interface"]["interfaceInfo"]["extends"] == ["Base"]


def test_index_rows_keep_property_types(index):
    code = """export class Box<T> {
  plain = 1;
  wide?: Map<string, { a: T; b: [T] }> = new Map();
  sure!: (x: { y: T }) => void;
  #count: number = 0;
  private hidden: string;
  #run(): void {}
}
export interface Form {
  nested: {
    a: string;
  };
  call?: (x: number, y: string) => void, last: string[]
}
"""
    box, form = index(code)["exports"]
    assert names(box["classInfo"]["properties"], "name", "type", "required") == [
        ("plain", "any", True), ("wide", "Map<string, { a: T; b: [T] }>", False), ("sure", "(x: { y: T }) => void", True)
    ]
    assert names(box["classInfo"]["methods"], "name", "type", "visibility", "required") == [("#run", "function", "private", None)]
    assert names(form["interfaceInfo"]["properties"], "name", "type", "required") == [
        ("nested", "{\n    a: string;\n  }", True), ("call", "(x: number, y: string) => void", False), ("last", "string[]", True)
    ]


def test_default_export_beside_a_class(index):
    assert names(index(GENERIC)["exports"], "name", "type") == [("RouteTable", "class"), ("RouteTable", "variable")]


def test_unclosed_class_keeps_its_export(index):
    (export,) = index("export class Broken { foo() { ")["exports"]
    assert (export["name"], export["classInfo"]["methods"]) == ("Broken", [])


def test_interface(parse):
    code = """export interface Service<T> extends Base, Other<Map<string, T>> {
  readonly version: string;
  label?: string;
  create(user: User, options?: Options): Promise<User>;
  nested: { a: string; b: number };
}"""
    rows = parse(code, "interfaces", typescript.with_interfaces)
    assert names(rows, "name", "extends", "line") == [("Service", ["Base", "Other"], 1)]
    rows = parse(code, "interface_properties", typescript.with_interfaces)
    assert names(rows, "name", "required", "line") == [("version", True, 2), ("label", False, 3), ("nested", True, 5)]
    (method,) = parse(code, "interface_methods", typescript.with_interfaces)
    assert (method["name"], method["line"], method["signature"]["returnType"]) == ("create", 4, "Promise<User>")
    assert names(method["signature"]["parameters"], "name", "required") == [("user", True), ("options", False)]


@pytest.mark.parametrize(
    ("code", "params", "returns"),
    [
        ("export function f(a: string, b = 2, ...c: any[]): void {}", [("a", "string", True, None), ("b", "any", False, "2"), ("c", "any[]", False, None)], "void"),
        ("export function f(cb: (x: number, y: string) => void = () => {}): Map<string, number[]> {}", [("cb", "(x: number, y: string) => void", False, "() => {}")], "Map<string, number[]>"),
        ("export function f({ a, b }: Props, [c, d] = [1, 2]) {}", [("{ a, b }", "Props", True, None), ("[c, d]", "any", False, "[1, 2]")], "any"),
        ("export function f<T extends { a: string }>(x: T): { a: string } {}", [("x", "T", True, None)], "{ a: string }"),
        ("export function f(a: string /* , b: number */) {}", [("a", "string", True, None)], "any"),
        ("export function f(sep = ',', end = ')') {}", [("sep", "any", False, "','"), ("end", "any", False, "')'")], "any"),
        ("export function f() {}", [], "any"),
    ],
)
def test_signatures(parse, code, params, returns):
    (f,) = parse(code, "functions", typescript.with_functions)
    assert names(f["signature"]["parameters"], "name", "type", "required", "defaultValue") == params
    assert f["signature"]["returnType"] == returns


def test_flags_come_from_the_declaration_only(parse):
    code = "// async *\nexport function plain() {}\nexport async function* both() {}"
    rows = parse(code, "functions", typescript.with_functions)
    flags = [(r["signature"]["isAsync"], r["signature"]["isGenerator"]) for r in rows]
    assert flags == [(False, False), (True, True)]


def test_overloads(index):
    code = (
        "export function f(x: string): void;\nexport function f(x: number, y?: string): void\n"
        "export function f(x: any): void { }\nexport function g(): void;"
    )
    f, g = index(code)["exports"]
    assert (f["name"], f["lineNumber"], g["name"]) == ("f", 3, "g")
    assert [len(o["parameters"]) for o in f["functionSignature"]["overloads"]] == [1, 2]
    assert g["functionSignature"]["overloads"] == []


def test_unsupported_file(index):
    row = index('{"export": "const a = 1"}', "package.json")
    assert (row["language"], row["exports"], row["imports"], len(row["parseErrors"])) == ("json", [], [], 1)
