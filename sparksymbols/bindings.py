"""Views of the test tables as files, changes, repositories and code.

``documents`` also gives a corpus of source files: each text goes whole into a comment (or doc string) of a
generated file, below which the declarations carry the document's number. Rules must then find the
declarations at the right line and nothing inside the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksymbols.functions import scalars as S


INPUT_TASKS = "spark.sparksymbols.input.tasks"


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to as many tasks as the session asks for in ``spark.sparksymbols.input.tasks``; else as they are.

    For sessions that read a single small file with many cores; large inputs have splits enough.
    """
    tasks = df.sparkSession.conf.get(INPUT_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


def pages_as_files(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, repoId = host, filePath = path of the url, content = html)."""
    return load(spark, folder, "pages").select(
        "page_id",
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("repoId"),
        F.regexp_extract("url", "://[^/]+/([^?#]*)", 1).alias("filePath"),
        F.col("html").alias("content"),
        "url",
    )


def documents_as_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, repoId = source, filePath = lang/doc, language, content = text)."""
    return load(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("repoId"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("filePath"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
    )


def events_as_changes(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, repoId = user, filePath = event type, content = props, fileHash, ts)."""
    return changes_from_events(load(spark, folder, "events"))


def changes_from_events(events: DataFrame, *more: str) -> DataFrame:
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("repoId"),
        F.col("event_type").alias("filePath"),
        F.col("props").alias("content"),
        S.content_hash(F.col("props")).alias("fileHash"),
        "ts",
        *more,
    )


# Order status as repository status.
ORDER_STATUS = (("F", "completed"), ("O", "processing"), ("P", "pending"))


def order_status(column: str = "o_orderstatus") -> Column:
    expr = F
    for code, status in ORDER_STATUS:
        expr = expr.when(F.col(column) == code, status)
    return expr


def orders_as_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """(repoId, url, status, totalFiles, processedFiles, failedFiles, lastUpdated)."""
    files = (
        lineitem_as_files(spark, folder)
        .groupBy("orderkey")
        .agg(
            F.count("*").alias("totalFiles"),
            F.count_if(F.col("outcome") == "processed").alias("processedFiles"),
            F.count_if(F.col("outcome") == "failed").alias("failedFiles"),
        )
    )
    orders = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderkey"), order_status().alias("status"), F.col("o_orderdate").alias("lastUpdated")
    )
    return orders.join(files, "orderkey", "left").select(
        F.col("orderkey").cast("string").alias("repoId"),
        repository_url(F.col("orderkey")).alias("url"),
        "status",
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("totalFiles", "processedFiles", "failedFiles")),
        "lastUpdated",
    )


def repository_url(key: Column) -> Column:
    return F.concat(F.lit("repo://orders/"), key.cast("string"))


def lineitem_as_files(spark: SparkSession, folder: str) -> DataFrame:
    """One file per line: outcome processed (status F), failed (returned among the rest) or skipped."""
    outcome = (
        F.when(F.col("l_linestatus") == "F", "processed").when(F.col("l_returnflag") == "R", "failed").otherwise("skipped")
    )
    return load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"),
        outcome.alias("outcome"),
        F.col("l_shipdate").alias("ts"),
    )


# {n}: document number, {m}: the next one, {text}: the whole text, {methods}: n % 4 one-line methods.
TYPESCRIPT_TEMPLATE = """\
/* {text}
export function ghost{n}() {{ */
import Def{n}, {{ Left{n}, right as Right{n} }} from "./doc{m}";
import {{ fn{m} }} from './doc{m}';
import * as ns{n} from '../{lang}/util';
export async function fn{n}(a: string, b?: number, opts: Map<string, number> = new Map(), ...rest: any[]): Promise<User> {{
  const s = "}}}} export class Fake {{";
  if (a) {{ return b; }} // }}}}
}}
export function* gen{n}(cb: (x: number) => void = noop): Iterator<{{ a: string }}> {{
}}
export function over{n}(x: string): void;
export function over{n}(x: number, y?: string): void;
export function over{n}(x: any, y?: any) {{ return x; }}
export interface Shape{n}<T> extends IBase, IOther<number> {{
  readonly version: string;
  label?: string;
  area(scale: number): number;
}}
export type Alias{n} = string;
export const value{n} = 1;
export {{ one{n}, two as three{n} }};
export abstract class Svc{n}<T> extends Base<T> implements IA, IB<Map<string, T>> {{
  private secret: string = "{{";
  public count: number = 0;
  name?: string;
  constructor(private repo: Repo, size: number = 1) {{ super(); }}
  async find(id: string): Promise<User | null> {{ if (id) {{ for (;;) {{ }} }} return null; }}
  private hide(): void {{ }}
  get size(): number {{ return 1; }}
{methods}}}
export default Svc{n};
"""

PYTHON_TEMPLATE = '''\
"""{text}
def ghost{n}():
"""
import os.path, re as rx
from pkg.mod{n} import alpha{n}, beta as gamma{n}
from . import sibling{n}
LIMIT{n} = 10
def load{n}(path: str, mode: str = "r", *args, **kwargs) -> List[Dict[str, int]]:
    value = 1
    def inner(z: int): return z
    return value
async def fetch{n}(url):
    pass
class Store{n}(Base):
    size = 3
    def __init__(self, root: Path):
        self.root = root
    def get(self, key: str, default: int = 0) -> int:
        return 1
    class Meta:
        def tag(self) -> str:
            return "x"
{methods}def tail{n}() -> None:
    x = "def no(): pass"  # def never():
'''


# Forms that the first template does not have.
TYPESCRIPT_FORMS = """\
/* {text}
*/
export enum Color{n} {{ Red, Green }}
export declare const enum Size{n} {{ S }}
export namespace Space{n} {{ const inside = 1; }}
export * from "./doc{m}";
export * as all{n} from './doc{m}';
export const {{ left{n}, right: east{n}, ...rest{n} }} = load();
export const one{n} = 1, two{n} = [1, 2], three{n} = (a, b) => a;
export default {{ name: {n} }};
@Component({{ selector: "x" }})
export class Form{n} extends Base<A<B<C<D<E<F>>>>>> {{
  @Input() label: string;
  @Output()
  changed = new Emitter<string>();
  count = 0;
  static readonly MAX = 5;
  handler = (e) => {{ return e; }};
  constructor(@Inject(TOKEN) private token: Token, @Optional() log?: Log) {{ super(); }}
  fetch(id: number): One;
  fetch(id: any): One {{ return id; }}
  @HostListener("x", ["$event"])
  onEvent(e):          {{ a: string }} {{ }}
{methods}}}
"""

# Modules that hand a name on: document 10 k defines it, the eight after it take it from the one before, in turn by name,
# under a new name and by a star; every tenth takes it from itself. Each also imports it from its own module.
BARRELS = """\
/* {text}
*/
{line}
import {{ leaf }} from './doc{n}';
"""

PYTHON_MODULES = '''\
"""{text}
"""
from .doc{m} import load{m}
from src.{lang}.doc{m} import Store{m} as Other
from ..{lang}.doc{m} import LIMIT{m}
from . import gone{n}
from outside import thing{n}
LIMIT{n} = 10
def load{n}(path): pass
class Store{n}: pass
{methods}'''


def _code_files(
    spark: SparkSession, folder: str, template: str, suffix: str, method: str, closers: str, more: dict[str, str] | None = None
) -> DataFrame:
    n, m = "cast(doc_id as string)", "cast(doc_id + 1 as string)"
    text = f"regexp_replace(text, r'{closers}', ' ')"
    count = "cast(doc_id % 4 as int)"
    methods = f"array_join(transform(if({count} = 0, array(), sequence(0, {count} - 1)), i -> concat({method})), '')"
    values = {"n": n, "m": m, "text": text, "lang": "lang", "methods": methods} | (more or {})
    marks = {name: f"\x00{name}\x00" for name in values}
    pieces = template.format(**marks).split("\x00")
    # Odd pieces are the names between the marks.
    content = ", ".join(
        values[piece] if i % 2 else "'" + piece.replace("\\", "\\\\").replace("'", "\\'") + "'"
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    )
    return load(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("repoId"),
        F.expr(f"concat('src/', lang, '/doc', {n}, '{suffix}')").alias("filePath"),
        F.expr(f"concat({content})").alias("content"),
    )


def typescript_files(spark: SparkSession, folder: str) -> DataFrame:
    method = "'  m', i, '(p', i, ': T): T { return p', i, '; }\\n'"
    return _code_files(spark, folder, TYPESCRIPT_TEMPLATE, ".ts", method, r"\*/")


def typescript_forms(spark: SparkSession, folder: str) -> DataFrame:
    return _code_files(spark, folder, TYPESCRIPT_FORMS, ".ts", "''", r"\*/")


def typescript_barrels(spark: SparkSession, folder: str) -> DataFrame:
    """One repository only, as chains of modules run through all documents."""
    before = "cast(doc_id - 1 as string)"
    line = (
        "case when doc_id % 10 = 0 then 'export function leaf() {}'"
        f" when doc_id % 10 = 9 then concat('export {{ leaf }} from \\'./doc', {'cast(doc_id as string)'}, '\\';')"
        f" when doc_id % 3 = 0 then concat('export * from \\'./doc', {before}, '\\';')"
        f" else concat('export {{ leaf as leaf }} from \\'./doc', {before}, '\\';') end"
    )
    files = _code_files(spark, folder, BARRELS, ".ts", "''", r"\*/", {"line": line})
    return files.withColumns({"repoId": F.lit("barrels"), "filePath": F.regexp_replace("filePath", "^src/[^/]*/", "src/")})


def python_modules(spark: SparkSession, folder: str) -> DataFrame:
    return _code_files(spark, folder, PYTHON_MODULES, ".py", "''", r'"""|\\\\')


def python_files(spark: SparkSession, folder: str) -> DataFrame:
    method = "'    def m', i, '(self) -> int: return ', i, '\\n'"
    return _code_files(spark, folder, PYTHON_TEMPLATE, ".py", method, r'"""|\\\\')
