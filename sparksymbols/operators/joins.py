"""Joins of changes, files and imports against tables that hold one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksymbols.functions import scalars as S
from sparksymbols.operators.skew import split_join
from sparksymbols.session import checkpointed


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], hash_column: str = "fileHash") -> DataFrame:
    """Changes between two snapshots with one row per key: ``change_type`` A, D or M; a rename is D and A."""
    old = before.select(*keys, F.col(hash_column).alias("old_hash"))
    new = after.select(*keys, F.col(hash_column).alias("new_hash"))
    kind = (
        F.when(F.col("old_hash").isNull(), "A")
        .when(F.col("new_hash").isNull(), "D")
        .when(F.col("old_hash") != F.col("new_hash"), "M")
    )
    joined = old.join(new, list(keys), "full_outer").withColumn("change_type", kind)
    return joined.where(F.col("change_type").isNotNull())


def changed_set(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added, deleted and modified keys together, each once."""
    return diff.where(F.col("change_type").isin("A", "D", "M")).select(*keys).distinct()


def with_stored(
    changes: DataFrame, stored: DataFrame, keys: Sequence[str], spread_by: Sequence[str], hash_column: str, ts: str
) -> DataFrame:
    """Changes with the stored hash and time of their key."""
    state = stored.select(*keys, F.col(hash_column).alias("stored_hash"), F.col(ts).alias("stored_ts"))
    return split_join(changes, state, keys, "left", spread_by)


def unchanged_gate(joined: DataFrame, hash_column: str = "fileHash") -> DataFrame:
    """Keep changes whose hash differs from the stored one, or that are new."""
    return joined.where(F.col("stored_hash").isNull() | (F.col("stored_hash") != F.col(hash_column)))


def stale_gate(joined: DataFrame, ts: str = "ts") -> DataFrame:
    """Keep changes not older than the stored row; an equal or missing time passes."""
    return joined.where(F.col("stored_ts").isNull() | F.col(ts).isNull() | (F.col(ts) >= F.col("stored_ts")))


def gate_reason(joined: DataFrame, hash_column: str = "fileHash", ts: str = "ts") -> DataFrame:
    """Add ``reason``: ``stale`` (checked first), ``unchanged``, ``new`` or ``changed``."""
    reason = (
        F.when(F.col(ts) < F.col("stored_ts"), "stale")
        .when(F.col(hash_column) == F.col("stored_hash"), "unchanged")
        .when(F.col("stored_hash").isNull(), "new")
        .otherwise("changed")
    )
    return joined.withColumn("reason", reason)


def missing_only(
    files: DataFrame, index: DataFrame, keys: Sequence[str], spread_by: Sequence[str], force_reprocess: bool = False
) -> DataFrame:
    """Files that the index does not hold yet; all of them with ``force_reprocess``."""
    if force_reprocess:
        return files
    return split_join(files, index.select(*keys).distinct(), keys, "left_anti", spread_by)


def initial_without_changed(initial: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files of a first load that newer commits have not touched; ``initial`` has one row per key."""
    return initial.join(changes.select(*keys).distinct(), list(keys), "left_anti")


def cascade_delete(
    repositories: DataFrame, files: DataFrame, doomed: DataFrame, key: str, spread_by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the repositories in ``doomed`` and their files.

    A task holds its share of the doomed keys and reads past it the repositories and files, which need no sort.
    """
    gone = doomed.select(key).distinct().hint("shuffle_hash")
    return repositories.join(gone, key, "left_anti"), split_join(files, gone, [key], "left_anti", spread_by)


def _with_modules(rows: DataFrame) -> DataFrame:
    """Rows of a file once for each ``module`` it is: ``a/b.ts`` is ``a/b``, ``a/index.ts`` is also ``a``."""
    stem = F.regexp_replace("filePath", "\\.(?:ts|tsx|js|jsx|py)$", "")
    folder = F.regexp_replace(stem, "/?(?:index|__init__)$", "")
    return rows.withColumn("module", F.explode(F.array_distinct(F.array(stem, folder))))


def _named_module() -> Column:
    """The module that ``source`` names in a file; null for packages from elsewhere."""
    folder, source = S.parent_folder(F.col("filePath")), F.col("source")
    script = F.regexp_replace(S.resolve_path(folder, source), "\\.(?:ts|tsx|js|jsx)$", "")
    return F.when(F.col("filePath").endswith(".py"), S.python_module(folder, source)).when(source.startswith("."), script)


def module_exports(exports: DataFrame) -> DataFrame:
    """Export rows ``(repoId, filePath, name, lineNumber)`` as one row per (repoId, module, name).

    Of several files or lines the first counts.
    """
    return _with_modules(exports).groupBy("repoId", "module", "name").agg(F.min(F.struct("filePath", "lineNumber")).alias("target"))


def reexported(exports: DataFrame, reexports: DataFrame) -> DataFrame:
    """``repoId, module, name, target, hops`` of names that a module hands on: where they are defined at last.

    ``exports`` are definitions as for ``module_exports``; ``reexports`` has ``(repoId, filePath, name, original, source)``,
    with ``*`` for all names of the other module but ``default``. A module's own names win over handed-on ones, named
    ones over those of ``*``, and of several the one that sorts first. ``target`` is null where a chain of names comes
    back to itself or ends at no definition. Every round doubles the length of the chains that are settled, so their
    number is the logarithm of the longest chain; rounds end when one settles nothing.
    """
    name = ["repoId", "module", "name"]
    defined = module_exports(exports)
    edges = _with_modules(reexports.withColumn("to_module", _named_module())).where("to_module IS NOT NULL")
    edges = checkpointed(edges.select(*name, "to_module", F.col("original").alias("to_name")).distinct())
    named = edges.where("name <> '*'")
    stars = edges.where("name = '*' AND module <> to_module").select("repoId", "module", "to_module").distinct()

    # All modules a module takes everything from, by doubling; then the names each of these has by itself.
    reach = checkpointed(stars)
    count, last = reach.count(), 0
    while count > last:
        onward = reach.select("repoId", F.col("module").alias("to_module"), F.col("to_module").alias("_further"))
        further = reach.join(onward, ["repoId", "to_module"]).select("repoId", "module", F.col("_further").alias("to_module"))
        reach = checkpointed(reach.union(further.where("module <> to_module")).distinct())
        count, last = reach.count(), count
    own = defined.select(*name).union(named.select(*name)).distinct()
    offered = own.where("name <> 'default'").withColumnRenamed("module", "to_module")
    by_star = reach.join(offered, ["repoId", "to_module"]).select(*name, "to_module", F.col("name").alias("to_name"))
    by_star = by_star.join(own, name, "left_anti")
    first = F.min(F.struct("to_module", "to_name")).alias("to")
    links = named.join(defined, name, "left_anti").union(by_star).groupBy(*name).agg(first).select(*name, "to.*")

    at_end = defined.select("repoId", F.col("module").alias("to_module"), F.col("name").alias("to_name"), "target")
    to = ["repoId", "to_module", "to_name"]
    chains = checkpointed(links.join(at_end, to, "left").withColumn("hops", F.lit(1)))
    open_rows, last = chains.where("target IS NULL").count(), -1
    while open_rows and open_rows != last:
        further = chains.select(
            "repoId", F.col("module").alias("to_module"), F.col("name").alias("to_name"), F.col("to_module").alias("_module"),
            F.col("to_name").alias("_name"), F.col("target").alias("_target"), F.col("hops").alias("_hops"),
        )
        moved = chains.where("target IS NULL").join(further, to, "left").select(
            *name, F.coalesce("_module", "to_module").alias("to_module"), F.coalesce("_name", "to_name").alias("to_name"),
            F.col("_target").alias("target"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
        )
        chains = checkpointed(chains.where("target IS NOT NULL").select(moved.columns).union(moved))
        open_rows, last = chains.where("target IS NULL").count(), open_rows
    return chains.select(*name, "target", F.when(F.col("target").isNotNull(), F.col("hops")).alias("hops"))


def resolve_imports(imports: DataFrame, exports: DataFrame, reexports: DataFrame | None = None) -> DataFrame:
    """Import rows ``(repoId, filePath, name, source, lineNumber)`` with the file and line of the export they name.

    A relative source is resolved against the importer's folder; in Python files modules are written with dots, and
    absolute ones start at the root of the repository. Unresolved imports keep null targets. With ``reexports`` (see
    ``reexported``) names that a module hands on lead to their definition, ``hops`` modules further.
    """
    modules = module_exports(exports)
    if reexports is not None:
        modules = modules.withColumn("hops", F.lit(0)).unionByName(reexported(exports, reexports))
    modules = modules.withColumnRenamed("module", "_module").withColumnRenamed("name", "_name")
    located = imports.withColumn("_module", _named_module()).withColumn("_name", F.col("name"))
    # A plain join: Spark splits a module that very many files import at run time.
    joined = located.join(modules, ["repoId", "_module", "_name"], "left")
    hops = [] if reexports is None else [F.col("hops")]
    return joined.select(
        *imports.columns, F.col("target.filePath").alias("targetPath"), F.col("target.lineNumber").alias("targetLine"), *hops
    )


def resolve_names(imports: DataFrame, exports: DataFrame, name: str, order: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """Imports with the first export of the same name (case folded) and how many there are; no pairs are made."""
    folded = exports.groupBy(F.lower(name).alias("folded")).agg(
        F.min(F.struct(*order)).alias("target"), F.count("*").alias("candidates")
    )
    return split_join(imports.withColumn("folded", F.lower(name)), folded, ["folded"], "left", spread_by).drop("folded")
