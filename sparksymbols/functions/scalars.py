"""Scalar functions on hashes, keys, timestamps, paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders and extensions that are indexed, and the language of each extension.
ALLOWED_FOLDERS = ("src", "app", "packages")
EXTENSIONS = (".ts", ".js", ".tsx", ".jsx", ".py", ".go", ".java", ".cs")
# extension, language tag, rule set that reads it
LANGUAGES = (
    (".ts", "typescript", "typescript"),
    (".tsx", "typescript", "typescript"),
    (".js", "javascript", "typescript"),
    (".jsx", "javascript", "typescript"),
    (".py", "python", "python"),
    (".pyi", "python", "python"),
    (".go", "go", None),
    (".java", "java", None),
    (".cs", "csharp", None),
    (".json", "json", None),
    (".md", "markdown", None),
)
REPOSITORY_STATUSES = ("pending", "processing", "completed", "failed", "paused")
VISIBILITIES = ("public", "private")
MIN_SHA_LENGTH = 7


def tolerant_decode(raw: Column) -> Column:
    """Bytes as UTF-8 with undecodable bytes dropped. A genuine U+FFFD in the input stays."""
    text, mark, escape = raw.cast("string"), F.lit("\ufffd"), F.lit("\u0001")
    plain = F.replace(F.make_valid_utf8(text), mark, F.lit(""))
    # Undecodable bytes turn into the same character, so a genuine one is written in two others meanwhile.
    hidden = F.replace(F.replace(text, escape, F.lit("\u0001a")), mark, F.lit("\u0001b"))
    shown = F.replace(F.make_valid_utf8(hidden), mark, F.lit(""))
    shown = F.replace(F.replace(shown, F.lit("\u0001b"), mark), F.lit("\u0001a"), escape)
    return F.when(F.contains(text, mark), shown).otherwise(plain)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def git_blob_id(content: Column) -> Column:
    """Object id git gives a file with this content (no line-ending filters)."""
    body = F.encode(content, "UTF-8")
    header = F.concat(F.lit("blob "), F.octet_length(content).cast("string"))
    return F.sha1(F.concat(F.encode(header, "UTF-8"), F.unhex(F.lit("00")), body))


def short_key(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 8)


def doc_key(repo: Column, path: Column) -> Column:
    """Display key; the stored key stays the pair, since ``a/b`` and ``a_b`` share a display key."""
    return F.concat_ws("_", repo, F.replace(path, F.lit("/"), F.lit("_")))


def lock_key(repo: Column, path: Column) -> Column:
    return F.concat_ws(":", repo, path)


def parse_iso_ts(text: Column) -> Column:
    """ISO-8601 with ``Z`` or an offset (UTC without one); unreadable text gives null."""
    zoned = F.when(text.rlike("(?:[Zz]|[+-]\\d{2}:?\\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def format_iso_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def in_allowed_folder(path: Column, folders: tuple[str, ...] = ALLOWED_FOLDERS) -> Column:
    """True for files at the top and for files below one of ``folders``."""
    parts = path_parts(path)
    return (F.size(parts) == 1) | F.coalesce(F.get(parts, F.lit(0)).isin(*folders), F.lit(False))


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for none or for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(path, "[^./](\\.[^./]+)$", 1))


def icontains(text: Column, query: Column) -> Column:
    return F.contains(F.lower(text), F.lower(query))


def strip_quotes(text: Column) -> Column:
    return F.btrim(F.btrim(text), F.lit("\"'"))


def split_params(text: Column) -> Column:
    """Names of a comma list: the part before ``:``, blank entries dropped."""
    names = F.transform(F.split(text, ","), lambda p: F.btrim(F.get(F.split(p, ":"), F.lit(0))))
    return F.filter(names, lambda n: n != "")


def resolve_path(folder: Column, relative: Column) -> Column:
    """``relative`` joined to ``folder`` with ``.`` and ``..`` worked out."""
    parts = F.concat(path_parts(folder), path_parts(relative))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(kept, "/")


def python_module(folder: Column, source: Column) -> Column:
    """Path of the module that ``source`` names in a file of ``folder``: one dot is its folder, each further dot one up."""
    dots = F.length(F.regexp_extract(source, "^(\\.*)", 1))
    up = F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise("")
    rest = F.replace(F.substring(source, dots + 1, F.length(source)), F.lit("."), F.lit("/"))
    return F.when(dots > 0, resolve_path(folder, F.concat(up, rest))).otherwise(rest)


def parent_folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")
