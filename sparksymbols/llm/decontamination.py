"""Benchmark passages in documents, re-parameterised ones included, by windows of canonical templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksymbols.llm.common import let, small, stored, text_or_empty

WINDOW = 10
#: A mark before a token says that its value is a slot: a number, a name or a unit.
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
# Units that may follow a number.
UNITS = (
    "mm|cm|km|m|kg|g|mg|lb|lbs|oz|l|ml|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|miles?|feet|"
    "ft|inch|inches|meters?|metres?|kilometers?|kilometres?|grams?|kilograms?|liters?|litres?|dollars?|euros?|cents?|"
    "percent|degrees?|mph|kmh|kb|mb|gb|tb"
)


def marked_tokens(text: Column) -> Column:
    """Lower-case tokens of a text as an array, slot values behind their mark; empty for texts without a token.

    Numbers are runs of digits with separators. Units are unit words after a number. Names are capitalised words
    after a lower-case word, a number or a comma on the same line, as sentence starts say nothing.
    """
    text = F.regexp_replace(text_or_empty(text), "[\u0001-\u0003]", " ")
    # Each pattern looks behind only once its first character fits.
    text = F.regexp_replace(text, r"(\p{Lu}(?<=[\p{Ll}\p{N},] \p{Lu})\p{Ll}+)(?![\p{L}\p{N}])", NAME + "$1")
    number = r"(\p{N}(?<![\p{L}\p{N}]\p{N})\p{N}*(?:[.,]\p{N}+)*) ?((?i:" + UNITS + r"))?(?![\p{L}\p{N}])"
    text = F.regexp_replace(text, number, f"{NUMBER}$1 {UNIT}$2 ")
    text = F.regexp_replace(F.lower(text), r"[.,](?<=\p{N}[.,])(?=\p{N})", "")
    words = F.split(F.regexp_replace(text, "[^\\p{L}\\p{N}\u0001-\u0003]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & (w != UNIT))


def _is_slot(token: Column) -> Column:
    return token < F.lit("\u0004")


def _value_codes(tokens: Column) -> Column:
    """A hash of each token."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _template_codes(tokens: Column, values: Column) -> Column:
    """A hash of each token, slots by their type only."""
    kind = lambda i: F.xxhash64(F.substring(F.get(tokens, i), 1, 1))
    return F.transform(values, lambda v, i: F.when(_is_slot(F.get(tokens, i)), kind(i)).otherwise(v))


def _literal_hash(tokens: Column) -> Column:
    """A hash of tokens without their marks, which depend on what is before a passage."""
    plain = F.transform(tokens, lambda t: F.when(_is_slot(t), F.substring(t, 2, 1 << 30)).otherwise(t))
    return F.xxhash64(F.lit("literal"), plain)


def _starts(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))


def _slot_windows(slots: Column, size: Column, width: int) -> Column:
    """Starts of the windows with more than half placeholders, from the places of all placeholders in order."""
    most = width // 2  # a window has more if it holds a placeholder and the one so many further on
    around = F.transform(
        _starts(F.lit(0), F.size(slots) - most - 1),
        lambda j: _starts(F.greatest(F.get(slots, j + most) - width + 1, F.lit(0)), F.least(F.get(slots, j), size - width)),
    )
    return F.array_distinct(F.flatten(around))


def _windows(tokens: Column, width: int) -> Column:
    """All windows of a document by their start ``pos``: ``h``, the hash of the template, and ``values``, those of all
    tokens; those with more than half placeholders once more, with the hash of their literal tokens."""

    def of_document(t: Column, values: Column, codes: Column) -> Column:
        size = F.size(values)
        window = lambda i, h: F.struct(i.alias("pos"), h.alias("h"), F.slice(values, i + 1, width).alias("values"))
        templates = F.transform(_starts(F.lit(0), size - width), lambda i: window(i, F.xxhash64(F.slice(codes, i + 1, width))))
        slots = F.filter(_starts(F.lit(0), size - 1), lambda i: F.get(codes, i) != F.get(values, i))
        literal = let(slots, lambda p: F.transform(_slot_windows(p, size, width), lambda i: window(i, _literal_hash(F.slice(t, i + 1, width)))))
        return F.concat(templates, literal)

    return let(tokens, lambda t: let(_value_codes(t), lambda v: let(_template_codes(t, v), lambda c: of_document(t, v, c))))


def _benchmark_windows(items: DataFrame, width: int) -> DataFrame:
    """``item_id, item_pos, width, h, item_values, slots, names``: windows that are literal for at least one half, with the
    places of their slots and of the names among these; the others by the hash of their literal tokens, without places.

    In a document the first word may be seen as a name too, so windows that would then be others are known in both ways.
    """
    size = F.least(F.size("tokens"), F.lit(width))
    rows = items.withColumn("width", size).where("width > 0")
    at = F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("width"))).alias("item_pos")
    rows = rows.withColumn("all_values", _value_codes(F.col("tokens")))
    rows = rows.withColumn("codes", _template_codes(F.col("tokens"), F.col("all_values"))).select("*", at)
    start = F.col("item_pos") + 1
    token = lambda k: F.get("tokens", F.col("item_pos") + k)
    slots = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda k: _is_slot(token(k)))
    names = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.startswith(token(k), F.lit(NAME)))
    rows = rows.select(
        "item_id", "item_pos", "width", F.xxhash64(F.slice("codes", start, F.col("width"))).alias("h"),
        F.slice("all_values", start, F.col("width")).alias("item_values"), slots.alias("slots"), names.alias("names"),
        _literal_hash(F.slice("tokens", start, F.col("width"))).alias("literal"),
    )
    templates = rows.where(2 * F.size("slots") <= F.col("width")).drop("literal")
    none = F.array().cast("array<int>")
    literal = rows.where(2 * (F.size("slots") + 1) > F.col("width")).withColumns({"h": F.col("literal"), "slots": none, "names": none})
    return templates.unionByName(literal.drop("literal"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_windows, n_tokens, verbatim``: documents that hold a passage of a benchmark item.

    Tokens are compared without case and punctuation, with numbers, names and units as typed placeholders. All windows
    of ``width`` tokens (of the whole item, if shorter) are looked up by hash; those that are placeholders for more than
    half by the hash of their literal tokens, so that only exact copies match. Matched windows at one distance belong together. There, each name of the item must always stand
    for one and the same name in the document, and different names for different ones; otherwise only the windows count
    whose values are all the item's own. Numbers and units may change freely, as equal ones can be different parameters.
    ``n_tokens`` counts the item's tokens that are covered, ``verbatim`` says that all their values are the item's own.

    Windows of all documents meet the benchmark map-side while that is small (its size is checked), else by shuffle.
    Null or empty texts and items without a token match nothing; null ids are ids like others and repeated ids count as
    one document. Empty tables give no rows. Items that repeat each match.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), marked_tokens(F.col(item_text_col)).alias("tokens"))
    # A text in one case shows no names, so items are known with names as plain words too.
    plain = F.transform("tokens", lambda t: F.when(F.startswith(t, F.lit(NAME)), F.substring(t, 2, 1 << 30)).otherwise(t))
    items = items.unionByName(items.withColumn("tokens", plain)).distinct()
    known = stored(_benchmark_windows(items, width), "item-windows")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashes = small(known.select("h", "width").distinct())
    widths = [r["width"] for r in known.select("width").distinct().orderBy("width").collect()]  # at most ``width`` values
    if not widths:
        return known.select(
            F.lit(None).cast(texts.schema["doc_id"].dataType).alias("doc_id"), "item_id", F.lit(0).cast("bigint").alias("n_windows"),
            F.lit(0).cast("bigint").alias("n_tokens"), F.lit(True).alias("verbatim"),
        ).limit(0)
    tokens = texts.select("doc_id", marked_tokens(F.col("text")).alias("tokens"))
    seen = [
        tokens.select("doc_id", F.explode(_windows(F.col("tokens"), w)).alias("window"))
        .select("doc_id", "window.pos", F.lit(w).alias("width"), F.col("window.h").alias("h"), F.col("window.values").alias("values"))
        .join(hashes, ["h", "width"], "left_semi")
        for w in widths
    ]
    found = stored(reduce(DataFrame.unionByName, seen), "found-windows")
    pair = lambda k: F.struct(F.get("item_values", k).alias("item"), F.get("values", k).alias("doc"))
    met = found.join(small(known), ["h", "width"]).select(
        "doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("distance"), "pos", "item_pos", "width",
        F.forall("slots", lambda k: F.get("item_values", k) == F.get("values", k)).alias("own"), F.transform("names", pair).alias("names"),
    )
    met = stored(met, "met-windows")
    together = ["doc_id", "item_id", "distance"]
    names = met.select(*together, F.explode("names").alias("name")).distinct()
    clashes = names.groupBy(*together).agg(
        F.count("*").alias("pairs"), F.count_distinct("name.item").alias("item_names"), F.count_distinct("name.doc").alias("doc_names")
    )
    clashes = clashes.where("pairs <> item_names OR pairs <> doc_names").select(*together, F.lit(True).alias("clash"))
    fine = _same(met, clashes, together, "left").where("clash IS NULL OR own")
    at = F.explode(F.sequence(F.col("item_pos"), F.col("item_pos") + F.col("width") - 1)).alias("at")
    sizes = fine.select(*together, at).distinct().groupBy(*together).agg(F.count("*").alias("n_tokens"))
    counts = fine.groupBy(*together).agg(F.count_distinct("pos").alias("n_windows"), F.bool_and("own").alias("same"))
    return (
        _same(sizes, counts, together, "inner")
        .groupBy("doc_id", "item_id")
        .agg(F.sum("n_windows").alias("n_windows"), F.max("n_tokens").alias("n_tokens"), F.bool_or("same").alias("verbatim"))
    )


def _same(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """An equi-join in which null ids are equal to each other."""
    right = right.select(*(F.col(c).alias(f"_{c}") if c in columns else F.col(c) for c in right.columns))
    test = reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_{c}"]) for c in columns))
    return left.join(right, test, how).drop(*(f"_{c}" for c in columns))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """The documents without any passage of the benchmark, with all their columns; those without an id stay."""
    bad = contaminated(docs, benchmark, **columns).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(bad, docs[columns.get("id_col", "doc_id")] == bad["_id"], "left_anti")
