"""Quality by a sparse ensemble of rules over text statistics, scored as one Spark column."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksymbols.llm.common import crc_of_id, let, text_or_empty, words_of

#: Learning takes at most so many labelled documents, chosen by a hash of the id.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 3, 7
L1 = 0.002
THRESHOLD = 0.3

STATISTICS = (
    "n_words", "word_length", "distinct_words", "word_variety", "distinct_lines", "line_words",
    "symbols", "capitals", "digits", "letters",
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def statistics(text: Column) -> Column:
    """A struct of the statistics of a whole text; null counts as empty, and an empty text has zeros."""

    def all_of(t: Column) -> Column:
        chars = F.length(t).cast("double")
        solid, letters = _without(t, r"\s+"), _without(t, r"[^\p{L}]+")
        of_words = let(words_of(t), lambda w: F.struct(F.size(w).cast("double").alias("n"), F.size(F.array_distinct(w)).cast("double").alias("d")))
        of_lines = let(
            F.filter(F.split(t, "\n"), lambda x: x != ""),
            lambda x: F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("d")),
        )
        counted = F.struct(
            solid.alias("solid"), letters.alias("letters"), of_words.alias("words"), of_lines.alias("lines"), chars.alias("chars"),
            (chars - _without(t, r"[#$%&*|@^~=<>{}\[\]\\_+!]+")).alias("symbols"),
            _without(t, r"[^\p{Lu}]+").alias("upper"), _without(t, r"[^\p{N}]+").alias("digits"),
        )
        return let(
            counted,
            lambda c: F.struct(
                c["words"]["n"].alias("n_words"),
                _share(c["solid"], c["words"]["n"]).alias("word_length"),
                _share(c["words"]["d"], c["words"]["n"]).alias("distinct_words"),
                _share(c["words"]["d"], F.sqrt(c["words"]["n"])).alias("word_variety"),
                _share(c["lines"]["d"], c["lines"]["n"]).alias("distinct_lines"),
                _share(c["words"]["n"], c["lines"]["n"]).alias("line_words"),
                _share(c["symbols"], c["solid"]).alias("symbols"),
                _share(c["upper"], c["letters"]).alias("capitals"),
                _share(c["digits"], c["solid"]).alias("digits"),
                _share(c["letters"], c["solid"]).alias("letters"),
            ),
        )

    return let(text_or_empty(text), all_of)


@dataclass(frozen=True)
class RuleModel:
    """Conjunctions of ``(statistic, operator, threshold)`` with their weights in a logistic sum."""

    rules: tuple[tuple[tuple[tuple[str, str, float], ...], float], ...]
    intercept: float

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as a column over a struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, stats), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple[tuple[str, str, float], ...], stats: Column) -> Column:
    out = F.lit(True)
    for name, sign, threshold in rule:
        out = out & ((stats[name] <= threshold) if sign == "<=" else (stats[name] > threshold))
    return out


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[float, int, float] | None:
    """The feature and threshold that lower the Gini impurity most: gain, feature, threshold."""
    best, n, ones = None, len(y), y.sum()
    whole = ones * (n - ones) / n
    for feature in features:
        order = np.argsort(x[:, feature], kind="stable")
        values, left = x[order, feature], np.cumsum(y[order])[:-1]
        size = np.arange(1, n)
        right = ones - left
        impurity = left * (size - left) / size + right * (n - size - right) / (n - size)
        impurity[values[1:] == values[:-1]] = np.inf
        at = int(np.argmin(impurity)) if n > 1 else 0
        if n > 1 and np.isfinite(impurity[at]) and whole - impurity[at] > 1e-9 and (best is None or whole - impurity[at] > best[0]):
            best = (float(whole - impurity[at]), int(feature), float((values[at] + values[at + 1]) / 2))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[tuple[tuple[str, str, float], ...]]:
    """All paths from a root to any node of a forest of shallow trees, each once, narrowest bounds only.

    Each tree sees rows drawn with replacement, each of its nodes a third of the statistics.
    """
    random = np.random.default_rng(seed)
    some = max(1, -(-x.shape[1] // 3))
    found: dict[tuple[tuple[str, str, float], ...], None] = {}

    def grow(rows: np.ndarray, path: dict[tuple[str, str], float], left: int) -> None:
        if path:
            found[tuple(sorted((name, sign, at) for (name, sign), at in path.items()))] = None
        split = left and _split(x[rows], y[rows], random.choice(x.shape[1], some, replace=False))
        if not split:
            return
        _, feature, at = split
        name, low = STATISTICS[feature], x[rows, feature] <= at
        grow(rows[low], path | {(name, "<="): min(at, path.get((name, "<="), math.inf))}, left - 1)
        grow(rows[~low], path | {(name, ">"): max(at, path.get((name, ">"), -math.inf))}, left - 1)

    for _ in range(trees):
        grow(random.integers(0, len(y), len(y)), {}, depth)
    return list(found)


def lasso(followed: np.ndarray, y: np.ndarray, penalty: float = L1, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic sum over 0/1 columns, with the mean loss plus ``penalty`` times the weights' sizes.

    Accelerated gradient steps, each followed by a soft threshold; the intercept is free. Rows that follow the same
    rules are one row with a count.
    """
    n = len(y)
    _, first, same = np.unique(np.packbits(followed, axis=1), axis=0, return_index=True, return_inverse=True)
    same = same.ravel()
    x = np.column_stack([followed[first], np.ones(len(first), bool)]).astype(float)
    count, ones = np.bincount(same), np.bincount(same, weights=y)
    rate = 4 * n / np.linalg.norm(x * np.sqrt(count)[:, None], 2) ** 2
    w = past = at = np.zeros(x.shape[1])
    shrink = np.full(len(w), penalty * rate)
    shrink[-1] = 0
    pace = 1.0
    for _ in range(steps):
        slope = x.T @ (count / (1 + np.exp(-np.clip(x @ at, -50, 50))) - ones) / n
        w = at - rate * slope
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        at, past, pace = w + (pace - 1) / faster * (w - past), w, faster
    return w[:-1], float(w[-1])


def _follows(rule: tuple[tuple[str, str, float], ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, at in rule:
        values = x[:, STATISTICS.index(name)]
        out &= values <= at if sign == "<=" else values > at
    return out


def training_rows(labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, label``: at most ``rows`` labelled ids that are not held out, chosen by a hash; an id counts once."""
    named = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc_of_id(F.col(id_col)) != 0))
    once = named.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("double").alias("label"))
    return once.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Learn rules from the labelled documents that are not held out (``rows`` of them at most, a few numbers each).

    Shallow trees propose conjunctions; a lasso on the rules as 0/1 columns keeps few and gives their weights. Both run
    on the few numbers that come to the driver, where Spark would need some hundreds of small jobs for them. Without
    labels the score is 0.5 everywhere, with one class only it is that class's share, smoothed.
    """
    chosen = training_rows(labels, label, rows, id_col)
    stats = statistics(F.col(text_col))
    known = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias(text_col))
        .join(F.broadcast(chosen), "_id")
        .select("_id", "label", stats.alias("s"))
        # An id that repeats is learned from once, however many rows it has.
        .groupBy("_id")
        .agg(F.max("label").alias("label"), F.min("s").alias("s"))
        .select("_id", "label", *(F.col("s")[name].alias(name) for name in STATISTICS))
        .collect()
    )
    known = sorted(tuple(row) for row in known)
    ones = sum(row[1] for row in known)
    if ones in (0, len(known)):
        return RuleModel((), math.log((ones + 0.5) / (len(known) - ones + 0.5)))
    y, x = np.array([row[1] for row in known]), np.array([row[2:] for row in known])
    rules = tree_rules(x, y)
    if not rules:
        return RuleModel((), math.log(ones / (len(known) - ones)))
    weights, intercept = lasso(np.column_stack([_follows(rule, x) for rule in rules]), y)
    kept = tuple((rule, float(w)) for rule, w in zip(rules, weights, strict=True) if w)
    return RuleModel(kept, intercept)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, from its whole text.

    ``score`` is 0 to 1, higher if label 1 is likelier; ``predicted`` is 1 from ``threshold`` on. Null texts count as
    empty and are scored as such; null ids count as empty text for ``held_out`` and are never learned from. Repeated
    rows are scored each, and labels that repeat an id count once with their largest value. Empty tables are fine.
    """
    model = fit_rules(docs, labels, label, rows, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("s")).select(
        "doc_id", (crc_of_id(F.col("doc_id")) == 0).alias("held_out"), model.score(F.col("s")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules accept, with all their columns; texts stay in their rows."""
    model = fit_rules(docs, labels, label, TRAIN_ROWS, id_col, text_col)
    return docs.where(model.score(statistics(F.col(text_col))) >= threshold)
