"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparksymbols.llm.common import crc_of_id, stored, text_or_empty
from sparksymbols.session import ship_with_tasks

#: Learning takes at most so many toxic and so many other labelled documents, chosen by a hash of the id.
TRAIN_ROWS = 5_000
MIN_DOCUMENTS, MIN_WEIGHT = 5, 2.5
PREFIXES = range(4, 10)
THRESHOLD = 0.5

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "к": "k",
    "м": "m", "т": "t", "н": "h", "в": "b", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "ո": "n", "օ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
# Phrases in which a lexicon word is no insult.
EXCEPTIONS = ("trash can", "trash bin", "recycle trash", "clown fish", "pathetic fallacy", "stupid question is no", "pond scum")

_GLYPHS = str.maketrans(HOMOGLYPHS)
_INSIDE = re.compile(r"(?:(?<=[^\W\d_])|(?<![\w@$!|]))[013-9@$!|]{1,3}(?=[^\W\d_])")
#: Digits that end a word of three characters or more; signs there are punctuation.
_AT_END = re.compile(r"(?:(?<=[^\W\d_]{2})[013-9]{1,3}|(?<=[^\W\d_])[013-9]{2,3})(?!\w)")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Lower-case words with one blank before, between and after; look-alikes and digits inside words are letters."""
    text = unicodedata.normalize("NFKC", text or "").lower()
    if not text.isascii():
        text = text.translate(_GLYPHS)
    for place in (_INSIDE, _AT_END):
        text = place.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)
    return f" {_GAPS.sub(' ', text).strip()} "


def terms_of(folded: str) -> set[str]:
    """The words of a folded text, ended by a blank, and their beginnings."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in PREFIXES if len(word) > n)
    return found


@dataclass
class Lexicon:
    """Weights of terms, exception phrases, and the logistic curve over the weight per 100 words."""

    weights: dict[str, float]
    exceptions: Sequence[str]
    slope: float = 0.0
    intercept: float = 0.0

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(fold(phrase)), None))
        found.make_automaton()
        return found

    def density(self, matcher, text: str | None) -> float:
        """log(1 + matched weight per 100 words). A word counts its heaviest term; words in exception phrases none."""
        if not len(matcher):
            return 0.0
        folded = fold(text)
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in matcher.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        ends = _joined(spared)
        total = sum(w for at, w in hits.items() if not _inside(at, *ends))
        return math.log1p(100 * total / max(1, folded.count(" ") - 1))

    def score(self, x):
        return 1 / (1 + np.exp(-(self.intercept + self.slope * x)))


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of spans, those that overlap as one."""
    starts, ends = [], []
    for start, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _inside(at: int, starts: list[int], ends: list[int]) -> bool:
    place = bisect_right(starts, at) - 1
    return place >= 0 and at < ends[place]


def _densities(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = lexicon.matcher()
        for batch in batches:
            yield batch.drop(columns="text").assign(x=[lexicon.density(matcher, t) for t in batch["text"]])

    return run


def _document_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for label, text in zip(batch["label"], batch["text"], strict=True):
            terms = list(terms_of(fold(text)))
            yield pd.DataFrame({"term": terms, "label": [label] * len(terms)})


def _chosen(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct texts of the labelled documents to learn from: ``label, text, share`` taken of that label's documents."""
    named = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc_of_id(F.col(id_col)) != 0))
    once = named.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    parts = [once.where(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(rows) for k in (0, 1)]
    total = once.groupBy("label").agg(F.count("*").alias("all"))
    taken = parts[0].unionByName(parts[1])
    found = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("text")).join(F.broadcast(taken), "_id")
    # An id that repeats gives one text, so that no more than the chosen rows go on.
    found = found.groupBy("_id", "label").agg(F.min("text").alias("text"))
    return found.groupBy("label", "text").agg(F.min("_id").alias("_id")).join(
        F.broadcast(total.select("label", F.least(F.lit(1.0), rows / F.col("all")).alias("share"))), "label"
    )


def learn_lexicon(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, exceptions: Sequence[str] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Terms that tell toxic from other documents, weighted by smoothed log odds, and the curve over their density.

    Learns from labelled documents that are not held out, ``rows`` of each label at most, equal texts once. A term is a
    word or the beginning of one; of terms in the same documents the longest stands for all. Without documents of both
    labels the lexicon is empty and the score the smoothed share of label 1.
    """
    ship_with_tasks(__name__)
    known = stored(_chosen(docs, labels, label, rows, id_col, text_col), "toxic-train")
    sizes = {r["label"]: (r["n"], r["share"]) for r in known.groupBy("label").agg(F.count("*").alias("n"), F.max("share").alias("share")).collect()}
    (others, other_share), (toxic, toxic_share) = sizes.get(0, (0, 1.0)), sizes.get(1, (0, 1.0))
    if not others or not toxic:
        return Lexicon({}, exceptions, 0.0, math.log((toxic + 0.5) / (others + 0.5)))
    terms = known.select("label", "text").mapInPandas(_document_terms, "term string, label int")
    weight = F.ln((F.col("t") + 0.5) / (toxic + 1)) - F.ln((F.col("o") + 0.5) / (others + 1))
    best = (
        terms.groupBy("term")
        .agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o"))
        .where(F.col("t") >= MIN_DOCUMENTS)
        .withColumn("weight", weight)
        .where(F.col("weight") >= MIN_WEIGHT)
        .orderBy(F.length("term").desc(), "term")
        .collect()
    )
    # The longest of terms in the same documents stands for its beginnings. The thresholds alone bound the list: a term
    # is in at least MIN_DOCUMENTS of the documents to learn from.
    seen, weights = set(), {}
    for row in best:
        same = (row["t"], row["o"])
        if (row["term"], same) not in seen:
            weights[row["term"]] = row["weight"]
        seen.update((row["term"][:n], same) for n in range(5, len(row["term"]) + 1))
    lexicon = Lexicon(weights, exceptions)
    points = known.select("label", "text").mapInPandas(_densities(lexicon), "label int, x double").collect()
    x, y = np.array([p["x"] for p in points]), np.array([p["label"] for p in points], float)
    lexicon.slope, lexicon.intercept = _logistic(x, y)
    # Labels were taken at different rates; the intercept is moved to the rates of all labelled documents.
    lexicon.intercept += math.log(other_share / toxic_share)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a small penalty on the slope; rows in any order give the same."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    design, beta = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hessian, design.T @ (y - p) - np.array([ridge, 1e-6]) * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, exceptions: Sequence[str] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, from its whole text.

    ``score`` is 0 to 1, higher if label 1 is likelier; ``predicted`` is 1 from ``threshold`` on. Null texts count as
    empty; null ids count as empty text for ``held_out`` and are never learned from. Repeated rows are scored each;
    labels that repeat an id count once, as toxic if any says so. Empty tables are fine.
    """
    lexicon = learn_lexicon(docs, labels, label, rows, exceptions, id_col, text_col)
    ids = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    # pandas has no integers with nulls by default: the id travels as text.
    found = ids.select(F.col("doc_id").cast("string"), "text").mapInPandas(_densities(lexicon), "doc_id string, x double")
    score = 1 / (1 + F.exp(-(F.lit(lexicon.intercept) + F.lit(lexicon.slope) * F.col("x"))))
    return found.select(
        F.col("doc_id").cast(kind).alias("doc_id"), (crc_of_id(F.col("doc_id")) == 0).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
