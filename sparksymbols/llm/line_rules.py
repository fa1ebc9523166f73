"""Quality rules, lines first: lines that are no prose are taken out, then documents that lose too much are rejected."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksymbols.llm.common import let, text_or_empty, words_of

FEWEST_WORDS = 50
#: A document is rejected if more than so many per cent of its words stand in windows that it repeats.
MOST_REPEATED = 50
#: ... or if its lines lose more than so many per cent of the characters of its words.
MOST_LOST = 50
SYMBOLS = "[#*$%&|<>]"

# Patterns are written so that Java's and RE2's expressions read them alike.
HAS_WORD = r"[^\x20\x09-\x0D]"
#: A sentence ends in a stop, perhaps behind closing quotes or brackets, before white space or the end of its line.
SENTENCE_END = r"""[.!?…。！？]["'”’»)\]]*(?:[\x20\x09-\x0D]|$)"""
#: Words that only part entries of a menu, and words that end in marks which no prose puts behind a word.
SEPARATOR = r"^[|»›>·•/\\~=-]+$"
DECORATED = r"(?:[#*$%&|<>^~=@]|!!|\?\?)$"
#: More than so many words of a line to each separator or decorated word are prose.
WORDS_TO_A_MARK = 4
# Phrases of page furniture, in lower case.
BOILERPLATE = (
    "javascript", "cookie policy", "cookie settings", "cookie consent", "uses cookies", "use cookies", "all rights reserved",
    "privacy policy", "terms of use", "terms of service", "lorem ipsum", "click here", "sign in to", "sign up for", "log in to",
    "subscribe to our", "share on", "skip to content", "skip to main content", "back to top", "powered by", "{", "}",
)
RULES = ("navigation", "boilerplate", "punctuation")


def rule_of(line: Column) -> Column:
    """The first rule that a line fails, by name; null for a line that stays."""
    words = words_of(line)
    marks = F.filter(words, lambda w: w.rlike(SEPARATOR) | w.rlike(DECORATED))
    # A line without any mark is the usual case and needs no words.
    menu = line.rlike(r"[|»›>·•/\\~=#*$%&<^@-]|!!|\?\?") & (F.size(marks) * WORDS_TO_A_MARK >= F.size(words)) & (F.size(marks) > 0)
    furniture = let(F.lower(line), lambda x: reduce(or_, (x.contains(phrase) for phrase in BOILERPLATE)))
    return F.when(menu, "navigation").when(furniture, "boilerplate").when(~line.rlike(SENTENCE_END), "punctuation")


def _chars(words: Column) -> Column:
    """Code points of words."""
    return F.length(F.array_join(words, "")).cast("bigint")


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three that the text has twice or more.

    Hashes of windows are sorted with their places; equal neighbours give the places, each of which covers three
    words less what the next one covers too.
    """

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        windows = F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("hash"), i.alias("at")))
        return let(F.sort_array(windows), places)

    def places(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i)["hash"] == x["hash"], F.lit(False))
        found = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["at"])), covered)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    return let(words, of)


def word_report(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("bigint").alias("n_words"), _chars(words).alias("word_chars"), repeated_words(words).alias("n_repeat_words")
    )


def _fails(rule: str):
    return lambda line: line["rule"] == rule


def line_report(text: Column) -> Column:
    """A struct for a whole text: its counts, its distinct lines with the rule each fails, and what they lose."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(HAS_WORD))
        return let(lines, lambda x: counts(t, x))

    def counts(t: Column, lines: Column) -> Column:
        single = F.transform(F.array_distinct(lines), lambda x: F.struct(x.alias("line"), rule_of(x).alias("rule")))
        return let(single, lambda s: report(t, lines, s))

    def report(t: Column, lines: Column, single: Column) -> Column:
        stay = F.array_join(F.transform(F.filter(single, lambda s: s["rule"].isNull()), lambda s: s["line"]), "\n")
        return F.struct(
            (F.length(t) - F.length(F.regexp_replace(t, f"{SYMBOLS}+", ""))).cast("bigint").alias("n_symbols"),
            (F.size(lines) - F.size(single)).cast("bigint").alias("n_dup_lines"),
            *(F.size(F.filter(single, _fails(rule))).cast("bigint").alias(f"n_{rule}") for rule in RULES),
            stay.alias("clean_text"),
        )

    return let(text_or_empty(text), of)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """One row per document: its counts, the lines that stay and the verdict on the whole.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` describe the text as it is. A line fails as
    ``navigation`` if a quarter of its words or more are separators or end in marks, as ``boilerplate`` by a phrase of
    page furniture, as ``punctuation`` if no sentence ends in it; a line that an earlier one equals goes too.
    ``clean_text`` has the lines that stay and ``kept_chars`` the characters of their words. ``base_failed`` are texts
    under ``FEWEST_WORDS`` words or mostly of repeated windows, ``kept`` the others that lose at most ``most_lost`` per
    cent of ``word_chars``.

    Everything is said in columns: texts stay in their rows and nothing is shuffled; a task holds some fifty bytes a
    word for the windows of the one text it is at. Windows are told apart by a hash of 64 bits. Null texts count as
    empty, which fails as too short; null and repeated ids are rows like any other; other columns are not looked at.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = whole.select(
        "doc_id",
        let(words_of(F.col("text")), word_report).alias("w"),
        line_report(F.col("text")).alias("l"),
    )
    flat = counted.select(
        "doc_id", "w.n_words", "w.word_chars", "l.n_symbols", "l.n_dup_lines", "w.n_repeat_words",
        *(f"l.n_{rule}" for rule in RULES), "l.clean_text", _chars(words_of(F.col("l.clean_text"))).alias("kept_chars"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost = 100 * (F.col("word_chars") - F.col("kept_chars")) > most_lost * F.col("word_chars")
    return flat.withColumns({"base_failed": failed, "kept": ~failed & ~lost})


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``clean_lines`` without the texts."""
    return clean_lines(docs, id_col, text_col).drop("clean_text")


SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM docs
),
placed AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
windows AS (
  SELECT rid, pos, word AS a, lead(word) OVER doc AS b, lead(word, 2) OVER doc AS c FROM placed WINDOW doc AS (PARTITION BY rid ORDER BY pos)
),
found AS (
  SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, a, b, c) AS times FROM windows WHERE c IS NOT NULL) WHERE times >= 2
),
covered AS (
  SELECT rid, sum(least(3, coalesce(after - pos, 3)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS after FROM found) GROUP BY rid
),
lines AS (
  SELECT rid, line, count(*) AS times
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{HAS_WORD}') GROUP BY rid, line
),
marked AS (
  SELECT rid, line, times, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM lines
),
counted AS (
  SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '{SEPARATOR}') OR regexp_matches(x, '{DECORATED}'))) AS marks FROM marked
),
judged AS (
  SELECT rid, line, times, CASE
    WHEN marks > 0 AND marks * {WORDS_TO_A_MARK} >= len(w) THEN 'navigation'
    WHEN {" OR ".join(f"contains(lower(line), '{phrase}')" for phrase in BOILERPLATE)} THEN 'boilerplate'
    WHEN NOT regexp_matches(line, '{SENTENCE_END.replace("'", "''")}') THEN 'punctuation' END AS rule
  FROM counted
),
reported AS (
  SELECT rid, sum(times - 1)::BIGINT AS n_dup_lines,
         {", ".join(f"count(*) FILTER (rule = '{rule}') AS n_{rule}" for rule in RULES)},
         coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (rule IS NULL), 0)::BIGINT AS kept_chars
  FROM judged GROUP BY rid
),
flat AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         {", ".join(f"coalesce(n_{rule}, 0) AS n_{rule}" for rule in RULES)}, coalesce(kept_chars, 0) AS kept_chars
  FROM docs JOIN words USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN reported USING (rid)
)
SELECT *, base_failed IS FALSE AND 100 * (word_chars - kept_chars) <= {MOST_LOST} * word_chars AS kept
FROM (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM flat)
"""
