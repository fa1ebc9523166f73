"""The operators as queries over the given tables, with the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparksymbols.llm import conversations, decontamination, exact_dedup, hard_negatives, licenses, line_rules, minhash, mixing, quality, repeats, token_counts, toxicity, warc
from sparksymbols.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, folder, "pages"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"), licenses.known_licenses(spark))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(spark, table(spark, folder, "documents"))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.corpus_history(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, folder, "conversations"))


def op12_line_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.line_verdicts(table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


OPERATORS = (
    op1_warc, op2_exact_dedup, op3_license_scan, op4_decontamination, op5_suffix_repeats, op6_minhash, op7_mixing,
    op8_token_counts, op9_quality, op10_toxicity, op11_turn_repair, op12_line_cleaning,
    op13_hard_negatives,
)
QUERIES: dict[str, Query] = {operator.__name__: operator for operator in OPERATORS}

ORACLE_SQL = {
    "op1_warc": warc.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_license_scan": licenses.SQL,
    "op7_mixing": mixing.SQL,
    "op11_turn_repair": conversations.SQL,
    "op12_line_cleaning": line_rules.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
