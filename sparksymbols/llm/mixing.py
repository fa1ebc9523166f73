"""Sources mixed to target weights by Efraimidis-Spirakis sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparksymbols.llm.common import join_back, small, stored, text_or_empty

SPACES = " \t\n\u000b\u000c\r"
#: Keys are binned this finely before anything is sorted: only one bin of each source is.
BINS = 65_536
NOT_PROSE = r"""[^\p{L}\p{N}\s.,;:!?'"()-]"""


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text_or_empty(text), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint")


def prose_weight(text: Column) -> Column:
    """Quality weight: the share of characters that prose is written with, 0.05 at least; 1 for empty texts."""
    text = text_or_empty(text)
    share = F.length(F.regexp_replace(text, NOT_PROSE, "")) / F.length(text)
    return F.when(F.length(text) == 0, 1.0).otherwise(F.greatest(share, F.lit(0.05)))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``source, source_size, target`` from sizes by source: one short row per source.

    Weights repeat over the sources in code point order, null last. Together the sources get ``share`` of all sizes;
    none gets more than ``cap`` times its own, and what that leaves goes to the others by weight. In order of
    cap / weight the sources that meet their cap come first, which gives the final share of a unit of weight at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    weighed = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(cap)).alias("most"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    levels = weighed.withColumn("level", (total - F.coalesce(before, F.lit(0.0))) / left)
    free = F.col("level") <= F.col("most") / F.col("w")
    level = F.max_by(F.when(free, F.col("level")), F.when(free, -F.col("most") / F.col("w"))).over(Window.partitionBy())
    target = F.least(F.col("most"), F.coalesce(F.col("w") * level, F.col("most")))
    return levels.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    cap: float = 3.0,
    seed: int = 7,
    quality: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bins: int = BINS,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    Each source is taken whole as often as its target allows; the rest of its target is filled by documents in
    order of the exponential key -ln(u) / weight, u being a hash of id and seed and the weight ``quality`` (by default
    the share of prose characters). The document that crosses the target gives its first words only, so each source's
    ``taken`` is its target to the word, and no document gives more than ``cap`` epochs, rounded up.

    Keys are counted in bins; prefix sums over the bins find the one in which a source's budget ends, and only that
    bin is sorted. Null sources are one source, null or blank texts have size 0, null ids share one key and ties go
    by id; rows that repeat are separate. An empty table gives an empty result.
    """
    weight = F.greatest(quality if quality is not None else prose_weight(F.col(text_col)), F.lit(1e-6))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("src"),
        word_count(F.col(text_col)).alias("size"),
        (-F.ln(uniform(F.col(id_col), seed)) / weight).alias("key"),
    )
    place = F.least(F.floor((1 - F.exp(-F.col("key"))) * bins), F.lit(bins - 1)).cast("int")
    rows = stored(rows.withColumn("bin", place), "mix-rows")
    sizes = rows.groupBy("src", "source", "bin").agg(F.sum("size").alias("in_bin"))
    sizes = stored(sizes, "mix-bins")
    per_source = sizes.groupBy("source").agg(F.sum("in_bin").alias("source_size"))
    plan = source_targets(per_source, weights, share, cap).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("src"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"),
    )
    plan = plan.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
    before = F.sum("in_bin").over(Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    ends = (
        sizes.select("src", "bin", "in_bin", F.coalesce(before, F.lit(0)).alias("before"))
        .join(plan, "src")
        .where("before < budget AND budget <= before + in_bin")
        .select("src", F.col("bin").alias("end_bin"), F.col("before").alias("end_before"))
    )
    plan = stored(plan.join(ends, "src", "left"), "mix-plan")
    wide = small(plan)
    planned = rows.join(wide, "src") if wide is not plan else join_back(rows, plan, ["src"])
    whole = F.when(F.col("end_bin").isNotNull() & (F.col("bin") < F.col("end_bin")), F.col("size")).otherwise(0)
    in_end = F.col("end_bin").isNotNull() & (F.col("bin") == F.col("end_bin"))
    outside = planned.where(~in_end).withColumn("extra", whole)
    so_far = Window.partitionBy("src").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("end_before") - F.coalesce(F.sum("size").over(so_far), F.lit(0))
    inside = planned.where(in_end).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).cast("bigint").alias("taken")
    return outside.unionByName(inside).select("doc_id", "size", "source_size", "target", taken)


SQL = rf"""
WITH rows AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u FROM documents),
keyed AS (SELECT doc_id, source, size, -ln(u) / greatest(CASE WHEN t = '' THEN 1.0::DOUBLE ELSE greatest(
            length(regexp_replace(t, '{NOT_PROSE.replace("'", "''")}', '', 'g'))::DOUBLE / length(t), 0.05) END, 1e-6) AS key
          FROM rows),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
weighed AS (SELECT source, source_size, source_size * 3.0::DOUBLE AS most,
              CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS w
            FROM sizes),
levels AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM sizes)
             - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
           FROM weighed),
targets AS (SELECT source, source_size, least(most, coalesce(w * (SELECT arg_min(level, most / w) FROM levels
              WHERE level <= most / w), most)) AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
summed AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs,
             CAST(round(p.target - p.epochs * p.source_size) AS BIGINT) - coalesce(sum(k.size) OVER (PARTITION BY k.source
               ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
           FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM summed
"""
