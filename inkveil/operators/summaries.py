"""Counts, distinct values and ordered reports over detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.validators import stripped, suspect_reason


def total_entities(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count(F.lit(1)).alias("total_entities"))


def count_by_type(entities: DataFrame) -> DataFrame:
    """Partial counts per task, then at most nine groups cross the exchange."""
    return entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def ranked_types(entities: DataFrame) -> DataFrame:
    """Categories by falling count."""
    return count_by_type(entities).orderBy(F.desc("n"), "entity_type")


def paragraph_totals(annotated: DataFrame) -> DataFrame:
    """All paragraphs, those with detections, those whose text changed."""
    changed = F.count_if(F.col("changed")) if "changed" in annotated.columns else F.lit(None).cast("bigint")
    return annotated.agg(
        F.count(F.lit(1)).alias("total_paragraphs"),
        F.count_if(F.size("entities") > 0).alias("paragraphs_modified"),
        changed.alias("paragraphs_changed"),
    )


def run_summary(annotated: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row per run: totals plus a count per category, in a single pass.

    The counts per category are sums over the array of the row, so neither an
    explode nor a join of two aggregates is needed.
    """

    def found(category: str) -> Column:
        return F.sum(F.size(F.filter("entities", lambda e: e["entity_type"] == category))).alias(category)

    totals = annotated.agg(
        F.count(F.lit(1)).alias("total_paragraphs"),
        F.count_if(F.size("entities") > 0).alias("paragraphs_modified"),
        F.sum(F.size("entities")).alias("total_entities_found"),
        *[found(category) for category in categories],
    )
    pairs = [part for category in categories for part in (F.lit(category), F.col(category))]
    return totals.select(
        "total_paragraphs", "paragraphs_modified", "total_entities_found",
        F.map_filter(F.create_map(*pairs), lambda _, n: n > 0).alias("by_type"),
    )


def distinct_values(entities: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per value without outer white space; its category is that of the first record.

    A minimum over a struct combines on the map side; a window over the value
    would pull all rows of a frequent value into one task.
    """
    first = F.min(F.struct(*order, "entity_type"))["entity_type"]
    return entities.groupBy(F.expr(stripped("original_text")).alias("value")).agg(
        first.alias("entity_type"), F.count(F.lit(1)).alias("n")
    )


# Sketches of 2 ** SKETCH_BITS places: a merged estimate errs by 1.04 / sqrt(places) in one standard deviation.
SKETCH_BITS = 14
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def value_sketches(entities: DataFrame, *by: str) -> DataFrame:
    """Per category and ``by`` (a day, a source): sketches of the distinct originals and replacements, and a count.

    One pass with partial sketches per task; what crosses the exchange is one
    sketch per task and group, however many values there are.  The rows can be
    kept and merged later.
    """
    return entities.groupBy("entity_type", *by).agg(
        F.hll_sketch_agg(F.expr(stripped("original_text")), SKETCH_BITS).alias("originals"),
        F.hll_sketch_agg("replacement", SKETCH_BITS).alias("replacements"),
        F.count(F.lit(1)).alias("n"),
    )


def distinct_ratios(sketches: DataFrame, *by: str) -> DataFrame:
    """Merged sketches: how many distinct originals and replacements there are per category (and ``by``), and their ratio.

    Counts are within ``error`` (a share, three standard deviations) of the
    exact ones.  A ratio clearly below 1 shows replacements shared by several
    originals, as in a pool of names that is too small.
    """
    merged = sketches.groupBy("entity_type", *by).agg(
        F.hll_union_agg("originals").alias("originals"), F.hll_union_agg("replacements").alias("replacements"), F.sum("n").alias("n")
    )
    estimates = merged.select(
        "entity_type", *by, "n",
        F.hll_sketch_estimate("originals").alias("originals"), F.hll_sketch_estimate("replacements").alias("replacements"),
    )
    ratio = F.when(F.col("originals") > 0, F.col("replacements") / F.col("originals"))
    return estimates.withColumn("ratio", ratio).withColumn("error", F.lit(SKETCH_ERROR))


def suspect_values(entities: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct values that are probably no personal data, with the reason."""
    return (
        distinct_values(entities, order)
        .select("value", "entity_type", F.expr(suspect_reason("value")).alias("reason"))
        .where("reason IS NOT NULL")
    )


def documents_with(documents: DataFrame, entities: DataFrame, category: str, key: str) -> DataFrame:
    """Documents that hold at least one entity of a category."""
    having = entities.where(F.col("entity_type") == category).select(key).distinct()
    return documents.join(having, key, "left_semi")


def first_rows(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of a report, in a stated order."""
    return rows.orderBy(*order).limit(n)
