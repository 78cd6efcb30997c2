"""Resolution of spans that stand in a long table, one row each.

Several detectors may have written their spans as tables, so that no row holds
all spans of a text.  Overlaps are settled inside clusters, runs of spans that
share characters, and nothing larger than a cluster is ever gathered:

1. Spans are dealt to blocks of ``BLOCK_CHARS`` characters by their start.  Per
   block one row tells how far its spans reach; blocks that a span of an
   earlier one reaches into are joined with it.  So a text with a third of all
   spans is spread over tasks by its blocks.
2. Inside joined blocks a running maximum of the ends cuts the spans into
   clusters: a span starts a new one where all before it have ended.
3. The spans of a cluster are resolved by the expression that also resolves
   the spans of a text inside its row, so both ways give the same entities.

Keys may be NULL.  Spans without start or end are dropped, repeated ones count
once; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from inkveil.functions import fixed_values as fixed
from inkveil.operators.detect import at_least, resolve

BLOCK_CHARS = 4096
FIELDS = ["entity_type", "original_text", "start", "end", "score"]


def clusters(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``spans`` with ``text_`` (a text's keys as one string), ``from_`` (first block joined) and ``cluster_`` (its first start)."""
    placed = (
        spans.select(*keys, *FIELDS).where("start IS NOT NULL AND `end` IS NOT NULL")
        .withColumn("text_", F.to_json(F.struct(*keys))).withColumn("block_", F.expr(f"start DIV {BLOCK_CHARS}"))
    )
    earlier = Window.partitionBy("text_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("text_").orderBy("block_").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (
        placed.groupBy("text_", "block_").agg(F.max("end").alias("reach"))
        .withColumn("apart", F.coalesce(F.max("reach").over(earlier) <= F.col("block_") * BLOCK_CHARS, F.lit(True)))
        .select("text_", "block_", F.max(F.when(F.col("apart"), F.col("block_"))).over(upto).alias("from_"))
    )
    of_blocks = Window.partitionBy("text_", "from_").orderBy("start", "end")
    before = of_blocks.rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(blocks, ["text_", "block_"]).drop("block_")
        .withColumn("head_", F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True)))
        .withColumn("cluster_", F.max(F.when(F.col("head_"), F.col("start"))).over(of_blocks.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("head_")
    )


def resolve_long(
    spans: DataFrame,
    keys: Sequence[str],
    min_score: float = fixed.MIN_SCORE,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """``keys`` and one row per entity, from ``keys, entity_type, original_text, start, end, score`` with labels as types."""
    enough = spans.where(F.col("score") >= min_score)
    span = F.struct("entity_type", "original_text", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "score")
    gathered = clusters(enough, keys).groupBy("text_", "cluster_").agg(
        *(F.first(k).alias(k) for k in keys), F.collect_set(span).alias("spans_")
    )
    return gathered.select(*keys, F.expr(f"inline({resolve(at_least('spans_', min_score), labels)})"))
