"""Scoring detections against labelled spans.

Long tables: ``gold(sent_id, start, end, category)`` and
``detections(sent_id, start, end, entity_type, original_text, score)``.
Wide rows: one sentence with its gold spans and its entities as arrays; they
need no join at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.columns import each, fresh
from inkveil.operators.detect import at_least, resolve, spans_of
from inkveil.operators.rules import Rule, default_rules

GOLD = "struct<start:int,end:int,category:string>"
_PLACE = ["sent_id", "start", "end", "category"]


# -- gold offsets -----------------------------------------------------------
def gold_spans_sql(text: str, listed: str) -> str:
    """Offsets of listed (entity_text, category) pairs within ``text``.

    Each is searched from the end of the one before, else from the beginning;
    a missing one has a negative start.  Sorted by position.
    """
    acc, x, done = fresh("acc"), fresh("x"), fresh("done")
    onward = f"locate({x}.entity_text, {text}, {acc}.at + 1)"
    begin = f"CASE WHEN {onward} > 0 THEN {onward} ELSE locate({x}.entity_text, {text}) END - 1"
    span = f"named_struct('start', {begin}, 'end', {begin} + length({x}.entity_text), 'category', {x}.category)"
    return (
        f"array_sort(aggregate({listed}, named_struct('at', 0, 'out', cast(array() AS array<{GOLD}>)),"
        f" ({acc}, {x}) -> named_struct('at', {begin} + length({x}.entity_text),"
        f" 'out', concat({acc}.out, array({span}))), {done} -> {done}.out))"
    )


def resolve_gold(sentences: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``gold`` spans.  A listed text that does not occur in its sentence
    is an error, or with ``strict=False`` is left to ``unresolved_gold``."""
    resolved = sentences.withColumn("gold", F.expr(gold_spans_sql("text", "entities")))
    if not strict:
        return resolved
    missing = F.exists("gold", lambda g: g["start"] < 0)
    message = F.concat(F.lit("labelled text not found in: "), F.col("text"))
    return resolved.withColumn("gold", F.when(missing, F.raise_error(message)).otherwise(F.col("gold")))


def unresolved_gold(resolved: DataFrame) -> DataFrame:
    """Sentences with a listed text that does not occur in them."""
    return resolved.where(F.exists("gold", lambda g: g["start"] < 0))


# -- long tables ------------------------------------------------------------
def _unsent(side: DataFrame) -> DataFrame:
    """``side`` of a join that shuffles it.

    Sentences and spans come out of generators, whose rows the planner takes
    for as few as those of their source: it would collect them on the driver to
    broadcast them.
    """
    return side.hint("merge")


def match_spans(gold: DataFrame, detections: DataFrame) -> DataFrame:
    """tp, fp and fn per exact (sentence, start, end, category).

    Both sides are counted per key first and joined one to one, so repeated
    keys pair up one by one without numbering them in a window.
    """
    wanted = gold.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n_gold"))
    given = detections.groupBy("sent_id", "start", "end", F.col("entity_type").alias("category")).agg(
        F.count(F.lit(1)).alias("n_detected")
    )
    n_gold, n_detected = F.coalesce("n_gold", F.lit(0)), F.coalesce("n_detected", F.lit(0))
    hits = F.least(n_gold, n_detected)
    return given.join(wanted, _PLACE, "full_outer").select(
        *_PLACE, hits.alias("tp"), (n_detected - hits).alias("fp"), (n_gold - hits).alias("fn")
    )


def false_positives(sentences: DataFrame, gold: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections beyond those that pair up with a gold span of the same place and category; repeated ones repeat."""
    wanted = gold.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n_gold"))
    found = detections.groupBy("sent_id", "start", "end", F.col("entity_type").alias("category")).agg(
        F.count(F.lit(1)).alias("n_detected"), F.min("original_text").alias("matched_text"),
        F.round(F.max("score"), 3).alias("score"),
    )
    placed = found.dropna(subset=_PLACE).join(_unsent(wanted), _PLACE, "left")
    surplus = placed.withColumn("fp", F.col("n_detected") - F.coalesce("n_gold", F.lit(0))).where("fp > 0")
    repeated = surplus.withColumn("copy_", F.explode(F.expr("sequence(1L, fp)")))
    return repeated.join(_unsent(sentences.select("sent_id", "text")), "sent_id").select(
        "sent_id", "start", "text", "matched_text", F.col("category").alias("entity_type"), "score"
    )


def false_negatives(sentences: DataFrame, gold: DataFrame, detections: DataFrame) -> DataFrame:
    """Gold spans beyond those that pair up with a detection of the same place and category; repeated ones repeat."""
    surplus = match_spans(gold, detections).where("fn > 0").select(*_PLACE, F.explode(F.expr("sequence(1L, fn)")).alias("copy_"))
    return surplus.join(_unsent(sentences.select("sent_id", "text")), "sent_id").select(
        "sent_id", "start", "text",
        F.expr("substring(text, start + 1, `end` - start)").alias("missed_text"),
        F.col("category").alias("entity_type"),
    )


def sentence_flags(sentences: DataFrame, gold: DataFrame, detections: DataFrame) -> DataFrame:
    """has_gold and has_detection for every sentence, also the silent ones."""
    with_gold = gold.select("sent_id", F.lit(True).alias("g_")).distinct()
    with_hits = detections.select("sent_id", F.lit(True).alias("d_")).distinct()
    return (
        sentences.select("sent_id")
        .join(_unsent(with_gold), "sent_id", "left")
        .join(_unsent(with_hits), "sent_id", "left")
        .select(
            "sent_id",
            F.coalesce("g_", F.lit(False)).alias("has_gold"),
            F.coalesce("d_", F.lit(False)).alias("has_detection"),
        )
    )


# -- metrics ----------------------------------------------------------------
def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_scores(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Add precision, recall and F1, zero where a denominator is zero."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * precision * recall, precision + recall)
    return counts.select(
        "*",
        F.round(precision, digits).alias("precision"),
        F.round(recall, digits).alias("recall"),
        F.round(f1, digits).alias("f1"),
    )


def span_metrics(matched: DataFrame) -> DataFrame:
    """Per category and, as category ``ALL``, over all of them."""
    sums = matched.rollup("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return with_scores(sums.withColumn("category", F.coalesce("category", F.lit("ALL"))))


def sentence_metrics(flags: DataFrame) -> DataFrame:
    """The confusion matrix of has-gold against has-detection."""
    gold, found = F.col("has_gold"), F.col("has_detection")
    cells = flags.agg(
        F.count_if(gold & found).alias("tp"),
        F.count_if(~gold & ~found).alias("tn"),
        F.count_if(~gold & found).alias("fp"),
        F.count_if(gold & ~found).alias("fn"),
    )
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return with_scores(cells.withColumn("accuracy", F.round(ratio(F.col("tp") + F.col("tn"), total), 4)))


def corpus_composition(sentences: DataFrame) -> DataFrame:
    """Sentences, positive and negative ones, and labelled targets."""
    return sentences.agg(
        F.count(F.lit(1)).alias("total_sentences"),
        F.count_if(F.size("gold") > 0).alias("positive_sentences"),
        F.count_if(F.size("gold") == 0).alias("negative_sentences"),
        F.sum(F.size("gold")).alias("total_target_entities"),
    )


# -- wide rows --------------------------------------------------------------
def outcome_spans(scored: DataFrame) -> DataFrame:
    """One row per outcome (tp, fp, fn) from the arrays of each sentence.

    Resolved entities never repeat a place, so a gold span counts as matched
    as often as it is detected: at most once.
    """
    place = f"struct<start:int,end:int,category:string>"
    found = each(
        "entities",
        lambda e: f"CAST(named_struct('start', {e}.start, 'end', {e}.`end`, 'category', {e}.entity_type) AS {place})",
    )
    hits = "array_intersect(gold, found_)"

    def outcome(spans: str, tp: str, fp: str, fn: str) -> str:
        return each(
            spans,
            lambda s: f"named_struct('category', {s}.category, 'tp', {tp}, 'fp', {fp}, 'fn', {fn})",
        )

    extra, i, g = fresh("extra"), fresh("i"), fresh("g")
    missed = f"filter(gold, ({g}, {i}) -> NOT array_contains(found_, {g}) OR array_position(gold, {g}) < {i} + 1)"
    wrong = each("found_", lambda s: f"NOT array_contains(gold, {s})", "filter")
    rows = f"concat({outcome(hits, '1', '0', '0')}, {outcome(wrong, '0', '1', '0')}, {outcome(missed, '0', '0', '1')})"
    return scored.withColumn("found_", F.expr(found)).withColumn("outcomes_", F.expr(rows)).drop("found_")


def span_metrics_of_rows(scored: DataFrame, *by: str) -> DataFrame:
    """``span_metrics`` without any join: in-row outcomes, one small aggregate."""
    rows = outcome_spans(scored).select(*by, F.inline_outer("outcomes_")).where("category IS NOT NULL")
    if not by:
        return span_metrics(rows)
    sums = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return with_scores(sums)


def threshold_sweep(
    sentences: DataFrame, thresholds: Sequence[float], rules: Sequence[Rule] | None = None
) -> DataFrame:
    """Span metrics at several minimum scores.

    The patterns run once per sentence; only cutting and resolving is
    repeated per threshold.
    """
    raw = sentences.withColumn("raw_", F.expr(spans_of("text", default_rules() if rules is None else list(rules))))
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    swept = raw.withColumn("min_score", steps).withColumn("entities", F.expr(resolve(at_least("raw_", "min_score"))))
    return span_metrics_of_rows(swept, "min_score")
