"""The full evaluation: composition, sentence level, span level, errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.operators import evaluate as ev
from inkveil.operators.detect import detect
from inkveil.sources.sinks import report_row, written_table


@dataclass(frozen=True)
class Evaluation:
    corpus: DataFrame
    sentence: DataFrame
    spans: DataFrame
    false_positives: DataFrame
    false_negatives: DataFrame

    def report(self) -> DataFrame:
        return report_row(self.corpus, self.sentence, self.spans, self.false_positives, self.false_negatives)


def evaluate(sentences: DataFrame, strict: bool = True, stage: bool = False, **detection) -> Evaluation:
    """Score the detector on ``sentences(sent_id, text, entities)``, where
    ``entities`` lists the labelled (entity_text, category) pairs.

    Everything is computed inside the sentence's own row; only counts of nine
    categories and the first errors leave their task.  With ``stage`` the
    scored sentences are written once and all five results read them.
    """
    scored = detect(ev.resolve_gold(sentences, strict).drop("entities"), **detection)
    if stage:
        scored = written_table(scored, "scored")
    flags = scored.select((F.size("gold") > 0).alias("has_gold"), (F.size("entities") > 0).alias("has_detection"))

    def place(s: Column, category: str) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s[category].alias("category"))

    gold_places = F.transform("gold", lambda g: place(g, "category"))
    found_places = F.transform("entities", lambda e: place(e, "entity_type"))
    def times(places: Column, wanted: Column) -> Column:
        return F.size(F.filter(places, lambda p: p == wanted))

    def surplus(spans: str, category: str, own: str, others: str) -> Column:
        """The spans beyond those that pair up one to one with ``others``: of equal ones, the last."""
        return F.filter(
            spans,
            lambda s, i: times(F.slice(own, 1, i + 1), place(s, category)) > times(F.col(others), place(s, category)),
        )

    wrong = surplus("entities", "entity_type", "found_places", "gold_places")
    missed = surplus("gold", "category", "gold_places", "found_places")
    placed = scored.withColumn("gold_places", gold_places).withColumn("found_places", found_places)
    fps = (
        placed.select("sent_id", "text", F.inline_outer(wrong))
        .where("start IS NOT NULL")
        .select(
            "sent_id", "start", "text", F.col("original_text").alias("matched_text"), "entity_type",
            F.round("score", 3).alias("score"),
        )
    )
    fns = (
        placed.select("sent_id", "text", F.inline_outer(missed))
        .where("start IS NOT NULL")
        .select(
            "sent_id", "start", "text", F.expr("substring(text, start + 1, `end` - start)").alias("missed_text"),
            F.col("category").alias("entity_type"),
        )
    )
    return Evaluation(
        ev.corpus_composition(scored), ev.sentence_metrics(flags), ev.span_metrics_of_rows(scored), fps, fns
    )
