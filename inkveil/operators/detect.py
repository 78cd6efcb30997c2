"""From text to resolved entities: union, filter, rename, resolve.

All of it is one expression over the text of one row, so detection is a
narrow step: no exchange, no Python worker, and the same expression serves
batch tables, streams and arrays of paragraphs inside a row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions import fixed_values as fixed
from inkveil.functions.columns import NO_SPANS, SPAN, each, fresh, is_blank, let, quote, running
from inkveil.functions.validators import blocked_value
from inkveil.operators.rules import Rule, default_rules, spans_of

Detector = Callable[[Column], Column]


def at_least(spans: str, min_score: float | str) -> str:
    """Keep spans that reach a score, given as a number or as a SQL operand."""
    bound = min_score if isinstance(min_score, str) else f"{float(min_score)}D"
    return each(spans, lambda s: f"{s}.score >= {bound}", "filter")


def rename_labels(spans: str, labels: Mapping[str, str] | None = None) -> str:
    """Keep spans whose label is listed and turn labels into categories."""
    labels = fixed.CATEGORY_OF_LABEL if labels is None else labels

    def renamed(s: str) -> str:
        cases = " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in labels.items())
        return _span(f"CASE {s}.entity_type {cases} END", s)

    return each(each(spans, renamed), lambda s: f"{s}.entity_type IS NOT NULL", "filter")


def _span(entity_type: str, s: str) -> str:
    return (
        f"named_struct('entity_type', {entity_type}, 'original_text', {s}.original_text,"
        f" 'start', {s}.start, 'end', {s}.`end`, 'score', {s}.score)"
    )


def drop_contained(spans: str) -> str:
    """Drop a span that lies inside an at least equally good one of its type."""
    x, i, y, j = fresh("x"), fresh("i"), fresh("y"), fresh("j")
    beats = (
        f"{y}.entity_type = {x}.entity_type AND {y}.start <= {x}.start AND {y}.`end` >= {x}.`end`"
        f" AND {y}.score >= {x}.score"
        f" AND ({j} < {i} OR {y}.start < {x}.start OR {y}.`end` > {x}.`end` OR {y}.score > {x}.score)"
    )
    marks = f"transform({spans}, ({y}, {j}) -> {beats})"
    return f"filter({spans}, ({x}, {i}) -> NOT array_contains({marks}, true))"


def drop_blocked(spans: str) -> str:
    return each(spans, lambda s: f"NOT ({blocked_value(f'{s}.entity_type', f'{s}.original_text')})", "filter")


def in_reading_order(spans: str) -> str:
    """Order by start, better score, longer span, category."""
    keyed = each(
        spans,
        lambda s: f"named_struct('start', {s}.start, 'worse', -{s}.score, 'shorter', -{s}.`end`,"
        f" 'entity_type', {s}.entity_type, 'original_text', {s}.original_text)",
    )
    return each(
        f"array_sort({keyed})",
        lambda k: f"named_struct('entity_type', {k}.entity_type, 'original_text', {k}.original_text,"
        f" 'start', {k}.start, 'end', -{k}.shorter, 'score', -{k}.worse)",
    )


def keep_earliest(ordered: str) -> str:
    """Keep a span iff it starts at or after the end of the last kept one."""
    kept, s = fresh("kept"), fresh("s")
    return (
        f"aggregate({ordered}, {NO_SPANS}, ({kept}, {s}) ->"
        f" CASE WHEN size({kept}) = 0 OR {s}.start >= element_at({kept}, -1).`end`"
        f" THEN concat({kept}, array({s})) ELSE {kept} END)"
    )


def overlap_clusters(ordered: str) -> str:
    """Cut ordered spans, at least one, into runs that share no character.

    Whatever compares spans pairwise works inside one run, so a text with very
    many spans stays cheap.
    """
    x, i, h, k = fresh("x"), fresh("i"), fresh("h"), fresh("k")

    def cut(s: str) -> str:
        def runs(heads: str) -> str:
            upto = f"coalesce(get({heads}, {k} + 1), size({s}))"
            return f"transform({heads}, ({h}, {k}) -> slice({s}, {h} + 1, {upto} - {h}))"

        return running(
            f"transform({s}, {x} -> {x}.`end`)", "0", lambda a, e: f"greatest({a}, {e})",
            lambda before: let(
                f"filter(sequence(0, size({s}) - 1), {i} -> {s}[{i}].start >= {before(i)})", runs, "heads"
            ),
        )

    return let(ordered, cut, "ordered")


def resolve(spans: str, labels: Mapping[str, str] | None = None) -> str:
    """From raw spans (labels) to non-overlapping entities (categories)."""

    def settle(run: str) -> str:
        distinct = f"CASE WHEN size({run}) > 1 THEN {drop_contained(run)} ELSE {run} END"
        return keep_earliest(drop_blocked(rename_labels(distinct, labels)))

    several = lambda raw: f"flatten({each(overlap_clusters(in_reading_order(raw)), settle)})"
    return let(
        spans,
        lambda raw: f"CASE WHEN size({raw}) = 0 THEN {NO_SPANS}"
        f" WHEN size({raw}) = 1 THEN {drop_blocked(rename_labels(raw, labels))}"
        f" ELSE {several(raw)} END",
        "raw",
    )


def entities_sql(
    text: str,
    rules: Sequence[Rule] | None = None,
    min_score: float = fixed.MIN_SCORE,
    labels: Mapping[str, str] | None = None,
    extra_spans: str | None = None,
) -> str:
    """The full detector as SQL text: an array of entities of ``text``."""

    def found(t: str) -> str:
        union = spans_of(t, default_rules() if rules is None else list(rules))
        if extra_spans is not None:
            union = f"concat({union}, coalesce(cast({extra_spans} AS array<{SPAN}>), {NO_SPANS}))"
        return f"CASE WHEN {is_blank(t)} THEN {NO_SPANS} ELSE {resolve(at_least(union, min_score), labels)} END"

    return let(text, found, "text")


def detect(
    df: DataFrame,
    text: str = "text",
    into: str = "entities",
    rules: Sequence[Rule] | None = None,
    min_score: float = fixed.MIN_SCORE,
    labels: Mapping[str, str] | None = None,
    extra_spans: str | None = None,
    detector: Detector | None = None,
) -> DataFrame:
    """Add the entities of column ``text`` as an array column.

    ``extra_spans`` names an array column of further candidates (see the
    mention dictionary).  ``detector`` replaces the rules by any function from
    the text Column to an array of spans, for example a ``pandas_udf``.
    """
    if detector is None:
        return df.withColumn(into, F.expr(entities_sql(f"`{text}`", rules, min_score, labels, extra_spans)))
    supplied = df.withColumn(into, detector(F.col(text)).cast(f"array<{SPAN}>"))
    return supplied.withColumn(into, F.expr(entities_sql(f"`{text}`", [], min_score, labels, f"`{into}`")))


def explode_entities(df: DataFrame, entities: str = "entities", drop: Sequence[str] = ()) -> DataFrame:
    """One row per entity; rows without entities vanish.

    The outer form plus a filter, because for the inner form the optimizer
    adds a size test below the projection and so runs the detector twice.
    """
    kept = [c for c in df.columns if c != entities and c not in drop]
    return df.select(*kept, F.inline_outer(entities)).where(F.col("start").isNotNull())
