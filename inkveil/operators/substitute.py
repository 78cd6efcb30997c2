"""Putting replacements into the text of one row (SQL text in, SQL text out).

``entities`` operands are arrays with a ``replacement`` field.
"""

from __future__ import annotations

from inkveil.functions.columns import cut, fresh, let, segments


def replace_chained(text: str, entities: str) -> str:
    """Replace every occurrence of each original, longest first.

    The output of one step is the input of the next, so a later, shorter
    original may rewrite an earlier replacement and undetected look-alikes
    change too.  This is the compatibility mode.
    """
    e, i, acc, p = fresh("e"), fresh("i"), fresh("acc"), fresh("p")
    pairs = (
        f"array_sort(transform({entities}, ({e}, {i}) -> named_struct('shorter', -length({e}.original_text),"
        f" 'place', {i}, 'original', {e}.original_text, 'replacement', {e}.replacement)))"
    )
    return (
        f"CASE WHEN size({entities}) > 0 THEN aggregate({pairs}, {text},"
        f" ({acc}, {p}) -> replace({acc}, {p}.original, {p}.replacement)) ELSE {text} END"
    )


def replace_exact(text: str, entities: str) -> str:
    """Replace the detected spans only; every other character stays."""
    e, i = fresh("e"), fresh("i")
    before = f"CASE WHEN {i} = 0 THEN 0 ELSE {entities}[{i} - 1].`end` END"

    def stitched(parts: str) -> str:
        gap = cut(parts, before, f"{e}.start - {before}")
        return f"array_join(transform({entities}, ({e}, {i}) -> concat({gap}, {e}.replacement)), '')"

    return (
        f"CASE WHEN size({entities}) > 0 THEN concat({let(segments(text), stitched, 'parts')},"
        f" substring({text}, element_at({entities}, -1).`end` + 1)) ELSE {text} END"
    )


MODES = {"exact": replace_exact, "chained": replace_chained}
