"""Regex matches with their character offsets, and the words around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from inkveil.functions import fixed_values as fixed
from inkveil.functions.columns import cut, each, fresh, let, quote, quotes, running

WORD = r"[\p{L}\p{N}_]+"
# Letters that a case-insensitive match equates with ASCII ones but lower() does not.
ODD_CASE_LETTERS = ("ſ", "İ", "ı")


def dialect(pattern: str) -> str:
    """Case-insensitive with Unicode classes, as every rule is matched."""
    return "(?iU)" + pattern


def find_all(text: str, pattern: str) -> str:
    """All matched strings, left to right."""
    return f"regexp_extract_all({text}, {quote(pattern)}, 0)"


# Characters on either side of a match that are read for its context first.
NEAR = 200

# Stands between pieces while a text is cut; no assigned character.
CUT = "\uffff"


def pieces_between(text: str, pattern: str) -> str:
    """The text between the matches of ``pattern``, as an array.

    ``split`` compiles its pattern anew for every row, while
    ``regexp_replace`` keeps it and splitting at one plain character needs
    none.  A text that holds the cut character itself takes the slow way.
    """
    cut = quote(CUT)
    return (
        f"CASE WHEN contains({text}, {cut}) THEN split({text}, {quote(pattern)}, -1)"
        f" ELSE split(regexp_replace({text}, {quote(pattern)}, {cut}), {cut}, -1) END"
    )


def locate_all(text: str, pattern: str, found: str) -> str:
    """``value, start, end`` of each of ``found = find_all(text, pattern)``,
    which must not be empty.

    Splitting on the same pattern yields the text between the matches, so a
    match starts where the lengths of all earlier pieces end.  Searching for
    the matched string instead would also hit look-alikes that a
    look-around rejected.
    """
    gap, value, g, i = (fresh(stem) for stem in ("gap", "value", "g", "i"))

    def with_gaps(gaps: str) -> str:
        lengths = f"zip_with({gaps}, {found}, ({g}, {value}) -> {g} + length({value}))"

        def placed(before: Callable[[str], str]) -> str:
            def match(start: str) -> str:
                return f"named_struct('value', {value}, 'start', {start}, 'end', {start} + length({value}))"

            return f"transform({found}, ({value}, {i}) -> {let(f'{before(i)} + {gaps}[{i}]', match, 'start')})"

        return running(lengths, "0", lambda a, x: f"{a} + {x}", placed)

    def alone(start: str) -> str:
        return f"array(named_struct('value', {found}[0], 'start', {start}, 'end', {start} + length({found}[0])))"

    pieces = f"slice({pieces_between(text, pattern)}, 1, size({found}))"
    several = let(f"transform({pieces}, {gap} -> length({gap}))", with_gaps, "gaps")
    # One match, as most texts have, starts where the text before it ends.
    before = f"substring_index(regexp_replace({text}, {quote(pattern)}, {quote(CUT)}), {quote(CUT)}, 1)"
    return (
        f"CASE WHEN size({found}) = 1 AND NOT contains({text}, {quote(CUT)}) THEN {let(f'length({before})', alone, 'start')}"
        f" ELSE {several} END"
    )


def contains_any(lowered: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {quote(w)})" for w in words) + ")"


def words_around(parts: str, start: str) -> str:
    """Of the text with segments ``parts``: the last tokens before ``start`` and the first content token from
    ``start`` on, lower-case and joined by blanks.

    A context word hits when it is part of a token.  Tokens hold no blanks,
    so searching the joined words is the same, and context words with blanks
    can never hit.

    Most windows lie within ``NEAR`` characters.  A token at the edge of such a
    piece may be cut, so a piece counts only if it holds one token more than
    needed; else all of that side of the text is read.
    """
    keep = fixed.CONTEXT_TOKENS_BEFORE

    def tokens(first: str, length: str) -> str:
        return find_all(f"lower({cut(parts, first, length)})", WORD)

    def content(words: str) -> str:
        return each(words, lambda w: f"{w} NOT IN ({quotes(fixed.STOP_WORDS)})", "filter")

    first = f"greatest({start} - {NEAR}, 0)"
    before = let(
        tokens(first, f"{start} - {first}"),
        lambda b: f"CASE WHEN {start} <= {NEAR} OR size({b}) > {keep} THEN {b} ELSE {tokens('0', start)} END",
    )
    nearest = let(before, lambda b: f"slice({b}, greatest(size({b}) - {keep - 1}, 1), {keep})")
    total = f"aggregate(transform({parts}, p_ -> length(p_)), 0, (a_, n_) -> a_ + n_)"
    ends = f"size({parts}) = 1 AND length({parts}[0]) <= {start} + {NEAR}"
    after = let(
        content(tokens(start, str(NEAR))),
        lambda a: f"CASE WHEN size({a}) > 1 OR {ends} THEN {a} ELSE {content(tokens(start, f'{total} - {start}'))} END",
    )
    return f"array_join(concat({nearest}, slice({after}, 1, 1)), ' ')"


def context_pattern(words: Sequence[str]) -> str:
    return "|".join(w for w in words if " " not in w)
