"""Pieces of Spark SQL text shared by the other modules.

Expressions are built as SQL text and parsed once by ``F.expr``: the full
detector has some thousand nodes, and one parse is far cheaper on the driver
than thousands of calls through the Python gateway.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

SPAN = "struct<entity_type:string,original_text:string,start:int,end:int,score:double>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"

_numbers = count()


def fresh(stem: str) -> str:
    """A lambda variable name that no enclosing lambda uses."""
    return f"{stem}_{next(_numbers)}"


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quotes(values: Sequence[str]) -> str:
    return ", ".join(quote(v) for v in values)


def let(value: str, body: Callable[[str], str], stem: str = "v") -> str:
    """Name ``value`` inside ``body`` so that it is evaluated once per row.

    ``withColumn`` does this for top-level expressions; inside a lambda over
    an array there is no projection to hang the value on.  The fold of an empty
    array takes the value as its start and hands it to the last function: no
    array is made, nothing is copied, and no type is derived anew for each row,
    as reading an element of a ``transform`` does through all nested ones.
    """
    name, start, none = fresh(stem), fresh("start"), fresh("none")
    return f"aggregate(array(), {value}, ({start}, {none}) -> {start}, {name} -> {body(name)})"


def each(items: str, body: Callable[[str], str], function: str = "transform", stem: str = "x") -> str:
    """``transform``, ``filter``, ``exists`` or ``forall`` with a fresh name."""
    name = fresh(stem)
    return f"{function}({items}, {name} -> {body(name)})"


def is_blank(text: str) -> str:
    return f"({text} IS NULL OR NOT {text} RLIKE {quote(r'(?U)\S')})"


# Running totals are looked up per block of 2 ** BLOCK_BITS items.
BLOCK_BITS = 7


def running(values: str, zero: str, step: Callable[[str, str], str], body: Callable[[Callable[[str], str]], str]) -> str:
    """SQL of ``body(before)``, where ``before(i)`` folds the values in front
    of index ``i``.

    ``values`` must not be empty.  Folding an array into a growing array
    would copy it at every step; here only numbers are folded: once per
    block, and for one item over no more than its own block.
    """

    def fold(items: str, start: str) -> str:
        acc, x = fresh("acc"), fresh("x")
        return f"aggregate({items}, {start}, ({acc}, {x}) -> {step(acc, x)})"

    def blocks(v: str) -> str:
        b = fresh("b")
        block = f"slice({v}, shiftleft({b}, {BLOCK_BITS}) + 1, {1 << BLOCK_BITS})"
        return f"transform(sequence(0, shiftright(size({v}) - 1, {BLOCK_BITS})), {b} -> {fold(block, zero)})"

    def offsets(totals: str) -> str:
        t, b = fresh("t"), fresh("b")
        return f"transform({totals}, ({t}, {b}) -> {fold(f'slice({totals}, 1, {b})', zero)})"

    def with_values(v: str) -> str:
        def with_offsets(o: str) -> str:
            def before(i: str) -> str:
                own = f"slice({v}, shiftleft(shiftright({i}, {BLOCK_BITS}), {BLOCK_BITS}) + 1, {i} & {(1 << BLOCK_BITS) - 1})"
                return fold(own, f"{o}[shiftright({i}, {BLOCK_BITS})]")

            return body(before)

        # Most arrays are one block, which begins at ``zero``.
        starts = f"CASE WHEN size({v}) <= {1 << BLOCK_BITS} THEN array({zero}) ELSE {let(blocks(v), offsets, 'totals')} END"
        return let(starts, with_offsets, "offsets")

    return let(values, with_values, "values")


# A long text is cut into segments of 2 ** SEGMENT_BITS characters.
SEGMENT_BITS = 10
LONG_TEXT = 4096


def segments(text: str) -> str:
    """``text`` as an array of equal segments, or as one element if short.

    A position in a string is found by walking to it, so asking a long text
    for many places would cost its length each time.
    """
    pattern = quote(f"(?s).{{1,{1 << SEGMENT_BITS}}}")
    return f"CASE WHEN length({text}) > {LONG_TEXT} THEN regexp_extract_all({text}, {pattern}, 0) ELSE array({text}) END"


def cut(parts: str, start: str, length: str) -> str:
    """``substring`` of the text whose ``segments`` are ``parts``; ``start`` is 0-based."""
    first = f"shiftright({start}, {SEGMENT_BITS})"
    covering = f"slice({parts}, {first} + 1, shiftright({start} + {length}, {SEGMENT_BITS}) - {first} + 1)"
    return (
        f"CASE WHEN size({parts}) = 1 THEN substring({parts}[0], {start} + 1, {length})"
        f" ELSE substring(array_join({covering}, ''), ({start} & {(1 << SEGMENT_BITS) - 1}) + 1, {length}) END"
    )
