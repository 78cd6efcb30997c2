"""E-mail addresses in time linear in the text.

A regex tries every word boundary of a run such as ``a.a.a.a`` and reads on to
its end each time.  Here the text is cut at its ``@`` signs.  What stands before
a sign decides where an address begins, what follows decides where it ends, and
each piece is read once from either end.  The matches are those that the pattern
``EMAIL`` finds from left to right: an address begins at the first word boundary
of the characters before the sign that the address before it has not taken.

Whether that address was one depends on the one before it again.  For each sign
two answers are kept, for an earlier match and for none; such pairs of answers
compose, so blocks of them are folded as running totals are.
"""

from __future__ import annotations

from inkveil.functions import fixed_values as fixed
from inkveil.functions.columns import each, let, quote, running
from inkveil.functions.matching import dialect

_LOCAL, _DOMAIN = fixed.EMAIL.removeprefix(r"\b").split("@")
_RUN = quote(dialect(f"^{_LOCAL.removesuffix('+')}*+"))
_AFTER = quote(dialect(f"^{_DOMAIN}"))
_WORD_RUN, _OTHER_RUN = quote(r"(?U)^\w*+"), quote(r"(?U)^\W*+")
# Answers (without, with) an earlier match, as bits: the pair that passes the earlier one on.
_SAME = "2"


def _composed(first: str, then: str) -> str:
    """The pair of answers of ``then`` after ``first``."""

    def answer(bit: int) -> str:
        return f"(shiftright({then}, shiftright({first}, {bit}) & 1) & 1)"

    return f"({answer(0)} + 2 * {answer(1)})"


def _begin(piece: str, first: str) -> str:
    """The first word boundary of ``piece`` from ``first`` on; its length if there is none before its end."""
    rest = f"substring({piece}, {first} + 1)"
    inside = f"({first} > 0 AND substring({piece}, {first}, 1) RLIKE {quote(r'(?U)\w')})"
    skipped = f"CASE WHEN {inside} THEN regexp_extract({rest}, {_WORD_RUN}, 0) ELSE regexp_extract({rest}, {_OTHER_RUN}, 0) END"
    return f"({first} + length({skipped}))"


def email_matches(text: str) -> str:
    """SQL of ``value, start, end`` of each match of ``EMAIL`` in ``text``, which must hold an ``@``."""

    def found(parts: str) -> str:
        signs = f"sequence(1, size({parts}) - 1)"
        # How much of each piece an address that ends there takes.
        taken = f"transform({parts}, p_ -> length(regexp_extract(p_, {_AFTER}, 0)))"

        def with_taken(d: str) -> str:
            def sign(i: str) -> str:
                piece = f"{parts}[{i} - 1]"
                run = f"length({piece}) - length(regexp_extract(reverse({piece}), {_RUN}, 0))"

                def begins(first: str) -> str:
                    later = f"CASE WHEN {i} > 1 AND {d}[{i} - 1] > {first} THEN {_begin(piece, f'{d}[{i} - 1]')} ELSE z_ END"
                    return let(
                        _begin(piece, first),
                        lambda z: f"named_struct('n', length({piece}), 'd', {d}[{i}], 'none', {z}, 'some', {later.replace('z_', z)})",
                        "begin",
                    )

                return let(run, begins, "first")

            def with_signs(s: str) -> str:
                pairs = each(
                    s, lambda x: f"CASE WHEN {x}.d = 0 THEN 0 ELSE cast({x}.none < {x}.n AS int) + 2 * cast({x}.some < {x}.n AS int) END"
                )

                def with_matches(earlier) -> str:
                    def with_offsets(offset) -> str:
                        def match(i: str) -> str:
                            x = f"{s}[{i} - 1]"

                            def placed(was: str) -> str:
                                def value(begin: str) -> str:
                                    start = f"{offset(f'{i} - 1')} + {begin}"
                                    return (
                                        f"CASE WHEN {x}.d > 0 AND {begin} < {x}.n THEN named_struct("
                                        f"'value', concat(substring({parts}[{i} - 1], {begin} + 1), '@', substring({parts}[{i}], 1, {x}.d)),"
                                        f" 'start', {start}, 'end', {start} + {x}.n - {begin} + 1 + {x}.d) END"
                                    )

                                return let(f"CASE WHEN {was} = 1 THEN {x}.some ELSE {x}.none END", value, "begin")

                            return let(f"{earlier(f'{i} - 1')} & 1", placed, "was")

                        matches = each(signs, match)
                        return each(matches, lambda m: f"{m} IS NOT NULL", "filter")

                    return running(f"transform({parts}, p_ -> length(p_) + 1)", "0", lambda a, x: f"{a} + {x}", with_offsets)

                return running(pairs, _SAME, _composed, with_matches)

            return let(each(signs, sign), with_signs, "signs")

        return let(taken, with_taken, "taken")

    return let(f"split({text}, '@', -1)", found, "parts")
