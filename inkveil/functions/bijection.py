"""Replacements of numbers that never meet: a keyed bijection on digits.

Hashing draws replacements, and drawn values collide: among some hundred
thousand numbers two share a replacement.  Here the digits of a number are
permuted instead, by a Feistel network whose rounds are keyed by the salt:
the number is cut into two parts, and each round adds to one part a hash of
the other.  Every round can be taken back, so different numbers have different
replacements, and who holds the salt can restore the original.

The ranges of the parts are products of what each position may hold, so the
result needs no walk through invalid numbers:

* SSN: areas that exist, groups 01 to 99, serials 0001 to 9999;
* cards: length, separators and first digit stay, the Luhn digit is computed;
* phones: separators, number of digits and prefix stay (country code, trunk and
  area digits, 1800), and so does whether the first digit behind is below 6.

Expressions give NULL for what is no such number: an impossible SSN, a card
with a wrong Luhn digit, digits of another script.
"""

from __future__ import annotations

from collections.abc import Callable

from inkveil.functions import fixed_values as fixed
from inkveil.functions.columns import fresh, let, quote
from inkveil.functions.validators import valid_card, valid_ssn

ROUNDS = 8
GROUPS, SERIALS = 99, 9999


def _permuted(left: str, right: str, lefts: str, rights: str, tweak: str, salt: str, inverse: bool) -> str:
    """SQL for ``struct(l, r)``: two parts below ``lefts`` and ``rights`` after all rounds, or before them."""
    state, i = fresh("state"), fresh("i")

    def moved(own: str, other: str, size: str) -> str:
        hashed = f"sha2(concat_ws('|', {quote(salt)}, {tweak}, {i}, {state}.{other}), 256)"
        step = f"cast(conv(substring({hashed}, 1, 15), 16, 10) AS BIGINT) % {size}"
        return f"pmod({state}.{own} {'-' if inverse else '+'} {step}, {size})"

    rounds = f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"
    return (
        f"aggregate({rounds}, named_struct('l', cast({left} AS BIGINT), 'r', cast({right} AS BIGINT)), ({state}, {i}) ->"
        f" CASE WHEN {i} % 2 = 0 THEN named_struct('l', {moved('l', 'r', lefts)}, 'r', {state}.r)"
        f" ELSE named_struct('l', {state}.l, 'r', {moved('r', 'l', rights)}) END)"
    )


def _number(digits: str) -> str:
    return f"coalesce(try_cast({digits} AS BIGINT), 0L)"


def _power(n: str) -> str:
    return f"cast(power(10, {n}) AS BIGINT)"


def _padded(number: str, width: str) -> str:
    return f"lpad(cast({number} AS STRING), {width}, '0')"


def _digits_only(original: str) -> str:
    return f"regexp_replace({original}, '[^0-9]', '')"


def _plain(original: str) -> str:
    """All digits are ASCII ones."""
    return f"NOT regexp_replace({original}, '[0-9]', '') RLIKE {quote(r'\p{Nd}')}"


def _in_place(original: str, digits: str) -> str:
    """The original with its digits exchanged for as many others."""

    def joined(between: str) -> str:
        i = fresh("i")
        return f"array_join(transform({between}, ({i}_s, {i}) -> concat({i}_s, substring({digits}, {i} + 1, 1))), '')"

    return let(f"split({original}, '[0-9]', -1)", joined, "between")


def _rest_permuted(digits: str, kept: str, tweak: str, salt: str, inverse: bool) -> str:
    """``digits`` with those behind the first ``kept`` permuted; the first of them stays on its side of 6."""

    def of_rest(rest: str) -> str:
        half = f"(length({rest}) - length({rest}) DIV 2)"
        tail = f"(length({rest}) DIV 2)"
        unit = _power(f"{half} - 1")
        # Without a kept prefix 0 and 1 begin no number, so that prefixes are told alike before and after.
        low = f"CASE WHEN {rest} >= '6' THEN 6 WHEN {kept} = 0 THEN 2 ELSE 0 END"
        size = f"CASE WHEN {rest} >= '6' OR {kept} = 0 THEN 4 ELSE 6 END"
        left = f"{_number(f'substring({rest}, 1, {half})')} - ({low}) * {unit}"
        moved = _permuted(
            left, _number(f"substring({rest}, {half} + 1, {tail})"), f"(({size}) * {unit})", _power(tail),
            f"concat_ws('|', {tweak}, substring({digits}, 1, {kept}), {low}, length({rest}))", salt, inverse,
        )
        return let(
            moved,
            lambda m: f"concat(substring({digits}, 1, {kept}), {_padded(f'{m}.l + ({low}) * {unit}', half)},"
            f" CASE WHEN {tail} > 0 THEN {_padded(f'{m}.r', tail)} ELSE '' END)",
            "moved",
        )

    return let(f"substring({digits}, {kept} + 1)", of_rest, "rest")


def ssn(original: str, salt: str, inverse: bool = False) -> str:
    impossible = sorted(map(int, fixed.SSN_IMPOSSIBLE_AREAS))
    areas = 1000 - len(impossible)

    def skipped(area: str) -> str:
        return f"{area} - ({' + '.join(f'cast({area} > {x} AS INT)' for x in impossible)})"

    def restored(index: str) -> str:
        # Impossible areas in rising order: each at or below the running value moves it on.
        value = index
        for x in impossible:
            value = let(value, lambda v, x=x: f"{v} + cast({v} >= {x} AS INT)", "area")
        return value

    def of_valid(v: str) -> str:
        area = f"cast(substring({v}, 1, 3) AS BIGINT)"
        left = f"({skipped(area)}) * {GROUPS} + cast(substring({v}, 5, 2) AS BIGINT) - 1"
        moved = _permuted(left, f"cast(substring({v}, 8, 4) AS BIGINT) - 1", f"{areas * GROUPS}L", f"{SERIALS}L", "'SSN'", salt, inverse)
        return let(
            moved,
            lambda m: f"concat_ws('-', {_padded(restored(f'{m}.l DIV {GROUPS}'), '3')},"
            f" {_padded(f'{m}.l % {GROUPS} + 1', '2')}, {_padded(f'{m}.r + 1', '4')})",
            "moved",
        )

    made = let(f"trim({original})", of_valid, "ssn")
    return f"CASE WHEN {valid_ssn(original)} AND {_plain(original)} THEN {made} END"


def credit_card(original: str, salt: str, inverse: bool = False) -> str:
    def with_check_digit(body: str) -> str:
        total, i = fresh("total"), fresh("i")
        digit = f"cast(substring({body}, -{i}, 1) AS INT)"
        doubled = f"(2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END)"
        luhn = (
            f"aggregate(sequence(1, length({body})), 0, ({total}, {i}) ->"
            f" {total} + CASE WHEN {i} % 2 = 1 THEN {doubled} ELSE {digit} END)"
        )
        return f"concat({body}, cast((10 - {luhn} % 10) % 10 AS STRING))"

    def of_digits(digits: str) -> str:
        body = f"substring({digits}, 1, length({digits}) - 1)"
        made = let(body, lambda b: let(_rest_permuted(b, "1", "'CARD'", salt, inverse), with_check_digit, "body"), "given")
        return let(made, lambda d: _in_place(original, d), "made")

    return f"CASE WHEN {valid_card(original)} AND {_plain(original)} THEN {let(_digits_only(original), of_digits, 'digits')} END"


def phone(original: str, salt: str, inverse: bool = False) -> str:
    """Numbers of fewer than six digits have no replacement."""

    def of_digits(digits: str) -> str:
        n = f"length({digits})"
        # A country code ends at the first separator, if that comes within three digits.
        country = f"length(regexp_extract({original}, {quote(r'^[^0-9]*[+][^0-9]*([0-9]{1,3})[^0-9]')}, 1))"
        kept = (
            f"CASE WHEN {original} RLIKE {quote(r'^[^0-9]*[+]')} THEN CASE WHEN {country} > 0 THEN {country} ELSE 2 END"
            f" WHEN {n} = 12 THEN 2"
            f" WHEN {digits} LIKE '0%' THEN CASE WHEN {n} >= 9 THEN 3 ELSE 1 END"
            f" WHEN {digits} LIKE '1%' THEN CASE WHEN {n} >= 10 THEN 4 ELSE 1 END"
            f" ELSE 0 END"
        )
        made = let(kept, lambda k: _rest_permuted(digits, k, "'PHONE'", salt, inverse), "kept")
        return f"CASE WHEN {n} BETWEEN 6 AND 18 THEN {let(made, lambda d: _in_place(original, d), 'made')} END"

    return f"CASE WHEN {_plain(original)} THEN {let(_digits_only(original), of_digits, 'digits')} END"


NUMBERS: dict[str, Callable[..., str]] = {"SSN": ssn, "CREDIT_CARD": credit_card, "PHONE": phone}


def original_of(entity_type: str, replacement: str, salt: str) -> str:
    """SQL for the number that a distinct replacement stands for; NULL for other categories."""
    cases = " ".join(f"WHEN {quote(c)} THEN {made(replacement, salt, inverse=True)}" for c, made in NUMBERS.items())
    return f"CASE {entity_type} {cases} END"
