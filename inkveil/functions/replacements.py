"""Synthetic values as a pure function of (salt, category, original).

One keyed SHA-256 per value supplies eight independent 32-bit numbers.  Equal
inputs give equal replacements on every partition, run and stream, without a
registry; another salt gives another mapping.
"""

from __future__ import annotations

from inkveil.functions import bijection, fixed_values as fixed
from inkveil.functions.columns import each, fresh, let, quote, quotes

DEFAULT_SALT = "inkveil"
DEFAULT_AS_OF = "2024-01-01"


def digest(entity_type: str, original: str, salt: str = DEFAULT_SALT) -> str:
    return f"sha2(concat_ws('|', {quote(salt)}, {entity_type}, {original}), 256)"


def number(hashed: str, slot: int) -> str:
    """The ``slot``-th 32-bit number of a digest, slots 0 to 7."""
    return f"cast(conv(substring({hashed}, {8 * slot + 1}, 8), 16, 10) AS BIGINT)"


def pick(hashed: str, slot: int, values: tuple[str, ...]) -> str:
    return f"element_at(array({quotes(values)}), cast({number(hashed, slot)} % {len(values)} AS INT) + 1)"


def digits(hashed: str, slot: int, n: int) -> str:
    """``n`` decimal digits, leading zeros kept (n up to 9)."""
    return f"lpad(cast({number(hashed, slot)} % {10 ** n} AS STRING), {n}, '0')"


def between(hashed: str, slot: int, low: int, high: int) -> str:
    return f"cast({low} + {number(hashed, slot)} % {high - low + 1} AS STRING)"


def person(h: str) -> str:
    return f"concat({pick(h, 0, fixed.FIRST_NAMES)}, ' ', {pick(h, 1, fixed.LAST_NAMES)})"


def organization(h: str) -> str:
    words = pick(h, 0, fixed.COMPANY_STEMS), pick(h, 1, fixed.COMPANY_NOUNS), pick(h, 2, fixed.COMPANY_ENDINGS)
    return f"concat_ws(' ', {', '.join(words)})"


def email(h: str) -> str:
    """A neutral user name and domain; nothing of the original is kept."""
    first, last = pick(h, 0, fixed.FIRST_NAMES), pick(h, 1, fixed.LAST_NAMES)
    user = f"lower(concat({first}, '.', {last}, {digits(h, 2, 3)}))"
    return f"concat({user}, '@', {pick(h, 3, fixed.SAFE_MAIL_DOMAINS)})"


def phone(h: str, original: str) -> str:
    """A number of the same kind as the original, told by its prefix."""
    mobile = f"concat('+91 ', substring('6789', cast({number(h, 0)} % 4 AS INT) + 1, 1), {digits(h, 1, 9)})"

    def by_kind(c: str) -> str:
        code = f"CASE WHEN substring({c}, 1, 3) IN ({quotes(fixed.KNOWN_STD_CODES)}) THEN substring({c}, 1, 3) ELSE {quote(fixed.DEFAULT_STD_CODE)} END"
        country = f"regexp_extract({c}, {quote(r'^\+([0-9]{1,3})')}, 1)"
        return (
            f"CASE WHEN {c} LIKE '+91%' OR {c} LIKE '091%' OR ({c} LIKE '91%' AND length({c}) >= 12) THEN {mobile}"
            f" WHEN {c} LIKE '0%' AND length({c}) BETWEEN 8 AND 12 THEN concat({code}, '-', {digits(h, 2, 8)})"
            f" WHEN {c} RLIKE '^[6-9].{{9}}$' THEN {mobile}"
            f" WHEN {c} LIKE '1800%' THEN concat('1800-', {digits(h, 3, 3)}, '-', {digits(h, 4, 3)})"
            f" WHEN {country} <> '' THEN concat('+', {country}, ' ', {digits(h, 5, 5)}, {digits(h, 6, 5)})"
            f" ELSE {mobile} END"
        )

    return let(f"regexp_replace({original}, {quote(r'(?U)[\s\-().]+')}, '')", by_kind, "cleaned")


def ssn(h: str) -> str:
    """Areas 001 to 665, so the number always passes the validity check."""
    parts = between(h, 0, 1, 665), between(h, 1, 1, 99), between(h, 2, 1, 9999)
    return "concat_ws('-', " + ", ".join(f"lpad({p}, {w}, '0')" for p, w in zip(parts, (3, 2, 4))) + ")"


def credit_card(h: str) -> str:
    """Sixteen digits; the last one is the Luhn digit of the others."""

    def with_check_digit(body: str) -> str:
        total, i = fresh("total"), fresh("i")
        digit = f"cast(substring({body}, {i} + 1, 1) AS INT)"
        doubled = f"(2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END)"
        luhn = (
            f"aggregate(sequence(0, 14), 0, ({total}, {i}) ->"
            f" {total} + CASE WHEN {i} % 2 = 0 THEN {doubled} ELSE {digit} END)"
        )
        return f"concat({body}, cast((10 - {luhn} % 10) % 10 AS STRING))"

    return let(f"concat('4', {digits(h, 0, 7)}, {digits(h, 1, 7)})", with_check_digit, "body")


def ip_address(h: str) -> str:
    """An address of a private range; the last octet is 1 to 254."""
    second, third, last = between(h, 1, 0, 255), between(h, 2, 0, 255), between(h, 3, 1, 254)
    return (
        f"CASE {number(h, 0)} % 3 WHEN 0 THEN concat_ws('.', '10', {second}, {third}, {last})"
        f" WHEN 1 THEN concat_ws('.', '172', {between(h, 1, 16, 31)}, {third}, {last})"
        f" ELSE concat_ws('.', '192', '168', {third}, {last}) END"
    )


def birth_date(h: str, as_of: str = DEFAULT_AS_OF) -> str:
    """A date of birth aged 18 to 80 at ``as_of``."""
    youngest = f"add_months(DATE{quote(as_of)}, {-12 * fixed.BIRTH_AGE_MIN})"
    too_old = f"add_months(DATE{quote(as_of)}, {-12 * (fixed.BIRTH_AGE_MAX + 1)})"
    back = f"cast({number(h, 0)} % datediff({youngest}, {too_old}) AS INT)"
    return f"date_format(date_sub({youngest}, {back}), {quote(fixed.BIRTH_DATE_FORMAT)})"


def address(h: str) -> str:
    street = f"concat_ws(' ', {between(h, 0, 1, 999)}, {pick(h, 1, fixed.STREET_STEMS)}, {pick(h, 2, fixed.STREET_KINDS)})"
    return f"concat_ws(', ', {street}, concat_ws(' ', {pick(h, 3, fixed.TOWNS)}, {digits(h, 4, 5)}))"


def replacement(
    entity_type: str, original: str, salt: str = DEFAULT_SALT, as_of: str = DEFAULT_AS_OF, masked: bool = False,
    distinct: bool = False,
) -> str:
    """SQL for the replacement of one value; unknown categories are masked.

    ``distinct`` permutes the digits of SSN, cards and phones, so that different
    numbers never share a replacement (``functions/bijection.py``).
    """
    if masked:
        return quote(fixed.MASK)

    def by_category(h: str) -> str:
        made = {
            "PERSON": person(h),
            "ORGANIZATION": organization(h),
            "EMAIL": email(h),
            "PHONE": phone(h, original),
            "SSN": ssn(h),
            "CREDIT_CARD": credit_card(h),
            "IP_ADDRESS": ip_address(h),
            "DATE_OF_BIRTH": birth_date(h, as_of),
            "ADDRESS": address(h),
        }
        if distinct:
            made |= {c: f"coalesce({permuted(original, salt)}, {made[c]})" for c, permuted in bijection.NUMBERS.items()}
        cases = " ".join(f"WHEN {quote(category)} THEN {value}" for category, value in made.items())
        return f"CASE {entity_type} {cases} ELSE {quote(fixed.MASK)} END"

    return let(digest(entity_type, original, salt), by_category, "hashed")


def with_replacements(entities: str, **options) -> str:
    """Entities with their replacement as a sixth field."""
    return each(
        entities,
        lambda e: f"named_struct('entity_type', {e}.entity_type, 'original_text', {e}.original_text,"
        f" 'start', {e}.start, 'end', {e}.`end`, 'score', {e}.score, 'replacement',"
        f" {replacement(f'{e}.entity_type', f'{e}.original_text', **options)})",
    )
