"""Checks on a matched value, as SQL conditions over SQL operands."""

from __future__ import annotations

from inkveil.functions import fixed_values as fixed
from inkveil.functions.columns import cut, each, let, quote, quotes


def valid_ssn(value: str) -> str:
    """An SSN whose area, group and serial can have been issued."""
    return let(
        f"trim({value})",
        lambda v: f"({v} RLIKE {quote(r'(?U)^\d{3}-\d{2}-\d{4}$')}"
        f" AND substring({v}, 1, 3) NOT IN ({quotes(fixed.SSN_IMPOSSIBLE_AREAS)})"
        f" AND substring({v}, 5, 2) <> '00' AND substring({v}, 8, 4) <> '0000')",
    )


def valid_card(value: str) -> str:
    """13 to 19 digits, blanks and hyphens aside, with a right Luhn digit."""
    shape = f"^[0-9]{{{fixed.CARD_MIN_DIGITS},{fixed.CARD_MAX_DIGITS}}}$"
    return let(
        f"regexp_replace({value}, {quote(r'(?U)[\s\-]')}, '')",
        lambda v: f"({v} RLIKE {quote(shape)} AND luhn_check({v}))",
    )


def valid_ipv4(value: str) -> str:
    """Four dot-joined numbers, none above 255; leading zeros are accepted."""
    return let(
        f"split(trim({value}), {quote('\\.')}, -1)",
        lambda parts: f"(size({parts}) = 4 AND "
        + each(parts, lambda p: f"coalesce(try_cast({p} AS INT) BETWEEN 0 AND 255, false)", "forall")
        + ")",
    )


def plausible_person(value: str) -> str:
    """At least two words, none of them a title or field word."""
    return let(
        f"split(trim({value}), {quote(r'(?U)\s+')})",
        lambda words: f"(size({words}) >= 2 AND NOT "
        + each(words, lambda w: f"{w} IN ({quotes(fixed.PERSON_TITLE_WORDS)})", "exists")
        + ")",
    )


def near_birth_keyword(parts: str, start: str, end: str) -> str:
    """A birth keyword stands within reach of the span ``[start, end)`` of the
    text with segments ``parts``."""
    reach = fixed.BIRTH_KEYWORD_REACH
    keyword = r"(?iU)\b(?:" + "|".join(fixed.BIRTH_KEYWORDS) + r")\b"
    first = f"greatest({start} - {reach}, 0)"
    return f"{cut(parts, first, f'{end} + {reach} - {first}')} RLIKE {quote(keyword)}"


def short_acronym(value: str) -> str:
    """One upper-case token of at most six characters."""
    return (
        f"(length({value}) <= {fixed.ACRONYM_MAX_LENGTH} AND NOT trim({value}) RLIKE {quote(r'(?U)\s')}"
        f" AND upper({value}) = {value} AND lower({value}) <> {value})"
    )


def blocked_value(entity_type: str, value: str) -> str:
    """A PERSON or ORGANIZATION value that is a term or a short acronym."""
    shared = "|".join(fixed.NOT_A_NAME_TERMS)
    labels = "|".join(fixed.FIELD_LABEL_TERMS)
    person = quote(rf"(?iU)^\s*(?:{shared}|{labels})\s*$")
    organization = quote(rf"(?iU)^\s*(?:{shared})\s*$")
    return (
        f"CASE {entity_type} WHEN 'PERSON' THEN {value} RLIKE {person} OR {short_acronym(value)}"
        f" WHEN 'ORGANIZATION' THEN {value} RLIKE {organization} OR {short_acronym(value)} ELSE false END"
    )


def stripped(value: str) -> str:
    """``value`` without white space of any kind at its ends."""
    return f"regexp_replace({value}, {quote(r'(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$')}, '')"


def suspect_reason(value: str) -> str:
    """Why a detected value is likely no personal data; NULL if it may be."""
    cases = " ".join(
        f"WHEN {stripped(value)} RLIKE {quote(pattern)} THEN {quote(reason)}"
        for pattern, reason in fixed.SUSPECT_VALUES
    )
    return f"CASE {cases} END"
