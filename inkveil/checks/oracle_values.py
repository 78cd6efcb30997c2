"""Replacement values restated for the single-node engine."""

from __future__ import annotations

from inkveil.functions import bijection, fixed_values as fixed
from inkveil.functions.columns import quotes
from inkveil.functions.replacements import DEFAULT_SALT


def _n(slot: int) -> str:
    return f"CAST('0x' || substr(h, {8 * slot + 1}, 8) AS BIGINT)"


def _pick(slot: int, values: tuple[str, ...]) -> str:
    return f"[{quotes(values)}][{_n(slot)} % {len(values)} + 1]"


def _digits(slot: int, n: int) -> str:
    return f"lpad(CAST({_n(slot)} % {10 ** n} AS VARCHAR), {n}, '0')"


def _range(slot: int, low: int, high: int) -> str:
    return f"CAST({low} + {_n(slot)} % {high - low + 1} AS VARCHAR)"


_MOBILE = f"('+91 ' || substr('6789', {_n(0)} % 4 + 1, 1) || {_digits(1, 9)})"
_BODY = f"('4' || {_digits(0, 7)} || {_digits(1, 7)})"
_LUHN_SUM = (
    f"list_sum(list_transform(range(15), lambda i: list_extract([0,2,4,6,8,1,3,5,7,9,0,1,2,3,4,5,6,7,8,9],"
    f" CAST(substr({_BODY}, i + 1, 1) AS INT) + 1 + CASE WHEN i % 2 = 0 THEN 0 ELSE 10 END)))"
)

VALUES = {
    "PERSON": f"{_pick(0, fixed.FIRST_NAMES)} || ' ' || {_pick(1, fixed.LAST_NAMES)}",
    "ORGANIZATION": f"{_pick(0, fixed.COMPANY_STEMS)} || ' ' || {_pick(1, fixed.COMPANY_NOUNS)} || ' ' || {_pick(2, fixed.COMPANY_ENDINGS)}",
    "EMAIL": f"lower({_pick(0, fixed.FIRST_NAMES)} || '.' || {_pick(1, fixed.LAST_NAMES)}) || {_digits(2, 3)} || '@' || {_pick(3, fixed.SAFE_MAIL_DOMAINS)}",
    "PHONE": (
        f"CASE WHEN regexp_matches(c, '^(?:\\+91|091)') OR (starts_with(c, '91') AND length(c) >= 12) THEN {_MOBILE}"
        f" WHEN starts_with(c, '0') AND length(c) >= 8 AND length(c) <= 12 THEN"
        f" (CASE WHEN c[1:3] IN ({quotes(fixed.KNOWN_STD_CODES)}) THEN c[1:3] ELSE '020' END) || '-' || {_digits(2, 8)}"
        f" WHEN length(c) = 10 AND c[1:1] IN ('6', '7', '8', '9') THEN {_MOBILE}"
        f" WHEN starts_with(c, '1800') THEN '1800-' || {_digits(3, 3)} || '-' || {_digits(4, 3)}"
        f" WHEN regexp_matches(c, '^\\+[0-9]') THEN regexp_extract(c, '^(\\+[0-9]{{1,3}})', 1) || ' ' || {_digits(5, 5)} || {_digits(6, 5)}"
        f" ELSE {_MOBILE} END"
    ),
    "SSN": f"lpad({_range(0, 1, 665)}, 3, '0') || '-' || lpad({_range(1, 1, 99)}, 2, '0') || '-' || lpad({_range(2, 1, 9999)}, 4, '0')",
    "CREDIT_CARD": f"{_BODY} || CAST((10 - {_LUHN_SUM} % 10) % 10 AS VARCHAR)",
    "IP_ADDRESS": (
        f"CASE {_n(0)} % 3 WHEN 0 THEN '10.' || {_range(1, 0, 255)} WHEN 1 THEN '172.' || {_range(1, 16, 31)} ELSE '192.168' END"
        f" || '.' || {_range(2, 0, 255)} || '.' || {_range(3, 1, 254)}"
    ),
    "DATE_OF_BIRTH": f"strftime(DATE '2006-01-01' - CAST({_n(0)} % date_diff('day', DATE '1943-01-01', DATE '2006-01-01') AS INT), '%d/%m/%Y')",
    "ADDRESS": (
        f"{_range(0, 1, 999)} || ' ' || {_pick(1, fixed.STREET_STEMS)} || ' ' || {_pick(2, fixed.STREET_KINDS)}"
        f" || ', ' || {_pick(3, fixed.TOWNS)} || ' ' || {_digits(4, 5)}"
    ),
}


def replaced(source: str = "ents", out: str = "named", salt: str = DEFAULT_SALT, masked: bool = False) -> str:
    """CTEs that add ``replacement`` to the entities."""
    if masked:
        return f"{out} AS (SELECT *, '{fixed.MASK}' AS replacement FROM {source})"
    cases = " ".join(f"WHEN '{category}' THEN {value}" for category, value in VALUES.items())
    return (
        f"{out}_h AS (SELECT *, sha256(concat_ws('|', '{salt}', category, v)) AS h,"
        f" regexp_replace(v, '[\\s().-]+', '', 'g') AS c FROM {source}),"
        f" {out} AS MATERIALIZED (SELECT * EXCLUDE (h, c), CASE category {cases} ELSE '{fixed.MASK}' END AS replacement FROM {out}_h)"
    )


def _permuted_rounds(salt: str) -> list[str]:
    """CTEs ``round0`` to ``round8``: one round of the permutation each, on parts ``l`` and ``r``."""
    steps = []
    for i in range(bijection.ROUNDS):
        own, other, size = ("l", "r", "ls") if i % 2 == 0 else ("r", "l", "rs")
        added = f"CAST('0x' || substr(sha256(concat_ws('|', '{salt}', tweak, {i}, {other})), 1, 15) AS BIGINT)"
        steps.append(f"round{i + 1} AS MATERIALIZED (SELECT * REPLACE (({own} + {added} % {size}) % {size} AS {own}) FROM round{i})")
    return steps


def distinct_numbers(source: str = "named", out: str = "permuted", salt: str = DEFAULT_SALT) -> str:
    """CTEs that add ``distinct_replacement`` to entities with SSN, card and phone numbers (other rows are left out)."""
    ten = "CAST(power(10, {}) AS BIGINT)".format
    kept = (
        "CASE WHEN category = 'CREDIT_CARD' THEN 1 WHEN regexp_matches(v, '^[^0-9]*[+]') THEN"
        " CASE WHEN regexp_matches(v, '^[^0-9]*[+][^0-9]*[0-9]{1,3}[^0-9]')"
        " THEN length(regexp_extract(v, '^[^0-9]*[+][^0-9]*([0-9]{1,3})[^0-9]', 1)) ELSE 2 END"
        " WHEN length(d) = 12 THEN 2 WHEN d LIKE '0%' THEN CASE WHEN length(d) >= 9 THEN 3 ELSE 1 END"
        " WHEN d LIKE '1%' THEN CASE WHEN length(d) >= 10 THEN 4 ELSE 1 END ELSE 0 END"
    )
    area = "CAST(substr(v, 1, 3) AS BIGINT)"
    luhn = (
        "list_sum(list_transform(range(1, length(body2) + 1), lambda i: list_extract([0,2,4,6,8,1,3,5,7,9,0,1,2,3,4,5,6,7,8,9],"
        " CAST(substr(body2, length(body2) + 1 - i, 1) AS INT) + 1 + CASE WHEN i % 2 = 1 THEN 0 ELSE 10 END)))"
    )
    in_place = (
        "list_reduce(list_prepend('', list_transform(range(1, length(v) + 1), lambda i: CASE WHEN regexp_matches(substr(v, i, 1), '[0-9]')"
        " THEN substr(d2, length(regexp_replace(substr(v, 1, i), '[^0-9]', '', 'g')), 1) ELSE substr(v, i, 1) END)), lambda x, y: x || y)"
    )
    return ", ".join([
        f"digits AS (SELECT DISTINCT category, v, replacement, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM {source} WHERE category IN ('SSN', 'CREDIT_CARD', 'PHONE'))",
        "bodies AS (SELECT *, CASE WHEN category = 'CREDIT_CARD' THEN substr(d, 1, length(d) - 1) ELSE d END AS body, " + kept + " AS kept FROM digits)",
        "rests AS (SELECT *, substr(body, kept + 1) AS rest FROM bodies)",
        "sides AS (SELECT *, CASE WHEN rest >= '6' THEN 6 WHEN kept = 0 THEN 2 ELSE 0 END AS low,"
        " CASE WHEN rest >= '6' OR kept = 0 THEN 4 ELSE 6 END AS size, length(rest) // 2 AS tail, length(rest) - length(rest) // 2 AS half FROM rests)",
        "round0 AS MATERIALIZED (SELECT *,"
        f" CASE WHEN category = 'SSN' THEN ({area} - 1 - CASE WHEN {area} > 666 THEN 1 ELSE 0 END) * 99 + CAST(substr(v, 5, 2) AS BIGINT) - 1"
        f" ELSE CAST(substr(rest, 1, half) AS BIGINT) - low * {ten('half - 1')} END AS l,"
        " CASE WHEN category = 'SSN' THEN CAST(substr(v, 8, 4) AS BIGINT) - 1 ELSE coalesce(TRY_CAST(substr(rest, half + 1) AS BIGINT), 0) END AS r,"
        f" CASE WHEN category = 'SSN' THEN 998 * 99 ELSE size * {ten('half - 1')} END AS ls,"
        f" CASE WHEN category = 'SSN' THEN 9999 ELSE {ten('tail')} END AS rs,"
        " CASE category WHEN 'SSN' THEN 'SSN' ELSE concat_ws('|', CASE category WHEN 'PHONE' THEN 'PHONE' ELSE 'CARD' END,"
        " substr(body, 1, kept), low, length(rest)) END AS tweak FROM sides)",
        *_permuted_rounds(salt),
        "joined AS (SELECT *, substr(body, 1, kept) || lpad(CAST(l + low * " + ten("half - 1") + " AS VARCHAR), half::INT, '0')"
        f" || CASE WHEN tail > 0 THEN lpad(CAST(r AS VARCHAR), tail::INT, '0') ELSE '' END AS body2 FROM round{bijection.ROUNDS})",
        f"checked AS (SELECT *, CASE WHEN category = 'CREDIT_CARD' THEN body2 || CAST((10 - {luhn} % 10) % 10 AS VARCHAR) ELSE body2 END AS d2 FROM joined)",
        f"{out} AS MATERIALIZED (SELECT *, CASE WHEN category = 'SSN' THEN lpad(CAST(l // 99 + 1 + CASE WHEN l // 99 + 1 >= 666 THEN 1 ELSE 0 END AS VARCHAR), 3, '0')"
        " || '-' || lpad(CAST(l % 99 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(r + 1 AS VARCHAR), 4, '0')"
        f" WHEN category = 'PHONE' AND (length(d) < 6 OR length(d) > 18) THEN replacement ELSE {in_place} END AS distinct_replacement FROM checked)",
    ])


REDACTED = (
    "gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY src, id, para ORDER BY s), 0) AS before FROM named),"
    " stitched AS (SELECT g.src, g.id, g.para, string_agg(substr(t.text, g.before + 1, g.s - g.before) || g.replacement, ''"
    " ORDER BY g.s) AS head, max(g.e) AS upto FROM gaps g JOIN texts t ON g.src = t.src AND g.id = t.id AND g.para = t.para"
    " GROUP BY ALL),"
    " redacted AS MATERIALIZED (SELECT t.src, t.id, t.para, t.text, coalesce(r.head || substr(t.text, r.upto + 1), t.text) AS redacted"
    " FROM texts t LEFT JOIN stitched r ON t.src = r.src AND t.id = r.id AND t.para = r.para)"
)

CHAINED = (
    "steps AS (SELECT *, row_number() OVER (PARTITION BY src, id, para ORDER BY length(v) DESC, s) AS k FROM named),"
    " chain(src, id, para, k, text) AS (SELECT t.src, t.id, t.para, CAST(0 AS BIGINT), t.text FROM texts t"
    " UNION ALL SELECT c.src, c.id, c.para, s.k, replace(c.text, s.v, s.replacement) FROM chain c JOIN steps s"
    " ON c.src = s.src AND c.id = s.id AND c.para = s.para AND s.k = c.k + 1),"
    " chained AS (SELECT src, id, para, arg_max(text, k) AS redacted FROM chain GROUP BY ALL)"
)
