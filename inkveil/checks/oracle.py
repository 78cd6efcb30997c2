"""The same results by another way, as SQL for a single-node engine.

The engine's regexes have no look-around and ASCII word boundaries, so every
rule is tried at each position of a text with an anchored pattern; what may
stand to the left is a condition on the text before, what may stand to the
right is an extra group.  Non-overlapping matches and entities are then picked
by recursion over ranked candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from inkveil.checks.derived import RECIPES
from inkveil.functions import fixed_values as fixed
from inkveil.functions.columns import quotes

D = r"\p{Nd}"
S = r"\s\x{0B}\x{85}\p{Z}"  # inside a class
SP = rf"[{S}]"
W = r"\p{L}\p{M}\p{Nd}\p{Pc}"  # inside a class
END = rf"(?:[^{W}]|$)"
NO_DIGIT = rf"(?:[^{D}]|$)"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def at(pattern: str) -> str:
    """The group-1 match of an anchored pattern at the current position."""
    return f"regexp_extract(rest, {_lit('(?i)^' + pattern)}, 1)"


def first_of(*found: str) -> str:
    return f"coalesce({', '.join(f'nullif({f}, {chr(39)}{chr(39)})' for f in found)}, '')"


PREV_WORD = f"regexp_matches(prev, {_lit(f'[{W}]')})"
PREV_DIGIT = f"regexp_matches(prev, {_lit(f'[{D}]')})"


@dataclass(frozen=True)
class Twin:
    """How a rule is re-stated: category, base score, raw prefilter, left
    condition, extraction, check on value ``v``, context words."""

    category: str
    score: float
    raw: str
    left: str
    value: str
    check: str = "true"
    context: tuple[str, ...] = ()
    validated: bool = False


_MONTH = rf"(?:{fixed.MONTH_NAMES})"
_NAME = rf"[A-Z][a-zA-Z]+(?:{SP}+[A-Z][a-zA-Z]+){{1,3}}"
_ORG_START = rf"[A-Z][A-Za-z&\-.]*(?:{SP}+[A-Z][A-Za-z&\-.]*){{0,5}}{SP}+"
_ORG_BOUND = "Limited|LLP|Corporation|Enterprises|Industries|Technologies|Solutions|Services|Holdings|Group|Associates|Consultants|Ventures|International"
_ORG = (
    rf"({_ORG_START}(?:Private{SP}+Limited|Pvt\.?{SP}*Ltd\.?|Public{SP}+Limited|Limited({END})|Ltd\.?|LLP({END})"
    rf"|Inc\.?|Corp\.?|(?:Corporation|Enterprises|Industries|Technologies|Solutions|Services|Holdings|Group"
    rf"|Associates|Consultants|Ventures|International)({END})))"
)
_DESIGNATION = fixed.DESIGNATION.replace(r"\s", SP)
_ROADS = f"(?:{fixed.STREET_ENDING})"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_DIGITS = f"regexp_replace(v, {_lit(f'[{S}-]')}, '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0"
    f" THEN CAST(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS INT)"
    f" ELSE (2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS INT)) % 10"
    f" + (2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS INT)) // 10 END)) % 10 = 0"
)
_PERSON = (
    f"NOT list_has_any(string_split_regex(trim(v), {_lit(SP + '+')}), [{quotes(fixed.PERSON_TITLE_WORDS)}])"
)
_BIRTH = (
    "regexp_matches(substr(text, greatest(s - 120, 0) + 1, s + length(v) + 120 - greatest(s - 120, 0)), "
    + _lit(rf"(?i)(?:^|[^{W}])(?:{'|'.join(k for k in fixed.BIRTH_KEYWORDS if k != 'age:')}){END}")
    + ") OR regexp_matches(substr(text, greatest(s - 120, 0) + 1, s + length(v) + 120 - greatest(s - 120, 0)), "
    + _lit(rf"(?i)(?:^|[^{W}])age:[{W}]")
    + ")"
)
_ORG_VALUE = (
    f"substr({at(_ORG)}, 1, length({at(_ORG)})"
    + "".join(f" - length(regexp_extract(rest, {_lit('(?i)^' + _ORG)}, {g}))" for g in (2, 3, 4))
    + ")"
)

TWINS = {
    "email": Twin(
        "EMAIL", 0.95, "@", f"{PREV_WORD} <> regexp_matches(substr(rest, 1, 1), {_lit(f'[{W}]')})",
        at(rf"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}){END}"), context=fixed.EMAIL_CONTEXT,
    ),
    "phone_india": Twin(
        "PHONE", 0.95, rf"91[^{W}]*\(?{D}", f"NOT ({PREV_WORD} AND starts_with(rest, '9'))",
        at(rf"((?:\+{SP}*91|091|91)[{S}\-]*(?:\(?{D}{{2,4}}\)?[{S}\-]*)?{D}{{3,5}}[{S}\-]?{D}{{4,5}}){END}"),
        context=fixed.PHONE_CONTEXT,
    ),
    "phone_std": Twin(
        "PHONE", 0.85, rf"0{D}{{2,4}}[{S}\-]{D}{{6}}", f"NOT {PREV_WORD}",
        at(rf"(0{D}{{2,4}}[{S}\-]{D}{{6,8}}){END}"), context=fixed.PHONE_CONTEXT,
    ),
    "phone_mobile": Twin(
        "PHONE", 0.65, rf"[6-9]{D}{{9}}", f"NOT {PREV_DIGIT}", at(rf"([6-9]{D}{{9}}){NO_DIGIT}"),
        context=fixed.PHONE_CONTEXT,
    ),
    "phone_toll_free": Twin(
        "PHONE", 0.85, "1800", f"NOT {PREV_WORD}", at(rf"(1800[{S}\-]?{D}{{3}}[{S}\-]?{D}{{3,4}}){END}"),
        context=fixed.PHONE_CONTEXT,
    ),
    "phone_international": Twin(
        "PHONE", 0.80, rf"\+{D}", "true",
        at(rf"(\+{D}{{1,3}}[{S}\-]?\(?{D}{{1,4}}\)?[{S}\-]?{D}{{3,4}}[{S}\-]?{D}{{3,4}}){END}"),
        context=fixed.PHONE_CONTEXT,
    ),
    "phone_us": Twin(
        "PHONE", 0.75, rf"{D}{{3}}\)?[{S}.\-]{D}{{3}}[{S}.\-]{D}{{4}}", f"NOT {PREV_DIGIT}",
        at(rf"(\(?{D}{{3}}\)?[{S}.\-]{D}{{3}}[{S}.\-]{D}{{4}}){NO_DIGIT}"), context=fixed.PHONE_CONTEXT,
    ),
    "ssn": Twin(
        "SSN", 0.85, rf"{D}{{3}}-{D}{{2}}-{D}{{4}}", f"NOT {PREV_WORD}", at(rf"({D}{{3}}-{D}{{2}}-{D}{{4}}){END}"),
        "substr(v, 1, 3) NOT IN ('000', '666') AND substr(v, 5, 2) <> '00' AND substr(v, 8) <> '0000'",
        validated=True,
    ),
    "credit_card": Twin(
        "CREDIT_CARD", 0.75, rf"{D}{{4}}[{S}\-]{D}{{4}}[{S}\-]{D}{{4}}|{D}{{13}}", "true",
        first_of(
            f"CASE WHEN NOT {PREV_DIGIT} THEN " + at(rf"((?:{D}{{4}}[{S}\-]){{3}}{D}{{1,4}})") + " END",
            at(rf"((?:{D}{{4}}[{S}\-]){{2}}{D}{{4,6}})"),
            at(rf"({D}{{13,19}}){NO_DIGIT}"),
        ),
        f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", validated=True,
    ),
    "birth_date": Twin(
        "DATE_OF_BIRTH", 0.88,
        rf"(?i){D}[/\-.]{D}{{1,2}}[/\-.]{D}|{_MONTH}[{S},]+{D}|{D}{SP}+{_MONTH}|{D}{{2}}-[a-z]{{3}}-{D}{{4}}",
        f"NOT {PREV_WORD}",
        at(
            rf"({D}{{1,2}}[/\-.]{D}{{1,2}}[/\-.]{D}{{4}}|{D}{{4}}[/\-.]{D}{{1,2}}[/\-.]{D}{{1,2}}"
            rf"|{_MONTH}[{S},]+{D}{{1,2}}[{S},]+{D}{{4}}|{D}{{1,2}}{SP}+{_MONTH}[{S},]+{D}{{4}}"
            rf"|{D}{{2}}-[A-Za-z]{{3}}-{D}{{4}}){END}"
        ),
        _BIRTH,
    ),
    "pin_code": Twin(
        "ADDRESS", 0.75, rf"[1-9]{D}{{5}}", "true",
        first_of(
            at(rf"((?:pin(?:{SP}*code)?|postal(?:{SP}*code)?){SP}*[:\-]?{SP}*[1-9]{D}{{5}})"),
            f"CASE WHEN NOT {PREV_WORD} THEN " + at(rf"([1-9]{D}{{5}}){END}") + " END",
        ),
        context=fixed.ADDRESS_CONTEXT,
    ),
    "ip_address": Twin(
        "IP_ADDRESS", 0.85, rf"{D}\.{D}+\.{D}+\.{D}", f"NOT {PREV_WORD}",
        at(rf"((?:{D}{{1,3}}\.){{3}}{D}{{1,3}}){END}"),
        f"regexp_full_match(v, {_lit(rf'(?:{_OCTET}\.){{3}}{_OCTET}')})", validated=True,
    ),
    "organization": Twin(
        "ORGANIZATION", 0.65, rf"(?i){SP}(?:{_ORG_BOUND}|Private|Pvt|Public|Ltd|Inc|Corp)", f"NOT {PREV_WORD}",
        _ORG_VALUE, context=fixed.ORGANIZATION_CONTEXT,
    ),
    "street": Twin(
        "ADDRESS", 0.60,
        rf"(?i)[A-Z{D}]{SP}+Floor|(?:^|[^{W}])(?:Floor{SP}|(?:Plot|Survey|Khasra|Gat|House|Flat|Shop|Unit|Sector|Phase|Block))"
        rf"|[A-Z{D}]{SP}*[\-–]?{SP}*Wing{END}|[{W}.{S}]{_ROADS}{END}",
        f"NOT {PREV_WORD}",
        first_of(
            at(rf"({D}{{1,2}}(?:st|nd|rd|th)?{SP}+Floor|[A-Z{D}]+{SP}+Floor|Floor{SP}+[A-Z{D}]+)"),
            at(
                rf"((?:Plot|Survey|Khasra|Gat|House|Flat|Shop|Unit){SP}*(?:No\.?|Number|#)?{SP}*[{W}/]+"
                rf"(?:{SP}*,{SP}*[{W}{S}]+)?)"
            ),
            at(rf"([A-Z{D}]{SP}*[\-–]?{SP}*Wing){END}"),
            at(rf"((?:Sector|Phase|Block){SP}*[\-–]?{SP}*[A-Z{D}]+)"),
            at(rf"([A-Z][{W}.{S}]{{1,30}}?{_ROADS}){END}"),
        ),
        context=fixed.ADDRESS_CONTEXT,
    ),
    "person_contact": Twin(
        "PERSON", 0.85, rf"(?i)Contact{SP}Person:{SP}",
        f"regexp_matches(substr(text, greatest(s - 15, 1), least(s, 16)), {_lit(rf'(?i)Contact{SP}Person:{SP}$')})",
        at(f"({_NAME})"), _PERSON, validated=True,
    ),
    "person_label": Twin(
        "PERSON", 0.85, rf"(?i)(?:Name|Promoter|Director):{SP}",
        f"regexp_matches(substr(text, greatest(s - 15, 1), least(s, 16)), {_lit(rf'(?i)(?:Name|Promoter|Director):{SP}$')})",
        at(f"({_NAME})"), _PERSON, validated=True,
    ),
    "person_designation": Twin(
        "PERSON", 0.85, rf"(?i){SP}(?:{_DESIGNATION})", f"NOT {PREV_WORD}", at(f"({_NAME}){SP}+(?:{_DESIGNATION})"),
        _PERSON, validated=True,
    ),
}


# -- texts ------------------------------------------------------------------
def sentences_cte() -> str:
    """``sentences(sent_id, text, value, times, category)`` over customer."""
    parts = [
        f"SELECT k * 10 + {j} AS sent_id, {text} AS text, {value} AS value, {times} AS times, '{category}' AS category FROM ck"
        for j, (text, value, times, category) in enumerate(RECIPES)
    ]
    return "ck AS (SELECT c_custkey AS k FROM customer), sentences AS (" + " UNION ALL ".join(parts) + ")"


DOC_PARAGRAPHS = (
    "doc_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), "
    "doc_paras AS (SELECT doc_id, unnest(range(len(ls)))::INT AS para_id, unnest(ls) AS text FROM doc_lines)"
)
TEXTS = {
    "all": sentences_cte() + ", " + DOC_PARAGRAPHS
    + ", texts AS (SELECT 'doc' AS src, doc_id AS id, para_id AS para, text FROM doc_paras"
    " UNION ALL SELECT 'sent', sent_id, 0, text FROM sentences)",
    "documents": DOC_PARAGRAPHS
    + ", texts AS (SELECT 'doc' AS src, doc_id AS id, para_id AS para, text FROM doc_paras)",
    "sentences": sentences_cte() + ", texts AS (SELECT 'sent' AS src, sent_id AS id, 0 AS para, text FROM sentences)",
    "pages": "texts AS (SELECT 'page' AS src, p.page_id AS id, u.i AS para, string_split(p.html, chr(10))[u.i + 1] AS text"
    " FROM pages p, LATERAL (SELECT unnest(range(len(string_split(p.html, chr(10)))))::INT AS i) u)",
    "conversations": "texts AS (SELECT 'turn' AS src, conv_id AS id, turn AS para, text FROM conversations)",
}

_WORD = r"[\p{L}\p{N}_]+"


def _score(twin: Twin) -> str:
    if twin.validated:
        return "CAST(1.0 AS DOUBLE)"
    single = [w for w in twin.context if " " not in w]
    if not single:
        return f"CAST({twin.score} AS DOUBLE)"
    before = f"regexp_extract_all(lower(substr(text, 1, s)), '{_WORD}')"
    after = f"regexp_extract_all(lower(substr(text, s + 1)), '{_WORD}')"
    content = f"list_filter({after}, lambda w: w NOT IN ({quotes(fixed.STOP_WORDS)}))"
    words = f"list_concat(list_reverse(list_reverse({before})[1:{fixed.CONTEXT_TOKENS_BEFORE}]), {content}[1:1])"
    raised = min(1.0, round(twin.score + fixed.CONTEXT_BOOST, 4))
    return (
        f"CAST(CASE WHEN regexp_matches(array_to_string({words}, ' '), '{'|'.join(single)}')"
        f" THEN {raised} ELSE {twin.score} END AS DOUBLE)"
    )


def candidates(rules: list[str]) -> str:
    """CTEs up to ``cand(rule, category, src, id, para, s, e, v, score)``:
    every rule's leftmost non-overlapping matches that pass its check."""
    tried = []
    for name in rules:
        twin = TWINS[name]
        tried.append(
            f"SELECT '{name}' AS rule, src, id, para, text, s, v FROM (SELECT src, id, para, text, s, {twin.value} AS v FROM"
            f" (SELECT src, id, para, text, s, CASE WHEN s = 0 THEN '' ELSE substr(text, s, 1) END AS prev,"
            f" substr(text, s + 1) AS rest FROM (SELECT src, id, para, text, unnest(range(length(text)))::INT AS s"
            f" FROM texts WHERE regexp_matches(text, {_lit(twin.raw)}))) WHERE {twin.left}) WHERE v <> ''"
        )
    scored = []
    for name in rules:
        twin = TWINS[name]
        scored.append(
            f"SELECT rule, '{twin.category}' AS category, src, id, para, s, e, v, {_score(twin)} AS score"
            f" FROM picked WHERE rule = '{name}' AND ({twin.check})"
        )
    return (
        f"tried AS MATERIALIZED ({' UNION ALL '.join(tried)}),"
        " ends AS MATERIALIZED (SELECT *, s + length(v) AS e FROM tried),"
        " hops AS MATERIALIZED (SELECT a.rule, a.src, a.id, a.para, a.s, min(b.s) AS hop FROM ends a JOIN ends b"
        " ON a.rule = b.rule AND a.src = b.src AND a.id = b.id AND a.para = b.para AND b.s >= a.e"
        " GROUP BY ALL),"
        " taken(rule, src, id, para, s) AS (SELECT rule, src, id, para, min(s) FROM ends GROUP BY ALL"
        " UNION ALL SELECT h.rule, h.src, h.id, h.para, h.hop FROM taken t JOIN hops h"
        " ON h.rule = t.rule AND h.src = t.src AND h.id = t.id AND h.para = t.para AND h.s = t.s),"
        " picked AS MATERIALIZED (SELECT e.* FROM ends e JOIN taken t ON e.rule = t.rule AND e.src = t.src"
        " AND e.id = t.id AND e.para = t.para AND e.s = t.s),"
        f" cand AS MATERIALIZED ({' UNION ALL '.join(scored)})"
    )


_TERMS = "|".join(fixed.NOT_A_NAME_TERMS)
_LABELS = "|".join(fixed.FIELD_LABEL_TERMS)
_ACRONYM = f"(length(v) <= 6 AND NOT regexp_matches(trim(v), {_lit(SP)}) AND upper(v) = v AND lower(v) <> v)"
BLOCKED = (
    f"((category = 'PERSON' AND (regexp_matches(v, {_lit(rf'(?i)^{SP}*(?:{_TERMS}|{_LABELS}){SP}*$')}) OR {_ACRONYM}))"
    f" OR (category = 'ORGANIZATION' AND (regexp_matches(v, {_lit(rf'(?i)^{SP}*(?:{_TERMS}){SP}*$')}) OR {_ACRONYM})))"
)


def resolved(min_score: float = 0.5, source: str = "cand", out: str = "ents") -> str:
    """CTEs from ``source`` to resolved entities ``out``."""
    same = "y.src = x.src AND y.id = x.id AND y.para = x.para"
    return (
        f"{out}_cut AS MATERIALIZED (SELECT DISTINCT category, src, id, para, s, e, v, score FROM {source} WHERE score >= {min_score}),"
        f" {out}_free AS MATERIALIZED (SELECT * FROM {out}_cut x WHERE NOT EXISTS (SELECT 1 FROM {out}_cut y WHERE {same}"
        " AND y.category = x.category AND y.s <= x.s AND y.e >= x.e AND y.score >= x.score"
        f" AND (y.s < x.s OR y.e > x.e OR y.score > x.score)) AND NOT {BLOCKED}),"
        f" {out}_ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src, id, para"
        f" ORDER BY s, score DESC, e DESC, category) AS r FROM {out}_free),"
        f" {out}_hops AS MATERIALIZED (SELECT x.src, x.id, x.para, x.r, min(y.r) AS hop FROM {out}_ranked x JOIN {out}_ranked y"
        f" ON {same} AND y.s >= x.e GROUP BY ALL),"
        f" {out}_taken(src, id, para, r) AS (SELECT src, id, para, CAST(1 AS BIGINT) FROM {out}_ranked WHERE r = 1"
        f" UNION ALL SELECT h.src, h.id, h.para, h.hop FROM {out}_taken t JOIN {out}_hops h"
        " ON h.src = t.src AND h.id = t.id AND h.para = t.para AND h.r = t.r),"
        f" {out} AS MATERIALIZED (SELECT x.* FROM {out}_ranked x JOIN {out}_taken t ON x.src = t.src AND x.id = t.id"
        " AND x.para = t.para AND x.r = t.r)"
    )


ALL_RULES = list(TWINS)
# One position can hold several labels only where a rule is listed twice, so
# contained spans are compared by category; LOCATION is the one label of ADDRESS.


def with_query(query: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + query


def rule_query(*rules: str, texts: str = "all") -> str:
    return with_query(
        "SELECT src, id, para, s AS start, e AS \"end\", v AS original_text, score FROM cand",
        TEXTS[texts], candidates(list(rules)),
    )


def entities(texts: str, rules: list[str] | None = None, min_score: float = 0.5) -> tuple[str, ...]:
    """CTEs up to ``ents``."""
    return TEXTS[texts], candidates(rules or ALL_RULES), resolved(min_score)
