"""The rule table: what to look for, and how to add to it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import groupby

from inkveil.functions import fixed_values as fixed, validators
from inkveil.functions.columns import NO_SPANS, each, let, quote, quotes, segments
from inkveil.functions.emails import email_matches
from inkveil.functions.matching import (
    ODD_CASE_LETTERS, contains_any, context_pattern, dialect, find_all, locate_all, words_around,
)


@dataclass(frozen=True)
class Rule:
    """One recognizer, as data.

    ``label``     is renamed to a category by the label map.
    ``context``   words that raise the score when they stand near a match.
    ``any_of``    lower-case literals; every text with a match, confirmed if
                  there is ``confirm``, holds one.
    ``gate``      a cheap regex that finds something in every text with a match.
    ``validate``  SQL condition over ``{value}``; a pass sets the score to 1.0.
    ``locate``    makes SQL of ``value, start, end`` of all matches from that
                  of the text, for rules that a regex would find slowly; the
                  text then holds one of ``any_of``.
    ``confirm``   SQL condition over ``{parts}`` (the text's segments, see
                  ``cut``), ``{start}`` and ``{end}``; a pass leaves the
                  score alone.

    The two gates keep the pattern off the texts that cannot match.
    """

    name: str
    label: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    gate: str = ""
    validate: str = ""
    confirm: str = ""
    locate: Callable[[str], str] | None = None

    def spans(self, text: str, entity_type: str) -> str:
        """SQL for this rule's spans in ``text``; ``spans_of`` weighs their
        context, told by ``entity_type``, the rule's label or name."""
        pattern = dialect(self.pattern)
        score = fixed.VALIDATED_SCORE if self.validate else self.score

        def to_spans(found: str) -> str:
            matches = found if self.locate else locate_all(text, pattern, found)
            if self.validate:
                matches = each(matches, lambda m: self.validate.format(value=f"{m}.value"), "filter")
            if self.confirm:
                unsure = matches
                matches = let(
                    segments(text),
                    lambda parts: each(
                        unsure,
                        lambda m: self.confirm.format(parts=parts, start=f"{m}.start", end=f"{m}.`end`"),
                        "filter",
                    ),
                    "parts",
                )
            return each(
                matches,
                lambda m: f"named_struct('entity_type', {quote(entity_type)}, 'original_text', {m}.value,"
                f" 'start', {m}.start, 'end', {m}.`end`, 'score', {float(score)}D)",
            )

        return let(
            self.locate(text) if self.locate else find_all(text, pattern),
            lambda found: f"CASE WHEN size({found}) > 0 THEN {to_spans(found)} ELSE {NO_SPANS} END",
            "found",
        )


def _told_by_label(rules: Sequence[Rule]) -> bool:
    """Whether a span's label alone tells its context words, so that it need not carry the rule's name."""
    contexts = {(rule.label, context_pattern(rule.context)) for rule in rules if not rule.validate}
    return len(contexts) == len({label for label, _ in contexts})


def _labelled(parts: str, spans: str, rules: Sequence[Rule]) -> str:
    """Turn rule names into labels and raise scores that have context.

    One expression for all rules: the words around a span are the same
    whichever rule found it.
    """
    told = _told_by_label(rules)
    by_label: dict[str, list[str]] = {}
    by_context: dict[str, list[str]] = {}
    for rule in rules:
        by_label.setdefault(rule.label, []).append(rule.name)
        if context_pattern(rule.context) and not rule.validate:
            names = by_context.setdefault(context_pattern(rule.context), [])
            names += [rule.label if told else rule.name] if not told or rule.label not in names else []

    def label(s: str) -> str:
        if told:
            return f"{s}.entity_type"
        cases = " ".join(f"WHEN {s}.entity_type IN ({quotes(n)}) THEN {quote(to)}" for to, n in by_label.items())
        return f"CASE {cases} END"

    def score(s: str) -> str:
        if not by_context:
            return f"{s}.score"

        def hit(around: str) -> str:
            cases = " ".join(
                f"WHEN {s}.entity_type IN ({quotes(n)}) THEN {around} RLIKE {quote(p)}" for p, n in by_context.items()
            )
            return f"CASE {cases} ELSE false END"

        near = let(words_around(parts, f"{s}.start"), hit, "around")
        return (
            f"CASE WHEN {s}.score >= 1.0D THEN {s}.score"
            f" WHEN {near} THEN least(1.0D, round({s}.score + {fixed.CONTEXT_BOOST}D, 4)) ELSE {s}.score END"
        )

    return each(
        spans,
        lambda s: f"named_struct('entity_type', {label(s)}, 'original_text', {s}.original_text,"
        f" 'start', {s}.start, 'end', {s}.`end`, 'score', {score(s)})",
    )


def spans_of(text: str, rules: Sequence[Rule]) -> str:
    """SQL for the bag union of all rules' spans, as an array of ``SPAN``.

    Neighbouring rules with the same gate share one test of it, and so do those with the same literals.
    """
    if not rules:
        return NO_SPANS

    told = _told_by_label(rules)

    def guarded(lowered: str, odd: str) -> str:
        def joined(spans: Sequence[str]) -> str:
            return spans[0] if len(spans) == 1 else f"concat({', '.join(spans)})"

        def when(tests: Sequence[str], spans: str) -> str:
            return f"CASE WHEN {' AND '.join(tests)} THEN {spans} ELSE {NO_SPANS} END" if tests else spans

        def literals(any_of: tuple[str, ...]) -> list[str]:
            cased = any(c.isalpha() for word in any_of for c in word)
            return [f"({odd} OR {contains_any(lowered, any_of)})" if cased else contains_any(lowered, any_of)] if any_of else []

        parts = []
        for gate, members in groupby(rules, key=lambda r: r.gate):
            matches = [f"{text} RLIKE {quote(dialect(gate))}"] if gate else []
            groups = [(any_of, joined([r.spans(text, r.label if told else r.name) for r in same])) for any_of, same in groupby(members, key=lambda r: r.any_of)]
            if len(groups) == 1:  # literals are cheaper than a regex
                parts.append(when([*literals(groups[0][0]), *matches], groups[0][1]))
            else:
                parts.append(when(matches, joined([when(literals(any_of), spans) for any_of, spans in groups])))
        return joined(parts)

    union = let(
        f"lower({text})",
        lambda lowered: let(contains_any(text, ODD_CASE_LETTERS), lambda odd: guarded(lowered, odd), "odd"),
        "lowered",
    )
    return let(
        union,
        lambda u: f"CASE WHEN size({u}) > 0 THEN"
        f" {let(segments(text), lambda parts: _labelled(parts, u, rules), 'parts')} ELSE {NO_SPANS} END",
        "union",
    )


_VALUE, _PARTS, _START, _END = "{value}", "{parts}", "{start}", "{end}"


def _template(sql: str) -> str:
    """Keep braces of the SQL (regex counts) and open only the operands."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for operand in (_VALUE, _PARTS, _START, _END):
        sql = sql.replace("{" + operand + "}", operand)
    return sql


def default_rules() -> list[Rule]:
    """The nine categories' rules, in registration order."""
    digits = {"gate": r"\d{3}"}
    phone = {"label": "PHONE_NUMBER", "context": fixed.PHONE_CONTEXT, **digits}
    person = {"label": "PERSON", "score": 0.85, "validate": _template(validators.plausible_person(_VALUE))}
    address = {"label": "LOCATION", "context": fixed.ADDRESS_CONTEXT}
    return [
        Rule("email", "EMAIL_ADDRESS", fixed.EMAIL, 0.95, fixed.EMAIL_CONTEXT, any_of=("@",), locate=email_matches),
        Rule("phone_india", pattern=fixed.PHONE_INDIA, score=0.95, any_of=("91",), **phone),
        Rule("phone_std", pattern=fixed.PHONE_STD, score=0.85, any_of=("0",), **phone),
        Rule("phone_mobile", pattern=fixed.PHONE_MOBILE, score=0.65, **phone),
        Rule("phone_toll_free", pattern=fixed.PHONE_TOLL_FREE, score=0.85, any_of=("1800",), **phone),
        Rule("phone_international", pattern=fixed.PHONE_INTERNATIONAL, score=0.80, any_of=("+",), **phone),
        Rule("phone_us", pattern=fixed.PHONE_US, score=0.75, **phone),
        Rule("ssn", "US_SSN", fixed.SSN, 0.85, fixed.SSN_CONTEXT, any_of=("-",),
             validate=_template(validators.valid_ssn(_VALUE)), **digits),
        Rule("credit_card", "CREDIT_CARD", fixed.CREDIT_CARD, 0.75, fixed.CARD_CONTEXT,
             validate=_template(validators.valid_card(_VALUE)), **digits),
        Rule("birth_date", "DATE_OF_BIRTH", fixed.DATE, 0.88, any_of=fixed.BIRTH_KEYWORD_PIECES,
             confirm=_template(validators.near_birth_keyword(_PARTS, _START, _END)), **digits),
        Rule("pin_code", pattern=fixed.PIN_CODE, score=0.75, **address, **digits),
        Rule("ip_address", "IP_ADDRESS", fixed.IP_ADDRESS, 0.85, fixed.IP_CONTEXT,
             gate=r"\d\.\d{1,3}\.\d", validate=_template(validators.valid_ipv4(_VALUE))),
        Rule("organization", "ORG", fixed.ORGANIZATION, 0.65, fixed.ORGANIZATION_CONTEXT,
             any_of=fixed.LEGAL_SUFFIX_PIECES, gate=rf"\s(?:{fixed.LEGAL_SUFFIX})"),
        Rule("street", pattern=fixed.STREET, score=0.60, any_of=fixed.STREET_PIECES, gate=fixed.STREET_HINT,
             **address),
        Rule("person_contact", pattern=fixed.PERSON_CONTACT, any_of=("person:",), **person),
        Rule("person_label", pattern=fixed.PERSON_LABEL, any_of=("name:", "promoter:", "director:"), **person),
        Rule("person_designation", pattern=fixed.PERSON_DESIGNATION,
             any_of=("secretary", "officer", "director", "executive"), gate=rf"\s(?:{fixed.DESIGNATION})", **person),
    ]


def bounded_organization_rule() -> Rule:
    """Like ``organization``, but a suffix must end at a word boundary, so
    ``increased`` no longer ends a company name.  Not part of the defaults."""
    return Rule(
        "organization_bounded", "ORG", fixed.ORGANIZATION + r"(?!\w)", 0.65, fixed.ORGANIZATION_CONTEXT,
        any_of=fixed.LEGAL_SUFFIX_PIECES, gate=rf"\s(?:{fixed.LEGAL_SUFFIX})(?!\w)",
    )


def rules_named(*names: str) -> list[Rule]:
    """The default rules with these names."""
    known = {rule.name: rule for rule in default_rules()}
    return [known[name] for name in names]
