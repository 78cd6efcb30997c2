"""The whole detector: categories, scores, filters, overlaps, extensions."""

import random

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.operators import dictionary
from inkveil.operators.detect import detect, entities_sql, explode_entities, resolve
from inkveil.operators.rules import Rule, default_rules


def kinds(found):
    return [[e[0] for e in row] for row in found]


def test_one_of_each(find):
    texts = {
        "Email us at jo@site.org today.": "EMAIL", "Call +91 9812345678.": "PHONE", "Host 192.168.7.1 is up": "IP_ADDRESS",
        "Card 4012 8888 8888 1881.": "CREDIT_CARD", "SSN: 321-54-9876.": "SSN", "Date of birth: 03/04/1971.": "DATE_OF_BIRTH",
        "9: Quill Inc": "ORGANIZATION", "pin 560001": "ADDRESS", "Contact Person: Lena Marsh": "PERSON",
    }
    assert kinds(find(list(texts))) == [[k] for k in texts.values()]


def test_nothing_found(find):
    texts = ["Turnover 98,76,54,321 in FY 2023", "On sheet 42 it ends.", "Version 2.71 is out", "", " \t\n", None, "The picnic falls on 17/09/2024."]
    assert find(texts) == [[] for _ in texts]


def test_repeats_are_both_found(find):
    assert [e[1:4] for e in find(["to a@b.co and a@b.co"])[0]] == [("a@b.co", 3, 9), ("a@b.co", 14, 20)]


def test_context_raises_scores(find):
    texts = [
        "The company Quill Technologies filed", "1 Quill Technologies filed", "office: B Wing, 4th Floor, Ruby Tower",
        "Blocked at noon", "Amex card: 3714 496353 98431.",
    ]
    found = find(texts)
    assert found[0] == [("ORGANIZATION", "The company Quill Technologies", 0, 30, 1.0)]
    assert found[1][0][4] == 0.65
    assert [(e[1], e[4]) for e in found[2]] == [("B Wing", 0.6), ("4th Floor", 0.95), ("Ruby Tower", 0.95)]
    assert found[3] == [("ADDRESS", "Blocked", 0, 7, 0.95)]
    assert found[4] == [("ADDRESS", "496353", 16, 22, 0.75)]


def test_minimum_score(find):
    assert find(["1 Quill Technologies filed"], min_score=0.66) == [[]]
    assert len(find(["1 Quill Technologies filed"], min_score=0.65)[0]) == 1


def spans(spark, rows):
    text = ", ".join(
        f"named_struct('entity_type', '{k}', 'original_text', '{v}', 'start', {s}, 'end', {e}, 'score', {p}D)" for k, v, s, e, p in rows
    )
    done = spark.range(1).select(F.expr(resolve(f"array({text})")).alias("r")).first().r
    return [(e.entity_type, e.start, e.end) for e in done]


def test_earlier_start_wins_over_better_score(spark):
    assert spans(spark, [("US_SSN", "b", 3, 9, 1.0), ("ORG", "some firm", 0, 5, 0.6)]) == [("ORGANIZATION", 0, 5)]


def test_same_start_better_score_then_longer(spark):
    assert spans(spark, [("US_SSN", "a", 0, 4, 0.7), ("CREDIT_CARD", "b", 0, 3, 0.9)]) == [("CREDIT_CARD", 0, 3)]
    assert spans(spark, [("US_SSN", "a", 0, 4, 0.7), ("CREDIT_CARD", "b", 0, 6, 0.7)]) == [("CREDIT_CARD", 0, 6)]


def test_touching_spans_both_stay(spark):
    assert len(spans(spark, [("US_SSN", "a", 0, 4, 0.7), ("CREDIT_CARD", "b", 4, 6, 0.7)])) == 2


def test_contained_same_label_is_gone_before_resolution(spark):
    # The phone span is displaced by the card; the phone inside it must not come back.
    rows = [("CREDIT_CARD", "c", 0, 4, 0.7), ("PHONE_NUMBER", "p", 2, 20, 0.9), ("PHONE_NUMBER", "q", 8, 12, 0.8)]
    assert spans(spark, rows) == [("CREDIT_CARD", 0, 4)]
    rows[2] = ("PHONE_NUMBER", "q", 8, 12, 0.95)
    assert spans(spark, rows) == [("CREDIT_CARD", 0, 4), ("PHONE", 8, 12)]


def test_blocked_and_unknown_values(spark):
    rows = [("PERSON", "SEBI", 0, 4, 0.9), ("PERSON", "Fax", 5, 8, 0.9), ("ORG", "Fax", 9, 12, 0.9), ("ORG", "NATO", 13, 17, 0.9),
            ("FAC", "Hall", 18, 22, 0.9), ("GPE", "UK", 23, 25, 0.9), ("PERSON", "q3", 26, 28, 0.9)]
    assert spans(spark, rows) == [("ORGANIZATION", 9, 12), ("ADDRESS", 23, 25)]


def brute_force(rows):
    """Containment, then greedy by (start, -score, -end, type), in plain Python."""
    rows = list(dict.fromkeys(rows))
    alive = [
        x for x in rows
        if not any(y != x and y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] and y[3] >= x[3] for y in rows)
    ]
    kept = []
    for x in sorted(alive, key=lambda r: (r[1], -r[3], -r[2], r[0])):
        if all(x[1] >= k[2] or x[2] <= k[1] for k in kept):
            kept.append(x)
    return [(k[0], k[1], k[2]) for k in kept]


def test_resolution_against_brute_force(spark):
    rng = random.Random(7)
    cases = []
    for i in range(120):
        rows = []
        for _ in range(rng.randint(1, 14)):
            s = rng.randint(0, 40)
            rows.append((rng.choice(["US_SSN", "CREDIT_CARD", "IP_ADDRESS"]), s, s + rng.randint(1, 9), rng.choice([0.6, 0.8, 1.0])))
        cases.append(rows)
    data = [(i, [dict(entity_type=t, original_text="v", start=s, end=e, score=p) for t, s, e, p in rows]) for i, rows in enumerate(cases)]
    span = "struct<entity_type:string,original_text:string,start:int,end:int,score:double>"
    df = spark.createDataFrame(data, f"i int, raw array<{span}>")
    names = {"US_SSN": "SSN"}
    for r in df.select("i", F.expr(resolve("raw")).alias("r")).collect():
        expected = [(names.get(t, t), s, e) for t, s, e in brute_force(cases[r.i])]
        assert [(x.entity_type, x.start, x.end) for x in r.r] == expected


def test_no_overlaps_and_slices_agree(spark, sf_dir):
    from inkveil.checks.derived import texts

    for r in detect(texts(spark, sf_dir)).where("size(entities) > 0").collect():
        last = 0
        for e in r.entities:
            assert last <= e.start < e.end <= len(r.text) and r.text[e.start : e.end] == e.original_text
            last = e.end


def long_line(n):
    """One line with values of five kinds, accents and emoji between them."""
    kinds = [
        "mail né u{i}x@h{i}.org", "host 10.1.{j}.7", "😀 date of birth: 0{k}/04/1971", "SSN 321-54-98{k}6 été", "the firm Quill LLP",
    ]
    return " ; ".join(t.format(i=i, j=i % 250, k=1 + i % 9) for i in range(n) for t in kinds)


def test_long_lines_are_like_short_ones(spark, find, monkeypatch):
    from inkveil.functions import columns

    text = long_line(300)
    assert len(text) > 3 * columns.LONG_TEXT
    found = find([text])[0]
    assert len(found) == 1500 and all(text[s:e] == v for _, v, s, e, _ in found)
    monkeypatch.setattr(columns, "LONG_TEXT", 10**9)
    assert find([text])[0] == found


def test_long_lines_are_redacted_whole(spark):
    from inkveil.plans.redact import redact

    text = long_line(300)
    row = redact(spark.createDataFrame([(text,)], "text string")).first()
    expected, last = "", 0
    for e in row.entities:
        expected += text[last : e.start] + e.replacement
        last = e.end
    assert row.redacted == expected + text[last:]


def test_dictionary_in_a_long_line(spark):
    text = "é😀 " * 3000 + "Port Vila, then port-vila " * 20
    words = spark.createDataFrame([("port vila", "GPE")], "phrase string, entity_type string")
    rows = dictionary.with_mentions(spark.createDataFrame([(text,)], "text string"), words, ["text"])
    found = rows.first().mentions
    assert len(found) == 40 and all(text[m.start : m.end] == m.original_text for m in found)
    assert {m.original_text for m in found} == {"Port Vila", "port-vila"}


def test_own_rule_and_label(find):
    rule = Rule("ticket", "TICKET", r"\bT-\d{4}\b", 0.6, context=("ticket",), validate="{value} <> 'T-0000'")
    found = find(["ticket T-1234 and T-0000"], rules=[rule], labels={"TICKET": "TICKET"})
    assert found == [[("TICKET", "T-1234", 7, 13, 1.0)]]
    unvalidated = Rule("ticket", "TICKET", r"\bT-\d{4}\b", 0.6, context=("ticket",))
    assert find(["ticket T-1234"], rules=[unvalidated], labels={"TICKET": "TICKET"})[0][0][4] == 0.95


def test_pandas_udf_as_detector(spark):
    span = "array<struct<entity_type:string,original_text:string,start:int,end:int,score:double>>"

    @F.pandas_udf(span)
    def shout(texts: pd.Series) -> pd.Series:
        def one(t):
            words = [w for w in (t or "").split() if w.isupper() and len(w) > 6]
            return [dict(entity_type="ORG", original_text=w, start=t.index(w), end=t.index(w) + len(w), score=0.8) for w in words]

        return texts.map(one)

    rows = spark.createDataFrame([("see EVERGREEN there",), ("none",)], "text string")
    found = [[(e.entity_type, e.original_text) for e in r.entities] for r in detect(rows, detector=shout).collect()]
    assert found == [[("ORGANIZATION", "EVERGREEN")], []]


def test_plan_has_neither_exchange_nor_python(spark, sf_dir):
    from inkveil.plans.redact import redact, redact_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (redact(docs.select("doc_id", "text")), redact_documents(docs.select("doc_id", "text"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    plan = explode_entities(detect(docs.select("text")))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan


@pytest.mark.parametrize("limit", ["inline", "broadcast", "shuffle"])
def test_dictionary_ways_agree(spark, monkeypatch, limit):
    if limit != "inline":
        monkeypatch.setattr(dictionary, "INLINE_PHRASES", 0)
    if limit == "shuffle":
        monkeypatch.setattr(dictionary, "BROADCAST_PHRASES", 0)
    words = spark.createDataFrame([("New  York", "GPE"), ("york", "GPE"), ("Anna-Maria Berg", "PERSON"), ("sebi", "PERSON")], "phrase string, entity_type string")
    rows = spark.createDataFrame([(1, "é 😀 from new york, by ANNA MARIA BERG of SEBI"), (2, "none"), (3, None), (4, "york york")], "i int, text string")
    named = dictionary.with_mentions(rows, words, ["i"])
    found = {r.i: [(e.entity_type, e.original_text, e.start, e.end, e.score) for e in r.entities] for r in detect(named, rules=[], extra_spans="mentions").collect()}
    assert found[1] == [("ADDRESS", "new york", 9, 17, 0.85), ("PERSON", "ANNA MARIA BERG", 22, 37, 0.85)]
    assert found[2] == found[3] == []
    assert [e[2] for e in found[4]] == [0, 5]


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_PHRASES": 0}, {"BROADCAST_PHRASES": 0, "BROADCAST_PREFIXES": 0}])
def test_phrase_trie(spark, monkeypatch, limits):
    """Every listed word sequence is found, by few others: those on listed prefixes."""
    for name, value in limits.items():
        monkeypatch.setattr(dictionary, name, value)
    rng = np.random.default_rng(3)
    letters = "abcd"
    listed = sorted({" ".join(rng.choice(list(letters), int(n))) for n in rng.integers(1, 14, 60)})
    texts = [" ".join(rng.choice(list(letters + "xyz"), 200)) + " " + " ".join(rng.choice(listed, 5)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    phrases = dictionary.normalized(spark.createDataFrame([(p, "ORG") for p in listed], "phrase string, entity_type string"))
    named = dictionary.joined_mentions(rows, phrases, ["i"])
    got = sorted((r.i, m.start, m.original_text) for r in named.collect() for m in r.mentions)
    wanted, prefixes = [], {tuple(p.split()[:n]) for p in listed for n in range(1, 15)}
    on_prefixes = 0
    for i, text in enumerate(texts):
        words = text.split()
        for at in range(len(words)):
            for n in range(1, 15):
                if at + n <= len(words):
                    on_prefixes += tuple(words[at : at + n]) in prefixes
                    if " ".join(words[at : at + n]) in listed:
                        wanted.append((i, 2 * at, " ".join(words[at : at + n])))
    assert got == sorted(wanted)
    assert dictionary.grams_on_prefixes(rows, phrases, ["i"], "text").count() < 2 * on_prefixes


def test_trie_moves_keys_and_confirms_words(spark, monkeypatch):
    """What crosses exchanges has a fixed size per sequence; where keys collide, the words decide."""
    for name in ("INLINE_PHRASES", "BROADCAST_PHRASES", "BROADCAST_PREFIXES"):
        monkeypatch.setattr(dictionary, name, 0)
    rows = spark.createDataFrame([(1, "old fish quay, new Fish market"), (2, "fish"), (2, "quay fish"), (None, "x quay")], "i int, text string")
    phrases = dictionary.normalized(spark.createDataFrame([("fish", "ORG"), ("fish market", "ORG"), ("old fish quay", "GPE")], "phrase string, entity_type string"))
    assert dictionary.grams_on_prefixes(rows, phrases, ["i"], "text").dtypes == [("i", "int"), ("at", "int"), ("n", "int"), ("gram", "bigint")]

    def found():
        named = dictionary.joined_mentions(rows, phrases, ["i"]).collect()
        return sorted((r.text, m.original_text, m.start) for r in named for m in r.mentions)

    expected = [
        ("fish", "fish", 0), ("old fish quay, new Fish market", "Fish", 19), ("old fish quay, new Fish market", "Fish market", 19),
        ("old fish quay, new Fish market", "fish", 4), ("old fish quay, new Fish market", "old fish quay", 0), ("quay fish", "fish", 5),
    ]
    assert found() == expected
    monkeypatch.setattr(dictionary, "_gate", lambda words, n: f"xxhash64({n})")
    assert found() == expected


def test_hot_dictionary_phrase(spark, monkeypatch):
    """A phrase that makes up most rows goes through the salted join whole."""
    monkeypatch.setattr(dictionary, "INLINE_PHRASES", 0)
    monkeypatch.setattr(dictionary, "BROADCAST_PHRASES", 0)
    rows = spark.range(5000).select(F.col("id").alias("i"), F.expr("if(id % 3 = 0, 'in Oslo', 'in Oslo or Rome')").alias("text"))
    words = spark.createDataFrame([("oslo", "GPE"), ("rome", "GPE")], "phrase string, entity_type string")
    named = dictionary.with_mentions(rows, words, ["i"])
    assert named.agg(F.sum(F.size("mentions"))).first()[0] == 5000 + 5000 - 1667


def test_default_rules_have_distinct_names():
    names = [r.name for r in default_rules()]
    assert len(names) == len(set(names)) == 17
    assert entities_sql("text").count("regexp_extract_all") >= 17


def test_context_is_counted_in_tokens_however_long(find):
    long = "x" * 250
    (near,), (far,), (sixth,) = find([f"phone {w} 9812345678" for w in (long[:50], long, "a b c d e")], rules=default_rules())
    assert near[4] == far[4] == 1.0 and sixth[4] < 1.0
