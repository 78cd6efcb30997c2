"""Gold offsets, matching and metrics, by hand-made sentences of our own."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inkveil.operators import evaluate as ev
from inkveil.operators.detect import detect, explode_entities
from inkveil.plans.evaluation import evaluate

SENTENCES = "sent_id int, text string, entities array<struct<entity_text:string,category:string>>"


def gold(spark, text, *pairs, **options):
    df = spark.createDataFrame([(1, text, list(pairs))], SENTENCES)
    return [tuple(g) for g in ev.resolve_gold(df, **options).first().gold]


def test_gold_offsets(spark):
    assert gold(spark, "by Lena Marsh.", ("Lena Marsh", "PERSON")) == [(3, 13, "PERSON")]
    assert gold(spark, "a@b.co or a@b.co", ("a@b.co", "EMAIL"), ("a@b.co", "EMAIL")) == [(0, 6, "EMAIL"), (10, 16, "EMAIL")]
    assert gold(spark, "x then y", ("y", "A"), ("x", "B")) == [(0, 1, "B"), (7, 8, "A")]
    assert gold(spark, "nothing") == []
    assert gold(spark, "one", ("one", "A"), ("one", "A")) == [(0, 3, "A"), (0, 3, "A")]


def test_missing_gold_is_an_error_or_set_aside(spark):
    with pytest.raises(PySparkException, match="not found in"):
        gold(spark, "abc", ("zzz", "A"))
    df = spark.createDataFrame([(1, "abc", [("zzz", "A")]), (2, "abc", [("b", "A")])], SENTENCES)
    assert [r.sent_id for r in ev.unresolved_gold(ev.resolve_gold(df, strict=False)).collect()] == [1]


def corpus(spark):
    rows = [
        (1, "Mail a@b.co now", [("a@b.co", "EMAIL")]),
        (2, "Host 10.0.0.1 and 10.0.0.2", [("10.0.0.1", "IP_ADDRESS"), ("10.0.0.2", "IP_ADDRESS")]),
        (3, "Amex card: 3714 496353 98431.", [("3714 496353 98431", "CREDIT_CARD")]),
        (4, "Revenue increased", []),
        (5, "Chapter 3 covers risks", []),
        (6, "By Omar Haddad", [("Omar Haddad", "PERSON")]),
        (7, "SSN 321-54-9876 twice", [("321-54-9876", "SSN"), ("321-54-9876", "SSN")]),
    ]
    return spark.createDataFrame(rows, SENTENCES)


EXPECTED = {
    "ADDRESS": (0, 1, 0), "CREDIT_CARD": (0, 0, 1), "EMAIL": (1, 0, 0), "IP_ADDRESS": (2, 0, 0), "ORGANIZATION": (0, 1, 0),
    "PERSON": (0, 0, 1), "SSN": (1, 0, 1), "ALL": (4, 2, 3),
}


def counts(df):
    return {r.category: (r.tp, r.fp, r.fn) for r in df.collect()}


def test_wide_and_long_forms_agree(spark):
    done = evaluate(corpus(spark))
    assert counts(done.spans) == EXPECTED
    resolved = ev.resolve_gold(corpus(spark))
    gold_rows = resolved.select("sent_id", F.inline("gold"))
    found = explode_entities(detect(resolved.select("sent_id", "text")), drop=["text"])
    assert counts(ev.span_metrics(ev.match_spans(gold_rows, found))) == EXPECTED
    flags = ev.sentence_flags(resolved, gold_rows, found)
    assert ev.sentence_metrics(flags).first() == done.sentence.first()
    assert ev.false_positives(resolved, gold_rows, found).exceptAll(done.false_positives).count() == 0


def test_sentence_metrics(spark):
    r = evaluate(corpus(spark)).sentence.first()
    assert (r.tp, r.tn, r.fp, r.fn) == (4, 1, 1, 1)
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.7143, 0.8, 0.8, 0.8)


def test_zero_denominators(spark):
    r = ev.with_scores(spark.createDataFrame([(0, 0, 0)], "tp int, fp int, fn int")).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_report_row(spark):
    r = evaluate(corpus(spark), stage=True).report().first()
    assert r.corpus.total_sentences == 7 and r.corpus.total_target_entities == 7
    assert r.entity_level_metrics.tp == 4 and [c.category for c in r.per_category] == sorted(k for k in EXPECTED if k != "ALL")
    assert [e.matched_text for e in r.false_positives] == ["496353", "Revenue inc"]
    assert len(r.false_negatives) == 3 == r.entity_level_metrics.fn


def test_threshold_sweep(spark):
    rows = ev.threshold_sweep(ev.resolve_gold(corpus(spark)), [0.5, 0.7, 0.9])
    assert {r.min_score: r.fp for r in rows.collect()} == {0.5: 2, 0.7: 1, 0.9: 0}


def test_composition(spark):
    assert ev.corpus_composition(ev.resolve_gold(corpus(spark))).first() == (7, 5, 2, 7)


def labelled_corpus():
    """87 sentences of our own with the category sizes of a small benchmark."""
    first = ["Maya", "Rohan", "Elena", "Omar", "Ingrid", "Kenji", "Lena", "Ravi"]
    last = ["Iyer", "Stone", "Novak", "Haddad", "Berg", "Mori", "Marsh", "Das"]
    name = lambda i: f"{first[i % 8]} {last[(i * 3) % 8]}"
    rows = [(f"Contact Person: {name(i)}; desk {i}.", [(name(i), "PERSON")]) for i in range(9)]
    rows += [(f"Name: {name(i)}; Director: {name(i + 1)}.", [(name(i), "PERSON"), (name(i + 1), "PERSON")]) for i in range(3)]
    rows += [(f"{i}: Alder{chr(97 + i)} Holdings, 2020", [(f"Alder{chr(97 + i)} Holdings", "ORGANIZATION")]) for i in range(10)]
    rows += [(f"Write to desk{i}@firm{i}.example.org today", [(f"desk{i}@firm{i}.example.org", "EMAIL")]) for i in range(7)]
    rows += [("Use a@x.org or b@y.org", [("a@x.org", "EMAIL"), ("b@y.org", "EMAIL")])]
    rows += [(f"Call +91 20 3111 22{i}2", [(f"+91 20 3111 22{i}2", "PHONE")]) for i in range(8)]
    rows += [(f"SSN {321 + i}-54-9876", [(f"{321 + i}-54-9876", "SSN")]) for i in range(5)]
    cards = ["4012 8888 8888 1881", "5105105105105100", "371449635398431", "6011111111111117", "4222222222222"]
    rows += [(f"Card {c} used", [(c, "CREDIT_CARD")]) for c in cards]
    rows += [("Card 3714 496353 98431 used", [("3714 496353 98431", "CREDIT_CARD")])]
    rows += [(f"Host 10.1.2.{i} is up", [(f"10.1.2.{i}", "IP_ADDRESS")]) for i in range(5)]
    rows += [("From 10.9.8.7 to 10.9.8.6", [("10.9.8.7", "IP_ADDRESS"), ("10.9.8.6", "IP_ADDRESS")])]
    rows += [(f"Date of birth: 0{i + 1}/04/1971", [(f"0{i + 1}/04/1971", "DATE_OF_BIRTH")]) for i in range(6)]
    rows += [(f"The PIN code is 56000{i}.", [(f"56000{i}", "ADDRESS")]) for i in range(8)]
    rows += [(f"Item {i} of the agenda was read.", []) for i in range(18)]
    return [(i, t, e) for i, (t, e) in enumerate(rows)]


def test_metric_floors_on_own_corpus(spark):
    df = spark.createDataFrame(labelled_corpus(), SENTENCES)
    done = evaluate(df)
    assert done.corpus.first() == (87, 69, 18, 74)
    spans = {r.category: r for r in done.spans.collect()}
    for category, tp in (("CREDIT_CARD", 5), ("DATE_OF_BIRTH", 6), ("IP_ADDRESS", 7), ("PHONE", 8), ("SSN", 5), ("EMAIL", 9)):
        assert (spans[category].tp, spans[category].fp) == (tp, 0)
    assert spans["CREDIT_CARD"].fn == 1
    assert done.sentence.first().accuracy > 0.95
    assert spans["ALL"].precision > 0.6 and spans["ALL"].recall > 0.7


def test_long_tables_are_not_sent_through_the_driver(spark):
    """Generated rows look few to the planner; no join of them may broadcast a side."""
    sentences = spark.range(40).select(
        F.expr("inline(array(named_struct('sent_id', id * 2, 'text', concat('a', id)), named_struct('sent_id', id * 2 + 1, 'text', 'b')))")
    )
    gold = sentences.where("sent_id % 3 = 0").select("sent_id", F.expr("0 AS start"), F.expr("1 AS `end`"), F.lit("EMAIL").alias("category"))
    found = sentences.where("sent_id % 2 = 0").select(
        "sent_id", F.expr("0 AS start"), F.expr("1 AS `end`"), F.lit("EMAIL").alias("entity_type"),
        F.expr("substring(text, 1, 1) AS original_text"), F.lit(0.5).alias("score"),
    )
    counts = {}
    for name in ("false_positives", "false_negatives", "sentence_flags"):
        made = getattr(ev, name)(sentences, gold, found)
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString(), name
        counts[name] = made.count()
    assert counts == {"false_positives": 26, "false_negatives": 13, "sentence_flags": 80}
