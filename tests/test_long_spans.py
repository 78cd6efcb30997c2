"""Spans in long tables resolve as they do inside a row."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions.columns import SPAN
from inkveil.operators import long_spans
from inkveil.operators.detect import resolve

LONG = "doc long, part string, entity_type string, original_text string, start int, end int, score double"


@pytest.mark.parametrize("block, crowd", [(64, 1), (64, 8), (4096, 2), (8, 3)])
def test_equals_resolution_in_the_row(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(long_spans, "BLOCK_CHARS", block)
    rng = random.Random(block * crowd)
    rows = []
    for doc, part in [(1, "a"), (1, None), (None, "a"), (2, "b")]:
        for _ in range(60 * crowd):
            start = rng.randrange(2000)
            end = start + rng.choice([1, 3, 9, 9, 30, 200])
            rows.append((doc, part, rng.choice(["PERSON", "ORG", "SSN", "UNKNOWN"]), f"v{start % 7}", start, end, rng.choice([0.2, 0.5, 0.7, 0.7])))
    rows += rows[:50]  # both detectors found these
    table = spark.createDataFrame(rows, LONG).repartition(5)
    got = sorted(map(repr, long_spans.resolve_long(table, ["doc", "part"], min_score=0.4).collect()))
    arrays = table.where("score >= 0.4").groupBy("doc", "part").agg(
        F.collect_list(F.struct("entity_type", "original_text", "start", "end", "score")).cast(f"array<{SPAN}>").alias("s")
    )
    wanted = sorted(map(repr, arrays.select("doc", "part", F.expr(f"inline({resolve('s')})")).collect()))
    assert got == wanted and len(got) > 20


def test_no_cluster_reaches_past_a_gap(spark, monkeypatch):
    monkeypatch.setattr(long_spans, "BLOCK_CHARS", 16)
    rows = [(1, "a", "SSN", "x", at, at + 10, 1.0) for at in range(0, 100_000, 10)]  # one hot text whose spans touch
    table = spark.createDataFrame(rows, LONG)
    found = long_spans.clusters(table, ["doc", "part"])
    assert found.groupBy("text_", "cluster_").count().agg(F.max("count")).first()[0] == 1
    assert long_spans.resolve_long(table, ["doc", "part"], labels={"SSN": "SSN"}).count() == len(rows)


def test_odd_spans(spark):
    rows = [(1, "a", "SSN", "x", None, 5, 1.0), (1, "a", "SSN", "x", 5, None, 1.0), (1, "a", "SSN", "x", 0, 5, None), (1, "a", None, None, 0, 5, 1.0)]
    table = spark.createDataFrame(rows, LONG)
    assert long_spans.resolve_long(table, ["doc", "part"]).count() == 0
    assert long_spans.resolve_long(table.limit(0), ["doc", "part"]).count() == 0
