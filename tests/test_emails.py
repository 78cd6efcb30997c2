"""Addresses found around each sign are those of the pattern, in linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from inkveil.functions import fixed_values as fixed
from inkveil.functions.columns import let
from inkveil.functions.emails import email_matches
from inkveil.functions.matching import dialect, find_all, locate_all
from inkveil.operators.detect import detect

FOUND = f"CASE WHEN contains(text, '@') THEN {email_matches('text')} END"
PATTERN = dialect(fixed.EMAIL)
WANTED = let(find_all("text", PATTERN), lambda f: f"CASE WHEN size({f}) > 0 THEN {locate_all('text', PATTERN, f)} END")
FIXED = [
    "ann@x.org", "a@b.com@c.org", "a@b.com-x@c.org", "@", "@@", "a@", "@b.com", "a@b", "-a@b.co", "é-a@b.co", "éa.b@b.co", "éa@b.co", "--@b.co",
    "a@b.c1 a@b.co1", "a@b.co.uk.", "a@b.com.@c.org", "x a@b.com@b.com@b.com@b.com y", "́a@b.co", "ſ@K.coſ", "a@b.co\nc@d.org", "😀a@b.co",
    "a_@_b.co", "a@b..co", "a@-.co", "%@b.co", "a%@b.co c", "A@B.CO", "a@b.co@", "a@.co", "_@b.co@x.org", "1@1.aa",
]


@pytest.fixture(scope="module")
def rows(spark):
    chance = random.Random(8)
    made = ["".join(chance.choices("ab1._-%+@@@@  éſ\n.c", k=chance.randrange(40))) for _ in range(6000)]
    parts = ["a@b.com", "@", "-", ".", "x", " ", "é", "@c.org", "b.co", "_", "1", "ab.cd"]
    made += ["".join(chance.choices(parts, k=chance.randrange(300 if i % 50 == 0 else 14))) for i in range(6000)]
    return spark.createDataFrame([(t,) for t in FIXED + made], "text string").repartition(8)


def test_same_matches_as_the_pattern(rows):
    empty = "coalesce({}, cast(array() AS array<struct<value:string,start:int,end:int>>))"
    both = rows.select("text", F.expr(empty.format(FOUND)).alias("found"), F.expr(empty.format(WANTED)).alias("wanted"))
    wrong = both.where("found <> wanted").limit(5).collect()
    assert not wrong, wrong
    assert both.agg(F.sum(F.size("found"))).first()[0] > 3000


def seconds(spark, text):
    df = spark.createDataFrame([(text,)], "text string").select(F.expr(FOUND).alias("f"))
    best = 9e9
    for _ in range(3):
        begin = time.perf_counter()
        df.collect()
        best = min(best, time.perf_counter() - begin)
    return best


@pytest.mark.parametrize("make", [lambda n: "a." * n + " x@", lambda n: "a." * n + "@x", lambda n: "a@b.co" * n, lambda n: "@" * n, lambda n: "x@" + "a." * n])
def test_a_long_line_takes_linear_time(spark, make):
    short, long = (seconds(spark, make(n)) for n in (100_000, 200_000))
    assert long < 2.6 * short + 0.3, (short, long)


def test_the_rule_uses_it(spark):
    text = "a." * 50_000 + " mail ann.b@x.org, twice: c@d.com@e.org"
    found = detect(spark.createDataFrame([(text,)], "text string")).select(F.explode("entities").alias("e")).where("e.entity_type = 'EMAIL'")
    assert [(r.e.original_text, text[r.e.start : r.e.end]) for r in found.collect()] == [(v, v) for v in ("ann.b@x.org", "c@d.com")]
