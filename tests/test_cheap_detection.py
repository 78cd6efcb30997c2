"""What keeps detection cheap: no wasted patterns, values named without arrays, the same spans as the plain form."""

import dataclasses

from pyspark.sql import functions as F

from inkveil.functions.columns import let
from inkveil.functions.matching import CUT, dialect, find_all, locate_all
from inkveil.operators import rules as r
from inkveil.operators.detect import entities_sql

TEXTS = [
    "born 12/03/1981", "seen 12/03/1981", "call 091 22 45051234", "\U0001d7d9 +91 20 45051234", f"{CUT} born 1981-02-03",
    "SSN 123-45-6789 and 1800-123-4567", "a 022-61234567 b (212) 555-0100 c +1-212-555-0100", None, "", "9876543210",
    "PIN code 123456 DoB: 3 April 1990", "ſ Date of birth " + "x " * 40 + "12-Oct-1990", "Name: Anna Berg, Firmaa Pvt. Ltd.",
]


def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")


def test_let_names_a_value_without_making_arrays(spark):
    assert "transform" not in let("id + 1", lambda v: f"{v} * {v}")
    nested = let("id + 1", lambda v: let(f"{v} * 2", lambda w: f"named_struct('v', {v}, 'w', {w})"))
    assert [tuple(x.n) for x in spark.range(2).select(F.expr(nested).alias("n")).collect()] == [(1, 2), (2, 4)]


def test_literals_hide_no_span(spark):
    """Every rule finds what it finds without its literals and gate."""
    rules = r.default_rules()
    opened = [dataclasses.replace(x, any_of=x.any_of if x.locate else (), gate="") for x in rules]
    found = rows(spark).select(*[F.expr(entities_sql("text", x)).alias(n) for n, x in (("gated", rules), ("open", opened))]).collect()
    assert [x.gated for x in found] == [x.open for x in found] and sum(len(x.open) for x in found) > 10
    by_name = {x.name: x for x in rules}
    assert all(by_name[n].any_of for n in ("birth_date", "ssn", "phone_india", "phone_std", "phone_toll_free", "phone_international"))


def test_one_match_is_placed_as_several_are(spark):
    pattern = dialect(r"\d+")
    found = find_all("text", pattern)
    texts = spark.createDataFrame([("\U0001d11e x 12 y",), (f"a{CUT}b 12",), ("12 34",), ("7",)], "text string")
    placed = texts.select("text", F.expr(locate_all("text", pattern, found)).alias("m")).collect()
    assert all(x.text[m.start : m.end] == m.value for x in placed for m in x.m) and [len(x.m) for x in placed] == [1, 1, 2, 1]


def test_rules_of_one_label_may_differ_in_context(spark):
    near = r.Rule("near", "TICKET", r"T\d", 0.5, context=("ticket",))
    far = r.Rule("far", "TICKET", r"X\d", 0.5, context=("parcel",))
    texts = spark.createDataFrame([("ticket T1",), ("ticket X1",)], "text string")
    assert not r._told_by_label([near, far]) and r._told_by_label(r.default_rules())
    spans = texts.select(F.expr(r.spans_of("text", [near, far])).alias("s")).collect()
    assert [[(s.entity_type, s.score) for s in x.s] for x in spans] == [[("TICKET", 0.85)], [("TICKET", 0.5)]]
