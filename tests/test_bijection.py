"""Numbers keep their form, never meet and can be restored."""

import pytest
from pyspark.sql import functions as F

from inkveil.functions import bijection, validators as v
from inkveil.functions.columns import quote
from inkveil.functions.replacements import replacement
from inkveil.operators.mapping import mapping_of
from inkveil.plans.redact import redact

SHAPES = {
    "SSN": "concat(lpad(cast(if(id % 899 + 1 = 666, 667, id % 899 + 1) AS STRING), 3, '0'), '-', lpad(cast(id % 99 + 1 AS STRING), 2, '0'), '-',"
    " lpad(cast(id % 9999 + 1 AS STRING), 4, '0'))",
    "PHONE": "CASE id % 7 WHEN 0 THEN concat('+91 ', 6000000000 + id) WHEN 1 THEN concat('022-', 20000000 + id) WHEN 2 THEN concat('1800-', 100 + id % 900, '-', 1000 + id DIV 900)"
    " WHEN 3 THEN concat('+1 (', 200 + id % 700, ') 555-', 1000 + id DIV 700) WHEN 4 THEN cast(9000000000 + id AS STRING)"
    " WHEN 5 THEN concat('+91', 8000000000 + id) ELSE concat('91', 7000000000 + id) END",
}


@pytest.mark.parametrize("category, valid", [("SSN", v.valid_ssn), ("PHONE", None)])
def test_distinct_valid_and_restored(spark, category, valid):
    rows = spark.range(20_000).select(F.lit(category).alias("entity_type"), F.expr(SHAPES[category]).alias("original_text"))
    made = mapping_of(rows, salt="s", distinct=True)
    made = made.withColumn("back", F.expr(bijection.original_of("entity_type", "replacement", "s")))
    made = made.withColumn("form", F.regexp_replace("replacement", "[0-9]", "0") == F.regexp_replace("original_text", "[0-9]", "0"))
    n, replacements, restored, form, same = made.agg(
        F.count("*"), F.countDistinct("replacement"), F.count_if(F.col("back") == F.col("original_text")), F.count_if("form"),
        F.count_if(F.col("replacement") == F.col("original_text")),
    ).first()
    assert n == replacements == restored == form and n > 15_000 and same < 5
    if valid:
        assert made.where(f"NOT {valid('replacement')}").count() == 0
    other = mapping_of(rows, salt="t", distinct=True).withColumnRenamed("replacement", "other")
    assert made.join(other, ["entity_type", "original_text"]).where("replacement = other").count() < 5


def test_cards(spark):
    """All card numbers of a range: distinct replacements of the same form with right check digits."""
    body = "concat('4', lpad(cast(id * 7919 AS STRING), 11, '0'))"
    rows = spark.range(3000).select(F.explode(F.array(*(F.expr(f"concat({body}, '{d}')") for d in range(10)))).alias("c"))
    rows = rows.where(v.valid_card("c")).select(F.expr("concat(substring(c, 1, 4), ' ', substring(c, 5, 9))").alias("c"))
    made = rows.select("c", F.expr(bijection.credit_card("c", "s")).alias("r"))
    made = made.withColumn("back", F.expr(bijection.credit_card("r", "s", inverse=True)))
    n, distinct, valid, restored = made.agg(
        F.count("*"), F.countDistinct("r"), F.count_if(F.expr(v.valid_card("r"))), F.count_if(F.col("back") == F.col("c"))
    ).first()
    assert n == distinct == valid == restored == 3000
    assert made.where("NOT r RLIKE '^4[0-9]{3} [0-9]{9}$'").count() == 0


def test_whole_domain_is_permuted(spark):
    """Every number of six digits behind a prefix is reached once."""
    rows = spark.range(1_000_000).select(F.expr("concat('+44 ', lpad(cast(id AS STRING), 6, '0'))").alias("p"))
    assert rows.select(F.expr(bijection.phone("p", "s")).alias("r")).distinct().count() == 1_000_000


@pytest.mark.parametrize("category, value", [("SSN", "000-12-3456"), ("CREDIT_CARD", "4111 1111 1111 1112"), ("PHONE", "12345"), ("PHONE", "+91 ٩٨١٢٣٤٥٦٧٨"), ("PHONE", "")])
def test_what_is_no_such_number_is_drawn(spark, category, value):
    drawn, permuted = (F.expr(replacement(quote(category), quote(value), distinct=d)) for d in (False, True))
    a, b = spark.range(1).select(drawn, permuted).first()
    assert a == b is not None and a != value


def test_redaction_with_distinct_numbers(spark):
    rows = spark.createDataFrame([(1, "SSN: 123-45-6789 or 123-45-6780")], "i int, text string")
    first, second = redact(rows, distinct=True).first().entities
    assert first.replacement != second.replacement and first.replacement != "123-45-6789"
