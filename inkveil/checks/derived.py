"""Labelled sentences derived from ``customer``, for categories that the given
text tables lack.

Every expression below is read alike by Spark SQL and by DuckDB, so both
sides of a check start from the same text.  ``k`` is ``c_custkey``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.sources.paragraphs import body_paragraphs
from inkveil.sources.tables import read_table


def _padded(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS STRING), {width}, '0')"


_LETTERS = "translate(CAST(k AS STRING), '0123456789', 'abcdefghij')"
_FIRST = (
    "CASE k % 6 WHEN 0 THEN 'Maya' WHEN 1 THEN 'Rohan' WHEN 2 THEN 'Elena' WHEN 3 THEN 'Omar'"
    " WHEN 4 THEN 'Ingrid' ELSE 'Kenji' END"
)
_LAST = (
    "CASE k % 7 WHEN 0 THEN 'Iyer' WHEN 1 THEN 'Stone' WHEN 2 THEN 'Novak' WHEN 3 THEN 'Haddad'"
    " WHEN 4 THEN 'Berg' WHEN 5 THEN 'Mori' ELSE 'Quist' END"
)
_DATE = (
    f"CASE k % 5 WHEN 0 THEN {_padded('1 + k % 28', 2)} || '/' || {_padded('1 + k % 12', 2)} || '/' || CAST(1950 + k % 50 AS STRING)"
    f" WHEN 1 THEN CAST(1950 + k % 50 AS STRING) || '-' || {_padded('1 + k % 12', 2)} || '-' || {_padded('1 + k % 28', 2)}"
    f" WHEN 2 THEN 'March ' || CAST(1 + k % 28 AS STRING) || ', ' || CAST(1950 + k % 50 AS STRING)"
    f" WHEN 3 THEN CAST(1 + k % 28 AS STRING) || ' April ' || CAST(1950 + k % 50 AS STRING)"
    f" ELSE {_padded('1 + k % 28', 2)} || '-Oct-' || CAST(1950 + k % 50 AS STRING) END"
)
_CARD = _padded("(k * 104729 + 7) % 1000000000000000", 15)
_PHONE = (
    f"CASE k % 6 WHEN 0 THEN '+91 20 4505' || {_padded('k % 10000', 4)}"
    f" WHEN 1 THEN '022-6' || {_padded('k % 10000000', 7)}"
    f" WHEN 2 THEN '9' || {_padded('(k * 7919) % 1000000000', 9)}"
    f" WHEN 3 THEN '1800-' || {_padded('k % 1000', 3)} || '-' || {_padded('(k * 3) % 10000', 4)}"
    f" WHEN 4 THEN '+1-' || CAST(200 + k % 700 AS STRING) || '-555-' || {_padded('k % 10000', 4)}"
    f" ELSE '(' || CAST(200 + k % 700 AS STRING) || ') 555-' || {_padded('k % 10000', 4)} END"
)
_EMAIL = "'user' || CAST(k AS STRING) || '@mail' || CAST(k % 9 AS STRING) || '.example.org'"
_SUFFIX = (
    "CASE k % 5 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' Pvt. Ltd.' WHEN 2 THEN ' LLP'"
    " WHEN 3 THEN ' Technologies' ELSE ' Inc.' END"
)
_ADDRESS = (
    "CASE k % 4 WHEN 0 THEN 'Plot No. ' || CAST(k AS STRING) || ', Mill Area, Town'"
    " WHEN 1 THEN CAST(4 + k % 16 AS STRING) || 'th Floor'"
    " WHEN 2 THEN 'Sector ' || CAST(k % 90 AS STRING)"
    " ELSE 'PIN code ' || CAST(100000 + (k * 13) % 800000 AS STRING) END"
)
_IP = "CAST(k % 300 AS STRING) || '.' || CAST(k % 256 AS STRING) || '.' || CAST((k * 3) % 256 AS STRING) || '.' || CAST(k % 200 AS STRING)"

# (text, labelled value or NULL, how often it is labelled, category)
RECIPES = [
    (
        f"CASE WHEN k % 8 = 3 THEN 'Ratio 3@' || CAST(k AS STRING) || ' is no address'"
        f" WHEN k % 5 = 0 THEN 'Send to ' || {_EMAIL} || ' and cc ' || {_EMAIL}"
        f" ELSE 'Please write: ' || {_EMAIL} || ' today' END",
        f"CASE WHEN k % 8 <> 3 THEN {_EMAIL} END", "CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END", "EMAIL",
    ),
    (f"'Call ' || {_PHONE} || ' now'", _PHONE, "1", "PHONE"),
    (
        f"'Staff file with SSN ' || {_padded('k % 1000', 3)} || '-' || {_padded('k % 100', 2)} || '-' || {_padded('(k * 7) % 10000', 4)} || ' kept'",
        f"CASE WHEN k % 1000 <> 0 AND k % 1000 <> 666 AND k % 100 <> 0 AND (k * 7) % 10000 <> 0 THEN"
        f" {_padded('k % 1000', 3)} || '-' || {_padded('k % 100', 2)} || '-' || {_padded('(k * 7) % 10000', 4)} END",
        "1", "SSN",
    ),
    (
        f"CASE WHEN k % 50 = 0 THEN 'Run 12345' || {_CARD} || ' ends'"
        f" WHEN k % 2 = 0 THEN 'Card 4' || substring({_CARD}, 1, 3) || ' ' || substring({_CARD}, 4, 4) || ' ' || substring({_CARD}, 8, 4) || ' ' || substring({_CARD}, 12, 4) || ' used'"
        f" ELSE 'Paid by 4' || {_CARD} || ' in May' END",
        "CAST(NULL AS STRING)", "0", "CREDIT_CARD",
    ),
    (
        f"CASE WHEN k % 10 = 7 THEN 'Version 3.' || CAST(k % 20 AS STRING) || '.' || CAST(k % 30 AS STRING) || ' is out'"
        f" ELSE 'Host ' || {_IP} || ' is up' END",
        f"CASE WHEN k % 10 <> 7 AND k % 300 <= 255 THEN {_IP} END", "1", "IP_ADDRESS",
    ),
    (
        f"CASE WHEN k % 10 = 0 THEN 'Date of birth' || repeat(' x', 65) || ' ' || {_DATE}"
        f" WHEN k % 2 = 0 THEN 'Date of birth: ' || {_DATE} ELSE 'Meeting held on ' || {_DATE} END",
        f"CASE WHEN k % 10 <> 0 AND k % 2 = 0 THEN {_DATE} END", "1", "DATE_OF_BIRTH",
    ),
    (
        f"CASE WHEN k % 7 = 6 THEN 'Revenue increased by ' || CAST(k AS STRING)"
        f" WHEN k % 7 = 5 THEN 'The firm Zeta' || {_LETTERS} || ' Limited filed'"
        f" ELSE '2024: Firm' || {_LETTERS} || {_SUFFIX} || ', 2023' END",
        f"CASE WHEN k % 7 = 5 THEN 'Zeta' || {_LETTERS} || ' Limited' WHEN k % 7 < 5 THEN 'Firm' || {_LETTERS} || {_SUFFIX} END",
        "1", "ORGANIZATION",
    ),
    (
        f"'Office at ' || {_ADDRESS} || '.'",
        f"CASE WHEN k % 4 = 3 THEN CAST(100000 + (k * 13) % 800000 AS STRING) ELSE {_ADDRESS} END", "1", "ADDRESS",
    ),
    (
        f"CASE k % 4 WHEN 0 THEN 'Contact Person: ' || {_FIRST} || ' ' || {_LAST} || ', since 2020'"
        f" WHEN 1 THEN {_FIRST} || ' ' || {_LAST} || ' Company Secretary'"
        f" WHEN 2 THEN 'Promoter: Chief Manager, since 2020'"
        f" ELSE 'Name: ' || {_FIRST} || ' ' || {_LAST} || ' (born ' || CAST(1950 + k % 50 AS STRING) || '-02-03)' END",
        f"CASE WHEN k % 4 <> 2 THEN {_FIRST} || ' ' || {_LAST} END", "1", "PERSON",
    ),
    (
        "CASE k % 5 WHEN 0 THEN 'Turnover came to 98,76,54,321 in FY 2023'"
        " WHEN 1 THEN 'As told in part 91 above' WHEN 2 THEN 'Parcel order 1277304412'"
        " WHEN 3 THEN '' ELSE 'Sheet ' || CAST(k AS STRING) || ' in this bundle' END",
        "CAST(NULL AS STRING)", "0", "NONE",
    ),
]


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sent_id, text, entities ARRAY<STRUCT<entity_text, category>>``."""
    pair = "struct<entity_text:string,category:string>"
    rows = ", ".join(
        f"named_struct('sent_id', k * 10 + {j}, 'text', {text}, 'entities', CASE WHEN {value} IS NULL"
        f" THEN cast(array() AS array<{pair}>)"
        f" ELSE array_repeat(named_struct('entity_text', {value}, 'category', '{category}'), CAST({times} AS INT)) END)"
        for j, (text, value, times, category) in enumerate(RECIPES)
    )
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return customers.select(F.expr(f"inline(array({rows}))"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs of ``documents`` and all derived sentences:
    ``src, id, para, text``."""
    documents = body_paragraphs(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return documents.select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.col("para_id").alias("para"), "text").unionAll(
        sentences(spark, sf_dir).select(F.lit("sent"), "sent_id", F.lit(0), "text")
    )
