"""Every registered query, next to its SQL twin."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkveil.checks import oracle as o
from inkveil.checks.derived import sentences, texts
from inkveil.checks.oracle_values import CHAINED, REDACTED, VALUES, distinct_numbers, replaced
from inkveil.functions import bijection, fixed_values as fixed, validators as v
from inkveil.functions.columns import is_blank, let, segments
from inkveil.functions.replacements import DEFAULT_SALT, with_replacements
from inkveil.operators import dictionary, evaluate as ev, mapping as m, summaries as sm
from inkveil.operators.detect import (
    at_least, detect, drop_contained, explode_entities, in_reading_order, keep_earliest, rename_labels,
)
from inkveil.operators.long_spans import resolve_long
from inkveil.operators.rules import Rule, bounded_organization_rule, default_rules, rules_named, spans_of
from inkveil.plans.evaluation import evaluate
from inkveil.plans import runs
from inkveil.plans.redact import redact, redact_documents
from inkveil.sources import paragraphs as par, sinks, uploads
from inkveil.sources.tables import read_table
from inkveil.streaming.mapping_stream import MAPPING, mapping_stream
from inkveil.streaming.redact_stream import arriving_documents, redact_stream, redact_upload_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["src", "id", "para"]
PLACE = [*KEYS, "start", "end"]
SPAN_COLUMNS = 'src, id, para, s AS start, CAST(e AS INT) AS "end"'


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, id, para, text`` of the documents alone."""
    return par.body_paragraphs(documents(spark, sf_dir), ["doc_id"]).select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.col("para_id").alias("para"), "text"
    )


def found_in(rows: DataFrame, **options) -> DataFrame:
    return explode_entities(detect(rows, **options), drop=["text"])


def raw_spans(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Candidates of some rules, renamed but not resolved."""
    spans = rows.select(*KEYS, F.expr(rename_labels(spans_of("text", rules))).alias("entities"))
    return explode_entities(spans)


# -- flagship ---------------------------------------------------------------
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to paragraphs to entities to counts per category."""
    found = found_in(document_paragraphs(spark, sf_dir))
    return sm.ranked_types(found)


register(
    "flagship_document_types",
    o.with_query(
        "SELECT category AS entity_type, count(*) AS n FROM ents GROUP BY category",
        *o.entities("documents"),
    ),
)(flagship)


# -- scans ------------------------------------------------------------------
@register(
    "S1_document_paragraphs",
    o.with_query("SELECT doc_id, para_id, 'body' AS context, text FROM doc_paras", o.DOC_PARAGRAPHS),
)
def _(spark, sf_dir):
    return par.body_paragraphs(documents(spark, sf_dir), ["doc_id"])


@register(
    "S1_conversation_paragraphs",
    "WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)"
    " SELECT conv_id, turn, unnest(range(len(ls)))::INT AS para_id, 'body' AS context, unnest(ls) AS text FROM l",
)
def _(spark, sf_dir):
    return par.body_paragraphs(read_table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@register(
    "S2_relational_cells",
    "SELECT c_custkey, 0 AS para_id, 'column[c_name]' AS context, c_name AS text FROM customer"
    " UNION ALL SELECT c_custkey, 1, 'column[c_mktsegment]', c_mktsegment FROM customer",
)
def _(spark, sf_dir):
    return par.relational_cells(read_table(spark, sf_dir, "customer"), ["c_custkey"], ["c_name", "c_mktsegment"])


def nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables per order: one of two rows, one whose cell has two lines."""
    key = F.col("o_orderkey").cast("string")
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array(
            F.array(F.array(F.lit("Order"), key), F.array(F.lit("Status"), F.col("o_orderstatus"))),
            F.array(F.array(F.concat(F.lit("Priority\n"), F.col("o_orderpriority")))),
        ).alias("tables"),
    )


@register(
    "S2_table_cells",
    " UNION ALL ".join(
        f"SELECT o_orderkey, {p} AS para_id, '{context}' AS context, {text} AS text FROM orders"
        for p, context, text in [
            (0, "table[0][0,0]", "'Order'"), (1, "table[0][0,1]", "CAST(o_orderkey AS VARCHAR)"),
            (2, "table[0][1,0]", "'Status'"), (3, "table[0][1,1]", "o_orderstatus"),
            (4, "table[1][0,0]", "'Priority'"), (5, "table[1][0,0]", "o_orderpriority"),
        ]
    ),
)
def _(spark, sf_dir):
    return par.table_cells(nested_tables(spark, sf_dir), ["o_orderkey"])


@register(
    "S3_upload_checks",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'wrong extension' WHEN n_chars * 20000 > 26214400 THEN 'too large'"
    " WHEN doc_id % 7 = 3 THEN 'not a docx file' END AS reason FROM documents",
)
def _(spark, sf_dir):
    """Files made of the documents: every fifth misnamed, every seventh without
    the right first bytes, long ones over the size limit."""
    files = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("concat('in/', doc_id, CASE doc_id % 5 WHEN 1 THEN '.pdf' WHEN 2 THEN '.DOCX' ELSE '.docx' END)").alias("path"),
        (F.col("n_chars") * 20000).alias("length"),
        F.expr("concat(CASE WHEN doc_id % 7 = 3 THEN X'50000304' ELSE X'504B0304' END, encode(text, 'UTF-8'))").alias("content"),
    )
    return uploads.check_uploads(files).select("doc_id", "reason")


_DOCX_XML = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
)


def _docx(lines: list[str], cells: list[str]) -> bytes:
    p = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr></w:tbl>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", _DOCX_XML.format("".join(map(p, lines)) + table))
    return buffer.getvalue()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in uploads.in_slices(batches):
        ids, bodies, langs, origins = (column.to_pylist() for column in batch.columns)
        packed = [_docx(t.split("\n"), [a, b]) for t, a, b in zip(bodies, langs, origins)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"in/{i}.docx" for i in ids]), pa.array(packed, pa.binary())], names=["path", "content"]
        )


_WHOLE_DOCUMENT = (
    "SELECT doc_id, para_id, 'body' AS context, text FROM doc_paras"
    " UNION ALL SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT), 'table[0][0,0]', lang FROM documents"
    " UNION ALL SELECT doc_id, CAST(len(string_split(text, chr(10))) + 1 AS INT), 'table[0][0,1]', source FROM documents"
)


@register("S1_S2_whole_document", o.with_query(_WHOLE_DOCUMENT, o.DOC_PARAGRAPHS))
def _(spark, sf_dir):
    """Body first, then the cells of one table that holds the other columns."""
    documents = read_table(spark, sf_dir, "documents")
    tables = F.array(F.array(F.array("lang", "source"))).alias("tables")
    return par.document_paragraphs(documents.select("doc_id", "text", tables), ["doc_id"])


@register(
    "S4_broken_files",
    "SELECT doc_id, doc_id % 3 = 0 AS broken, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE len(string_split(text, chr(10))) + 2 END AS n_rows"
    " FROM documents",
)
def _(spark, sf_dir):
    """Every third file damaged in the middle: it gives an error row, the others their paragraphs."""
    packed = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").mapInArrow(
        _pack, "path string, content binary"
    )
    number = F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("bigint")
    damaged = F.expr("concat(substring(content, 1, 60), X'FFFFFFFFFFFFFFFF', substring(content, 69))")
    files = packed.withColumn("content", F.when(number % 3 == 0, damaged).otherwise(F.col("content")))
    return uploads.docx_paragraphs(files).groupBy(number.alias("doc_id")).agg(
        F.max(F.col("error").isNotNull()).alias("broken"), F.count("*").alias("n_rows")
    )


@register("S4_docx_paragraphs", o.with_query(_WHOLE_DOCUMENT, o.DOC_PARAGRAPHS))
def _(spark, sf_dir):
    """Every document packed as a Word file by its task, then read back."""
    files = (
        read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
        .mapInArrow(_pack, "path string, content binary")
    )
    rows = uploads.docx_paragraphs(files).where("error IS NULL")
    number = F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("bigint")
    return rows.select(number.alias("doc_id"), "para_id", "context", "text")


@register(
    "S5_labelled_sentences",
    o.with_query(
        "SELECT sent_id, text, CASE WHEN value IS NULL THEN NULL ELSE CAST(i AS INT) END AS place, value AS entity_text,"
        " CASE WHEN value IS NULL THEN NULL ELSE category END AS category"
        " FROM sentences, LATERAL (SELECT unnest(range(greatest(CASE WHEN value IS NULL THEN 1 ELSE times END, 1))) AS i)",
        o.sentences_cte(),
    ),
)
def _(spark, sf_dir):
    return par.labelled_sentences(sentences(spark, sf_dir))


# -- recognizers ------------------------------------------------------------
RULE_KEYS = {
    "D1_email": "email", "D2_phone_india": "phone_india", "D3_phone_std": "phone_std",
    "D4_phone_mobile": "phone_mobile", "D5_phone_toll_free": "phone_toll_free",
    "D6_phone_international": "phone_international", "D7_phone_us": "phone_us", "D8_ssn": "ssn",
    "D9_credit_card": "credit_card", "D10_ip_address": "ip_address", "D11_birth_date": "birth_date",
    "D12_organization": "organization", "D13_pin_code": "pin_code", "D14_street": "street",
    "D15_person_contact": "person_contact", "D16_person_label": "person_label",
    "D17_person_designation": "person_designation",
}


def _rule_query(rule: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raw_spans(texts(spark, sf_dir), rules_named(rule)).drop("entity_type")

    return query


for _key, _rule in RULE_KEYS.items():
    register(_key, o.rule_query(_rule))(_rule_query(_rule))


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary of nations as places and market segments as organizations."""
    nations = read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("Port "), "n_name").alias("phrase"), F.lit("GPE").alias("entity_type")
    )
    regions = read_table(spark, sf_dir, "region").select(F.col("r_name"), F.lit("LOCATION"))
    return nations.unionAll(regions)


def travel_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence per customer that names its nation and a region."""
    return read_table(spark, sf_dir, "customer").select(
        F.lit("note").alias("src"), F.col("c_custkey").alias("id"), F.lit(0).alias("para"),
        F.expr(
            "concat('Trip ', c_custkey, ' to port  NATION_', c_nationkey, ', then ', CASE c_custkey % 3 WHEN 0 THEN"
            " 'Asia' WHEN 1 THEN 'the Middle-East' ELSE 'europe' END, '; Nation_1 alone')"
        ).alias("text"),
    )


_DICTIONARY_SQL = (
    "WITH n AS (SELECT c_custkey AS id, length('Trip ' || c_custkey || ' to ') AS pos, 'port  NATION_' || c_nationkey AS a,"
    " CASE c_custkey % 3 WHEN 0 THEN 'Asia' WHEN 1 THEN 'Middle-East' ELSE 'europe' END AS b,"
    " CASE c_custkey % 3 WHEN 1 THEN 4 ELSE 0 END AS skip FROM customer)"
    " SELECT 'note' AS src, id, 0 AS para, 'ADDRESS' AS entity_type, a AS original_text, CAST(pos AS INT) AS start,"
    " CAST(pos + length(a) AS INT) AS \"end\", CAST(0.85 AS DOUBLE) AS score FROM n"
    " UNION ALL SELECT 'note', id, 0, 'ADDRESS', b, CAST(pos + length(a) + 7 + skip AS INT),"
    " CAST(pos + length(a) + 7 + skip + length(b) AS INT), 0.85 FROM n"
    " WHERE EXISTS (SELECT 1 FROM region WHERE lower(r_name) = lower(replace(b, '-', ' ')))"
)


@register("D18_dictionary_mentions", _DICTIONARY_SQL)
def _(spark, sf_dir):
    notes = travel_notes(spark, sf_dir)
    named = dictionary.with_mentions(notes, place_names(spark, sf_dir), KEYS)
    return explode_entities(detect(named, rules=[], extra_spans="mentions"), drop=["text", "mentions"])


@register("D18_dictionary_join", _DICTIONARY_SQL)
def _(spark, sf_dir):
    """The same by the join that larger dictionaries take."""
    phrases = dictionary.normalized(place_names(spark, sf_dir))
    named = dictionary.joined_mentions(travel_notes(spark, sf_dir), phrases, KEYS)
    return explode_entities(detect(named, rules=[], extra_spans="mentions"), drop=["text", "mentions"])


_LONG_NAMES = "concat_ws(' ', 'Old', {part}, 'Market', 'Square', 'and', 'Fish', 'Quay')"


def long_names(spark, sf_dir):
    """Eight-word phrases made from the regions' names; each is listed twice."""
    regions = read_table(spark, sf_dir, "region").selectExpr(f"{_LONG_NAMES.format(part='r_name')} AS phrase", "'LOCATION' AS entity_type")
    return regions.union(regions)


def long_notes(spark, sf_dir, key: str):
    """Notes that name one phrase of ``long_names``, blanks doubled."""
    text = f"concat('Meet at ', replace({_LONG_NAMES.format(part='r_name')}, ' ', '  '), ', ', n_name)"
    nations = read_table(spark, sf_dir, "nation").join(F.broadcast(read_table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
    return nations.selectExpr("'note' AS src", f"{key} AS id", "0 AS para", f"{text} AS text")


def _long_sql(key: str) -> str:
    name = _LONG_NAMES.format(part="r_name")
    return (
        f"SELECT 'note' AS src, {key} AS id, 0 AS para, replace({name}, ' ', '  ') AS original_text, 8 AS start,"
        f" 8 + length(replace({name}, ' ', '  ')) AS \"end\" FROM nation JOIN region ON n_regionkey = r_regionkey"
    )


def _named(notes: DataFrame) -> DataFrame:
    return explode_entities(detect(notes, rules=[], extra_spans="mentions")).select("src", "id", "para", "original_text", "start", "end")


@register("D18_long_phrases", _long_sql("n_nationkey"))
def _(spark, sf_dir):
    return _named(dictionary.with_mentions(long_notes(spark, sf_dir, "n_nationkey"), long_names(spark, sf_dir), KEYS))


@register("D18_repeated_keys", _long_sql("CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END"))
def _(spark, sf_dir):
    """The join, with keys that repeat and keys that are NULL."""
    notes = long_notes(spark, sf_dir, "CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END")
    return _named(dictionary.joined_mentions(notes, dictionary.normalized(long_names(spark, sf_dir)), KEYS))


# Twelve words on a line of an order; its phrase is the first 3 to 12 of them.
_LINE_WORDS = (
    "concat_ws(' ', p_name, lower(p_type), 'item', l_partkey, 'from', l_suppkey, 'line', l_linenumber, 'for', l_orderkey, 'today')"
)
_LINE_LENGTH = "3 + (l_orderkey + l_linenumber) % 10"


def line_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase per order line: a dictionary that grows with the data, full of phrases that begin others."""
    words = F.split(F.expr(_LINE_WORDS), " ")
    phrase = F.array_join(F.slice(words, 1, F.expr(f"CAST({_LINE_LENGTH} AS INT)")), " ")
    return _lines(spark, sf_dir).select(phrase.alias("phrase"), F.lit("ORG").alias("entity_type"))


def line_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per order that lists its lines."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.expr(_LINE_WORDS).alias("w")))), lambda x: x.w), " and ")
    return _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.concat(F.lit("order of "), listed).alias("text")).select(
        F.lit("note").alias("src"), F.col("l_orderkey").alias("id"), F.lit(0).alias("para"), "text"
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(
        parts, F.expr("l_partkey = p_partkey")
    )


@register(
    "D18_phrase_trie",
    f"WITH l AS (SELECT l_orderkey, l_linenumber, {_LINE_WORDS} AS w, {_LINE_LENGTH} AS n FROM lineitem JOIN part ON l_partkey = p_partkey),"
    " phrases AS (SELECT DISTINCT array_to_string(string_split(w, ' ')[1:n], ' ') AS phrase FROM l),"
    " notes AS (SELECT l_orderkey AS id, string_split('order of ' || string_agg(w, ' and ' ORDER BY l_linenumber, w), ' ') AS t"
    " FROM l GROUP BY l_orderkey),"
    " places AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM notes),"
    " grams AS (SELECT id, t, i, unnest(range(3, 13)) AS k FROM places),"
    " found AS (SELECT id, t, i, array_to_string(t[i:i + k - 1], ' ') AS g FROM grams WHERE i + k - 1 <= len(t))"
    " SELECT 'note' AS src, id, 0 AS para, g AS original_text,"
    " CAST(length(array_to_string(t[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS INT) AS start,"
    " CAST(length(array_to_string(t[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END + length(g) AS INT) AS \"end\""
    " FROM found JOIN phrases ON g = phrase",
)
def _(spark, sf_dir):
    """Every listed phrase at every place, those inside others too."""
    phrases = dictionary.normalized(line_phrases(spark, sf_dir))
    named = dictionary.joined_mentions(line_notes(spark, sf_dir), phrases, KEYS)
    return explode_entities(named, "mentions", drop=["text"]).select("src", "id", "para", "original_text", "start", "end")


# -- validators and filters -------------------------------------------------
def unchecked(spark: SparkSession, sf_dir: str, rule: str, check: str) -> DataFrame:
    """Matches of a rule's pattern before its validator, with the verdict."""
    plain = rules_named(rule)[0]
    bare = Rule(plain.name, plain.label, plain.pattern, plain.score, gate=plain.gate, any_of=plain.any_of)
    found = raw_spans(texts(spark, sf_dir), [bare])
    return found.select(*PLACE, "original_text", F.expr(check).alias("valid"))


def _unchecked_sql(rule: str) -> str:
    twin = o.TWINS[rule]
    return o.with_query(
        f"SELECT {SPAN_COLUMNS}, v AS original_text, ({twin.check}) AS valid FROM picked",
        o.TEXTS["all"], o.candidates([rule]),
    )


@register("V1_ssn_validity", _unchecked_sql("ssn"))
def _(spark, sf_dir):
    return unchecked(spark, sf_dir, "ssn", v.valid_ssn("original_text"))


@register("V2_card_luhn", _unchecked_sql("credit_card"))
def _(spark, sf_dir):
    return unchecked(spark, sf_dir, "credit_card", v.valid_card("original_text"))


@register("V3_ipv4_octets", _unchecked_sql("ip_address"))
def _(spark, sf_dir):
    return unchecked(spark, sf_dir, "ip_address", v.valid_ipv4("original_text"))


@register("V4_birth_keyword_window", _unchecked_sql("birth_date"))
def _(spark, sf_dir):
    plain = rules_named("birth_date")[0]
    bare = Rule(plain.name, plain.label, plain.pattern, plain.score, gate=plain.gate)
    rows = texts(spark, sf_dir).select(*KEYS, "text", F.expr(spans_of("text", [bare])).alias("entities"))
    found = explode_entities(rows)
    near = let(segments("text"), lambda parts: v.near_birth_keyword(parts, "start", "`end`"))
    return found.select(*PLACE, "original_text", F.expr(near).alias("valid"))


@register("V5_person_title_words", _unchecked_sql("person_label"))
def _(spark, sf_dir):
    return unchecked(spark, sf_dir, "person_label", v.plausible_person("original_text"))


@register(
    "V6_minimum_score",
    o.with_query(
        f"SELECT {SPAN_COLUMNS}, category AS entity_type, v AS original_text, score FROM ents",
        *o.entities("all", min_score=0.9),
    ),
)
def _(spark, sf_dir):
    return found_in(texts(spark, sf_dir), min_score=0.9)


@register(
    "V7_blank_texts",
    o.with_query(
        f"SELECT src, id, para, NOT regexp_matches(text, {o._lit(f'[^{o.S}]')}) AS blank FROM texts", o.TEXTS["all"]
    ),
)
def _(spark, sf_dir):
    return texts(spark, sf_dir).select(*KEYS, F.expr(is_blank("text")).alias("blank"))


_TERM_CASES = (
    "CASE k % 9 WHEN 0 THEN 'SEBI' WHEN 1 THEN 'Fax' WHEN 2 THEN 'q' || CAST(1 + k % 5 AS STRING)"
    " WHEN 3 THEN 'Section' WHEN 4 THEN 'ABC' || CAST(k AS STRING) WHEN 5 THEN 'NATO' WHEN 6 THEN 'Harborline Limited'"
    " WHEN 7 THEN ' Page ' ELSE 'Anna Berg' END"
)


@register(
    "V8_V9_V10_blocked_values",
    f"WITH c AS (SELECT c_custkey AS k FROM customer), t AS (SELECT k, {_TERM_CASES} AS v FROM c)"
    f" SELECT k, category AS entity_type, v AS original_text, {o.BLOCKED} AS blocked"
    " FROM t, (VALUES ('PERSON'), ('ORGANIZATION'), ('ADDRESS')) AS x(category)",
)
def _(spark, sf_dir):
    keys = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    kinds = F.explode(F.array(*[F.lit(c) for c in ("PERSON", "ORGANIZATION", "ADDRESS")]))
    rows = keys.select("k", F.expr(_TERM_CASES).alias("original_text")).withColumn("entity_type", kinds)
    return rows.select("k", "entity_type", "original_text", F.expr(v.blocked_value("entity_type", "original_text")).alias("blocked"))


@register(
    "V11_label_allow_list",
    "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'ADDRESS' WHEN 1 THEN 'SSN' ELSE 'ORGANIZATION' END AS entity_type"
    " FROM customer WHERE c_custkey % 4 <> 3",
)
def _(spark, sf_dir):
    label = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'GPE' WHEN 1 THEN 'US_SSN' WHEN 2 THEN 'ORG' ELSE 'FAC' END")
    span = F.struct(
        label.alias("entity_type"), F.col("c_name").alias("original_text"), F.lit(0).alias("start"),
        F.length("c_name").alias("end"), F.lit(0.85).alias("score"),
    )
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(span).alias("entities"))
    return explode_entities(rows.withColumn("entities", F.expr(rename_labels("entities")))).select("id", "entity_type")


@register(
    "V12_context_boost",
    o.with_query(
        "SELECT category AS entity_type, score, count(*) AS n FROM cand GROUP BY ALL",
        o.TEXTS["all"], o.candidates(o.ALL_RULES),
    ),
)
def _(spark, sf_dir):
    return raw_spans(texts(spark, sf_dir), default_rules()).groupBy("entity_type", "score").agg(F.count("*").alias("n"))


_SUSPECTS = (
    "CASE k % 11 WHEN 0 THEN 'SEBI' WHEN 1 THEN 'Ltd.' WHEN 2 THEN 'section ' || CAST(k AS STRING)"
    " WHEN 3 THEN CAST(k AS STRING) || '.5' WHEN 4 THEN 'FY' || CAST(2000 + k % 20 AS STRING) WHEN 5 THEN 'sebi'"
    " WHEN 6 THEN ' RBI ' WHEN 7 THEN 'Firm ' || CAST(k % 13 AS STRING) ELSE CAST(k % 100 AS STRING) END"
)
_SUSPECT_SQL = " ".join(
    f"WHEN regexp_matches(value, {o._lit(p)}) THEN '{reason}'" for p, reason in fixed.SUSPECT_VALUES
)


@register(
    "V13_suspect_values",
    f"WITH c AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT k, trim({_SUSPECTS}) AS value,"
    " CASE WHEN k % 2 = 0 THEN 'PERSON' ELSE 'ADDRESS' END AS entity_type FROM c),"
    f" f AS (SELECT value, arg_min(entity_type, k) AS entity_type FROM t GROUP BY value)"
    f" SELECT * FROM (SELECT value, entity_type, CASE {_SUSPECT_SQL} END AS reason FROM f) WHERE reason IS NOT NULL",
)
def _(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    values = rows.select(
        "k", F.expr(_SUSPECTS).alias("original_text"),
        F.expr("CASE WHEN k % 2 = 0 THEN 'PERSON' ELSE 'ADDRESS' END").alias("entity_type"),
    )
    return sm.suspect_values(values, ["k"])


# -- combine and resolve ----------------------------------------------------
@register(
    "R1_candidate_union",
    o.with_query(
        f"SELECT {SPAN_COLUMNS}, category AS entity_type, v AS original_text, score FROM cand",
        o.TEXTS["all"], o.candidates(o.ALL_RULES),
    ),
)
def _(spark, sf_dir):
    return raw_spans(texts(spark, sf_dir), default_rules())


_CONTAINED = (
    "(SELECT DISTINCT category, src, id, para, s, e, v, score FROM cand x0) x WHERE NOT EXISTS (SELECT 1 FROM cand y"
    " WHERE y.src = x.src AND y.id = x.id AND y.para = x.para AND y.category = x.category AND y.s <= x.s AND y.e >= x.e"
    " AND y.score >= x.score AND (y.s < x.s OR y.e > x.e OR y.score > x.score))"
)


@register(
    "R2_contained_spans_dropped",
    o.with_query(
        f"SELECT {SPAN_COLUMNS}, category AS entity_type, v AS original_text, score FROM {_CONTAINED}",
        o.TEXTS["all"], o.candidates(o.ALL_RULES),
    ),
)
def _(spark, sf_dir):
    rows = texts(spark, sf_dir).select(*KEYS, F.expr(spans_of("text", default_rules())).alias("raw_"))
    return explode_entities(
        rows.select(*KEYS, F.expr(rename_labels(drop_contained("raw_"))).alias("entities"))
    )


_PHONES = [r for r in o.ALL_RULES if r.startswith("phone") or r in ("ssn", "pin_code", "street", "organization")]


@register(
    "R3_overlap_resolution",
    o.with_query(
        f"SELECT {SPAN_COLUMNS}, category AS entity_type, v AS original_text, score FROM ents",
        o.TEXTS["all"], o.candidates(_PHONES),
        "every AS (SELECT DISTINCT category, src, id, para, s, e, v, score FROM cand)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY src, id, para ORDER BY s, score DESC, e DESC, category) AS r FROM every)",
        "jumps AS (SELECT x.src, x.id, x.para, x.r, min(y.r) AS hop FROM ranked x JOIN ranked y ON x.src = y.src"
        " AND x.id = y.id AND x.para = y.para AND y.s >= x.e GROUP BY ALL)",
        "kept(src, id, para, r) AS (SELECT src, id, para, r FROM ranked WHERE r = 1 UNION ALL SELECT j.src, j.id, j.para, j.hop"
        " FROM kept k JOIN jumps j ON j.src = k.src AND j.id = k.id AND j.para = k.para AND j.r = k.r)",
        "ents AS (SELECT x.* FROM ranked x JOIN kept k ON x.src = k.src AND x.id = k.id AND x.para = k.para AND x.r = k.r)",
    ),
)
def _(spark, sf_dir):
    rows = texts(spark, sf_dir).select(*KEYS, F.expr(rename_labels(spans_of("text", rules_named(*_PHONES)))).alias("raw_"))
    return explode_entities(rows.select(*KEYS, F.expr(keep_earliest(in_reading_order("raw_"))).alias("entities")))


@register(
    "R3_long_spans",
    o.with_query(f"SELECT {SPAN_COLUMNS}, category AS entity_type, v AS original_text, score FROM ents", *o.entities("all")),
)
def _(spark, sf_dir):
    """Spans that two detectors wrote as one long table each, resolved by cluster."""
    rows = texts(spark, sf_dir)
    halves = default_rules()[::2], default_rules()[1::2]
    folder = sinks.shared_folder(spark, "spans")
    for half in halves:
        explode_entities(rows.select(*KEYS, F.expr(spans_of("text", half)).alias("entities"))).write.mode("append").parquet(folder)
    return resolve_long(spark.read.parquet(folder), KEYS)


def _detected_sql(source: str) -> str:
    return o.with_query(
        f"SELECT {SPAN_COLUMNS}, category AS entity_type, v AS original_text, score FROM ents", *o.entities(source)
    )


@register("R4_detect_documents", _detected_sql("documents"))
def _(spark, sf_dir):
    return found_in(document_paragraphs(spark, sf_dir))


@register("R4_detect_sentences", _detected_sql("sentences"))
def _(spark, sf_dir):
    rows = sentences(spark, sf_dir).select(
        F.lit("sent").alias("src"), F.col("sent_id").alias("id"), F.lit(0).alias("para"), "text"
    )
    return found_in(rows)


@register("R4_detect_pages", _detected_sql("pages"))
def _(spark, sf_dir):
    pages = par.body_paragraphs(read_table(spark, sf_dir, "pages"), ["page_id"], "html")
    return found_in(pages.select(F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("para_id").alias("para"), "text"))


@register("R4_detect_conversations", _detected_sql("conversations"))
def _(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    return found_in(turns.select(F.lit("turn").alias("src"), F.col("conv_id").alias("id"), F.col("turn").alias("para"), "text"))


@register(
    "R5_entities_per_paragraph",
    o.with_query(
        "SELECT t.src, t.id, t.para, CAST(count(e.s) AS INT) AS n_entities FROM texts t LEFT JOIN ents e"
        " ON t.src = e.src AND t.id = e.id AND t.para = e.para GROUP BY ALL",
        *o.entities("all"),
    ),
)
def _(spark, sf_dir):
    return detect(texts(spark, sf_dir)).select(*KEYS, F.size("entities").alias("n_entities"))


# -- replacements -----------------------------------------------------------
NAMED = (*o.entities("all"), replaced())


def _generated(category: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = found_in(texts(spark, sf_dir)).where(F.col("entity_type") == category)
        return m.mapping_of(found).select("original_text", "replacement")

    return query


for _number, _category in enumerate(VALUES, start=1):
    _order = ["PERSON", "ORGANIZATION", "EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IP_ADDRESS", "DATE_OF_BIRTH", "ADDRESS"]
    register(
        f"G{_order.index(_category) + 1}_{_category.lower()}_values",
        o.with_query(
            f"SELECT DISTINCT v AS original_text, replacement FROM named WHERE category = '{_category}'", *NAMED
        ),
    )(_generated(_category))


@register(
    "G4_G6_distinct_numbers",
    o.with_query(
        "SELECT DISTINCT category AS entity_type, v AS original_text, distinct_replacement AS replacement, v AS restored FROM permuted",
        *NAMED, distinct_numbers(),
    ),
)
def _(spark, sf_dir):
    """Different numbers, different replacements; the salt restores the originals."""
    found = found_in(texts(spark, sf_dir)).where(F.col("entity_type").isin(list(bijection.NUMBERS)))
    made = m.mapping_of(found, distinct=True)
    return made.withColumn("restored", F.expr(bijection.original_of("entity_type", "replacement", DEFAULT_SALT)))


_DISPATCH = f"CASE c_custkey % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'SSN' WHEN 2 THEN 'EMAIL' ELSE 'PASSPORT' END"


@register(
    "G0_dispatch_by_category",
    o.with_query(
        "SELECT category AS entity_type, v AS original_text, replacement FROM named",
        f"ents AS (SELECT {_DISPATCH} AS category, c_name AS v FROM customer)", replaced(),
    ),
)
def _(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").select(F.expr(_DISPATCH).alias("entity_type"), F.col("c_name").alias("original_text"))
    return m.mapping_of(rows)


@register(
    "M1_mapping",
    o.with_query("SELECT DISTINCT category AS entity_type, v AS original_text, replacement FROM named", *NAMED),
)
def _(spark, sf_dir):
    return m.mapping_of(found_in(texts(spark, sf_dir)))


@register(
    "M2_mapping_export",
    o.with_query("SELECT DISTINCT category || '::' || v AS mapping_key, replacement FROM named", *NAMED),
)
def _(spark, sf_dir):
    return m.export_mapping(m.mapping_of(found_in(texts(spark, sf_dir))))


@register(
    "M2_streamed_mapping",
    o.with_query("SELECT DISTINCT category || '::' || v AS mapping_key, replacement FROM named", *o.entities("documents"), replaced()),
)
def _(spark, sf_dir):
    """Half of the documents arrive in about two batches, the rest likewise after the query was started anew."""
    folder = sinks.shared_folder(spark, "mapping")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # Tasks write their own files, so no task reads a half whole; a batch takes half of the files.
    per_batch = max(1, docs.rdd.getNumPartitions() // 2)
    for half in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0")):
        half.write.mode("append").parquet(f"{folder}/in")
        arriving = arriving_documents(spark, f"{folder}/in", "doc_id bigint, text string", files_per_batch=per_batch)
        mapping_stream(arriving, ["doc_id"], f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(MAPPING).parquet(f"{folder}/out")


@register(
    "M3_mapping_with_new_salt",
    o.with_query(
        "SELECT DISTINCT category AS entity_type, v AS original_text, replacement FROM named",
        *o.entities("all"), replaced(salt="second run"),
    ),
)
def _(spark, sf_dir):
    return m.mapping_of(found_in(texts(spark, sf_dir)), salt="second run")


@register(
    "M4_mapping_join",
    o.with_query(
        f"SELECT {SPAN_COLUMNS}, category AS entity_type, v AS original_text, replacement FROM named", *NAMED
    ),
)
def _(spark, sf_dir):
    found = sinks.written_table(found_in(texts(spark, sf_dir)).drop("score"), "entities")
    return m.apply_mapping(found, m.mapping_of(found))


# -- substitution -----------------------------------------------------------
@register("A1_chained_replacement", o.with_query("SELECT src, id, para, redacted FROM chained", *NAMED, CHAINED))
def _(spark, sf_dir):
    return redact(texts(spark, sf_dir), mode="chained").select(*KEYS, "redacted")


@register("A2_exact_replacement", o.with_query("SELECT src, id, para, redacted FROM redacted", *NAMED, REDACTED))
def _(spark, sf_dir):
    return redact(texts(spark, sf_dir)).select(*KEYS, "redacted")


@register(
    "A3_changed_paragraphs",
    o.with_query("SELECT src, id, para, redacted <> text AS changed FROM redacted", *NAMED, REDACTED),
)
def _(spark, sf_dir):
    return redact(texts(spark, sf_dir)).select(*KEYS, "changed")


_MASKED_DOCUMENTS = (*o.entities("documents"), replaced(masked=True), REDACTED)


@register(
    "A4_redact_pipeline",
    o.with_query(
        "SELECT r.src, r.id, r.para, r.redacted, CAST(count(n.s) AS INT) AS n_entities FROM redacted r LEFT JOIN named n"
        " ON r.src = n.src AND r.id = n.id AND r.para = n.para GROUP BY ALL",
        *o.entities("documents"), replaced(), REDACTED,
    ),
)
def _(spark, sf_dir):
    done = redact(document_paragraphs(spark, sf_dir))
    return done.select(*KEYS, "redacted", F.size("entities").alias("n_entities"))


@register("A5_masked", o.with_query("SELECT src, id, para, redacted FROM redacted", *_MASKED_DOCUMENTS))
def _(spark, sf_dir):
    return redact(document_paragraphs(spark, sf_dir), masked=True).select(*KEYS, "redacted")


# -- sinks ------------------------------------------------------------------
_WHOLE = "SELECT id AS doc_id, string_agg(redacted, chr(10) ORDER BY para) AS redacted FROM redacted GROUP BY id"
_SYNTHETIC_DOCUMENTS = (*o.entities("documents"), replaced(), REDACTED)


@register("K1_redacted_documents", o.with_query(_WHOLE, *_SYNTHETIC_DOCUMENTS))
def _(spark, sf_dir):
    return redact_documents(documents(spark, sf_dir)).select("doc_id", "redacted")


@register("K1_reassembled_documents", o.with_query(_WHOLE, *_SYNTHETIC_DOCUMENTS))
def _(spark, sf_dir):
    rows = redact(par.body_paragraphs(documents(spark, sf_dir), ["doc_id"]))
    return sinks.reassembled(rows, ["doc_id"])


_LOG = (
    f"SELECT n.src, n.id, n.para, n.s AS start, CAST(n.e AS INT) AS \"end\", n.category AS entity_type,"
    " {original} AS original_text, n.replacement AS replacement_text, substr({shown}, 1, 80) AS paragraph_context"
    " FROM named n JOIN redacted r ON n.src = r.src AND n.id = r.id AND n.para = r.para"
)


@register("K2_redaction_log", o.with_query(_LOG.format(original="n.v", shown="r.text"), *NAMED, REDACTED))
def _(spark, sf_dir):
    return sinks.redaction_log(redact(texts(spark, sf_dir)), KEYS)


@register(
    "K2_hashed_log",
    o.with_query(_LOG.format(original="sha256('pepper' || n.v)", shown="r.redacted"), *NAMED, REDACTED),
)
def _(spark, sf_dir):
    return sinks.redaction_log(redact(texts(spark, sf_dir)), KEYS, hash_originals_with="pepper")


@register(
    "K2_log_preview",
    o.with_query(
        "SELECT category AS entity_type, substr(v, 1, 40) AS original_preview, substr(replacement, 1, 40) AS replacement_preview FROM named",
        *NAMED,
    ),
)
def _(spark, sf_dir):
    return sinks.log_preview(sinks.redaction_log(redact(texts(spark, sf_dir)), KEYS))


@register(
    "K1_K2_written_redaction",
    o.with_query(
        "SELECT r.src, r.id, r.para, r.redacted AS text, count(n.s) AS n_logged FROM redacted r LEFT JOIN named n"
        " ON r.src = n.src AND r.id = n.id AND r.para = n.para GROUP BY ALL",
        *_SYNTHETIC_DOCUMENTS,
    ),
)
def _(spark, sf_dir):
    """Redacted text and log written as files from one run and read back."""
    folder = sinks.shared_folder(spark, "redaction")
    sinks.write_redaction(redact(document_paragraphs(spark, sf_dir)), KEYS, folder)
    logged = spark.read.parquet(f"{folder}/log").groupBy(*KEYS).agg(F.count("*").alias("n_logged"))
    return spark.read.parquet(f"{folder}/redacted").join(logged, KEYS, "left").withColumn(
        "n_logged", F.coalesce("n_logged", F.lit(0))
    )


_LOGGED = (
    "logged AS (SELECT id, count(*) AS n FROM named GROUP BY id)",
    "changed AS (SELECT count(*) AS total_paragraphs, count(*) FILTER (redacted <> text) AS paragraphs_changed FROM redacted)",
)


@register(
    "A4_one_run",
    o.with_query(
        "SELECT w.doc_id, w.redacted AS text, coalesce(l.n, 0) AS n_logged, c.total_paragraphs,"
        " (SELECT count(*) FROM (SELECT DISTINCT id, para FROM named)) AS paragraphs_modified, c.paragraphs_changed,"
        " (SELECT count(*) FROM named) AS total_entities_found,"
        " (SELECT count(*) FROM named WHERE category = 'EMAIL') AS emails"
        f" FROM ({_WHOLE}) w LEFT JOIN logged l ON l.id = w.doc_id, changed c",
        *_SYNTHETIC_DOCUMENTS, *_LOGGED,
    ),
)
def _(spark, sf_dir):
    """Documents, log and summary of one run, read back by its commit record."""
    folder = sinks.shared_folder(spark, "one-run")
    rows = par.body_paragraphs(documents(spark, sf_dir), ["doc_id"])
    runs.redaction_run(rows, ["doc_id"], folder, "only")
    read = lambda output, schema: runs.committed(spark, folder, output, schema)
    log = read("log", "doc_id bigint, para_id int, context string, entity_type string").where("context = 'body'")
    logged = log.groupBy("doc_id").agg(F.count("*").alias("n_logged"))
    summary = read("commits", runs.COMMIT).select(
        "total_paragraphs", "paragraphs_modified", "paragraphs_changed", "total_entities_found",
        F.coalesce(F.col("by_type")["EMAIL"], F.lit(0)).alias("emails"),
    )
    whole = read("documents", "doc_id bigint, text string").join(logged, "doc_id", "left").crossJoin(F.broadcast(summary))
    return whole.select("doc_id", "text", F.coalesce("n_logged", F.lit(0)).alias("n_logged"), *summary.columns)


# -- aggregations -----------------------------------------------------------
@register("G_CNT_total_entities", o.with_query("SELECT count(*) AS total_entities FROM ents", *o.entities("all")))
def _(spark, sf_dir):
    return sm.total_entities(found_in(texts(spark, sf_dir)))


@register(
    "G_TYPE_count_by_category",
    o.with_query("SELECT category AS entity_type, count(*) AS n FROM ents GROUP BY category", *o.entities("all")),
)
def _(spark, sf_dir):
    return sm.count_by_type(found_in(texts(spark, sf_dir)))


@register(
    "G_PARA_paragraph_totals",
    o.with_query(
        "SELECT count(*) AS total_paragraphs, (SELECT count(*) FROM (SELECT DISTINCT src, id, para FROM named)) AS paragraphs_modified,"
        " count(*) FILTER (redacted <> text) AS paragraphs_changed FROM redacted",
        *NAMED, REDACTED,
    ),
)
def _(spark, sf_dir):
    return sm.paragraph_totals(redact(texts(spark, sf_dir)))


CATEGORIES = sorted(set(fixed.CATEGORY_OF_LABEL.values()))


@register(
    "G_DOC_run_summary",
    o.with_query(
        "SELECT t.*, g.entity_type, g.n FROM (SELECT (SELECT count(*) FROM texts) AS total_paragraphs,"
        " (SELECT count(*) FROM (SELECT DISTINCT src, id, para FROM ents)) AS paragraphs_modified,"
        " (SELECT count(*) FROM ents) AS total_entities_found) t,"
        " (SELECT category AS entity_type, count(*) AS n FROM ents GROUP BY category) g",
        *o.entities("all"),
    ),
)
def _(spark, sf_dir):
    summary = sm.run_summary(detect(texts(spark, sf_dir)), CATEGORIES)
    return summary.select(
        "total_paragraphs", "paragraphs_modified", "total_entities_found", F.explode("by_type").alias("entity_type", "n")
    )


@register(
    "G_DOC_documents_with_email",
    o.with_query("SELECT DISTINCT id AS doc_id FROM ents WHERE category = 'EMAIL'", *o.entities("documents")),
)
def _(spark, sf_dir):
    found = found_in(document_paragraphs(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    return sm.documents_with(documents(spark, sf_dir), found, "EMAIL", "doc_id").select("doc_id")


@register(
    "G_DIST_distinct_values",
    o.with_query(
        "SELECT regexp_replace(v, '^[\\s\\p{Z}\\x{85}]+|[\\s\\p{Z}\\x{85}]+$', '', 'g') AS value, arg_min(category, (src, id, para, s)) AS entity_type, count(*) AS n FROM ents GROUP BY 1",
        *o.entities("all"),
    ),
)
def _(spark, sf_dir):
    return sm.distinct_values(found_in(texts(spark, sf_dir)), [*KEYS, "start"])


@register(
    "G_DIST_distinct_ratio",
    o.with_query(
        "SELECT category AS entity_type, count(*) AS n,"
        " count(DISTINCT regexp_replace(v, '^[\\s\\p{Z}\\x{85}]+|[\\s\\p{Z}\\x{85}]+$', '', 'g')) AS originals,"
        " count(DISTINCT replacement) AS replacements, TRUE AS originals_within, TRUE AS replacements_within FROM named GROUP BY category",
        *NAMED,
    ),
)
def _(spark, sf_dir):
    """Exact distinct counts, and whether the estimates merged from one sketch per source lie within their stated error."""
    found = sinks.written_table(explode_entities(redact(texts(spark, sf_dir)), drop=["text", "redacted", "changed"]), "named")
    estimates = sm.distinct_ratios(sm.value_sketches(found, "src")).select(
        "entity_type", "error", F.col("originals").alias("about_originals"), F.col("replacements").alias("about_replacements")
    )
    exact = found.groupBy("entity_type").agg(
        F.count("*").alias("n"), F.countDistinct(F.expr(v.stripped("original_text"))).alias("originals"),
        F.countDistinct("replacement").alias("replacements"),
    )
    within = [
        (F.abs(F.col(f"about_{c}") - F.col(c)) <= F.greatest(F.lit(1.0), F.col("error") * F.col(c))).alias(f"{c}_within")
        for c in ("originals", "replacements")
    ]
    return exact.join(estimates, "entity_type").select("entity_type", "n", "originals", "replacements", *within)


_GOLD = (
    "gold AS (SELECT sent_id, strpos(text, value) - 1 AS s, strpos(text, value) - 1 + length(value) AS e, category, value, text"
    " FROM sentences WHERE value IS NOT NULL UNION ALL"
    " SELECT sent_id, length(text) - length(value), length(text), category, value, text FROM sentences"
    " WHERE value IS NOT NULL AND times = 2)"
)
_EVAL = (*o.entities("sentences"), _GOLD)
_HIT = "e.id = g.sent_id AND e.s = g.s AND e.e = g.e AND e.category = g.category"
_PRECISION = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END"
_RECALL = "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END"


def _ratios(counts: str, *columns: str) -> str:
    listed = "".join(f"{c}, " for c in columns)
    return (
        f"SELECT {listed}CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,"
        f" CAST(round(p, 4) AS DOUBLE) AS precision, CAST(round(q, 4) AS DOUBLE) AS recall,"
        f" CAST(round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS DOUBLE) AS f1"
        f" FROM (SELECT *, {_PRECISION} AS p, {_RECALL} AS q FROM ({counts}))"
    )


_OUTCOMES = (
    "outcomes AS (SELECT e.category, CASE WHEN EXISTS (SELECT 1 FROM gold g WHERE " + _HIT + ") THEN 1 ELSE 0 END AS tp,"
    " CASE WHEN EXISTS (SELECT 1 FROM gold g WHERE " + _HIT + ") THEN 0 ELSE 1 END AS fp, 0 AS fn FROM ents e"
    " UNION ALL SELECT g.category, 0, 0, 1 FROM gold g WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE " + _HIT + "))"
)
_SPAN_COUNTS = (
    "SELECT coalesce(category, 'ALL') AS category, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM outcomes GROUP BY ROLLUP (category)"
)
_FLAGS = (
    "flags AS (SELECT sent_id, EXISTS (SELECT 1 FROM gold g WHERE g.sent_id = x.sent_id) AS has_gold,"
    " EXISTS (SELECT 1 FROM ents e WHERE e.id = x.sent_id) AS has_detection FROM sentences x)"
)


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sentences, gold spans and detections as long tables."""
    resolved = ev.resolve_gold(sentences(spark, sf_dir))
    gold = resolved.select("sent_id", F.inline("gold"))
    found = explode_entities(detect(resolved.select("sent_id", "text")), drop=["text"])
    return resolved.select("sent_id", "text"), gold, found


@register(
    "G_CORP_corpus_composition",
    o.with_query(
        "SELECT count(*) AS total_sentences, count(value) AS positive_sentences, count(*) - count(value) AS negative_sentences,"
        " CAST(sum(CASE WHEN value IS NULL THEN 0 ELSE times END) AS BIGINT) AS total_target_entities FROM sentences",
        o.sentences_cte(),
    ),
)
def _(spark, sf_dir):
    return ev.corpus_composition(ev.resolve_gold(sentences(spark, sf_dir)))


# -- evaluation -------------------------------------------------------------
@register(
    "E1_gold_offsets",
    o.with_query(
        'SELECT sent_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", category FROM gold', o.sentences_cte(), _GOLD
    ),
)
def _(spark, sf_dir):
    return labelled(spark, sf_dir)[1]


@register(
    "E2_exact_span_matches",
    o.with_query(
        'SELECT id AS sent_id, s AS start, CAST(e.e AS INT) AS "end", category, CASE WHEN hit THEN 1 ELSE 0 END::BIGINT AS tp,'
        " CASE WHEN hit THEN 0 ELSE 1 END::BIGINT AS fp, 0::BIGINT AS fn FROM (SELECT e.*, EXISTS (SELECT 1 FROM gold g WHERE "
        + _HIT + ") AS hit FROM ents e) e"
        " UNION ALL SELECT sent_id, CAST(s AS INT), CAST(e AS INT), category, 0, 0, 1 FROM gold g WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE "
        + _HIT + ")",
        *_EVAL,
    ),
)
def _(spark, sf_dir):
    _, gold, found = labelled(spark, sf_dir)
    return ev.match_spans(gold, found)


_FP = (
    "SELECT e.id AS sent_id, e.s AS start, t.text, e.v AS matched_text, e.category AS entity_type, round(e.score, 3)::DOUBLE AS score"
    " FROM ents e JOIN texts t ON t.id = e.id WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE " + _HIT + ")"
)
_FN = (
    "SELECT g.sent_id, CAST(g.s AS INT) AS start, g.text, g.value AS missed_text, g.category AS entity_type FROM gold g"
    " WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE " + _HIT + ")"
)


@register("E3_false_positives", o.with_query(_FP, *_EVAL))
def _(spark, sf_dir):
    return ev.false_positives(*labelled(spark, sf_dir))


@register("E4_false_negatives", o.with_query(_FN, *_EVAL))
def _(spark, sf_dir):
    return ev.false_negatives(*labelled(spark, sf_dir))


@register("E5_span_metrics", o.with_query(_ratios(_SPAN_COUNTS, "category"), *_EVAL, _OUTCOMES))
def _(spark, sf_dir):
    _, gold, found = labelled(spark, sf_dir)
    return ev.span_metrics(ev.match_spans(gold, found))


_SENTENCE_COUNTS = (
    "SELECT count(*) FILTER (has_gold AND has_detection) AS tp, count(*) FILTER (NOT has_gold AND NOT has_detection) AS tn,"
    " count(*) FILTER (NOT has_gold AND has_detection) AS fp, count(*) FILTER (has_gold AND NOT has_detection) AS fn FROM flags"
)
_SENTENCE_SQL = _ratios(
    f"SELECT *, CAST(round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 4) AS DOUBLE) AS accuracy FROM ({_SENTENCE_COUNTS})", "tn", "accuracy"
)


@register("E6_sentence_metrics", o.with_query(_SENTENCE_SQL, *_EVAL, _FLAGS))
def _(spark, sf_dir):
    return ev.sentence_metrics(ev.sentence_flags(*labelled(spark, sf_dir)))


@register(
    "E7_evaluation_spans", o.with_query(_ratios(_SPAN_COUNTS, "category"), *_EVAL, _OUTCOMES)
)
def _(spark, sf_dir):
    return evaluate(sentences(spark, sf_dir)).spans


@register("E7_evaluation_sentences", o.with_query(_SENTENCE_SQL, *_EVAL, _FLAGS))
def _(spark, sf_dir):
    return evaluate(sentences(spark, sf_dir)).sentence


_STEPS = (0.5, 0.7, 0.9, 1.0)


@register(
    "E8_threshold_sweep",
    o.with_query(
        _ratios(
            " UNION ALL ".join(
                f"SELECT CAST({t} AS DOUBLE) AS min_score, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM out{i}"
                for i, t in enumerate(_STEPS)
            ),
            "min_score",
        ),
        o.TEXTS["sentences"], o.candidates(o.ALL_RULES), _GOLD,
        *[o.resolved(t, out=f"ents{i}") for i, t in enumerate(_STEPS)],
        *[
            _OUTCOMES.replace("outcomes AS", f"out{i} AS").replace("FROM ents e", f"FROM ents{i} e")
            for i, _ in enumerate(_STEPS)
        ],
    ),
)
def _(spark, sf_dir):
    return ev.threshold_sweep(ev.resolve_gold(sentences(spark, sf_dir)), _STEPS)


@register(
    "K3_evaluation_report",
    o.with_query(
        "SELECT section, name, CAST(value AS DOUBLE) AS value FROM ("
        " SELECT 'corpus' AS section, 'total_sentences' AS name, (SELECT count(*) FROM sentences) AS value"
        " UNION ALL SELECT 'corpus', 'total_target_entities', (SELECT count(*) FROM gold)"
        f" UNION ALL SELECT 'sentence', 'accuracy', (SELECT accuracy FROM ({_SENTENCE_SQL}))"
        f" UNION ALL SELECT 'spans', 'f1', (SELECT f1 FROM ({_ratios(_SPAN_COUNTS, 'category')}) WHERE category = 'ALL')"
        f" UNION ALL SELECT 'category', category, f1 FROM ({_ratios(_SPAN_COUNTS, 'category')}) WHERE category <> 'ALL'"
        f" UNION ALL SELECT 'false positive', matched_text, score FROM (SELECT * FROM ({_FP}) ORDER BY sent_id, start LIMIT 20)"
        f" UNION ALL SELECT 'false negative', missed_text, 1 FROM (SELECT * FROM ({_FN}) ORDER BY sent_id, start LIMIT 20))",
        *_EVAL, _OUTCOMES, _FLAGS,
    ),
)
def _(spark, sf_dir):
    """The one nested report row, shown as (section, name, value)."""
    item = lambda section, name, value: F.struct(
        F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value")
    )
    report = evaluate(sentences(spark, sf_dir), stage=True).report()
    rows = F.concat(
        F.array(
            item("corpus", F.lit("total_sentences"), F.col("corpus.total_sentences")),
            item("corpus", F.lit("total_target_entities"), F.col("corpus.total_target_entities")),
            item("sentence", F.lit("accuracy"), F.col("sentence_level_binary_classification.accuracy")),
            item("spans", F.lit("f1"), F.col("entity_level_metrics.f1")),
        ),
        F.transform("per_category", lambda c: item("category", c["category"], c["f1"])),
        F.transform("false_positives", lambda e: item("false positive", e["matched_text"], e["score"])),
        F.transform("false_negatives", lambda e: item("false negative", e["missed_text"], F.lit(1))),
    )
    return report.select(F.inline(rows))


# -- orders and limits ------------------------------------------------------
@register(
    "O1_categories_by_count",
    o.with_query("SELECT category AS entity_type, count(*) AS n FROM ents GROUP BY category ORDER BY n DESC, entity_type", *o.entities("all")),
)
def _(spark, sf_dir):
    return sm.ranked_types(found_in(texts(spark, sf_dir)))


@register(
    "O2_categories_by_name",
    o.with_query(_ratios(_SPAN_COUNTS, "category") + " WHERE category <> 'ALL' ORDER BY category", *_EVAL, _OUTCOMES),
)
def _(spark, sf_dir):
    return evaluate(sentences(spark, sf_dir)).spans.where("category <> 'ALL'").orderBy("category")


@register("O3_first_false_positives", o.with_query(f"SELECT * FROM ({_FP}) ORDER BY sent_id, start LIMIT 20", *_EVAL))
def _(spark, sf_dir):
    return sm.first_rows(evaluate(sentences(spark, sf_dir)).false_positives, ["sent_id", "start"], 20)


@register(
    "O4_spans_by_position",
    o.with_query(
        "SELECT src, id, para, CAST(row_number() OVER (PARTITION BY src, id, para ORDER BY s) - 1 AS INT) AS place,"
        " s AS start, v AS original_text FROM ents",
        *o.entities("all"),
    ),
)
def _(spark, sf_dir):
    rows = detect(texts(spark, sf_dir)).select(*KEYS, F.posexplode_outer("entities").alias("place", "e_"))
    return rows.where("place IS NOT NULL").select(*KEYS, "place", "e_.start", "e_.original_text")


# -- extension and streaming ------------------------------------------------
@register(
    "U1_own_rule",
    o.with_query(
        "SELECT 'sent' AS src, sent_id AS id, 0 AS para, 'ORDER' AS entity_type, '1277304412' AS original_text, 13 AS start,"
        ' 23 AS "end", CAST(1.0 AS DOUBLE) AS score FROM sentences WHERE text = \'Parcel order 1277304412\'',
        o.sentences_cte(),
    ),
)
def _(spark, sf_dir):
    """A rule, a label and a validator of the user's own."""
    own = Rule(
        "order_number", "ORDER_NUMBER", r"\b\d{10}\b", 0.6, ("order",), gate=r"\d{10}",
        validate="{value} LIKE '12%'",
    )
    return found_in(texts(spark, sf_dir), rules=[own], labels={"ORDER_NUMBER": "ORDER"})


@register(
    "U1_bounded_organization",
    o.with_query(
        "SELECT id AS sent_id, v AS original_text FROM ents WHERE NOT regexp_matches(v || substr(text, e + 1, 1),"
        f" {o._lit(f'[{o.W}][{o.W}]$')}) OR NOT regexp_matches(substr(text, e + 1, 1), {o._lit(f'[{o.W}]')})",
        *o.entities("sentences", ["organization"]), "t AS (SELECT 1)",
    ).replace("FROM ents WHERE", "FROM (SELECT n.*, t.text FROM ents n JOIN texts t ON n.id = t.id) WHERE"),
)
def _(spark, sf_dir):
    """The organization rule whose suffix must end at a word boundary."""
    found = found_in(sentences(spark, sf_dir).drop("entities"), rules=[bounded_organization_rule()])
    return found.select("sent_id", "original_text")


def fiscal_years(text: Column) -> Column:
    """A detector of the user's own: fiscal years as organizations."""
    at = F.locate("FY 2023", text)
    span = F.struct(
        F.lit("ORG").alias("entity_type"), F.lit("FY 2023").alias("original_text"), (at - 1).alias("start"),
        (at + 6).alias("end"), F.lit(0.7).alias("score"),
    )
    return F.when(at > 0, F.array(span)).otherwise(F.array().cast(f"array<struct<entity_type:string,original_text:string,start:int,end:int,score:double>>"))


@register(
    "U2_injected_detector",
    o.with_query(
        "SELECT sent_id, 'ORGANIZATION' AS entity_type, 'FY 2023' AS original_text, CAST(strpos(text, 'FY 2023') - 1 AS INT) AS start,"
        " CAST(strpos(text, 'FY 2023') + 6 AS INT) AS \"end\", CAST(0.7 AS DOUBLE) AS score FROM sentences WHERE contains(text, 'FY 2023')",
        o.sentences_cte(),
    ),
)
def _(spark, sf_dir):
    return found_in(sentences(spark, sf_dir).drop("entities"), detector=fiscal_years)


@register(
    "ST1_streamed_redaction",
    o.with_query(
        "SELECT r.id AS doc_id, r.para AS para_id, r.redacted AS text, count(n.s) AS n_logged FROM redacted r LEFT JOIN named n"
        " ON r.src = n.src AND r.id = n.id AND r.para = n.para GROUP BY ALL",
        *_SYNTHETIC_DOCUMENTS,
    ),
)
def _(spark, sf_dir):
    """The documents file as a stream, run until nothing is left."""
    folder = sinks.shared_folder(spark, "stream")
    stream = arriving_documents(spark, f"{sf_dir}/documents*.parquet").select("doc_id", "text")
    redact_stream(stream, ["doc_id"], folder, f"{folder}/checkpoint").awaitTermination()
    log = spark.read.parquet(f"{folder}/log").groupBy("doc_id", "para_id").agg(F.count("*").alias("n_logged"))
    rows = spark.read.parquet(f"{folder}/redacted").select("doc_id", "para_id", "text")
    return rows.join(log, ["doc_id", "para_id"], "left").withColumn("n_logged", F.coalesce("n_logged", F.lit(0)))


def dropped_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Every document as a file in ``folder``, written by its task: some misnamed, some with other first bytes, some broken."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(place, recursive=True)
        for batch in uploads.in_slices(batches):
            ids, bodies = (column.to_pylist() for column in batch.columns)
            for i, text in zip(ids, bodies):
                data, name = _docx(text.split("\n"), []), f"{i}.pdf" if i % 5 == 1 else f"{i} [a].DOCX" if i % 5 == 2 else f"{i}.docx"
                data = b"PK\0\4" + data[4:] if i % 7 == 3 else data[:60] + b"\xff" * 8 + data[68:] if i % 11 == 4 else data
                with store.open_output_stream(f"{place}/{name}") as file:
                    file.write(data)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64())})

    documents(spark, sf_dir).mapInArrow(write, "id bigint").agg(F.count("*")).collect()


_UPLOAD = "CASE WHEN {0} % 5 = 1 THEN 'wrong extension' WHEN {0} % 7 = 3 THEN 'not a docx file' WHEN {0} % 11 = 4 THEN 'unreadable' END"


@register(
    "ST1_streamed_uploads",
    o.with_query(
        "SELECT r.id AS doc_id, r.para AS para_id, r.redacted AS text, count(n.s) AS n_logged, CAST(NULL AS VARCHAR) AS reason"
        " FROM redacted r LEFT JOIN named n ON r.src = n.src AND r.id = n.id AND r.para = n.para"
        f" WHERE {_UPLOAD.format('r.id')} IS NULL GROUP BY ALL"
        f" UNION ALL SELECT doc_id, NULL, NULL, 0, {_UPLOAD.format('doc_id')} FROM documents WHERE {_UPLOAD.format('doc_id')} IS NOT NULL",
        *_SYNTHETIC_DOCUMENTS,
    ),
)
def _(spark, sf_dir):
    """Files of the documents arrive in a folder; their stream runs in several batches until nothing is left."""
    folder = sinks.shared_folder(spark, "uploads")
    dropped_files(spark, sf_dir, f"{folder}/in")
    per_batch = max(1000, documents(spark, sf_dir).count() // 3)
    redact_upload_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", per_batch).awaitTermination()
    read = lambda output, schema: runs.committed(spark, f"{folder}/out", output, schema)
    number = F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("bigint").alias("doc_id")
    log = read("log", "path string, para_id int").groupBy("path", "para_id").agg(F.count("*").alias("n_logged"))
    rows = read("redacted", "path string, para_id int, text string").join(log, ["path", "para_id"], "left")
    reason = F.when(F.col("reason").rlike("^(wrong|too|not) "), F.col("reason")).otherwise("unreadable")
    done = rows.select(number, "para_id", "text", F.coalesce("n_logged", F.lit(0)).alias("n_logged"), F.lit(None).cast("string").alias("reason"))
    return done.unionByName(read("quarantine", "path string, reason string").select(number, reason.alias("reason")), allowMissingColumns=True).withColumn(
        "n_logged", F.coalesce("n_logged", F.lit(0))
    )
