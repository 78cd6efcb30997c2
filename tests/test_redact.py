"""Replacement values, mapping, substitution, sinks, streaming."""

import datetime
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from inkveil.functions import fixed_values as fixed
from inkveil.functions.replacements import replacement
from inkveil.functions.validators import suspect_reason, valid_card, valid_ipv4, valid_ssn
from inkveil.operators import mapping as m, summaries as sm
from inkveil.operators.skew import salted_join
from inkveil.operators.substitute import replace_chained, replace_exact
from inkveil.plans.redact import redact, redact_documents
from inkveil.sources import paragraphs as par, sinks, uploads
from inkveil.streaming.redact_stream import arriving_documents, redact_stream


def replaced(spark, category, originals, **options):
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(originals)], "i int, o string")
    out = rows.select("i", F.expr(replacement(f"'{category}'", "o", **options)).alias("r")).orderBy("i").collect()
    return [r.r for r in out]


MANY = [f"value {i}" for i in range(400)]


def test_replacements_depend_on_value_category_and_salt_only(spark):
    once, again = replaced(spark, "PERSON", MANY), replaced(spark, "PERSON", MANY)
    assert once == again and len(set(once)) > 300
    assert replaced(spark, "PERSON", MANY, salt="other") != once
    assert replaced(spark, "ORGANIZATION", MANY) != once


def test_formats(spark):
    shapes = {
        "PERSON": r"[A-Z]\w+ [A-Z]\w+", "ORGANIZATION": r"[A-Z]\w+ [A-Z]\w+ [\w ]+", "EMAIL": r"[a-z]+\.[a-z]+\d{3}@example\.(com|org|net)",
        "SSN": r"\d{3}-\d{2}-\d{4}", "CREDIT_CARD": r"\d{16}", "IP_ADDRESS": r"(10\.\d+|172\.(1[6-9]|2\d|3[01])|192\.168)\.\d+\.\d+",
        "DATE_OF_BIRTH": r"\d{2}/\d{2}/\d{4}", "ADDRESS": r"\d+ \w+ \w+, \w+ \d{5}", "PASSPORT": r"\[REDACTED\]",
    }
    for category, shape in shapes.items():
        assert all(re.fullmatch(shape, r) for r in replaced(spark, category, MANY)), category


def test_generated_values_pass_their_own_checks(spark):
    rows = spark.createDataFrame([(v,) for v in MANY], "o string")
    for category, check in (("SSN", valid_ssn), ("CREDIT_CARD", valid_card), ("IP_ADDRESS", valid_ipv4)):
        made = rows.select(F.expr(replacement(f"'{category}'", "o")).alias("r"))
        assert made.where(f"NOT ({check('r')})").count() == 0


def test_birth_dates_are_of_adults(spark):
    for r in replaced(spark, "DATE_OF_BIRTH", MANY, as_of="2024-06-30"):
        born = datetime.datetime.strptime(r, "%d/%m/%Y").date()
        age = 2024 - born.year - ((6, 30) < (born.month, born.day))
        assert 18 <= age <= 80


@pytest.mark.parametrize(
    "original, shape",
    [
        ("+ 91 20 31112222", r"\+91 [6-9]\d{9}"), ("091-9812345678", r"\+91 [6-9]\d{9}"), ("919812345678", r"\+91 [6-9]\d{9}"),
        ("022-61234567", r"022-\d{8}"), ("0231 123456", r"020-\d{8}"), ("9812345678", r"\+91 [6-9]\d{9}"),
        ("1800-222-3333", r"1800-\d{3}-\d{3}"), ("+1 (212) 555-0142", r"\+121 \d{10}"), ("+44", r"\+44 \d{10}"),
        ("(212) 555-0142", r"\+91 [6-9]\d{9}"), ("91234", r"\+91 [6-9]\d{9}"),
    ],
)
def test_phone_kinds(spark, original, shape):
    assert re.fullmatch(shape, replaced(spark, "PHONE", [original])[0])


def test_masking(spark):
    assert set(replaced(spark, "PERSON", MANY, masked=True)) == {fixed.MASK}


def substitute(spark, text, spans):
    listed = ", ".join(
        f"named_struct('original_text', '{text[s:e]}', 'start', {s}, 'end', {e}, 'replacement', '{r}')" for s, e, r in spans
    )
    row = spark.createDataFrame([(text,)], "text string").select(
        F.expr(replace_chained("text", f"array({listed})")).alias("chained"), F.expr(replace_exact("text", f"array({listed})")).alias("exact")
    ).first()
    return row.chained, row.exact


def test_chained_touches_look_alikes_and_earlier_output(spark):
    chained, exact = substitute(spark, "ab abc x ab", [(0, 2, "Q"), (3, 6, "Zab")])
    assert exact == "Q Zab x ab"
    assert chained == "Q ZQ x Q"


def test_exact_leaves_other_characters(spark):
    text = "né 😀 a@b.co, c@d.org!"
    chained, exact = substitute(spark, text, [(5, 11, "ONE"), (13, 20, "TWO")])
    assert chained == exact == "né 😀 ONE, TWO!"


def test_redact_rows(spark):
    rows = spark.createDataFrame([(1, "to a@b.co"), (2, "a@b.co again"), (3, "meeting 15/08/2024"), (4, None), (5, " ")], "i int, text string")
    done = {r.i: r for r in redact(rows).collect()}
    value = done[1].entities[0].replacement
    assert done[1].redacted == f"to {value}" and done[2].redacted == f"{value} again"
    assert done[3].redacted == "meeting 15/08/2024" and not done[3].changed
    assert done[4].redacted is None and done[4].entities == [] and done[5].redacted == " "
    assert done[1].changed and not done[4].changed


def test_documents_in_place_equal_paragraph_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = redact_documents(docs).select("doc_id", "redacted")
    rows = sinks.reassembled(redact(par.body_paragraphs(docs, ["doc_id"])), ["doc_id"])
    assert whole.exceptAll(rows).count() == 0 and rows.exceptAll(whole).count() == 0
    assert redact_documents(docs, mode="chained", masked=True).where("redacted LIKE '%[REDACTED]%'").count() > 0


def test_mapping_is_a_function_and_joins_back(spark):
    rows = spark.range(3000).select(
        F.lit("PERSON").alias("entity_type"), F.expr("if(id % 3 = 0, 'hot', concat('v', id % 50))").alias("original_text"), "id"
    )
    mapping = m.mapping_of(rows)
    joined = m.apply_mapping(rows, mapping)
    assert mapping.count() == 51 and joined.count() == 3000
    assert joined.select("original_text", "replacement").distinct().count() == 51
    assert {r.mapping_key for r in m.export_mapping(mapping).collect()} >= {"PERSON::hot"}


def test_salted_join_splits_hot_keys(spark):
    many = spark.range(2000).select(F.lit("k").alias("k"), "id")
    one = spark.createDataFrame([("k", 1), ("other", 2)], "k string, v int")
    assert salted_join(many, one, ["k"]).agg(F.count("*"), F.sum("v")).first() == (2000, 2000)


def test_log_and_totals(spark):
    rows = spark.createDataFrame([(1, "mail a@b.co " + "x" * 100), (2, "none"), (3, "")], "i int, text string")
    done = redact(rows)
    log = sinks.redaction_log(done, ["i"]).collect()
    assert len(log) == 1 and log[0].original_text == "a@b.co" and len(log[0].paragraph_context) == 80
    hashed = sinks.redaction_log(done, ["i"], hash_originals_with="s").first()
    assert "a@b.co" not in hashed.paragraph_context and len(hashed.original_text) == 64
    assert sm.paragraph_totals(done).first() == (3, 1, 1)
    summary = sm.run_summary(done, ["EMAIL", "PHONE"]).first()
    assert summary.by_type == {"EMAIL": 1} and summary.total_entities_found == 1


def test_suspects(spark):
    values = ["SEBI", "sebi", "Ltd.", "section 12b", "3.5", "FY2023", "Q42023", "Anna Berg", "H3"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    found = {r.v: r.w for r in rows.select("v", F.expr(suspect_reason("v")).alias("w")).collect()}
    assert [found[v] is not None for v in values] == [True, False, True, True, True, True, True, False, False]
    assert found["section 12b"] == "Document structure reference" and found["3.5"] == "Numeric value"


def test_first_record_decides_a_distinct_value(spark):
    rows = spark.createDataFrame([(2, "PERSON", " x "), (1, "ADDRESS", "x"), (3, "PERSON", "y")], "i int, entity_type string, original_text string")
    assert sorted(sm.distinct_values(rows, ["i"]).collect()) == [("x", "ADDRESS", 2), ("y", "PERSON", 1)]


def docx(body):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return data.getvalue()


def p(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def test_docx_files(spark, tmp_path):
    table = f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}</w:tc><w:tc><w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>{p('wide')}</w:tc></w:tr></w:tbl>"
    good = docx(p("Mail ", "a@b.co") + table + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>")
    (tmp_path / "good.DOCX").write_bytes(good)
    (tmp_path / "broken.docx").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "other.docx").write_bytes(b"plain")
    (tmp_path / "notes.txt").write_bytes(good)
    checked = uploads.check_uploads(uploads.read_uploads(spark, str(tmp_path)))
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in checked.collect()}
    assert reasons == {"good.DOCX": None, "broken.docx": None, "other.docx": "not a docx file", "notes.txt": "wrong extension"}
    assert uploads.quarantined(checked).count() == 2
    rows = uploads.docx_paragraphs(uploads.accepted(checked)).collect()
    read = [(r.para_id, r.context, r.text) for r in rows if r.path.endswith("good.DOCX")]
    assert read == [
        (0, "body", "Mail a@b.co"), (1, "body", "x\ty"), (2, "table[0][0,0]", "a"), (3, "table[0][0,0]", "b"),
        (4, "table[0][0,1]", "wide"), (5, "table[0][0,2]", "wide"),
    ]
    assert [r.error.split(":")[0] for r in rows if r.path.endswith("broken.docx")] == ["BadZipFile"]


def test_upload_size_limit(spark):
    rows = spark.createDataFrame([("a.docx", fixed.DOCX_MAX_BYTES), ("b.docx", fixed.DOCX_MAX_BYTES + 1)], "path string, length bigint")
    files = rows.withColumn("content", F.expr("X'504B0304'"))
    assert [r.reason for r in uploads.check_uploads(files).orderBy("path").collect()] == [None, "too large"]


def test_written_redaction(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "mail a@b.co"), (1, 1, "none")], "doc int, para_id int, text string")
    sinks.write_redaction(redact(rows), ["doc", "para_id"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/redacted")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/log")).first().entity_type == "EMAIL"


def test_stream_equals_batch(spark, tmp_path):
    texts = [(i, f"line a{i}@b.co\nplain {i}\nHost 10.0.0.{i}") for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    (tmp_path / "in").mkdir()
    docs.where("doc_id < 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = arriving_documents(spark, str(tmp_path / "in"), "doc_id bigint, text string")
        redact_stream(stream, ["doc_id"], out, checkpoint).awaitTermination()

    run()
    docs.where("doc_id >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    streamed = spark.read.parquet(f"{out}/redacted").select("doc_id", "para_id", "text")
    batch = redact(par.body_paragraphs(docs, ["doc_id"])).select("doc_id", "para_id", F.col("redacted").alias("text"))
    assert streamed.count() == 60
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert spark.read.parquet(f"{out}/log").count() == 40


def test_a_new_checkpoint_keeps_earlier_output(spark, tmp_path):
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(1, "Mail a@b.org\nno"), (2, None)], schema).write.parquet(str(tmp_path / "in"))
    for run in "ab":
        stream = arriving_documents(spark, str(tmp_path / "in"), schema)
        redact_stream(stream, ["doc_id"], str(tmp_path / "out"), str(tmp_path / run), trigger={"availableNow": True}).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out" / "redacted"))
    assert done.count() == 6
    runs = {r.run for r in done.select("run").distinct().collect()}
    assert len(runs) == 2 and "None" not in runs
