"""Inputs that lack a text, hold tables or are broken."""

import io
import zipfile

import pyarrow as pa

from inkveil.checks import catalog
from inkveil.functions import fixed_values as fixed
from inkveil.operators.summaries import distinct_values
from inkveil.sources import paragraphs as par, uploads

_XML = (
    '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r>'
    '<w:t>one</w:t><w:br/><w:t>two</w:t><w:br w:type="page"/><w:t>three</w:t></w:r></w:p></w:body></w:document>'
)


def packed(xml: str) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", xml)
    return buffer.getvalue()


def test_null_text_is_a_paragraph(spark):
    df = spark.createDataFrame([(1, None), (2, "a\n")], "doc_id int, text string")
    rows = [tuple(r) for r in par.body_paragraphs(df, ["doc_id"]).orderBy("doc_id", "para_id").collect()]
    assert rows == [(1, 0, "body", None), (2, 0, "body", "a"), (2, 1, "body", "")]


def test_whole_document_is_numbered_body_first(spark):
    tables = [[["x", None], ["y\nz"]], None, [None, ["w"]]]
    df = spark.createDataFrame(
        [(1, "a\nb", tables), (2, None, None)], "doc_id int, text string, tables array<array<array<string>>>"
    )
    rows = [tuple(r) for r in par.document_paragraphs(df, ["doc_id"]).orderBy("doc_id", "para_id").collect()]
    cells = [("table[0][0,0]", "x"), ("table[0][0,1]", None), ("table[0][1,0]", "y"), ("table[0][1,0]", "z"), ("table[2][1,0]", "w")]
    body = [("body", "a"), ("body", "b")]
    assert rows == [(1, i, *line) for i, line in enumerate(body + cells)] + [(2, 0, "body", None)]
    assert [r.text for r in par.table_cells(df, ["doc_id"]).orderBy("para_id").collect()] == [t for _, t in cells]


def test_broken_files_give_error_rows(spark, monkeypatch):
    good = packed(_XML)
    files = [("good", good), ("cut", good[: len(good) // 2]), ("damaged", good[:50] + b"\xff" * 8 + good[58:]), ("null", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    rows = uploads.docx_paragraphs(df).collect()
    assert [r.text for r in rows if r.path == "good"] == ["one\ntwothree"]
    assert sorted(r.path for r in rows if r.error) == ["cut", "damaged", "null"]
    monkeypatch.setattr(fixed, "DOCX_MAX_UNPACKED", 10)
    try:
        list(uploads._paragraphs(good))
    except ValueError:
        return
    raise AssertionError("the limit of unpacked bytes was not kept")


def test_values_are_stripped_of_any_white_space(spark):
    df = spark.createDataFrame([(1, " Oslo\t", "ADDRESS"), (2, " Oslo", "ADDRESS")], "i int, original_text string, entity_type string")
    assert [tuple(r) for r in distinct_values(df, ["i"]).collect()] == [("Oslo", "ADDRESS", 2)]


def test_word_files_are_packed_few_at_a_time():
    """However many rows Arrow hands over, few of them are held as Python objects."""
    n = 5 * uploads.SLICE_ROWS + 3
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": ["a\nb"] * n, "lang": ["en"] * n, "source": ["web"] * n})
    packed = list(catalog._pack(iter([rows, rows.slice(0, 0)])))
    assert [p for b in packed for p in b.column(0).to_pylist()] == [f"in/{i}.docx" for i in range(n)]
    assert max(b.num_rows for b in packed) <= uploads.SLICE_ROWS
    read = [r for b in uploads._read_batches(iter(packed)) for r in b.to_pylist()]
    assert len(read) == 4 * n and all(r["error"] is None for r in read)
