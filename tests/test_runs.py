"""Runs with a commit record: one detection, no half runs, streams of uploads that fail between two outputs."""

import os
import time

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from inkveil.checks.catalog import _docx, dropped_files
from inkveil.operators.detect import detect
from inkveil.operators.summaries import run_summary
from inkveil.plans import redact as redact_plan, runs
from inkveil.plans.redact import redact
from inkveil.sources import sinks, uploads
from inkveil.sources.paragraphs import body_paragraphs
from inkveil.streaming import redact_stream
from inkveil.streaming.redact_stream import redact_upload_stream

TEXTS = ["Write to ana.bell@mail.example today", "Nothing here\nCall 212-555-0143 or ana.bell@mail.example", "", None]
REDACTED = "path string, para_id int, context string, text string"


@pytest.fixture
def paragraphs(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return body_paragraphs(docs, ["doc_id"])


def outputs(spark, folder, keys="doc_id long"):
    read = lambda name, schema: sorted(map(repr, runs.committed(spark, folder, name, f"{keys}, {schema}").drop("run").collect()))
    return {
        "redacted": read("redacted", "para_id int, context string, text string"),
        "log": read("log", "para_id int, context string, start int, entity_type string, original_text string, replacement_text string"),
        "quarantine": read("quarantine", "reason string"),
    }


def summaries(spark, folder):
    return runs.committed(spark, folder, "commits", runs.COMMIT).drop("run")


def test_four_outputs_of_one_detection(spark, paragraphs, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(redact_plan, "detect", lambda *a, **k: calls.append(1) or detect(*a, **k))
    folder = str(tmp_path)
    runs.redaction_run(paragraphs, ["doc_id"], folder, "first")
    assert calls == [1]
    done = redact(paragraphs)
    got = outputs(spark, folder)
    assert got["redacted"] == sorted(map(repr, done.select("doc_id", "para_id", "context", F.col("redacted").alias("text")).collect()))
    wanted = sinks.redaction_log(done, ["doc_id", "para_id"], context="context")
    assert got["log"] == sorted(map(repr, wanted.drop("end", "paragraph_context").collect())) and len(got["log"]) == 3
    whole = {r["doc_id"]: r["text"] for r in runs.committed(spark, folder, "documents", "doc_id long, text string").collect()}
    assert whole == {r["doc_id"]: r["redacted"] for r in sinks.reassembled(done, ["doc_id"]).collect()}
    summary = summaries(spark, folder).first().asDict()
    same = run_summary(detect(paragraphs), runs.CATEGORIES).first().asDict()
    assert {k: summary[k] for k in same} == same and summary["paragraphs_changed"] == 2


def test_nothing_is_left_staged_and_a_run_is_done_once(spark, paragraphs, tmp_path, monkeypatch):
    staged = []
    monkeypatch.setattr(sinks, "shared_folder", lambda _, name: staged.append(str(tmp_path / "shared" / name)) or staged[-1])
    for _ in range(2):
        runs.redaction_run(paragraphs, ["doc_id"], str(tmp_path / "out"), "one", whole_documents=False)
    assert len(staged) == 1 and not os.path.exists(staged[0])
    assert summaries(spark, str(tmp_path / "out")).count() == 1 and not os.path.exists(tmp_path / "out/documents")
    with pytest.raises(ValueError):
        runs.redaction_run(paragraphs, ["doc_id"], str(tmp_path), "7/..")


def test_empty_table_gives_an_empty_run(spark, paragraphs, tmp_path):
    runs.redaction_run(paragraphs.where("false"), ["doc_id"], str(tmp_path), "none")
    assert outputs(spark, str(tmp_path)) == {"redacted": [], "log": [], "quarantine": []}
    assert summaries(spark, str(tmp_path)).first().asDict() == {
        "total_paragraphs": 0, "paragraphs_modified": 0, "paragraphs_changed": 0, "total_entities_found": 0, "by_type": {},
    }


def fail_at(monkeypatch, place, times=1):
    """The next ``times`` writes of this output fail before they begin."""
    write, left = DataFrameWriter.parquet, [times]

    def parquet(self, path, *args, **options):
        if f"/{place}/" in path and left[0]:
            left[0] -= 1
            raise OSError("disk full")
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)


@pytest.mark.parametrize("place", ["redacted", "log", "quarantine", "commits"])
def test_stream_that_fails_between_two_outputs(spark, sf_dir, tmp_path, monkeypatch, place):
    files, out, batch = (str(tmp_path / name) for name in ("in", "out", "batch"))
    os.makedirs(files)
    for i in range(12):
        data = _docx([f"Mail box{i}@mail.example", "plain"], [])
        name = ["{a}.docx", "b [1].DOCX", "c.pdf", "d.docx", "e*.docx"][i % 5]
        data = b"none" + data[4:] if i == 3 else data[:70] + bytes(8) + data[78:] if i == 8 else data
        (tmp_path / "in" / f"{i} {name}").write_bytes(data)
    runs.redact_upload_folder(spark, files, batch, "all", whole_documents=False)
    wanted = outputs(spark, batch, "path string")
    assert len(wanted["quarantine"]) == 4 and len(wanted["redacted"]) == 16

    def stream():
        query = redact_upload_stream(spark, files, out, str(tmp_path / "checkpoint"), 5, whole_documents=False)
        query.awaitTermination()

    with monkeypatch.context() as patched:
        fail_at(patched, place)
        with pytest.raises(Exception):
            stream()
    half = outputs(spark, out, "path string")
    assert half == {"redacted": [], "log": [], "quarantine": []}  # the torn batch isn't seen
    stream()
    assert outputs(spark, out, "path string") == wanted
    assert summaries(spark, out).agg(F.sum("total_paragraphs"), F.count("*")).first()[:] == (16, 3)


def test_a_committed_batch_is_not_repeated(spark, tmp_path):
    """The query's own record of a batch is lost after the commit: the batch comes again and changes nothing."""
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.docx").write_bytes(_docx(["Mail box@mail.example"], []))
    for _ in range(2):
        redact_upload_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        for name in ("0", ".0.crc"):
            record = tmp_path / "check/commits" / name
            if record.exists():
                record.unlink()
    assert runs.committed(spark, str(tmp_path / "out"), "redacted", REDACTED).count() == 1


def drop(folder, names):
    os.makedirs(folder, exist_ok=True)
    for name in names:
        with open(f"{folder}/{name}", "wb") as file:
            file.write(_docx([f"Mail {name[0]}@mail.example"], []))


def test_names_like_patterns_are_not_multiplied(spark, tmp_path):
    """The file source repeats all paths of a micro-batch for each that looks like a pattern; 120 names gave 14,400."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drop(folder, [f"{i} [a].DOCX" for i in range(120)])
    query = redact_upload_stream(spark, folder, out, str(tmp_path / "check"), whole_documents=False)
    query.awaitTermination()
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(str(query.runId)) for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 120
    assert runs.committed(spark, out, "redacted", REDACTED).count() == 120


def test_a_micro_batch_is_read_in_parts(spark, tmp_path, monkeypatch):
    folder, opened = str(tmp_path / "in"), []
    drop(folder, [*(f"{i} [a].docx" for i in range(7)), "x.pdf"])
    read = redact_stream.read_files
    monkeypatch.setattr(redact_stream, "FILES_AT_A_TIME", 3)
    monkeypatch.setattr(redact_stream, "read_files", lambda session, paths: opened.append(len(paths)) or read(session, paths))
    redact_upload_stream(spark, folder, str(tmp_path / "out"), str(tmp_path / "check"), whole_documents=False).awaitTermination()
    runs.redact_upload_folder(spark, folder, str(tmp_path / "batch"), "all", whole_documents=False)
    assert opened == [3, 3, 1]
    assert outputs(spark, str(tmp_path / "out"), "path string") == outputs(spark, str(tmp_path / "batch"), "path string")
    one, all_ = (summaries(spark, str(tmp_path / name)).first() for name in ("out", "batch"))
    assert one == all_ and one["total_paragraphs"] == 7


def test_files_are_announced_once_and_while_the_stream_runs(spark, tmp_path):
    folder, out, check = (str(tmp_path / name) for name in ("in", "out", "check"))
    redact_upload_stream(spark, folder, out, check, 2).awaitTermination()  # nobody has made the folder yet
    drop(folder, ["a.docx", "b.docx", "c.docx"])
    redact_upload_stream(spark, folder, out, check, 2).awaitTermination()
    lists = lambda: sorted(r["n"] for r in spark.read.parquet(f"{check}/arrivals").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())
    assert lists() == [1, 2]
    query = redact_upload_stream(spark, folder, out, check, 2, {"processingTime": "0 seconds"}, list_every=0.1)
    try:
        drop(folder, ["d.docx"])
        for _ in range(600):
            if query.exception() or runs.committed(spark, out, "redacted", REDACTED).count() == 4:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    assert lists() == [1, 1, 2] and runs.committed(spark, out, "redacted", REDACTED).count() == 4


def test_a_checkpoint_without_lists_is_refused(spark, tmp_path):
    os.makedirs(tmp_path / "check/sources/0")
    with pytest.raises(ValueError, match="without lists"):
        redact_upload_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))


def test_content_is_not_read_for_names_and_lengths(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"x")
    fit, failed = uploads.sorted_by_name(uploads.read_uploads(spark, str(tmp_path)))
    plan = fit._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length," in plan
    assert "content:binary" not in failed._jdf.queryExecution().executedPlan().toString()
    assert [r["error"] for r in uploads.docx_paragraphs(fit).collect()] == [uploads.NOT_DOCX]


def test_files_of_the_log_follow_its_size(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(7)
    sinks.write_redaction(redact(body_paragraphs(docs, ["doc_id"])), ["doc_id", "para_id"], str(tmp_path))
    log = spark.read.parquet(str(tmp_path / "log"))
    files = [f for _, _, names in os.walk(tmp_path / "log") for f in names if f.endswith(".parquet")]
    assert len(files) == log.select("entity_type").distinct().count() and "context" in log.columns


def test_preview_shows_the_context(spark, paragraphs):
    log = sinks.redaction_log(redact(paragraphs), ["doc_id"], context="context")
    assert sinks.log_preview(log).columns == ["context", "entity_type", "original_preview", "replacement_preview"]
    assert "context" not in sinks.log_preview(sinks.redaction_log(redact(paragraphs), ["doc_id"])).columns


def test_mapping_stream_emits_each_pair_once(spark, tmp_path):
    """Over batches, a restart, and a batch whose record was lost."""
    from inkveil.operators.mapping import export_mapping, mapping_of
    from inkveil.operators.detect import explode_entities
    from inkveil.streaming.mapping_stream import MAPPING, mapping_stream

    docs = [(i, t) for i, t in enumerate(TEXTS + TEXTS + ["bo@x.org bo@x.org SSN: 321-54-9876"])]
    schema = "doc_id long, text string"
    out, check = str(tmp_path / "out"), tmp_path / "check"
    for part in (docs[:3], docs[3:6], docs[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        mapping_stream(stream(), ["doc_id"], out, str(check)).awaitTermination()
    last = max(int(p.name) for p in (check / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        if (check / "commits" / name).exists():
            (check / "commits" / name).unlink()
    mapping_stream(stream(), ["doc_id"], out, str(check)).awaitTermination()
    got = sorted(map(tuple, spark.read.schema(MAPPING).parquet(out).collect()))
    found = explode_entities(detect(body_paragraphs(spark.createDataFrame(docs, schema), ["doc_id"])), drop=["text"])
    assert got == sorted(map(tuple, export_mapping(mapping_of(found)).collect())) and len(got) == 4


def test_merged_sketches_equal_one_sketch(spark):
    from inkveil.operators.summaries import distinct_ratios, value_sketches

    rows = spark.range(60_000).selectExpr(
        "id % 3 AS day", "'PHONE' AS entity_type", "concat(' ', id % 40000) AS original_text", "cast(id % 20000 AS string) AS replacement"
    )
    merged = distinct_ratios(value_sketches(rows, "day")).first()
    assert merged["n"] == 60_000
    for name, exact in (("originals", 40_000), ("replacements", 20_000)):
        assert abs(merged[name] - exact) <= merged["error"] * exact
    assert abs(merged["ratio"] - 0.5) < 0.03


def test_streamed_mapping_reads_no_half_in_one_task(spark, sf_dir, monkeypatch):
    """The arriving files are written by the tasks that read the documents, not gathered into one."""
    from pyspark.sql import DataFrame
    from inkveil.checks import catalog

    gathered = []
    plain = DataFrame.coalesce
    monkeypatch.setattr(DataFrame, "coalesce", lambda self, n: gathered.append(n) or plain(self, n))
    catalog.QUERIES["M2_streamed_mapping"](spark, sf_dir)
    assert gathered == []


def test_distinct_ratio_detects_once(spark, sf_dir):
    from inkveil.checks import catalog

    plan = catalog.QUERIES["G_DIST_distinct_ratio"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
