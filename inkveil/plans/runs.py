"""Redaction runs: one detection, several outputs, one commit record.

A run writes below ``folder``:

* ``redacted/run=…``   the redacted paragraphs with their context,
* ``documents/run=…``  whole redacted documents (if asked for),
* ``log/run=…``        a row per replaced span, with the paragraph's context,
* ``quarantine/run=…`` what could not be taken in, with the reason (uploads),
* ``commits/run=…``    the summary of the run, written last.

Detection runs once, while the annotated paragraphs are written to a staging
table in the shared folder; the summary is observed in that same write, and the
other outputs are read off the staged table, which is removed after the commit.
The write has no exchange before it, so a task that is repeated after a lost
executor is counted once.

The commit record makes a run repeatable: a run that has one is not done again,
one that has none overwrites whatever an earlier attempt left.  ``committed``
reads only runs that have one, so nobody sees half a run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from inkveil.functions import fixed_values as fixed
from inkveil.plans.redact import redact
from inkveil.sources import sinks, uploads

CATEGORIES = sorted(set(fixed.CATEGORY_OF_LABEL.values()))
_RUN = re.compile(r"[A-Za-z][\w.-]*")
COMMIT = (
    "total_paragraphs bigint, paragraphs_modified bigint, paragraphs_changed bigint, total_entities_found bigint,"
    " by_type map<string,bigint>"
)


def _summary_columns(unread: Column) -> list[Column]:
    """What is observed of the annotated paragraphs; ``unread`` rows stand for files without paragraphs."""

    def of(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(~unread, value)), F.lit(0)).cast("bigint")

    def found(category: str) -> Column:
        return of(F.size(F.filter("entities", lambda e: e["entity_type"] == category))).alias(f"n_{category}")

    return [
        of(F.lit(1)).alias("total_paragraphs"),
        of((F.size("entities") > 0).cast("int")).alias("paragraphs_modified"),
        of(F.col("changed").cast("int")).alias("paragraphs_changed"),
        of(F.size("entities")).alias("total_entities_found"),
        *map(found, CATEGORIES),
    ]


def is_committed(spark: SparkSession, folder: str, run: str) -> bool:
    return sinks.path_exists(spark, f"{folder}/commits/run={run}/_SUCCESS")


def committed(spark: SparkSession, folder: str, output: str, schema: str) -> DataFrame:
    """The rows of ``output`` of all committed runs, with ``run``; ``schema`` also serves where nothing was written yet."""

    def read(name: str, columns: str) -> DataFrame:
        path = f"{folder}/{name}"
        if not sinks.path_exists(spark, path):
            return spark.createDataFrame([], f"{columns}, run string")
        return spark.read.schema(f"{columns}, run string").parquet(path)

    runs = read("commits", COMMIT)
    return runs if output == "commits" else read(output, schema).join(runs.select("run"), "run", "left_semi")


def redaction_run(
    paragraphs: DataFrame,
    keys: Sequence[str],
    folder: str,
    run: str,
    quarantine: DataFrame | None = None,
    whole_documents: bool = True,
    log_options: dict | None = None,
    **options,
) -> None:
    """Redact ``paragraphs(*keys, para_id, context, text)`` once and write all outputs of the run.

    Rows with an ``error``, if there is such a column, are no paragraphs: they
    go to the quarantine, next to the rows of ``quarantine(*keys, reason)``.
    ``options`` are those of ``redact``, ``log_options`` those of the log.
    """
    if not _RUN.fullmatch(run):
        raise ValueError("a run is named by letters, digits, points and dashes and begins with a letter")
    spark = paragraphs.sparkSession
    if is_committed(spark, folder, run):
        return
    error = F.col("error") if "error" in paragraphs.columns else F.lit(None).cast("string")
    rows = paragraphs.select(*keys, "para_id", "context", "text", error.alias("error"))
    done = redact(rows, **options).select(
        *keys, "para_id", "context", "text", "redacted", "changed", "error", F.col("entities")
    )
    seen = Observation(f"run-{run}")
    unread = F.col("error").isNotNull()
    staging = sinks.shared_folder(spark, f"run-{run}")
    try:
        done.observe(seen, *_summary_columns(unread)).write.parquet(staging)
        staged = spark.read.schema(done.schema).parquet(staging)
        taken = staged.where(~unread)
        redacted = taken.select(*keys, "para_id", "context", F.col("redacted").alias("text"))

        def put(df: DataFrame, output: str) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/{output}/run={run}")

        put(redacted, "redacted")
        if whole_documents:
            put(sinks.reassembled(redacted, keys, "text"), "documents")
        log = sinks.redaction_log(taken, [*keys, "para_id"], context="context", **(log_options or {}))
        put(log.hint("rebalance", "entity_type"), "log")
        failed = staged.where(unread).select(*keys, F.col("error").alias("reason"))
        put(failed if quarantine is None else quarantine.select(*keys, "reason").unionByName(failed), "quarantine")
        counts = seen.get
        by_type = {c: counts[f"n_{c}"] for c in CATEGORIES if counts[f"n_{c}"]}
        totals = [counts[c] for c in ("total_paragraphs", "paragraphs_modified", "paragraphs_changed", "total_entities_found")]
        put(spark.createDataFrame([(*totals, by_type)], COMMIT).coalesce(1), "commits")
    finally:
        sinks.remove(spark, staging)


def redact_uploads(
    files: DataFrame | Iterable[DataFrame], folder: str, run: str, rejected: DataFrame | None = None, **options
) -> None:
    """One run over uploaded files (``path, length, content``): checked, read, redacted, logged, the rest in quarantine.

    ``rejected(path, reason)`` are files that were turned away before.  What
    fails by its first bytes, or can't be read, is told while it is read.  Files
    may come in parts: each is read before the next is asked for, and the
    paragraphs are redacted together.
    """
    if isinstance(files, DataFrame):
        redaction_run(_read(files), ["path"], folder, run, quarantine=rejected, **options)
        return
    staging = None
    try:
        for paragraphs in map(_read, files):
            staging = staging or sinks.shared_folder(paragraphs.sparkSession, f"read-{run}")
            paragraphs.write.mode("append").parquet(staging)
        staged = paragraphs.sparkSession.read.schema(uploads.PARAGRAPHS).parquet(staging)
        redaction_run(staged, ["path"], folder, run, quarantine=rejected, **options)
    finally:
        if staging:
            sinks.remove(paragraphs.sparkSession, staging)


def _read(files: DataFrame) -> DataFrame:
    """Paragraphs of the files that pass by name and length, a row with ``error`` for each of the others."""
    fit, failed = uploads.sorted_by_name(files)
    refused = failed.select("path", F.col("reason").alias("error")).coalesce(uploads.STATUS_TASKS)
    return uploads.docx_paragraphs(fit).unionByName(refused, allowMissingColumns=True)


def redact_upload_folder(spark: SparkSession, directory: str, folder: str, run: str, **options) -> None:
    """``redact_uploads`` over all files below a directory; files that fail by name or length are not opened."""
    _, rejected = uploads.sorted_by_name(uploads.read_uploads(spark, directory))
    redact_uploads(uploads.read_uploads(spark, directory, uploads.DOCX_NAMES), folder, run, rejected.where(_wrong_name()), **options)


def _wrong_name() -> Column:
    """Of those that pass by name, the run itself turns away the long ones."""
    return ~F.lower("path").endswith(fixed.DOCX_SUFFIX)
