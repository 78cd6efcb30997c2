"""Redacted text, redaction log and evaluation report as tables and files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.functions import fixed_values as fixed
from inkveil.functions.columns import quote


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="inkveil-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which executors share.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folder()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, so that several outputs share one run."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _at(spark: SparkSession, path: str):
    """The Hadoop path and its file system, whatever store it is in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, store = _at(spark, path)
    return store.exists(place)


def make_folder(spark: SparkSession, path: str) -> None:
    place, store = _at(spark, path)
    store.mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library staged."""
    place, store = _at(spark, path)
    store.delete(place, True)


def redaction_log(
    annotated: DataFrame, keys: Sequence[str], hash_originals_with: str | None = None, context: str | None = None
) -> DataFrame:
    """One row per replaced span.

    The log holds original values and is as sensitive as the input; with a
    salt given, originals are hashed and the paragraph's beginning is taken
    from the redacted text.  ``context`` names the column with the place of the
    paragraph in its document, if the log shall carry it.
    """
    shown = "redacted" if hash_originals_with is not None else "text"
    original = "original_text"
    if hash_originals_with is not None:
        original = f"sha2(concat({quote(hash_originals_with)}, original_text), 256)"
    place = [context] if context else []
    rows = annotated.select(*keys, *place, F.col(shown).alias("shown_"), F.inline_outer("entities")).where("start IS NOT NULL")
    return rows.select(
        *keys, *place, "start", "end", "entity_type",
        F.expr(original).alias("original_text"),
        F.col("replacement").alias("replacement_text"),
        F.substring("shown_", 1, fixed.LOG_CONTEXT_CHARS).alias("paragraph_context"),
    )


def log_preview(log: DataFrame) -> DataFrame:
    """The log with originals and replacements cut for display, and the paragraph's context if the log carries it."""
    n = fixed.LOG_PREVIEW_CHARS
    return log.select(
        *[c for c in ("context",) if c in log.columns],
        "entity_type",
        F.substring("original_text", 1, n).alias("original_preview"),
        F.substring("replacement_text", 1, n).alias("replacement_preview"),
    )


def reassembled(annotated: DataFrame, keys: Sequence[str], text: str = "redacted") -> DataFrame:
    """Whole documents from paragraph rows, in paragraph order.

    A group is one source row's text, so its size is bounded by that row.
    Where documents are still whole, ``redact_documents`` needs no exchange.
    """
    pieces = F.sort_array(F.collect_list(F.struct("para_id", text)))
    joined = F.array_join(F.transform(pieces, lambda p: p[text]), "\n")
    return annotated.groupBy(*keys).agg(joined.alias(text))


def write_redaction(annotated: DataFrame, keys: Sequence[str], folder: str, **log_options) -> None:
    """Write ``folder/redacted`` and ``folder/log`` from one detection run.

    The log is partitioned by category.  Its rows are rebalanced by category
    first: small categories share a task, large ones are split, so the number
    of files follows the size of the log and not tasks times categories.
    """
    spark = annotated.sparkSession
    extra = [c for c in ("context",) if c in annotated.columns and c not in keys]
    kept = annotated.select(*keys, "text", "redacted", "entities", *extra)
    staging = shared_folder(spark, "annotated")
    try:
        kept.write.parquet(staging)
        done = spark.read.schema(kept.schema).parquet(staging)
        done.select(*keys, *extra, F.col("redacted").alias("text")).write.mode("errorifexists").parquet(f"{folder}/redacted")
        log = redaction_log(done, keys, context="context" if extra else None, **log_options).hint("rebalance", "entity_type")
        log.write.mode("errorifexists").partitionBy("entity_type").parquet(f"{folder}/log")
    finally:
        remove(spark, staging)


def report_row(
    corpus: DataFrame, sentence: DataFrame, spans: DataFrame, fps: DataFrame, fns: DataFrame
) -> DataFrame:
    """The evaluation report as one nested row.

    Every input is a small aggregate; the error lists are cut to their first
    rows by sentence and position before they are gathered.
    """

    def rows(df: DataFrame, name: str) -> DataFrame:
        cut = df.orderBy("sent_id", "start").limit(fixed.REPORT_ERROR_ROWS)
        listed = F.sort_array(F.collect_list(F.struct("sent_id", "start", *[c for c in df.columns if c not in ("sent_id", "start")])))
        shown = F.transform(listed, lambda e: e.dropFields("sent_id", "start"))
        return cut.agg(shown.alias(name)).withColumn("key_", F.lit(1))

    metrics = ["tp", "fp", "fn", "precision", "recall", "f1"]
    whole = F.max(F.when(F.col("category") == "ALL", F.struct(*metrics))).alias("entity_level_metrics")
    each_one = F.collect_list(F.when(F.col("category") != "ALL", F.struct("category", *metrics)))
    per_category = F.sort_array(each_one).alias("per_category")
    parts = [
        corpus.select(F.struct("*").alias("corpus"), F.lit(1).alias("key_")),
        sentence.select(F.struct("*").alias("sentence_level_binary_classification"), F.lit(1).alias("key_")),
        spans.agg(whole, per_category).withColumn("key_", F.lit(1)),
        rows(fps, "false_positives"),
        rows(fns, "false_negatives"),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.join(part, "key_")
    return report.drop("key_")
