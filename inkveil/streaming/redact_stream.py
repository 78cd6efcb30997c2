"""Redaction of documents as they arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from threading import Thread
from time import sleep

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from inkveil.plans.redact import redact
from inkveil.plans.runs import is_committed, redact_uploads
from inkveil.sources.paragraphs import body_paragraphs
from inkveil.sources.sinks import make_folder, path_exists, redaction_log
from inkveil.sources.uploads import FILES, STATUS_TASKS, announce, arriving_uploads, read_files, sorted_by_name

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def arriving_documents(spark: SparkSession, folder: str, schema: str = DOCUMENTS, files_per_batch: int = 1000) -> DataFrame:
    """A stream of Parquet files dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def redact_stream(
    documents: DataFrame, keys: Sequence[str], folder: str, checkpoint: str, log_options: dict | None = None,
    trigger: dict | None = None, **options,
) -> StreamingQuery:
    """Write redacted paragraphs and the log of each micro-batch.

    The transform keeps no state: equal values get equal replacements by
    hash.  Each batch writes to its own partition and overwrites it when the
    batch is repeated after a failure, so nothing is lost or doubled.  The
    partition also carries the query's id, which lives in the checkpoint: a new
    checkpoint never overwrites what another one wrote.  ``trigger`` holds the
    options of ``DataStreamWriter.trigger``; by default all that has arrived is
    taken and the query ends.
    """
    rows = redact(body_paragraphs(documents, keys), **options)
    paragraph = [*keys, "para_id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        place = f"run={run}/batch_id={batch_id}"
        batch = batch.persist()
        try:
            batch.select(*paragraph, "context", F.col("redacted").alias("text")).write.mode("overwrite").parquet(
                f"{folder}/redacted/{place}"
            )
            redaction_log(batch, paragraph, **(log_options or {})).write.mode("overwrite").parquet(
                f"{folder}/log/{place}"
            )
        finally:
            batch.unpersist()

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# Files that a run opens at a time: the driver holds their statuses, a session's event store their tasks.
FILES_AT_A_TIME = 5000
# Settings of the sessions that list and read uploads, never of the caller's.  What opening a file counts for when files
# are packed into tasks: Spark's 4 MiB would give a task to every few Word files.  Tasks that list files.  No listing is
# kept after its use, and the parser's caches, which the detector's long expression fills, are given up after it.
SETTINGS = {
    "spark.sql.files.openCostInBytes": 64 << 10,
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": STATUS_TASKS,
    "spark.sql.hive.filesourcePartitionFileCacheSize": 0,
    "spark.sql.parser.manageParserCaches": "true",
    "spark.sql.parser.parserDfaCacheFlushThreshold": 10_000,
}


def _set(session: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        session.conf.set(name, value)
    return session


def _in_parts(session: SparkSession, paths: Sequence[str]) -> Iterator[DataFrame]:
    if not paths:
        yield session.createDataFrame([], FILES)
    for first in range(0, len(paths), FILES_AT_A_TIME):
        yield read_files(session, paths[first : first + FILES_AT_A_TIME])


def _lists(spark: SparkSession, checkpoint: str) -> str:
    """The folder of the lists of a stream, made with its checkpoint."""
    lists = f"{checkpoint}/arrivals"
    if not path_exists(spark, lists):
        if path_exists(spark, f"{checkpoint}/sources"):
            raise ValueError(f"{checkpoint} is of a stream that read uploads without lists; going on would take them twice")
        make_folder(spark, lists)
    return lists


def redact_upload_stream(
    spark: SparkSession, uploads: str, folder: str, checkpoint: str, files_per_batch: int = 1000,
    trigger: dict | None = None, list_every: float = 10.0, **options,
) -> StreamingQuery:
    """Redact Word files as they are dropped below ``uploads``; a run of ``redact_uploads`` per micro-batch.

    New files are announced in lists of names and lengths below ``checkpoint``;
    the stream reads these, a list per micro-batch, so that no name crosses the
    file source.  With a trigger that ends the query (``availableNow``, ``once``)
    this is done before it starts, else also every ``list_every`` seconds while
    it runs; a listing that fails stops the query.

    A micro-batch has at most ``files_per_batch`` files, so the list of its names
    is bounded; the files that pass by name and length are then read by path,
    ``FILES_AT_A_TIME``, and have to stay until the run is committed.  The run is
    named by the query and the batch: a batch that failed between two outputs is
    written again, one that failed after its commit is left as it is, and
    ``runs.committed`` never shows half of one.
    """
    trigger = trigger or {"availableNow": True}
    lists = _lists(spark, checkpoint)
    listing = _set(SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession()))
    announce(listing, uploads, lists, files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = _set(batch.sparkSession)  # the query's own
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        fit, rejected = sorted_by_name(batch)
        paths = [r["path"] for r in fit.collect()]
        run = f"q{query}-{batch_id}"
        if not is_committed(session, folder, run):
            redact_uploads(_in_parts(session, paths), folder, run, rejected, **options)

    query = (
        arriving_uploads(spark, lists).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )

    def keep_listing() -> None:
        try:
            while query.isActive:
                sleep(list_every)
                if query.isActive:
                    announce(listing, uploads, lists, files_per_batch)
        except BaseException:
            query.stop()
            raise

    if not {"availableNow", "once"} & trigger.keys():
        Thread(target=keep_listing, daemon=True).start()
    return query
