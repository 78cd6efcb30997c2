"""The mapping of originals to replacements as it grows with arriving documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from inkveil.functions.replacements import replacement
from inkveil.operators.detect import detect
from inkveil.operators.mapping import export_mapping
from inkveil.sources.paragraphs import body_paragraphs

KEY = ["entity_type", "original_text"]
MAPPING = "mapping_key string, replacement string"


def new_mappings(documents: DataFrame, keys: Sequence[str], replacing: dict | None = None, **detection) -> DataFrame:
    """``mapping_key, replacement`` of each (category, original) when it is first met in the stream.

    The state holds the pairs met so far, spread over the tasks by the pair, and
    lives in the checkpoint.  A pair that a paragraph holds several times leaves
    it once.  The replacement is computed after the state, for new pairs alone.
    """
    found = detect(body_paragraphs(documents, keys), into="entities", **detection)
    pairs = F.array_distinct(F.transform("entities", lambda e: F.struct(*[e[k].alias(k) for k in KEY])))
    met = found.select(F.explode(pairs).alias("pair")).select("pair.*").dropDuplicates(KEY)
    return export_mapping(met.withColumn("replacement", F.expr(replacement(*KEY, **(replacing or {})))))


def mapping_stream(
    documents: DataFrame, keys: Sequence[str], folder: str, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Append each new mapping row to ``folder`` once, also across restarts and repeated micro-batches.

    The file sink keeps a record of the files of each batch, and readers of the
    folder go by that record.  For mappings beyond the executors' memory set
    ``spark.sql.streaming.stateStore.providerClass`` to the store on disk.
    """
    return (
        new_mappings(documents, keys, **options).writeStream.format("parquet").outputMode("append")
        .option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
