"""The (category, original) -> replacement mapping as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkveil.functions.replacements import replacement
from inkveil.operators.skew import salted_join

_KEY = ["entity_type", "original_text"]


def mapping_of(entities: DataFrame, **options) -> DataFrame:
    """One row per distinct (category, original).

    ``distinct`` combines on the map side first, so a value that fills a third
    of all rows still crosses the exchange once per task.  Another ``salt``
    gives another mapping.
    """
    values = entities.select(*_KEY).distinct()
    return values.withColumn("replacement", F.expr(replacement("entity_type", "original_text", **options)))


def export_mapping(mapping: DataFrame) -> DataFrame:
    """``TYPE::original`` keys with their replacement."""
    return mapping.select(F.concat_ws("::", *_KEY).alias("mapping_key"), "replacement")


def apply_mapping(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach the replacement to every entity by an equi-join that splits hot values.

    ``entities`` is read twice; hand in a written or checkpointed table when
    it is dear to compute.  Where the mapping is not needed as a table, the
    replacement expression inside the redaction needs no join at all.
    """
    return salted_join(entities, mapping, _KEY)
