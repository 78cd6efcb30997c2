"""Detection, mapping and substitution as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from inkveil.functions.columns import each, fresh, let, quote
from inkveil.functions.replacements import DEFAULT_AS_OF, DEFAULT_SALT, with_replacements
from inkveil.operators.detect import detect, entities_sql
from inkveil.operators.substitute import MODES


def redact(
    paragraphs: DataFrame,
    text: str = "text",
    mode: str = "exact",
    masked: bool = False,
    salt: str = DEFAULT_SALT,
    as_of: str = DEFAULT_AS_OF,
    distinct: bool = False,
    **detection,
) -> DataFrame:
    """Add ``entities`` (with replacements), ``redacted`` and ``changed``.

    A narrow transform: it neither shuffles nor keeps state, so it serves
    batches and streams alike.  ``mode='chained'`` replaces by string as older
    tools do; ``masked=True`` writes one fixed mark instead of synthetic values;
    ``distinct=True`` gives different numbers different replacements.
    """
    found = detect(paragraphs, text, "entities", **detection)
    named = found.withColumn(
        "entities", F.expr(with_replacements("entities", salt=salt, as_of=as_of, masked=masked, distinct=distinct))
    )
    redacted = named.withColumn("redacted", F.expr(MODES[mode](f"`{text}`", "entities")))
    return redacted.withColumn("changed", F.coalesce(F.col("redacted") != F.col(text), F.lit(False)))


def redact_documents(
    documents: DataFrame,
    text: str = "text",
    into: str = "redacted",
    mode: str = "exact",
    masked: bool = False,
    salt: str = DEFAULT_SALT,
    as_of: str = DEFAULT_AS_OF,
    distinct: bool = False,
    **detection,
) -> DataFrame:
    """Redact whole documents paragraph by paragraph inside their row.

    The paragraphs stay in an array, so writing redacted documents in their
    original order needs no exchange of the text at all.
    """

    def paragraph(p: str) -> str:
        named = with_replacements(entities_sql(p, **detection), salt=salt, as_of=as_of, masked=masked, distinct=distinct)
        return let(named, lambda e: MODES[mode](p, e), "named")

    lines = each(f"split(`{text}`, {quote(chr(10))}, -1)", paragraph)
    return documents.withColumn(into, F.expr(f"array_join({lines}, {quote(chr(10))})"))
