"""Turning documents, chats and tables into paragraphs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from inkveil.functions.columns import each, fresh, quote

NEWLINE = "\n"


def _lines(text: str, context: str) -> str:
    """SQL of ``text``'s lines as an array of ``context, text``; NULL is one line without text."""
    lines = f"coalesce(split({text}, {quote(NEWLINE)}, -1), array(cast(NULL AS string)))"
    return each(lines, lambda line: f"named_struct('context', {context}, 'text', {line})")


def _cell_lines(tables: str) -> str:
    """SQL of the lines of all cells, table by table and row by row."""

    def flat(items: str, body: Callable[[str, str], str], stem: str) -> str:
        item, place = fresh(stem), fresh(f"{stem}_place")
        made = f"flatten(transform({items}, ({item}, {place}) -> {body(item, place)}))"
        return f"coalesce({made}, cast(array() AS array<struct<context:string,text:string>>))"

    def cell(t: str, r: str) -> Callable[[str, str], str]:
        return lambda value, c: _lines(value, f"format_string('table[%d][%d,%d]', {t}, {r}, {c})")

    return flat(tables, lambda rows, t: flat(rows, lambda cells, r: flat(cells, cell(t, r), "cell"), "row"), "table")


def _numbered(df: DataFrame, keys: Sequence[str], lines: str) -> DataFrame:
    rows = df.select(*keys, F.posexplode(F.expr(lines)).alias("para_id", "line_"))
    return rows.select(*keys, "para_id", "line_.context", "line_.text")


def body_paragraphs(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per line of ``text``, in order, with the context ``body``.

    Blank lines stay: they count as paragraphs.  A NULL text is one paragraph without text.
    """
    lines = F.coalesce(F.split(text, NEWLINE, -1), F.array(F.lit(None).cast("string")))
    return df.select(*keys, F.posexplode(lines).alias("para_id", "text")).select(
        *keys, "para_id", F.lit("body").alias("context"), "text"
    )


def table_cells(df: DataFrame, keys: Sequence[str], tables: str = "tables") -> DataFrame:
    """One row per paragraph of each cell of nested ``tables[t][r][c]``, numbered across all tables of the row."""
    return _numbered(df, keys, _cell_lines(f"`{tables}`"))


def document_paragraphs(df: DataFrame, keys: Sequence[str], text: str = "text", tables: str = "tables") -> DataFrame:
    """Body paragraphs, then those of table cells, numbered across the document."""
    return _numbered(df, keys, f"concat({_lines(f'`{text}`', quote('body'))}, {_cell_lines(f'`{tables}`')})")


def relational_cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per string cell of a relational table, labelled and numbered by its column."""
    long = df.unpivot(list(keys), list(columns), "column", "text")
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column")) - 1
    return long.select(
        *keys, place.cast("int").alias("para_id"), F.concat(F.lit("column["), "column", F.lit("]")).alias("context"), "text"
    )


def labelled_sentences(df: DataFrame) -> DataFrame:
    """One row per labelled value of ``(sent_id, text, entities)``; sentences
    without labels keep one row with NULLs."""
    return df.select("sent_id", "text", F.posexplode_outer("entities").alias("place", "e_")).select(
        "sent_id", "text", "place", "e_.entity_text", "e_.category"
    )
