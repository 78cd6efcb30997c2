"""Word files: checking uploads and reading their paragraphs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkveil.functions import fixed_values as fixed

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MAGIC, NOT_DOCX = bytes.fromhex(fixed.DOCX_MAGIC_HEX), "not a docx file"
# Names that pass, as the file source matches them.
DOCX_NAMES = "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in fixed.DOCX_SUFFIX)
PARAGRAPHS = "path string, para_id int, context string, text string, error string"


FILES = "path string, modificationTime timestamp, length bigint, content binary"
LISTED = "path string, length bigint"
# Tasks that look at names and lengths; the file source would make one for every few files, and the driver keeps a record of each.
STATUS_TASKS = 64


def read_uploads(spark: SparkSession, directory: str, names: str = "*", missing: str = "fail") -> DataFrame:
    """``path, modificationTime, length, content`` of all files below a directory, of those alone whose name fits ``names``.

    With ``missing="ignore"`` a file that is removed after it was listed is left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    return (reader.option("ignoreMissingFiles", "true") if missing == "ignore" else reader).load(directory)


def literal(path: str) -> str:
    """``path`` as a pattern that fits it alone: readers take paths as patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, modificationTime, length, content`` of the files listed."""
    return spark.read.format("binaryFile").load([literal(path) for path in paths])


def announce(spark: SparkSession, directory: str, lists: str, files_per_list: int) -> None:
    """Write lists of the files below ``directory`` that no list in ``lists`` names yet, oldest first.

    A list is one Parquet file of ``path, length`` of at most ``files_per_list``
    files.  It appears whole, and what is listed is told from the lists
    themselves, so an attempt that ends between two of them loses and doubles
    nothing.  Content stays unread.
    """
    try:
        found = read_uploads(spark, directory, missing="ignore").select("path", "length", "modificationTime")
    except AnalysisException as e:  # nobody has dropped a file yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    known = spark.read.schema(LISTED).parquet(literal(lists)).select("path")
    new = found.join(known, "path", "left_anti").coalesce(STATUS_TASKS).persist()
    try:
        if not new.isEmpty():
            ordered = new.repartition(1).sortWithinPartitions("modificationTime", "path").select("path", "length")
            ordered.write.mode("append").option("maxRecordsPerFile", files_per_list).parquet(lists)
    finally:
        new.unpersist()


def arriving_uploads(spark: SparkSession, lists: str) -> DataFrame:
    """A stream of ``path, length`` of announced files, a list per micro-batch.

    The stream's own files are the lists.  Were they the uploads, the file source
    would repeat all names of a micro-batch for each name that looks like a
    pattern, and list and schedule each file from the driver.
    """
    stream = spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d")
    return stream.parquet(lists)


def _reason_by_name() -> Column:
    """The first check that a file fails by its name or length alone, else NULL."""
    return F.when(~F.lower("path").endswith(fixed.DOCX_SUFFIX), "wrong extension").when(
        F.col("length") > fixed.DOCX_MAX_BYTES, "too large"
    )


def _reason_by_content() -> Column:
    return F.when(F.coalesce(F.hex(F.substring("content", 1, 4)), F.lit("")) != fixed.DOCX_MAGIC_HEX, NOT_DOCX)


def check_uploads(files: DataFrame) -> DataFrame:
    """Add ``reason``: NULL for an accepted file, else the first failed check."""
    return files.withColumn("reason", F.coalesce(_reason_by_name(), _reason_by_content()))


def sorted_by_name(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that pass by name and length, and ``path, length, reason`` of the others.

    Only ``path`` and ``length`` are looked at, so over a listing no content is read.
    """
    # The plain comparison is what the file source understands: longer files are not opened.
    fit = listing.where((F.col("length") <= fixed.DOCX_MAX_BYTES) & F.lower("path").endswith(fixed.DOCX_SUFFIX))
    failed = listing.select("path", "length", _reason_by_name().alias("reason")).where("reason IS NOT NULL")
    return fit, failed


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NULL").drop("reason")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NOT NULL").select("path", "length", "reason")


_MARKS = {_W + "tab": "\t", _W + "cr": "\n", _W + "noBreakHyphen": "-"}


def _run_part(n: ElementTree.Element) -> str:
    if n.tag == _W + "br":  # page and column breaks are no line breaks
        return "\n" if n.get(_W + "type", "textWrapping") == "textWrapping" else ""
    return (n.text or "") if n.tag == _W + "t" else _MARKS.get(n.tag, "")


def _text(paragraph: ElementTree.Element) -> str:
    """Text of the runs that stand in the paragraph or in its links."""
    runs = paragraph.findall(_W + "r") + paragraph.findall(_W + "hyperlink/" + _W + "r")
    order = {id(e): i for i, e in enumerate(paragraph.iter())}
    parts = (n for run in sorted(runs, key=lambda r: order[id(r)]) for n in run)
    return "".join(map(_run_part, parts))


def _cells(table: ElementTree.Element) -> Iterator[tuple[int, int, ElementTree.Element]]:
    """Cells by grid position: a merged cell stands at every place it covers."""
    above: list[ElementTree.Element] = []
    for r, row in enumerate(table.findall(_W + "tr")):
        current: list[ElementTree.Element] = []
        for cell in row.findall(_W + "tc"):
            span = cell.find(f"{_W}tcPr/{_W}gridSpan")
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            if merge is not None and merge.get(_W + "val", "continue") == "continue" and len(current) < len(above):
                cell = above[len(current)]
            current += [cell] * (int(span.get(_W + "val")) if span is not None else 1)
        yield from ((r, c, cell) for c, cell in enumerate(current))
        above = current


def _paragraphs(content: bytes) -> Iterator[tuple[str, str]]:
    """Body paragraphs, then the paragraphs of each cell of top-level tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        with archive.open("word/document.xml") as part:
            xml = part.read(fixed.DOCX_MAX_UNPACKED + 1)
    if len(xml) > fixed.DOCX_MAX_UNPACKED:
        raise ValueError(f"document.xml has over {fixed.DOCX_MAX_UNPACKED} bytes")
    body = ElementTree.fromstring(xml).find(_W + "body")
    for paragraph in body.findall(_W + "p"):
        yield "body", _text(paragraph)
    for t, table in enumerate(body.findall(_W + "tbl")):
        for r, c, cell in _cells(table):
            for paragraph in cell.findall(_W + "p"):
                yield f"table[{t}][{r},{c}]", _text(paragraph)


# Rows of a batch that Python holds as objects at a time.
SLICE_ROWS = 64


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few at a time, so that the objects made of them do not grow with Arrow's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "para_id", "context", "text", "error"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            data = content.as_py()
            try:
                if data is None or not data.startswith(_MAGIC):
                    found = [(None, None, None, NOT_DOCX)]
                else:
                    found = [(i, c, t, None) for i, (c, t) in enumerate(_paragraphs(data))]
            except Exception as e:  # whatever is wrong with one file must not end the job
                found = [(None, None, None, f"{type(e).__name__}: {e}")]
            columns = list(zip(*found)) if found else [[], [], [], []]
            values = [[path.as_py()] * len(found), *columns]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(values, types)], names=names)


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs and cells of accepted files, one file at a time per task.

    Only unzipping and XML run in Python; the file source packs files into
    bounded splits.  A file with other first bytes, a broken one, or one whose
    text unpacks to more than ``DOCX_MAX_UNPACKED`` bytes yields one row with
    ``error`` set.
    """
    return files.select("path", "content").mapInArrow(_read_batches, PARAGRAPHS)
