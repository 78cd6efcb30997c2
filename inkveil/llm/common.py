"""Tables of a run, intermediate tables in the shared folder, and checked broadcasts."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# A table is broadcast only after its rows were counted to be at most this many.
BROADCAST_ROWS = 20_000


def batch_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF that is made when first applied: its type, as SQL text, can't be read before there is a session."""

    def wrap(function: Callable) -> Callable[..., Column]:
        @functools.wraps(function)
        def apply(*columns: Column | str) -> Column:
            return F.pandas_udf(function, returns)(*columns)

        return apply

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a folder of this machine, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "inkveil-shared")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs neither recompute it nor depend on executors.

    ``row_group`` bounds the bytes that a task holds before it writes them, for rows of large values.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_all(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
