"""Reading tables so that all cores get work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table, spread over the cores if its files are too few.

    Large tables already have more splits than cores; they are left alone and
    stay free of any exchange.
    """
    table = spark.read.parquet(f"{directory}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
