"""The test tables, and rows dealt over all cores where a scan has too few tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over two tasks a core if its scan has fewer; a scan with tasks enough, as of any large table, is not shuffled.

    For narrow plans that take long for each row. A small file is one row group and so one task,
    however many cores wait.
    """
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
