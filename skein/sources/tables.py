"""The tables of a data folder: one Parquet file or folder each; or, for texts that are read again and again, tables in buckets of their file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bucketed(df: DataFrame, key: str, name: str, path: str, buckets: int) -> DataFrame:
    """``df`` written once as a table in sorted buckets of a key. Two tables in as many buckets of their file ids (``files`` by ``id``, ``source_files`` by ``file_id``) meet without moving a text."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
