"""The project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A stated set of queries: query_id (from 0), query."""
    one = spark.range(1).select(F.posexplode(F.array(*map(F.lit, texts))).alias("query_id", "query"))
    return one.select(F.col("query_id").cast("bigint").alias("query_id"), "query")
