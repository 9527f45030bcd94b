"""Named queries and, where one exists, the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), "text", F.col("source").alias("source_id")
    )


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def quality_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("document_id"), "quality")


def longs(df: DataFrame, *columns: str) -> DataFrame:
    """Integer columns as BIGINT, as SQL counts are."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def joined(column: str) -> Column:
    return F.array_join(column, "|")
