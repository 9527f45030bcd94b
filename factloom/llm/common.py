"""Small helpers of the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.scale import within_rows

#: Rows of single numbers that may be broadcast, after counting them.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def lowered(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), 0)


def bounded(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` marked for broadcasting if it is counted to hold at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if within_rows(df, limit) else df


def bounded_sample(df: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """About ``most`` rows of every group, or all where there are fewer, chosen by the key's hash."""
    sizes = df.groupBy(group).count().select(F.col(group).alias("_g"), F.col("count").alias("_size"))
    share = F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 20)) / float(1 << 20)
    rows = df.join(F.broadcast(sizes), F.col(group) == F.col("_g"))
    return rows.filter(share * F.col("_size") < most).drop("_g", "_size")
