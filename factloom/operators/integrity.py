"""Dataset checks, profiles and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issues(examples: DataFrame) -> DataFrame:
    """Problems of an example table, one row per kind and key.

    ``examples`` has ``example_id, question, content, split, has_gold``. Copies are
    counted with map-side aggregates and reported once per key, with their number.
    """

    def row(df: DataFrame, kind: str, key: str, n: str) -> DataFrame:
        return df.select(F.lit(kind).alias("issue"), F.col(key).cast("string").alias("key"), F.col(n).cast("bigint").alias("n"))

    ids = examples.groupBy("example_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    content = (
        examples.groupBy(F.sha2("content", 256).alias("h"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("example_id").alias("example_id"))
        .filter("n > 1")
    )
    missing = examples.filter(~F.col("has_gold")).select("example_id", F.lit(1).alias("n"))
    overlap = (
        examples.groupBy("question")
        .agg(F.count_distinct("split").alias("n"), F.min("example_id").alias("example_id"))
        .filter("n > 1")
    )
    return (
        row(ids, "duplicate_id", "example_id", "n")
        .unionByName(row(content, "duplicate_content", "example_id", "n"))
        .unionByName(row(missing, "missing_gold", "example_id", "n"))
        .unionByName(row(overlap, "split_overlap", "example_id", "n"))
    )


def profile(examples: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, mean document number and gold coverage per group.

    ``examples`` has ``num_documents, gold, present`` (gold pages and how many of
    them occur among the documents).
    """
    full = (F.col("gold") > 0) & (F.col("present") == F.col("gold"))
    none = F.col("present") == 0
    return examples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("num_documents").alias("mean_documents"),
        F.count_if(full).alias("full_coverage"),
        F.count_if(~full & ~none).alias("partial_coverage"),
        F.count_if(~full & none).alias("no_coverage"),
    )


def fingerprint(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One digest over all rows, ordered by key, without one task reading them all.

    Rows are hashed on their own and folded level by level: each level groups
    digests by a shorter prefix of the key's hash, so a group stays small.
    """
    leaf = F.sha2(F.concat(F.col(key).cast("string"), F.char(F.lit(0)), text, F.char(F.lit(1))), 256)
    home = F.sha2(F.col(key).cast("string"), 256)
    level = rows.select(home.alias("home"), leaf.alias("digest")).groupBy("home", "digest").agg(
        F.count(F.lit(1)).alias("n")
    )
    level = level.select("home", F.concat("digest", F.lit("x"), F.col("n").cast("string")).alias("digest"))
    for width in (8, 5, 2, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("home", "digest"))), lambda s: s["digest"]), ",")
        level = level.groupBy(F.left("home", F.lit(width)).alias("_p")).agg(F.sha2(joined, 256).alias("digest"))
        level = level.withColumnRenamed("_p", "home")
    return level.select(F.col("digest").alias("fingerprint"))
