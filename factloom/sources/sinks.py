"""Writers: result logs, run artifacts, tables and a keyed cache."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fixed_values as V
from factloom.functions import text as T


def append_results(results: DataFrame, path: str) -> None:
    """Append result rows as JSON lines, one folder per variant."""
    results.write.mode("append").partitionBy("variant").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_examples(examples: DataFrame, path: str) -> None:
    """Evaluation examples as JSON lines that ``readers.examples_jsonl`` takes; a document's own id becomes its source id."""
    labels = F.create_map(*[F.lit(x) for label, stance in V.FEVER_STANCES.items() for x in (stance, label)])
    own = lambda d: F.struct(d["document_id"].alias("source_id"), d["text"].alias("text"), d["title"].alias("title"))
    rows = examples.select(
        F.col("example_id").alias("id"), "question", F.transform("documents", own).alias("documents"), "answers",
        F.try_element_at(labels, F.col("stance")).alias("label"), "gold_source_ids", "split",
    )
    write_json(rows, path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small report table; fails rather than cut rows off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table holds at most {limit} rows; write CSV instead")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """One JSON document with secrets hidden, written like any other table."""
    plain = json.dumps(asdict(content) if is_dataclass(content) else content, sort_keys=True, default=str)
    row = spark.createDataFrame([(plain,)], "value string")
    row.select(T.redact(F.col("value")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def through_cache(
    wanted: DataFrame, cache_path: str, key: str, compute: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Look rows up in a keyed parquet cache, compute and append what is missing.

    Returns the cache rows for the wanted keys and the rows that were misses. Only
    distinct missing keys are computed, in one batch.
    """
    from factloom.session import cut_lineage

    spark = wanted.sparkSession
    distinct = wanted.dropDuplicates([key])
    known = _read_cache(spark, cache_path)
    misses = distinct if known is None else distinct.join(known.select(key), key, "left_anti")
    misses = cut_lineage(misses, "misses")
    compute(misses).write.mode("append").parquet(cache_path)
    cached = spark.read.parquet(cache_path)
    return cached.join(distinct.select(key), key, "left_semi"), misses


def _read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if files.exists(jvm_path) else None
