"""A corpus cleaned and packed in stages; each stage is written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of ``docs``. A stage drops only what
its operator rejects; documents without doc_id cannot be named by a join and stay. Columns may have any names but those of ``documents``, which have their meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from factloom.llm.common import bounded, fold
from factloom.session import cut_lineage

#: Documents of this score or more are rejected.
TOXIC = 0.7


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is not among ``ids`` (one column, doc_id)."""
    return docs.join(bounded(cut_lineage(ids.distinct(), "dropped")), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents by toxicity, learned from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels.filter(fold(F.col("doc_id"), 3) != 1))
    return docs.filter(toxicity.toxicity(F.col("text"), model)["score"] < TOXIC)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that stand on too many documents of a source; documents stay."""
    found = line_dedup.boilerplate(docs, "source", "text")
    whole = docs.select(F.struct(*docs.columns).alias("whole"), "source", "text")
    cleaned = line_dedup.drop_lines(whole, found, "source", "text")
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": n_chars}
    return cleaned.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every group of near-duplicates: the smallest doc_id, of rows that share it the first by a hash of the text.

    Rows whose doc_id repeats, is null or negative are written with a number of their own first, so that rows of one doc_id are
    compared like any others; texts without a word are like nothing and stay.
    """
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    repeated = bounded(cut_lineage(repeated, "repeated"))
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole"))
    named = whole.filter("doc_id >= 0")
    again = named.join(repeated, "doc_id", "left_semi").unionByName(whole.filter("doc_id IS NULL OR doc_id < 0"))
    again = cut_lineage(again.withColumn("number", -1 - F.monotonically_increasing_id()), "again")  # no doc_id of the others
    single = named.join(repeated, "doc_id", "left_anti")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("h"))
    rows = single.select("doc_id", "text", F.col("doc_id").cast("bigint").alias("number"), place.alias("place")).unionByName(
        again.select("doc_id", "text", "number", place.alias("place")))
    found = cut_lineage(near_dedup.near_duplicates(rows.select(F.col("number").alias("doc_id"), "text"), shingle=5, percent=80), "groups")
    # a group that a numbered row leads is led by its first row in the order of doc_id instead
    mixed = found.join(rows.filter("number < 0").select(F.col("number").alias("doc_id"), "place"), "doc_id")
    mixed = found.select("doc_id", "component_id").join(mixed.select("component_id").distinct(), "component_id", "left_semi")
    mixed = mixed.join(rows.select(F.col("number").alias("doc_id"), "place"), "doc_id")
    first = mixed.groupBy("component_id").agg(F.min_by("doc_id", F.struct("place", "doc_id")).alias("first"))
    led = found.join(bounded(cut_lineage(first, "first")), "component_id", "left")
    gone = cut_lineage(led.filter(F.col("doc_id") != F.coalesce("first", "component_id")).select(F.col("doc_id").alias("number")), "gone")
    left = single.join(bounded(gone.withColumnRenamed("number", "doc_id")), "doc_id", "left_anti").select("whole.*")
    return left.unionByName(again.join(bounded(gone), "number", "left_anti").select("whole.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontamination.contaminated(docs, items).select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the words of every document stand in the training sequences."""
    return packing.best_fit(docs, "doc_id", packing.word_count(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Learned scores and packing have no SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus: rows doc_id, piece, start, length, sequence, offset, capacity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
