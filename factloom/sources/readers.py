"""Readers: text folders, example files, benchmark files and result logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from factloom import schemas as S
from factloom.functions import fixed_values as V
from factloom.functions import text as T
from factloom.scale import numbered

MAX_FILE_BYTES = 10 * 1024 * 1024


def text_folder(spark: SparkSession, path: str, *, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Documents from the ``*.txt`` files directly inside a folder.

    Ids follow the sorted file names. An oversized file fails the read, as does a
    glob character in ``path``, so a read never leaves its folder.
    """
    if any(ch in path for ch in "*?[]{}"):
        raise ValueError("the folder must not contain glob characters")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    fits = F.assert_true(F.col("length") <= max_bytes, F.concat(F.lit("file too large: "), "path"))
    rows = files.select(
        name.alias("title"),
        F.when(fits.isNull(), F.decode("content", "utf-8")).alias("text"),
    )
    numbers = numbered(files.select(name.alias("title")), "title").withColumn("document_id", F.concat(F.lit("doc-"), F.col("number").cast("string")))
    return rows.join(numbers.drop("number"), "title").select(
        "document_id", T.strip(F.col("text")).alias("text"), F.regexp_replace("title", r"\.txt$", "").alias("source_id"), "title"
    )


def _example(df: DataFrame) -> DataFrame:
    columns = "example_id question documents answers stance gold_source_ids gold_available split metadata".split()
    return df.select(*columns)


_DOCS = "array<struct<document_id:string,text:string,source_id:string,title:string>>"


def examples_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation examples, one JSON object per line; a bad line fails the read."""
    rows = spark.read.schema(S.EXAMPLES).json(path, mode="FAILFAST")
    question = F.coalesce(F.nullif("question", F.lit("")), F.nullif("claim", F.lit("")))
    rows = rows.select(
        "*",
        F.when(
            F.assert_true(question.isNotNull(), F.lit("each example needs 'question' or 'claim'")).isNull()
            & F.assert_true(F.size("documents") > 0, F.lit("each example needs documents")).isNull(),
            question,
        ).alias("_question"),
    )
    stance = _lookup(F.upper("label"), V.FEVER_STANCES)
    gold = F.coalesce("gold_source_ids", F.array().cast("array<string>"))
    answers = F.when(F.size("answers") > 0, F.col("answers")).when(
        F.col("answer").isNotNull(), F.array("answer")
    ).otherwise(F.array().cast("array<string>"))
    return _example(
        rows.select(
            F.col("id").alias("example_id"),
            F.col("_question").alias("question"),
            F.transform(
                "documents",
                lambda d: F.struct(
                    d["source_id"].alias("document_id"), d["text"].alias("text"), d["source_id"].alias("source_id"), d["title"].alias("title")
                ),
            ).cast(_DOCS).alias("documents"),
            answers.alias("answers"),
            stance.alias("stance"),
            gold.alias("gold_source_ids"),
            ((F.size(gold) > 0) | stance.isNotNull()).alias("gold_available"),
            F.coalesce("split", F.lit("test")).alias("split"),
            F.create_map().cast("map<string,string>").alias("metadata"),
        )
    )


def _lookup(key, values: dict[str, str]):
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def fever_jsonl(spark: SparkSession, path: str, *, split: str = "valid") -> DataFrame:
    """Claim verification examples: evidence triples become documents.

    Empty sentences are skipped; pages are kept in order of first mention.
    """
    rows = spark.read.schema(S.FEVER).json(path, mode="FAILFAST")
    stance = _lookup(F.col("label"), V.FEVER_STANCES)
    known = F.assert_true(stance.isNotNull(), F.concat(F.lit("unknown label "), F.coalesce("label", F.lit("null"))))
    placed = F.transform(
        F.coalesce("evidence", F.array().cast("array<array<string>>")),
        lambda e, i: F.struct(e[0].alias("page"), e[1].alias("sentence"), e[2].alias("text"), i.alias("i")),
    )
    rows = rows.withColumn("_e", F.filter(placed, lambda e: T.strip(e["text"]) != ""))
    docs = F.transform(
        "_e",
        lambda e: F.struct(
            F.concat(e["page"], F.lit("#"), e["sentence"], F.lit("#"), e["i"].cast("string")).alias("document_id"),
            T.strip(e["text"]).alias("text"),
            e["page"].alias("source_id"),
            F.replace(e["page"], F.lit("_"), F.lit(" ")).alias("title"),
        ),
    )
    pages = F.array_distinct(F.transform("_e", lambda e: e["page"]))
    total = F.size(F.coalesce("evidence", F.array().cast("array<array<string>>")))
    return _example(
        rows.select(
            F.col("id").alias("example_id"),
            F.col("claim").alias("question"),
            docs.cast(_DOCS).alias("documents"),
            F.array("label").alias("answers"),
            F.when(known.isNull(), stance).alias("stance"),
            pages.alias("gold_source_ids"),
            (stance != "not_enough_info").alias("gold_available"),
            F.lit(split).alias("split"),
            F.create_map(
                F.lit("label"), F.col("label"),
                F.lit("verifiable"), F.coalesce("verifiable", F.lit("")),
                F.lit("original_id"), F.coalesce("original_id", F.lit("")),
                F.lit("evidence_pages"), F.to_json(pages),
                F.lit("num_evidence"), total.cast("string"),
                F.lit("num_evidence_skipped_empty"), (total - F.size("_e")).cast("string"),
            ).alias("metadata"),
        )
    )


def hotpot_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Multi-hop examples: one document per non-empty context sentence."""
    rows = spark.read.parquet(path)
    sections = F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))
    docs = F.flatten(
        F.transform(
            sections,
            lambda s: F.filter(
                F.transform(
                    s["sentences"],
                    lambda x, i: F.struct(
                        F.concat(s["title"], F.lit("#"), i.cast("string")).alias("document_id"),
                        T.strip(x).alias("text"),
                        s["title"].alias("source_id"),
                        s["title"].alias("title"),
                    ),
                ),
                lambda d: d["text"] != "",
            ),
        )
    )
    facts = F.zip_with(
        "supporting_facts.title", "supporting_facts.sent_id",
        lambda t, i: F.struct(t.alias("title"), i.cast("int").alias("sentence")),
    )
    return _example(
        rows.select(
            F.col("id").alias("example_id"),
            "question",
            docs.cast(_DOCS).alias("documents"),
            F.array("answer").alias("answers"),
            F.lit(None).cast("string").alias("stance"),
            F.array_distinct("supporting_facts.title").alias("gold_source_ids"),
            F.lit(True).alias("gold_available"),
            F.lit("validation").alias("split"),
            F.create_map(
                F.lit("type"), F.coalesce("type", F.lit("")), F.lit("level"), F.coalesce("level", F.lit("")),
                F.lit("supporting_facts"), F.to_json(facts),
            ).alias("metadata"),
        )
    )


def latest_snapshot(spark: SparkSession, pattern: str) -> str | None:
    """The first path in sorted order that matches a glob, or None."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(f.getPath().toString()) for f in found or [])
    return names[0] if names else None


def results_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Result rows and, separately, the lines that could not be read."""
    schema = TT._parse_datatype_string(S.RESULTS).add("_bad", TT.StringType())
    rows = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    # the corrupt-record column is only filled when other columns are read with it
    bad = F.col("_bad").isNotNull() | F.col("example_id").isNull()
    return rows.filter(~bad).drop("_bad"), rows.filter(bad)


def manifest_ids(spark: SparkSession, path: str) -> DataFrame:
    """``position, example_id`` of a sample manifest."""
    rows = spark.read.schema("example_ids array<string>, dataset_fingerprint_sha256 string").json(path, multiLine=True)
    return rows.select(F.posexplode("example_ids").alias("position", "example_id"))


def by_manifest(examples: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples in manifest order, and the manifest ids without an example."""
    return (
        manifest.join(examples, "example_id").orderBy("position"),
        manifest.join(examples.select("example_id"), "example_id", "left_anti"),
    )


def example_documents(examples: DataFrame) -> DataFrame:
    """Explode examples to documents keyed by ``query_id``."""
    return examples.select(F.col("example_id").alias("query_id"), F.explode("documents").alias("_d")).select(
        "query_id", "_d.*"
    )


def first_examples(examples: DataFrame, limit: int | None) -> DataFrame:
    """The first examples by id when a loader is asked for fewer."""
    return examples if limit is None else examples.orderBy("example_id").limit(limit)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
