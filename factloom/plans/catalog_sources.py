"""Given tables written in the input formats of the readers and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans import oracle as O
from factloom.plans.registry import longs, query, table
from factloom.session import shared_dir
from factloom.sources import readers, sinks


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach."""
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def _line(n: int) -> Column:
    return F.coalesce(F.get(F.split("text", "\n"), n), F.lit(""))


_LABELS = ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO"]
_LINES = "l AS (SELECT *, string_split(text, chr(10)) AS x FROM documents)"
_SQL_LINE = "coalesce(x[{0}], '')"


@query(
    "read_claim_checks",
    O.chain(
        _LINES,
        f"""e AS (SELECT doc_id, source, lang, {O.trimmed(_SQL_LINE.format(1))} AS a, {O.trimmed(_SQL_LINE.format(2))} AS b, {O.trimmed(_SQL_LINE.format(3))} AS c FROM l)""",
        final="""SELECT CAST(doc_id AS VARCHAR) AS example_id, ['supports', 'refutes', 'not_enough_info'][doc_id % 3 + 1] AS stance, doc_id % 3 < 2 AS gold_available,
  CAST((a <> '')::INT + (b <> '')::INT + (c <> '')::INT AS BIGINT) AS n_documents,
  array_to_string(list_filter([CASE WHEN a <> '' THEN source || '#0#0' END, CASE WHEN b <> '' THEN lang || '#1#1' END, CASE WHEN c <> '' THEN source || '#2#2' END],
    lambda v: v IS NOT NULL), '|') AS document_ids, md5(a || b || c) AS texts FROM e""",
    ),
)
def read_claim_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Claims with up to three evidence sentences, some of them without text."""
    doc_id = F.col("doc_id")
    triple = lambda page, n: F.array(F.col(page), F.lit(str(n)), _line(n))
    rows = table(spark, folder, "documents").select(
        doc_id.cast("string").alias("id"), F.concat(F.lit("claim "), doc_id.cast("string")).alias("claim"),
        F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (doc_id % 3 + 1).cast("int")).alias("label"),
        F.array(triple("source", 0), triple("lang", 1), triple("source", 2)).alias("evidence"),
    )
    path = _folder(spark, "claims")
    sinks.write_json(rows, path)
    found = readers.fever_jsonl(spark, path)
    return longs(
        found.select(
            "example_id", "stance", "gold_available", F.size("documents").alias("n_documents"),
            F.array_join(F.transform("documents", lambda d: d["document_id"]), "|").alias("document_ids"),
            F.md5(F.array_join(F.transform("documents", lambda d: d["text"]), "")).alias("texts"),
        ),
        "n_documents",
    )


@query(
    "read_multi_hop",
    O.chain(
        _LINES,
        f"""e AS (SELECT doc_id, source, lang, {O.trimmed(_SQL_LINE.format(1))} AS a, {O.trimmed(_SQL_LINE.format(2))} AS b, {O.trimmed(_SQL_LINE.format(3))} AS c FROM l)""",
        final="""SELECT CAST(doc_id AS VARCHAR) AS example_id, CAST((a <> '')::INT + (b <> '')::INT + (c <> '')::INT AS BIGINT) AS n_documents,
  array_to_string(list_filter([CASE WHEN a <> '' THEN source || '#0' END, CASE WHEN b <> '' THEN source || '#1' END, CASE WHEN c <> '' THEN lang || '#0' END],
    lambda v: v IS NOT NULL), '|') AS document_ids, source AS gold FROM e""",
    ),
)
def read_multi_hop(spark: SparkSession, folder: str) -> DataFrame:
    """Nested parquet with two titles and three sentences an example."""
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("question"), F.col("lang").alias("answer"),
        F.lit("bridge").alias("type"), F.lit(None).cast("string").alias("level"),
        F.struct(
            F.array("source", "lang").alias("title"), F.array(F.array(_line(0), _line(1)), F.array(_line(2))).alias("sentences")
        ).alias("context"),
        F.struct(F.array("source", "source").alias("title"), F.array(F.lit(0), F.lit(1)).alias("sent_id")).alias("supporting_facts"),
    )
    found = readers.hotpot_parquet(spark, _written(spark, rows, "multi-hop"))
    return longs(
        found.select(
            "example_id", F.size("documents").alias("n_documents"),
            F.array_join(F.transform("documents", lambda d: d["document_id"]), "|").alias("document_ids"), F.array_join("gold_source_ids", "|").alias("gold"),
        ),
        "n_documents",
    )


def _written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = _folder(spark, name)
    rows.write.parquet(path)
    return path


@query(
    "examples_round_trip",
    """SELECT CAST(doc_id AS VARCHAR) AS example_id, 'about ' || source AS question, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS answers,
  CASE WHEN doc_id % 4 < 3 THEN ['supports', 'refutes', 'not_enough_info'][doc_id % 4 + 1] END AS stance, md5(text) AS text, lang AS title,
  CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE '' END AS gold, doc_id % 3 = 0 OR doc_id % 4 < 3 AS gold_available FROM documents""",
)
def examples_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Examples written as JSON lines and read again."""
    doc_id, none = F.col("doc_id"), F.array().cast("array<string>")
    own = F.concat(F.lit("d"), doc_id.cast("string"))
    stance = F.when(doc_id % 4 < 3, F.element_at(F.array(*[F.lit(x) for x in ("supports", "refutes", "not_enough_info", "")]), (doc_id % 4 + 1).cast("int")))
    rows = table(spark, folder, "documents").select(
        doc_id.cast("string").alias("example_id"), F.concat(F.lit("about "), "source").alias("question"),
        F.array(F.struct(own.alias("document_id"), "text", F.col("source").alias("source_id"), F.col("lang").alias("title"))).alias("documents"),
        F.when(doc_id % 2 == 0, F.array("lang")).otherwise(none).alias("answers"), stance.alias("stance"),
        F.when(doc_id % 3 == 0, F.array(own)).otherwise(none).alias("gold_source_ids"), F.lit("test").alias("split"),
    )
    path = _folder(spark, "examples")
    sinks.write_examples(rows, path)
    found = readers.examples_jsonl(spark, path)
    return found.select(
        "example_id", "question", F.array_join("answers", "|").alias("answers"), "stance", F.md5(F.col("documents")[0]["text"]).alias("text"),
        F.col("documents")[0]["title"].alias("title"), F.array_join("gold_source_ids", "|").alias("gold"), "gold_available",
    )


@query("read_text_folder", "SELECT doc_id, md5(text) AS digest, length(text) AS size FROM documents WHERE text IS NOT NULL")
def read_text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, some twenty to a text file, read back as a folder of text files."""
    path = _folder(spark, "texts")
    line = F.to_json(F.struct("doc_id", "text")).alias("value")
    table(spark, folder, "documents").filter("text IS NOT NULL").select(line).write.option("maxRecordsPerFile", 20).text(path)
    files = readers.text_folder(spark, path, max_bytes=128 * 1024 * 1024)
    rows = files.select(F.explode(F.split("text", "\n")).alias("line")).select(F.from_json("line", "doc_id bigint, text string").alias("d"))
    return longs(rows.select("d.doc_id", F.md5("d.text").alias("digest"), F.length("d.text").alias("size")), "size")


@query(
    "read_snapshot_limit",
    """SELECT CAST(doc_id AS VARCHAR) AS example_id, 'about ' || source AS question, md5(text) AS text FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 100""",
)
def read_snapshot_limit(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred examples of the snapshot that sorts first; the other one asks other questions."""
    path = _folder(spark, "snapshots")
    for name, start in (("snap-b", "not about "), ("snap-a", "about ")):
        rows = table(spark, folder, "documents").select(
            F.col("doc_id").cast("string").alias("id"), F.concat(F.lit(start), "source").alias("question"),
            F.array(F.struct(F.col("source").alias("source_id"), "text", F.col("lang").alias("title"))).alias("documents"),
        )
        sinks.write_json(rows, f"{path}/{name}")
    found = readers.first_examples(readers.examples_jsonl(spark, readers.latest_snapshot(spark, f"{path}/snap-*")), 100)
    return found.select("example_id", "question", F.md5(F.col("documents")[0]["text"]).alias("text"))


@query(
    "result_log_lines",
    """SELECT o_orderpriority AS variant, count(*) FILTER (o_orderkey % 50 <> 0) AS good, count(*) FILTER (o_orderkey % 50 = 0) AS bad,
  round(sum(o_totalprice) FILTER (o_orderkey % 50 <> 0), 2) AS total FROM orders GROUP BY 1""",
)
def result_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A result log of which every fiftieth line was cut off while it was written."""
    line = F.to_json(
        F.struct(F.col("o_orderkey").cast("string").alias("example_id"), F.col("o_orderpriority").alias("variant"), F.lit(1).alias("seed"), F.create_map(F.lit("price"), "o_totalprice").alias("metrics"), F.lit(False).alias("failed"))
    )
    cut = F.concat(F.lit('{"variant": "'), "o_orderpriority", F.lit('", "example_id'))
    path = _folder(spark, "log")
    table(spark, folder, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, cut).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.results_log(spark, path)
    kept = good.select("variant", F.lit(1).alias("good"), F.lit(0).alias("bad"), F.col("metrics")["price"].alias("price"))
    lost = bad.select(F.regexp_extract("_bad", r'"variant": "([^"]*)"', 1).alias("variant"), F.lit(0).alias("good"), F.lit(1).alias("bad"), F.lit(0.0).alias("price"))
    found = kept.unionByName(lost).groupBy("variant").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.round(F.sum("price"), 2).alias("total"))
    return longs(found, "good", "bad")


@query(
    "cache_through",
    "SELECT md5(text) AS key, any_value(length(text)) AS size, bool_and(lang <> 'en') AS missed FROM documents GROUP BY 1",
)
def cache_through(spark: SparkSession, folder: str) -> DataFrame:
    """Texts looked up in a cache that already holds the English ones."""
    rows = table(spark, folder, "documents").select(F.md5("text").alias("key"), "text", "lang")
    compute = lambda df: df.select("key", F.length("text").cast("bigint").alias("size"))
    path = _folder(spark, "cache")
    sinks.through_cache(rows.filter("lang = 'en'"), path, "key", compute)
    found, misses = sinks.through_cache(rows, path, "key", compute)
    return found.join(misses.select("key", F.lit(True).alias("missed")), "key", "left").na.fill(False, ["missed"])
