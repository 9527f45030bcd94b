"""Stores and snapshots written and read back, and checks of graphs and citations with faults taken from table columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas as S
from factloom.operators import graph as G
from factloom.operators import packaging
from factloom.plans import catalog_facts as facts
from factloom.plans import oracle as O
from factloom.plans.registry import query, table
from factloom.session import cut_lineage, shared_dir
from factloom.sources import snapshots, store


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def damage(where: store.Store, spark: SparkSession, part: str, change: dict) -> None:
    """Overwrite the stored rows of one part with altered ones, behind the store's back."""
    path = f"{where.path}/entries"
    rows = cut_lineage(spark.read.parquet(path).filter(F.col("store_part") == part).withColumns(change), "damage")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store_batch", "store_part").parquet(path)


@query(
    "cache_repair",
    """WITH t AS (SELECT sha256(coalesce(text, '')) AS key, any_value(length(coalesce(text, ''))) AS size, bool_or(l.doc_id IS NOT NULL) AS stored
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1),
p AS (SELECT *, 'p' || substr(md5(key), 1, 1) AS part FROM t)
SELECT key, part, size, stored AND part <> 'p3' AS hit, part = 'p3' AND EXISTS (SELECT 1 FROM p WHERE stored AND part = 'p3') AS damaged FROM p""",
)
def cache_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of all texts from a store that holds those of the labelled ones and was damaged in one part since."""
    where = store.Store(_folder(spark, "store"), digits=1)
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select("doc_id", F.sha2(text, 256).alias("key"), text.alias("text"))
    compute = lambda df: df.select("key", F.length("text").cast("bigint").alias("size"))
    store.lookup(where, rows.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi"), compute)
    damage(where, spark, "p3", {"size": F.col("size") + 1})
    probe = store.lookup(where, rows, compute)
    return probe.rows.join(probe.outcomes, "key").select("key", F.col("store_part").alias("part"), "size", "hit", "damaged")


@query(
    "graph_snapshot",
    O.chain(
        facts._FACTS, facts._PAIRS,
        final="""SELECT query_id, 'claim' AS kind, claim_id AS id, predicate AS a, CAST(object AS VARCHAR) AS b, belief AS weight, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM f
UNION ALL SELECT query_id, 'contradiction', 'c:' || a_id || ':' || b_id, a_id, b_id, 0.8, NULL FROM p""",
    ),
)
def graph_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Facts and their contradictions written as a graph snapshot and read back."""
    claims = cut_lineage(facts.facts(spark, folder), "facts")
    path = _folder(spark, "snapshot")
    snapshots.write_graph(claims, facts.contradictions(claims), path, size=64)
    claims, relations = snapshots.read_graph(spark, path)
    nodes = claims.select(
        "query_id", F.lit("claim").alias("kind"), F.col("claim_id").alias("id"), F.col("predicate").alias("a"), F.col("object").alias("b"),
        F.col("belief").alias("weight"), F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )
    edges = relations.select(
        "query_id", F.col("relation_type").alias("kind"), F.col("relation_id").alias("id"), F.col("source_claim_id").alias("a"),
        F.col("target_claim_id").alias("b"), F.col("relation_confidence").alias("weight"), F.lit(None).cast("string").alias("at"),
    )
    return nodes.unionByName(edges)


_SUPPLY = [
    """c AS (SELECT CAST(l_suppkey AS VARCHAR) AS query_id, 'p' || l_partkey AS claim_id, l_linenumber AS span_start, CAST(l_quantity AS BIGINT) AS span_end
  FROM lineitem WHERE l_linestatus = 'O')""",
    """r AS (SELECT CAST(l_suppkey AS VARCHAR) AS query_id, l_orderkey || ':' || l_suppkey AS id, 'p' || l_partkey AS a,
  'p' || (l_partkey + CAST(l_quantity AS BIGINT) % 5 - 2) AS b, round(CAST(l_discount AS DOUBLE) * 11, 2) AS confidence, l_returnflag FROM lineitem)""",
]


@query(
    "supply_violations",
    O.chain(
        *_SUPPLY,
        final="""SELECT query_id, 'duplicate_claim' AS issue, claim_id AS id FROM c GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT query_id, 'duplicate_relation', id FROM r GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT query_id, 'self_relation', id FROM r WHERE a = b
UNION ALL SELECT query_id, 'confidence_out_of_range', id FROM r WHERE confidence > 1 OR confidence < 0
UNION ALL SELECT query_id, 'dangling_source', id FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = r.query_id AND claim_id = a)
UNION ALL SELECT query_id, 'dangling_target', id FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = r.query_id AND claim_id = b)
UNION ALL SELECT query_id, 'empty_span', claim_id FROM c WHERE span_end <= span_start
UNION ALL SELECT query_id, 'stored_neutral', id FROM r WHERE l_returnflag = 'A'""",
    ),
)
def supply_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Every graph invariant, broken by the lines themselves: open lines are claims about parts, each line relates two parts of its supplier."""
    lines = table(spark, folder, "lineitem")
    part = lambda number: F.concat(F.lit("p"), number.cast("string"))
    quantity, key = F.col("l_quantity").cast("bigint"), F.col("l_suppkey").cast("string").alias("query_id")
    claims = lines.filter("l_linestatus = 'O'").select(
        key, part(F.col("l_partkey")).alias("claim_id"), F.col("l_linenumber").alias("span_start"), quantity.alias("span_end")
    )
    relations = lines.select(
        key, F.concat_ws(":", "l_orderkey", "l_suppkey").alias("relation_id"), part(F.col("l_partkey")).alias("source_claim_id"),
        part(F.col("l_partkey") + quantity % 5 - 2).alias("target_claim_id"),
        F.when(F.col("l_returnflag") == "A", S.NEUTRAL).otherwise(S.SUPPORT).alias("relation_type"),
        F.round(F.col("l_discount").cast("double") * 11, 2).alias("relation_confidence"),
    )
    return G.validate(claims, relations)


@query(
    "attribution_checks",
    """WITH l AS (SELECT l_orderkey, 'L' || l_linenumber AS own, l_returnflag AS flag, CASE l_partkey % 4 WHEN 0 THEN 'L' || (l_linenumber + 10)
    WHEN 1 THEN NULL ELSE 'L' || l_linenumber END AS cited FROM lineitem),
k AS (SELECT a.l_orderkey, a.cited, bool_or(b.own IS NOT NULL) AS known, bool_or(coalesce(b.flag = 'R', false)) AS rejected
  FROM l a LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.own = a.cited WHERE a.cited IS NOT NULL GROUP BY ALL),
e AS (SELECT l_orderkey, count(*) AS cited, string_agg(cited, ''', ''' ORDER BY cited) FILTER (NOT known) AS unknown,
  string_agg(cited, ''', ''' ORDER BY cited) FILTER (rejected) AS wrong FROM k GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS query_id, coalesce(cited, 0) AS n_cited, CASE WHEN o_orderstatus = 'P' THEN 'GenerationError: cut off'
  WHEN unknown IS NOT NULL THEN 'GenerationError: answer cites unknown claim id(s): [''' || unknown || ''']'
  WHEN wrong IS NOT NULL THEN 'GenerationError: answer cites rejected evidence as support: [''' || wrong || ''']' END AS error
FROM orders LEFT JOIN e ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def attribution_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Answers about orders that cite their lines, some of which do not exist and some of which were rejected."""
    own = lambda n: F.concat(F.lit("L"), n.cast("string"))
    number, how = F.col("l_linenumber"), F.col("l_partkey") % 4
    status = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "superseded").otherwise("selected")
    cited = F.when(how == 0, own(number + 10)).when(how == 1, None).otherwise(own(number))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.struct(own(number).alias("claim_id"))).alias("claims"),
        F.collect_list(F.struct(own(number).alias("claim_id"), status.alias("status"))).alias("selected"),
        F.collect_set(cited).alias("cited_claim_ids"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "cut off").alias("error"))
    rows = lines.join(orders, "o_orderkey").withColumn("query_id", F.col("o_orderkey").cast("string"))
    found = packaging.attribution_errors(rows.select("query_id", "cited_claim_ids", "error"), rows.select("query_id", "claims", "selected"))
    return found.select("query_id", F.size("cited_claim_ids").cast("bigint").alias("n_cited"), "error")
