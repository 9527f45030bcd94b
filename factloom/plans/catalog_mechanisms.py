"""Mechanism metrics over the fact graph; gold annotations come from columns of the facts, so hits and misses occur.

Gold keeps the relations and sets of which the event number of the first claim is not divisible by three, names
the later claim as preferred where that number is odd, and asks for edges of a kind that the graph does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas as S
from factloom.operators import evaluation
from factloom.plans import oracle as O
from factloom.plans.catalog_facts import _FACTS, _NEWER, _OUTCOMES, _PAIRS, contradictions, fact_graph, resolved
from factloom.plans.registry import query

_NUMBER = "CAST(substr({0}, 2) AS BIGINT)"
_GOLD = f"""gold AS (SELECT query_id, newer_id AS a, older_id AS b, 'supersedes' AS relation FROM n WHERE {_NUMBER.format('newer_id')} % 3 <> 0
  UNION ALL SELECT query_id, least(a_id, b_id), greatest(a_id, b_id), 'contradicts' FROM p WHERE {_NUMBER.format('a_id')} % 3 <> 0
  UNION ALL SELECT query_id, least(a_id, b_id), greatest(a_id, b_id), 'supports' FROM p WHERE {_NUMBER.format('a_id')} % 50 = 0)"""


def _number(claim: str) -> Column:
    return F.substring(claim, 2, 20).cast("bigint")


def _gold(relations: DataFrame) -> DataFrame:
    a = _number("source_claim_id")
    names = F.when(F.col("relation_type") == S.SUPERSESSION, F.lit("supersedes")).otherwise(F.lit("contradicts"))
    kept = relations.filter(a % 3 != 0).select("query_id", "source_claim_id", "target_claim_id", names.alias("relation"))
    other = relations.filter((F.col("relation_type") == S.CONTRADICTION) & (a % 50 == 0))
    return kept.unionByName(other.select("query_id", "source_claim_id", "target_claim_id", F.lit("supports").alias("relation")))


@query(
    "mechanism_edges",
    O.chain(
        _FACTS, _NEWER, _PAIRS, _GOLD,
        """found AS (SELECT query_id, newer_id AS a, older_id AS b, 'supersedes' AS relation FROM n
  UNION ALL SELECT query_id, least(a_id, b_id), greatest(a_id, b_id), 'contradicts' FROM p)""",
        """s AS (SELECT query_id, relation, count(f.k) FILTER (g.k = 1) AS hits, count(f.k) AS predicted, count(g.k) AS gold
FROM (SELECT *, 1 AS k FROM found) f FULL JOIN (SELECT *, 1 AS k FROM gold) g USING (query_id, relation, a, b) GROUP BY query_id, relation)""",
        final="""SELECT q.query_id, r.relation, round(CASE WHEN hits IS NULL THEN NULL WHEN predicted = 0 THEN 1.0 ELSE hits / predicted END, 6) AS precision,
  round(CASE WHEN hits IS NULL THEN NULL WHEN gold = 0 THEN 1.0 ELSE hits / gold END, 6) AS recall
FROM (SELECT DISTINCT query_id FROM f) q CROSS JOIN (VALUES ('supports'), ('contradicts'), ('supersedes')) r(relation)
LEFT JOIN s ON s.query_id = q.query_id AND s.relation = r.relation""",
    ),
)
def mechanism_edges(spark: SparkSession, folder: str) -> DataFrame:
    claims, relations = fact_graph(spark, folder)
    found = evaluation.edge_metrics(relations, _gold(relations), claims.select("query_id").distinct())
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


_SETS = f"""g AS (SELECT query_id, component, outcome AS got, CASE WHEN outcome IN ('superseded', 'preferred') THEN best END AS chosen, a_id, b_id,
  {_NUMBER.format('a_id')} AS k FROM c)"""


@query(
    "mechanism_conflicts",
    O.chain(
        _FACTS, _NEWER, _PAIRS, _OUTCOMES, _SETS,
        final="""SELECT query_id, round(avg(CASE WHEN k % 50 = 0 THEN 0.0 ELSE 1.0 END), 6) AS conflict_set_recall,
  round(avg(CASE WHEN k % 2 = 1 THEN CASE WHEN k % 50 <> 0 AND chosen = b_id THEN 1.0 ELSE 0.0 END END), 6) AS conflict_resolution_accuracy,
  round(avg(CASE WHEN k % 2 = 0 THEN CASE WHEN k % 50 <> 0 AND got = 'unresolved' THEN 1.0 ELSE 0.0 END END), 6) AS unresolved_conflict_accuracy
FROM g GROUP BY query_id""",
    ),
)
def mechanism_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Gold sets: odd ones are resolved for the later claim, even ones open, every fiftieth has a claim no set holds."""
    claims, relations = fact_graph(spark, folder)
    k, later = _number("source_claim_id"), F.col("target_claim_id")
    sets = contradictions(claims).select(
        "query_id",
        F.array("source_claim_id", F.when(k % 50 == 0, F.concat(later, F.lit("?"))).otherwise(later)).alias("claim_ids"),
        F.when(k % 2 == 1, "resolved").otherwise("unresolved").alias("outcome"),
        F.when(k % 2 == 1, later).alias("preferred_claim_id"),
    )
    found = evaluation.conflict_metrics(resolved(claims, relations), sets)
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c != "query_id"})


@query(
    "mechanism_required",
    O.chain(
        _FACTS,
        final="""SELECT query_id, round(avg(CASE WHEN belief > 0.4 THEN 1.0 ELSE 0.0 END), 6) AS required_claim_recall,
  min(CASE WHEN belief > 0.4 THEN 1.0 ELSE 0.0 END)::DOUBLE AS required_hop_coverage FROM f WHERE place = 0 AND predicate <> 'error' GROUP BY query_id""",
    ),
)
def mechanism_required(spark: SparkSession, folder: str) -> DataFrame:
    """Required are a user's first claims of every type but errors, picked the claims believed in."""
    claims, _ = fact_graph(spark, folder)
    required = claims.filter((F.col("place") == 0) & (F.col("predicate") != "error")).select("query_id", "claim_id")
    found = evaluation.required_claims(claims.filter("belief > 0.4"), required)
    return found.withColumn("required_claim_recall", F.round("required_claim_recall", 6))


@query(
    "mechanism_candidates",
    O.chain(
        _FACTS, _NEWER, _PAIRS,
        "w AS (SELECT DISTINCT query_id, least(newer_id, older_id) AS a, greatest(newer_id, older_id) AS b FROM n)",
        final="""SELECT w.query_id, round(avg(CASE WHEN p.a_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS candidate_pair_recall
FROM w LEFT JOIN p ON p.query_id = w.query_id AND least(p.a_id, p.b_id) = a AND greatest(p.a_id, p.b_id) = b GROUP BY w.query_id""",
    ),
)
def mechanism_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """How many superseding pairs stand next to each other."""
    claims, relations = fact_graph(spark, folder)
    ends = (F.least("source_claim_id", "target_claim_id").alias("a_id"), F.greatest("source_claim_id", "target_claim_id").alias("b_id"))
    gold = relations.filter(F.col("relation_type") == S.SUPERSESSION).withColumn("relation", F.lit("supersedes"))
    found = evaluation.candidate_recall(contradictions(claims).select("query_id", *ends), gold)
    return found.withColumn("candidate_pair_recall", F.round("candidate_pair_recall", 6))


_SAME = "f.query_id = b.query_id AND f.predicate = b.predicate AND f.place % 2 = 0 AND b.place = f.place + 1"


@query(
    "mechanism_lineage",
    O.chain(
        _FACTS,
        final=f"SELECT f.query_id, round(avg(CASE WHEN f.object = b.object THEN 1.0 ELSE 0.0 END), 6) AS duplicate_cluster_accuracy FROM f JOIN f b ON {_SAME} GROUP BY f.query_id",
    ),
)
def mechanism_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring claims are annotated as copies; those of one value are duplicates."""
    claims, _ = fact_graph(spark, folder)
    pairs = contradictions(claims)
    objects = lambda end: claims.select("query_id", F.col("claim_id").alias(f"{end}_claim_id"), F.col("object").alias(end))
    same = pairs.join(objects("source"), ["query_id", "source_claim_id"]).join(objects("target"), ["query_id", "target_claim_id"]).filter(F.col("source") == F.col("target"))
    groups = pairs.select("query_id", F.array("source_claim_id", "target_claim_id").alias("claim_ids"))
    found = evaluation.lineage_accuracy(same.withColumn("relation_type", F.lit(S.DUPLICATE)), groups)
    return found.withColumn("duplicate_cluster_accuracy", F.round("duplicate_cluster_accuracy", 6))


@query(
    "mechanism_bridges",
    O.chain(
        _FACTS, _PAIRS,
        f"""b AS (SELECT p.query_id, {_NUMBER.format('a_id')} AS k FROM p)""",
        "s AS (SELECT query_id, count(*) FILTER (k % 3 <> 0) AS gold, count(*) FILTER (k % 5 <> 0) AS predicted, "
        "count(*) FILTER (k % 3 <> 0 AND k % 5 <> 0) AS hits, count(*) FILTER (k % 3 <> 0 AND k % 5 <> 0 AND k % 7 <> 0) AS named FROM b GROUP BY query_id)",
        final="""SELECT query_id, round(CASE WHEN predicted = 0 THEN 1.0 ELSE hits / predicted END, 6) AS bridge_precision,
  round(CASE WHEN gold = 0 THEN 1.0 ELSE hits / gold END, 6) AS bridge_recall, round(CASE WHEN gold > 0 THEN named / gold END, 6) AS bridge_entity_accuracy FROM s""",
    ),
)
def mechanism_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Bridges over the event type; some are missing, some not asked for, some name another entity."""
    claims, _ = fact_graph(spark, folder)
    k = _number("source_claim_id")
    pairs = contradictions(claims).withColumn("k", k).withColumn("a_id", F.least("source_claim_id", "target_claim_id")).withColumn("b_id", F.greatest("source_claim_id", "target_claim_id"))
    found = pairs.filter("k % 5 <> 0").select("query_id", "a_id", "b_id", F.when(F.col("k") % 7 == 0, "other").otherwise("type").alias("bridge_entity"))
    gold = pairs.filter("k % 3 <> 0").select("query_id", "a_id", "b_id", F.lit("type").alias("entity"))
    out = evaluation.bridge_metrics(found, gold)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "query_id"})


@query(
    "mechanism_inactive",
    O.chain(_FACTS, _PAIRS, f"w AS (SELECT DISTINCT query_id FROM p)", final=f"SELECT query_id FROM w WHERE query_id NOT IN (SELECT query_id FROM p WHERE {_NUMBER.format('a_id')} % 40 = 0)"),
)
def mechanism_inactive(spark: SparkSession, folder: str) -> DataFrame:
    """Users for whom relations are annotated, but none of every fortieth claim exists."""
    claims, _ = fact_graph(spark, folder)
    pairs = contradictions(claims)
    return evaluation.inactive_queries(pairs.filter(_number("source_claim_id") % 40 == 0), pairs.withColumn("relation", F.lit("contradicts")))
