"""Queries over facts of the event table as claims with subject, predicate, value, time and source.

A user is a query, the event type the predicate and the value in steps of 25 the object. Every second event of a
(user, type) contradicts the one before it; beliefs and utilities come from the ids, so that all outcomes occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom import schemas as S
from factloom.operators import graph as G
from factloom.operators import bridges, packaging, reasoning, temporal
from factloom.plans import oracle as O
from factloom.plans.registry import joined, longs, query, table
from factloom.session import cut_lineage, shuffles_dropped

KEY = ["query_id", "claim_id"]

_FACTS = """f AS (SELECT CAST(user_id AS VARCHAR) AS query_id, 'e' || event_id AS claim_id, event_type AS predicate, CAST(floor(value / 25) AS BIGINT) AS object,
  ts, round((event_id * 37 % 101) / 101.0, 6) AS belief, CASE WHEN user_id % 7 = 0 THEN 0.0 ELSE 0.5 END AS utility,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS place FROM events)"""
_NEWER = """n AS (SELECT a.query_id, a.claim_id AS newer_id, b.claim_id AS older_id FROM f a JOIN f b
  ON a.query_id = b.query_id AND a.predicate = b.predicate AND a.ts > b.ts AND a.object <> b.object)"""
_PAIRS = """p AS (SELECT a.query_id, a.claim_id AS a_id, b.claim_id AS b_id, a.belief AS a_belief, b.belief AS b_belief, a.utility
  FROM f a JOIN f b ON a.query_id = b.query_id AND a.predicate = b.predicate AND a.place % 2 = 0 AND b.place = a.place + 1)"""
_OUTCOMES = """o AS (SELECT p.query_id, least(a_id, b_id) AS component, a_id, b_id, greatest(a_belief, b_belief) AS top,
    CASE WHEN a_belief > b_belief OR a_belief = b_belief AND a_id < b_id THEN a_id ELSE b_id END AS best,
    abs(a_belief - b_belief) AS gap, utility FROM p),
c AS (SELECT o.*, CASE WHEN utility <= 0 THEN 'excluded_irrelevant' WHEN top < 0.15 THEN 'rejected_low_evidence' WHEN gap < 0.1 THEN 'unresolved'
    WHEN EXISTS (SELECT 1 FROM n WHERE n.query_id = o.query_id AND n.newer_id = best AND n.older_id = CASE WHEN best = a_id THEN b_id ELSE a_id END)
    THEN 'superseded' ELSE 'preferred' END AS outcome FROM o)"""


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Claims with the columns of the graph operators, and belief, utility and place."""
    place = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    none = F.lit(None).cast("timestamp_ntz")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("query_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("claim_id"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.floor(F.col("value") / 25).cast("string").alias("object"),
        F.array().cast("array<string>").alias("quantities"),
        F.array().cast("array<string>").alias("dates"),
        F.col("ts").alias("valid_from"), none.alias("asserted_at"), none.alias("observed_at"), none.alias("published_at"),
        F.concat(F.lit("day "), F.dayofmonth("ts").cast("string")).alias("source_id"),
        F.round(F.col("event_id") * 37 % 101 / 101.0, 6).alias("belief"),
        F.when(F.col("user_id") % 7 == 0, 0.0).otherwise(0.5).alias("query_utility"),
        place.alias("place"),
    )


def newer_edges(found: DataFrame) -> DataFrame:
    """Relations of (newer_id, older_id) rows."""
    return found.select(
        "query_id", F.concat_ws(":", F.lit("s"), "newer_id", "older_id").alias("relation_id"), F.col("newer_id").alias("source_claim_id"),
        F.col("older_id").alias("target_claim_id"), F.lit(S.SUPERSESSION).alias("relation_type"), F.lit(0.9).alias("relation_confidence"),
        F.lit("directed").alias("direction"), F.lit("").alias("rationale"),
    )


def contradictions(claims: DataFrame) -> DataFrame:
    first = claims.filter(F.col("place") % 2 == 0).select("query_id", "predicate", F.col("claim_id").alias("source_claim_id"), (F.col("place") + 1).alias("place"))
    second = claims.select("query_id", "predicate", "place", F.col("claim_id").alias("target_claim_id"))
    return first.join(second, ["query_id", "predicate", "place"]).select(
        "query_id", F.concat_ws(":", F.lit("c"), "source_claim_id", "target_claim_id").alias("relation_id"), "source_claim_id", "target_claim_id",
        F.lit(S.CONTRADICTION).alias("relation_type"), F.lit(0.8).alias("relation_confidence"), F.lit("symmetric").alias("direction"), F.lit("").alias("rationale"),
    )


def fact_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Claims, and all of their relations: pairs of a user's facts, for the queries that return these."""
    claims = cut_lineage(facts(spark, folder), "facts")
    return claims, cut_lineage(newer_edges(temporal.supersession_edges(claims)).unionByName(contradictions(claims)), "relations")


def narrow_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Claims, and relations of their number: contradictions, supersession between their ends and one edge to every old claim."""
    claims = cut_lineage(facts(spark, folder), "facts")
    against = cut_lineage(contradictions(claims), "contradictions")
    between = temporal.supersession_between(claims, against.select("query_id", F.col("source_claim_id").alias("a_id"), F.col("target_claim_id").alias("b_id")))
    newer = temporal.superseding(claims).select(between.columns).union(between).distinct()
    return claims, cut_lineage(newer_edges(newer).unionByName(against), "relations")


def resolved(claims: DataFrame, relations: DataFrame) -> DataFrame:
    board = claims.select(*KEY, "belief", F.lit(0.5).alias("source_reliability"), F.lit(1).alias("provenance_diversity"), "query_utility")
    return reasoning.resolve_conflicts(relations, board)


@query("fact_supersession", O.chain(_FACTS, _NEWER, final="SELECT query_id, newer_id, older_id, CAST(0.9 AS DOUBLE) AS confidence FROM n"))
def fact_supersession(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.supersession_edges(facts(spark, folder))


@query(
    "fact_lookups",
    O.chain(
        _FACTS, _NEWER,
        final="""SELECT f.query_id, f.claim_id, coalesce(s.ids, '') AS supersedes, coalesce(b.ids, '') AS superseded_by FROM f
LEFT JOIN (SELECT query_id, newer_id, string_agg(older_id, ',' ORDER BY older_id) AS ids FROM n GROUP BY ALL) s ON s.query_id = f.query_id AND s.newer_id = f.claim_id
LEFT JOIN (SELECT query_id, older_id, string_agg(newer_id, ',' ORDER BY newer_id) AS ids FROM n GROUP BY ALL) b ON b.query_id = f.query_id AND b.older_id = f.claim_id""",
    ),
)
def fact_lookups(spark: SparkSession, folder: str) -> DataFrame:
    claims, relations = fact_graph(spark, folder)
    rows = claims.select(*KEY)
    for name, incoming in (("supersedes", False), ("superseded_by", True)):
        found = G.directed_lookup(relations, S.SUPERSESSION, incoming=incoming).withColumnRenamed("ids", name)
        rows = rows.join(found, KEY, "left").withColumn(name, F.coalesce(F.array_join(F.array_sort(name), ","), F.lit("")))
    return rows


@query(
    "fact_lineage",
    O.chain(
        _FACTS, _NEWER,
        "step AS (SELECT query_id, newer_id AS claim_id, min(older_id) AS next FROM n GROUP BY ALL)",
        """walk AS (SELECT query_id, claim_id, claim_id AS at, claim_id AS lineage FROM f
  UNION ALL SELECT w.query_id, w.claim_id, s.next, w.lineage || ',' || s.next FROM walk w JOIN step s ON s.query_id = w.query_id AND s.claim_id = w.at)""",
        recursive=True,
        final="SELECT query_id, claim_id, arg_max(lineage, length(lineage)) AS lineage FROM walk GROUP BY query_id, claim_id",
    ),
)
def fact_lineage(spark: SparkSession, folder: str) -> DataFrame:
    claims, relations = fact_graph(spark, folder)
    return G.source_lineage(claims, relations).select(*KEY, F.array_join("lineage", ",").alias("lineage"))


@query(
    "fact_conflicts",
    O.chain(
        _FACTS, _NEWER, _PAIRS, _OUTCOMES,
        final="""SELECT query_id, component, least(a_id, b_id) || ',' || greatest(a_id, b_id) AS members, outcome,
  CASE WHEN outcome IN ('superseded', 'preferred') THEN best END AS preferred_claim_id FROM c""",
    ),
)
def fact_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    found = resolved(*narrow_graph(spark, folder))
    return found.select("query_id", "component", F.array_join("claim_ids", ",").alias("members"), "outcome", "preferred_claim_id")


@query(
    "fact_status",
    O.chain(
        _FACTS, _NEWER, _PAIRS, _OUTCOMES,
        final="""SELECT f.query_id, f.claim_id, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.query_id = f.query_id AND n.older_id = f.claim_id) THEN 'superseded'
  WHEN c.outcome = 'preferred' AND best <> f.claim_id OR c.outcome = 'rejected_low_evidence' THEN 'rejected' WHEN c.outcome = 'unresolved' THEN 'disputed'
  ELSE 'accepted' END AS status FROM f LEFT JOIN c ON c.query_id = f.query_id AND f.claim_id IN (c.a_id, c.b_id)""",
    ),
)
def fact_status(spark: SparkSession, folder: str) -> DataFrame:
    claims, relations = narrow_graph(spark, folder)
    return packaging.evidence_status(claims.select(*KEY), relations, resolved(claims, relations)).select(*KEY, "status")


_TIMES = {"valid_from": 5, "asserted_at": 4, "observed_at": 3, "published_at": 2}


@query(
    "claim_times",
    O.chain(
        "t AS (SELECT event_id, "
        + ", ".join(f"CASE WHEN event_id % {k} = 0 THEN ts - INTERVAL {k} HOUR END AS {n}" for n, k in _TIMES.items())
        + " FROM events)",
        final="""SELECT event_id, strftime(coalesce(valid_from, asserted_at), '%Y-%m-%d %H:%M:%S') AS event,
  strftime(coalesce(observed_at, published_at), '%Y-%m-%d %H:%M:%S') AS publication,
  strftime(coalesce(valid_from, asserted_at, observed_at, published_at), '%Y-%m-%d %H:%M:%S') AS effective,
  strftime(coalesce(asserted_at, published_at), '%Y-%m-%d %H:%M:%S') AS asserted FROM t""",
    ),
)
def claim_times(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of which some times are missing."""
    times = [F.when(F.col("event_id") % k == 0, F.col("ts") - F.expr(f"INTERVAL {k} HOURS")).alias(n) for n, k in _TIMES.items()]
    rows = table(spark, folder, "events").select("event_id", *times)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rows = rows.withColumns({"event": temporal.event_time(), "publication": temporal.publication_time(), "effective": temporal.effective_time()})
    rows = temporal.fill_asserted(rows)
    return rows.select("event_id", *[text(c).alias(c) for c in ("event", "publication", "effective")], text("asserted_at").alias("asserted"))


@query(
    "fact_summary",
    O.chain(
        _FACTS, _NEWER, _PAIRS,
        final="""SELECT f.query_id, count(*) AS num_nodes, count(DISTINCT extract(day FROM ts)) AS num_sources,
  coalesce(any_value(s.k), 0) AS supersedes_edges, coalesce(any_value(c.k), 0) AS contradicts_edges FROM f
LEFT JOIN (SELECT query_id, count(*) AS k FROM n GROUP BY 1) s ON s.query_id = f.query_id LEFT JOIN (SELECT query_id, count(*) AS k FROM p GROUP BY 1) c ON c.query_id = f.query_id
GROUP BY f.query_id""",
    ),
)
def fact_summary(spark: SparkSession, folder: str) -> DataFrame:
    claims = cut_lineage(facts(spark, folder), "facts")
    found = G.summary(claims, contradictions(claims)).join(temporal.supersession_counts(claims), "query_id", "left")
    edges = [F.coalesce("pairs", F.lit(0)).alias("supersedes_edges"), F.col(f"{S.CONTRADICTION}_edges").alias("contradicts_edges")]
    found = found.select("query_id", "num_nodes", "num_sources", *edges)
    return longs(found, "num_nodes", "num_sources", "supersedes_edges", "contradicts_edges")


def ring_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events of a user as claims; the k-th of n is superseded by number (k * k + 1) % n, which runs into cycles."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    n = F.count(F.lit(1)).over(W.partitionBy("user_id"))
    rows = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("query_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("claim_id"), place.alias("k"), n.alias("n"))
    rows = cut_lineage(rows, "rings")
    to = rows.select("query_id", F.col("k").alias("to"), F.col("claim_id").alias("target_claim_id"))
    edges = rows.select("query_id", F.col("claim_id").alias("source_claim_id"), ((F.col("k") * F.col("k") + 1) % F.col("n")).alias("to")).join(to, ["query_id", "to"])
    return rows, edges.withColumn("relation_type", F.lit(S.SUPERSESSION))


@query(
    "ring_lineage",
    O.chain(
        """r AS (SELECT CAST(user_id AS VARCHAR) AS query_id, 'e' || event_id AS claim_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)""",
        "step AS (SELECT a.query_id, a.claim_id, b.claim_id AS next FROM r a JOIN r b ON a.query_id = b.query_id AND b.k = (a.k * a.k + 1) % a.n)",
        """walk AS (SELECT query_id, claim_id, claim_id AS at, [claim_id] AS lineage FROM r
  UNION ALL SELECT w.query_id, w.claim_id, s.next, list_append(w.lineage, s.next) FROM walk w JOIN step s ON s.query_id = w.query_id AND s.claim_id = w.at
  WHERE NOT list_contains(w.lineage, s.next))""",
        recursive=True,
        final="SELECT query_id, claim_id, array_to_string(arg_max(lineage, len(lineage)), ',') AS lineage FROM walk GROUP BY query_id, claim_id",
    ),
)
def ring_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return G.source_lineage(*ring_facts(spark, folder)).select(*KEY, F.array_join("lineage", ",").alias("lineage"))


_LINES = """c AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS query_id, concat_ws('-', 'l' || l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id, l_orderkey, l_linenumber,
  ['Supplier' || (l_suppkey % 10), 'Part' || (l_partkey % 50), 'Line' || l_linenumber] AS names FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT CAST(o_custkey AS VARCHAR) AS query_id, ['Supplier' || (o_custkey % 10), 'Part' || (o_custkey % 50)] AS goals FROM orders GROUP BY o_custkey),
e AS (SELECT query_id, claim_id, names, unnest(names) AS name FROM c),
met AS (SELECT DISTINCT a.query_id, a.claim_id AS a_id, b.claim_id AS b_id, a.names AS an, b.names AS bn FROM e a JOIN e b ON a.query_id = b.query_id AND a.name = b.name AND a.claim_id < b.claim_id),
linked AS (SELECT DISTINCT least(a.claim_id, b.claim_id) AS a_id, greatest(a.claim_id, b.claim_id) AS b_id FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
pairs AS (SELECT m.query_id, m.a_id, m.b_id, list_sort(list_intersect(an, bn)) AS shared, list_sort(list_intersect(list_intersect(an, bn), goals)) AS asked,
    list_has_any(an, goals) AS a_asked, list_has_any(bn, goals) AS b_asked FROM met m JOIN g ON g.query_id = m.query_id ANTI JOIN linked l ON l.a_id = m.a_id AND l.b_id = m.b_id
  WHERE len(list_intersect(an, bn)) < 3 AND (list_has_any(an, goals) OR list_has_any(bn, goals)))"""
_RATED = "round(0.6 + CASE WHEN len(asked) > 0 THEN 0.2 ELSE 0 END + CASE WHEN a_asked AND b_asked THEN 0.2 ELSE 0 END, 4)"


def line_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Bridge candidates among a customer's order lines; a line supports the next one of its order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = lines.join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").distinct()
    # the lines that follow in the order stand in the row of a line, as numbers; texts are made where they are read
    after = W.partitionBy("o_custkey", "l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1)
    after = F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")).over(after)
    with shuffles_dropped(spark):
        lines = cut_lineage(lines.withColumn("after", F.when(F.col("l_linenumber").isNotNull(), after)), "lines")
    name = lambda kind, c, n=None: F.concat(F.lit(kind), (F.col(c) % n if n else F.col(c)).cast("string"))
    entities = [name("Supplier", "l_suppkey", 10), name("Part", "l_partkey", 50), name("Line", "l_linenumber")]
    claim = lambda of="": F.concat_ws("-", F.concat(F.lit("l"), F.col("l_orderkey").cast("string")), *[F.col(f"{of}{c}").cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    customer = F.col("o_custkey").cast("string").alias("query_id")
    rows = lines.select(customer, claim().alias("claim_id"), F.array(*entities).alias("entities"), F.concat_ws(" in ", *entities).alias("text"))
    support = lines.withColumn("next", F.explode("after")).select(customer, claim().alias("source_claim_id"), claim("next.").alias("target_claim_id"), F.lit(S.SUPPORT).alias("relation_type"))
    asked = F.concat_ws(" with ", name("compare Supplier", "o_custkey", 10), name("Part", "o_custkey", 50))
    queries = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("query_id"), asked.alias("text")).distinct()
    return bridges.bridge_candidates(rows, support, queries)


@query(
    "line_bridge_candidates",
    O.chain(_LINES, final=f"SELECT query_id, a_id, b_id, coalesce(asked[1], shared[1]) AS bridge_entity, array_to_string(shared, '|') AS bridge_terms, CAST({_RATED} AS DOUBLE) AS confidence FROM pairs"),
)
def line_bridge_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return line_bridges(spark, folder).withColumn("bridge_terms", joined("bridge_terms"))


@query(
    "line_bridges_by_degree",
    O.chain(
        _LINES,
        "placed AS MATERIALIZED (SELECT query_id, a_id, b_id, coalesce(asked[1], shared[1]) AS bridge_entity, row_number() OVER (PARTITION BY query_id ORDER BY a_id, b_id) AS k FROM pairs)",
        """walk AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS a_id, CAST(NULL AS VARCHAR) AS b_id, CAST(NULL AS VARCHAR) AS bridge_entity, false AS kept, CAST([] AS VARCHAR[]) AS ends FROM placed
  UNION ALL SELECT query_id, k, a_id, b_id, bridge_entity, fits, CASE WHEN fits THEN ends || [a_id, b_id] ELSE ends END FROM (
    SELECT p.*, w.ends, len(list_filter(w.ends, lambda x: x = p.a_id)) < 4 AND len(list_filter(w.ends, lambda x: x = p.b_id)) < 4 AS fits
    FROM walk w JOIN placed p ON p.query_id = w.query_id AND p.k = w.k + 1))""",
        recursive=True,
        final="SELECT query_id, 'bridge-' || a_id || '-' || b_id AS relation_id, bridge_entity FROM walk WHERE kept",
    ),
)
def line_bridges_by_degree(spark: SparkSession, folder: str) -> DataFrame:
    found = bridges.limit_degree(line_bridges(spark, folder).drop("bridge_terms"))
    found = bridges.bridge_relations(found, "bridge_entity").select("query_id", "relation_id", "bridge_entity")
    # a pair that stands n times, as claims may share an id, is a relation that stands n times and names its entity at each
    found = found.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("query_id", "relation_id")))
    return found.select("query_id", "relation_id", "bridge_entity", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("n")).drop("n")
