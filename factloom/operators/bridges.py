"""Query-conditioned bridges: connectivity between complementary claims."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schemas as S
from factloom.functions import text as T
from factloom.scale import top_per_key
from factloom.session import cut_lineage, release, shuffles_dropped


#: Claims of a query that meet one by one; claims of larger queries meet on the names they share.
CLAIMS_BY_QUERY = 256


def bridge_candidates(claims: DataFrame, relations: DataFrame, queries: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """All pairs that qualify as a bridge, before the degree limit.

    A claim that names a goal of its query meets the others that share a name with it; pairs without a goal are never
    built. Claims are shuffled once, by query, and the pairs already related by evidence come as a list of the query. Queries of
    more than ``CLAIMS_BY_QUERY`` claims, if there are any, meet by name instead, in any number of tasks.
    """
    subgoals = queries.select("query_id", T.bridge_entities(F.col("text")).alias("goals"))
    none = F.array().cast("array<string>")
    entities = T.claim_bridge_entities(F.coalesce("entities", none), F.col("text"))
    text = T.strip(F.col("text"))
    told = F.when(F.length(text) <= 64, text).otherwise(F.sha2(text, 256))  # tells texts apart
    # columns without nulls: Spark filters no side by them, so that both sides of a pair read one shuffle
    rows = claims.filter(F.col("text").isNotNull()).select(
        "query_id", "claim_id", F.coalesce(told, F.lit("")).alias("told"), F.coalesce(entities, none).alias("names")
    )
    blocked = relations.filter(F.col("relation_type").isin(*S.EVIDENTIAL)).select(
        "query_id",
        F.least("source_claim_id", "target_claim_id").alias("a_id"),
        F.greatest("source_claim_id", "target_claim_id").alias("b_id"),
    )
    sizes = claims.filter(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.count(F.lit(1)).alias("claims"))
    large = sizes.filter(F.col("claims") > CLAIMS_BY_QUERY).select("query_id")
    with shuffles_dropped(claims.sparkSession):
        large = cut_lineage(large, "large")
    if large.isEmpty():
        return _met_by_query(rows, blocked, subgoals, min_confidence)
    with shuffles_dropped(claims.sparkSession):
        blocked = cut_lineage(blocked, "blocked")  # read on both ways
    of = lambda df, how: df.join(F.broadcast(large), "query_id", how)  # noqa: E731  (a row for CLAIMS_BY_QUERY claims)
    few = _met_by_query(of(rows, "left_anti"), of(blocked, "left_anti"), subgoals, min_confidence)
    return few.unionByName(_met_by_name(of(rows, "left_semi"), blocked, subgoals, min_confidence))


def _asking(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Claims that name a goal, with the columns of ``asked``; only their names change, so that both sides are one shuffle."""
    asking = rows.join(asked, "query_id").filter(F.arrays_overlap("names", "goals"))
    return asking.withColumnsRenamed({"claim_id": "x_id", "told": "x_told", "names": "x_names"})


def _shared() -> Column:
    return F.sort_array(F.array_intersect("x_names", "names"))


def _ends() -> list[Column]:
    return [F.least("x_id", "claim_id").alias("a_id"), F.greatest("x_id", "claim_id").alias("b_id")]


def _pairs(met: DataFrame, meets: Column, free: Column, min_confidence: float) -> DataFrame:
    """Pairs of claims that met, in order of their ids, if they differ in texts and both bring a name of their own."""
    both = F.arrays_overlap("names", "goals")
    complementary = (F.size(F.array_except("x_names", "names")) > 0) & (F.size(F.array_except("names", "x_names")) > 0)
    # two claims that both name a goal meet from either side: the smaller one brings the pair
    once = (F.col("x_id") < F.col("claim_id")) | ((F.col("x_id") > F.col("claim_id")) & ~both)
    asked = F.array_intersect(_shared(), F.col("goals"))
    confidence = F.lit(0.6) + F.when(F.size(asked) > 0, 0.2).otherwise(0.0) + F.when(both, 0.2).otherwise(0.0)
    confidence = F.round(F.least(confidence, F.lit(1.0)), 4)
    differ = F.col("x_told") != F.col("told")
    # one filter, the cheap tests first
    return met.filter(meets & once & differ & complementary & free & (confidence >= min_confidence)).select(
        "query_id",
        *_ends(),
        F.coalesce(F.array_min(asked), F.element_at(_shared(), 1)).alias("bridge_entity"),
        _shared().alias("bridge_terms"),
        confidence.alias("confidence"),
    )


def _met_by_query(rows: DataFrame, blocked: DataFrame, subgoals: DataFrame, min_confidence: float) -> DataFrame:
    """Pairs of queries with few claims: every shuffle is by query, and none is of pairs."""
    known = blocked.groupBy("query_id").agg(F.collect_set(F.struct("a_id", "b_id")).alias("known"))
    asking = _asking(rows, subgoals.join(known, "query_id", "left"))
    free = F.col("known").isNull() | ~F.array_contains("known", F.struct(*_ends()))
    return _pairs(asking.join(rows, "query_id"), F.arrays_overlap("x_names", "names"), free, min_confidence)


def _met_by_name(rows: DataFrame, blocked: DataFrame, subgoals: DataFrame, min_confidence: float) -> DataFrame:
    """Pairs of queries with any number of claims: a pair is kept where its first shared name meets."""
    asking = _asking(rows, subgoals).withColumn("name", F.explode("x_names"))
    pairs = _pairs(asking.join(rows.withColumn("name", F.explode("names")), ["query_id", "name"]), F.col("name") == F.element_at(_shared(), 1), F.lit(True), min_confidence)
    return pairs.join(blocked, ["query_id", "a_id", "b_id"], "left_anti")


#: Pairs of a query that one task decides in order; larger queries are decided in rounds.
PAIRS_IN_ORDER = 200_000


def limit_degree(candidates: DataFrame, max_degree: int = 4) -> DataFrame:
    """Accept pairs in id order while both ends have fewer than the limit.

    Queries of at most ``PAIRS_IN_ORDER`` pairs are dealt over the tasks, which read their sorted pairs one by one and
    hold the degrees of one query. Queries with more pairs are decided in rounds over all tasks.
    """
    with shuffles_dropped(candidates.sparkSession):
        return _limit_degree(cut_lineage(candidates, "bridges"), max_degree)


def _limit_degree(candidates: DataFrame, max_degree: int) -> DataFrame:
    large = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") > PAIRS_IN_ORDER).select("query_id")
    large = cut_lineage(large, "large")
    few = candidates.join(F.broadcast(large), "query_id", "left_anti")  # a row for PAIRS_IN_ORDER pairs

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, before, taken, used = None, None, False, {}
        for batch in batches:
            kept = []
            for pair in zip(*(batch[c].to_pylist() for c in ("query_id", "a_id", "b_id")), strict=True):
                if pair != before:
                    if pair[0] != query:
                        query, used = pair[0], {}
                    before, ends = pair, pair[1:]
                    taken = all(used.get(e, 0) < max_degree for e in ends)
                    if taken:
                        used.update({e: used.get(e, 0) + 1 for e in ends})
                kept.append(taken)
            yield batch.filter(pa.array(kept, pa.bool_()))

    in_order = few.repartition("query_id").sortWithinPartitions("query_id", "a_id", "b_id").mapInArrow(accept, candidates.schema)
    if not large.isEmpty():
        in_order = in_order.union(_limit_in_rounds(candidates.join(F.broadcast(large), "query_id", "left_semi"), max_degree))
    limited = cut_lineage(in_order, "limited")
    release(candidates)
    return limited


def _limit_in_rounds(candidates: DataFrame, max_degree: int) -> DataFrame:
    """The rule of ``limit_degree`` in rounds.

    The rule is sequential, but a pair that is among the first open pairs of both of its ends, as many as they have
    places left, is accepted whatever happens to the others. Every round accepts all such pairs of all queries and closes the
    pairs of full ends, until no pair is open; the first open pair always qualifies. A round sends at most ``max_degree``
    pairs per end (WindowGroupLimit), so a hub is never gathered.
    """
    pair = ["query_id", "a_id", "b_id"]
    open_ = cut_lineage(candidates.select(*pair).distinct(), "open")
    accepted = cut_lineage(open_.limit(0), "accepted")
    ends = lambda rows: rows.select(*pair, F.explode(F.array("a_id", "b_id")).alias("end"))
    while not open_.isEmpty():
        used = ends(accepted).groupBy("query_id", "end").agg(F.count(F.lit(1)).alias("used"))
        near = top_per_key(ends(open_), ["query_id", "end"], [F.col("a_id"), F.col("b_id")], max_degree, "place")
        near = near.join(used, ["query_id", "end"], "left").filter(F.col("place") + F.coalesce("used", F.lit(0)) < max_degree)
        more = near.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(*pair)
        before = accepted
        accepted = cut_lineage(accepted.union(more), "accepted")
        used = ends(accepted).groupBy("query_id", "end").agg(F.count(F.lit(1)).alias("used"))
        full = cut_lineage(used.filter(F.col("used") >= max_degree).select("query_id", "end"), "full")
        left = open_.join(accepted, pair, "left_anti")
        for column in ("a_id", "b_id"):
            left = left.join(full.withColumnRenamed("end", column), ["query_id", column], "left_anti")
        left = cut_lineage(left.select(*pair), "open")
        for old in (before, open_, full):
            release(old)
        open_ = left
    return candidates.join(accepted, pair, "left_semi")


def bridge_relations(bridges: DataFrame, *more: str) -> DataFrame:
    """Relations of bridges, with the columns ``more`` of the bridges beside them."""
    return bridges.select(
        "query_id",
        F.concat(F.lit("bridge-"), "a_id", F.lit("-"), "b_id").alias("relation_id"),
        F.col("a_id").alias("source_claim_id"),
        F.col("b_id").alias("target_claim_id"),
        F.lit(S.BRIDGE).alias("relation_type"),
        F.col("confidence").alias("relation_confidence"),
        F.lit("symmetric").alias("direction"),
        F.concat(F.lit("complementary claims linked by "), "bridge_entity").alias("rationale"),
        *more,
    )
