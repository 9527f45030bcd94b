"""Gold-versus-predicted metrics that need joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import schemas as S
from factloom.functions import metrics as M
from factloom.functions import text as T
from factloom.operators import graph as G
from factloom.operators import selection


def answer_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exact match and token F1 of ``prediction`` against ``gold`` for long texts.

    Word counts come from one aggregate over (row, word), so the cost grows with
    text length and not with its square.
    """
    said = rows.select(*keys, F.explode(T.answer_words(F.col("prediction"))).alias("word"), F.lit(1).alias("p"), F.lit(0).alias("g"))
    want = rows.select(*keys, F.explode(T.answer_words(F.col("gold"))).alias("word"), F.lit(0).alias("p"), F.lit(1).alias("g"))
    counts = said.unionByName(want).groupBy(*keys, "word").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    sums = counts.groupBy(*keys).agg(
        F.sum(F.least("p", "g")).alias("common"), F.sum("p").alias("predicted"), F.sum("g").alias("wanted")
    )
    joined = rows.join(sums, keys, "left").na.fill(0, ["common", "predicted", "wanted"])
    return joined.select(
        *keys,
        (F.col("prediction") == F.col("gold")).cast("int").alias("exact_match"),
        (T.normalize_answer(F.col("prediction")) == T.normalize_answer(F.col("gold"))).cast("int").alias("normalized_match"),
        M.f1_from_counts(F.col("common"), F.col("predicted"), F.col("wanted")).alias("token_f1"),
        M.is_empty(F.col("prediction")).cast("int").alias("empty_prediction"),
    )


def set_sizes(rows: DataFrame, keys: list[str], element: str, predicted: str, gold: str) -> DataFrame:
    """Sizes of two element sets per key from one row per occurrence.

    ``predicted`` and ``gold`` are boolean columns. Sets are never collected.
    """
    flags = rows.groupBy(*keys, element).agg(
        F.max(F.col(predicted).cast("int")).alias("_p"), F.max(F.col(gold).cast("int")).alias("_g")
    )
    return flags.groupBy(*keys).agg(
        F.sum(F.col("_p") * F.col("_g")).alias("hits"), F.sum("_p").alias("predicted"), F.sum("_g").alias("gold")
    )


def recovered_sets(rows: DataFrame, keys: list[str], set_key: str, found: str) -> DataFrame:
    """Is at least one evidence set of a key completely found?"""
    per_set = rows.groupBy(*keys, set_key).agg(F.bool_and(found).alias("_all"))
    return per_set.groupBy(*keys).agg(F.bool_or("_all").alias("recovered"))


def edge_metrics(relations: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Precision and recall of edges per relation; NULL where neither side has any.

    Supersession is compared with its direction, the others as unordered pairs.
    """
    names = {"supports": S.SUPPORT, "contradicts": S.CONTRADICTION, "supersedes": S.SUPERSESSION}
    parts = None
    for gold_name, kind in names.items():
        directed = gold_name == "supersedes"

        def ends(df: DataFrame, directed: bool = directed) -> DataFrame:
            a, b = F.col("source_claim_id"), F.col("target_claim_id")
            if not directed:
                a, b = F.least(a, b), F.greatest(a, b)
            return df.select("query_id", a.alias("a"), b.alias("b")).distinct()

        both = (
            ends(relations.filter(F.col("relation_type") == kind))
            .withColumn("p", F.lit(1))
            .join(ends(gold.filter(F.col("relation") == gold_name)).withColumn("g", F.lit(1)), ["query_id", "a", "b"], "full_outer")
            .na.fill(0, ["p", "g"])
        )
        sizes = both.groupBy("query_id").agg(
            F.sum(F.col("p") * F.col("g")).alias("hits"), F.sum("p").alias("predicted"), F.sum("g").alias("gold")
        )
        p, r = M.mechanism_pr(F.col("hits"), F.col("predicted"), F.col("gold"))
        part = queries.select("query_id").join(sizes, "query_id", "left").select(
            "query_id",
            F.lit(gold_name).alias("relation"),
            F.when(F.col("hits").isNotNull(), p).alias("precision"),
            F.when(F.col("hits").isNotNull(), r).alias("recall"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def conflict_metrics(conflicts: DataFrame, gold: DataFrame) -> DataFrame:
    """Recall of gold conflict sets and accuracy of their outcome per query."""
    sets = conflicts.select("query_id", F.col("claim_ids").alias("found"), F.col("outcome").alias("got"), F.col("preferred_claim_id").alias("chosen"))
    rows = gold.join(sets, "query_id", "left")
    covered = F.coalesce(F.size(F.array_except("claim_ids", "found")) == 0, F.lit(False))
    per = rows.groupBy("query_id", "claim_ids", "outcome", "preferred_claim_id").agg(
        F.bool_or(covered).alias("recalled"),
        F.bool_or(covered & (F.col("chosen") == F.col("preferred_claim_id"))).alias("right_choice"),
        F.bool_or(covered & (F.col("got") == "unresolved")).alias("left_open"),
    )
    resolved = F.col("outcome") == "resolved"
    return per.groupBy("query_id").agg(
        F.avg(F.col("recalled").cast("double")).alias("conflict_set_recall"),
        F.avg(F.when(resolved, F.coalesce("right_choice", F.lit(False)).cast("double"))).alias("conflict_resolution_accuracy"),
        F.avg(F.when(~resolved, F.coalesce("left_open", F.lit(False)).cast("double"))).alias("unresolved_conflict_accuracy"),
    )


def required_claims(picked: DataFrame, required: DataFrame) -> DataFrame:
    """Recall of required claims and whether all of them were selected."""
    hit = required.join(picked.select("query_id", "claim_id", F.lit(1).alias("_hit")), ["query_id", "claim_id"], "left")
    return hit.groupBy("query_id").agg(
        F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("required_claim_recall"),
        F.min(F.coalesce("_hit", F.lit(0))).cast("double").alias("required_hop_coverage"),
    )


def candidate_recall(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of positive gold pairs among the candidate pairs."""
    wanted = gold.filter(F.col("relation") != "none").select(
        "query_id",
        F.least("source_claim_id", "target_claim_id").alias("a_id"),
        F.greatest("source_claim_id", "target_claim_id").alias("b_id"),
    ).distinct()
    hit = wanted.join(pairs.select("query_id", "a_id", "b_id", F.lit(1).alias("_hit")), ["query_id", "a_id", "b_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("candidate_pair_recall"))


def lineage_accuracy(relations: DataFrame, lineage: DataFrame) -> DataFrame:
    """Share of annotated lineage groups that lie inside one duplicate cluster."""
    parts = G.components(relations, [S.DUPLICATE])
    rows = lineage.select("query_id", "claim_ids", F.explode("claim_ids").alias("claim_id")).join(parts, ["query_id", "claim_id"], "left")
    per = rows.groupBy("query_id", "claim_ids").agg(
        ((F.count_distinct("component") == 1) & (F.count("component") == F.count(F.lit(1)))).alias("ok")
    )
    return per.groupBy("query_id").agg(F.avg(F.col("ok").cast("double")).alias("duplicate_cluster_accuracy"))


def bridge_metrics(bridges: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and entity accuracy of bridges per query."""
    found = bridges.select("query_id", "a_id", "b_id", F.col("bridge_entity").alias("got"), F.lit(1).alias("p"))
    want = gold.select("query_id", F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "entity", F.lit(1).alias("g"))
    both = found.join(want, ["query_id", "a_id", "b_id"], "full_outer").na.fill(0, ["p", "g"])
    hit = F.col("p") * F.col("g")
    sizes = both.groupBy("query_id").agg(
        F.sum(hit).alias("hits"), F.sum("p").alias("predicted"), F.sum("g").alias("gold"),
        F.sum(F.when((hit == 1) & (F.col("entity").isNull() | (F.col("entity") == F.col("got"))), 1).otherwise(0)).alias("named"),
    )
    p, r = M.mechanism_pr(F.col("hits"), F.col("predicted"), F.col("gold"))
    return sizes.select(
        "query_id",
        p.alias("bridge_precision"),
        r.alias("bridge_recall"),
        F.when(F.col("gold") > 0, F.col("named") / F.col("gold")).alias("bridge_entity_accuracy"),
    )


def activation(queries: DataFrame, relations: DataFrame, beliefs: DataFrame, conflicts: DataFrame, picked: DataFrame) -> DataFrame:
    """How much each mechanism did per query; summed over a run by the caller."""
    kinds = {
        S.SUPPORT: "support_edges", S.CONTRADICTION: "contradiction_edges", S.SUPERSESSION: "supersession_edges",
        S.DUPLICATE: "duplicate_edges", S.BRIDGE: "bridge_edges",
    }
    edges = relations.groupBy("query_id").agg(
        *[F.count_if(F.col("relation_type") == k).alias(name) for k, name in kinds.items()]
    )
    rounds = beliefs.groupBy("query_id").agg(F.max("iterations").alias("propagation_iterations"))
    sets = conflicts.groupBy("query_id").agg(F.count(F.lit(1)).alias("conflict_sets"))
    chosen = picked.groupBy("query_id").agg(F.count(F.lit(1)).alias("selected_claims"))
    linked = selection.connected(relations, picked).select("query_id", F.col("connected").cast("int").alias("connected_selected"))
    rows = queries.select("query_id")
    for table in (edges, rounds, sets, chosen, linked):
        rows = rows.join(table, "query_id", "left")
    return rows.na.fill(0)


def inactive_queries(relations: DataFrame, gold: DataFrame) -> DataFrame:
    """Queries whose annotations require edges but whose graph has none."""
    need = gold.filter(F.col("relation") != "none").select("query_id").distinct()
    return need.join(relations.select("query_id").distinct(), "query_id", "left_anti")
