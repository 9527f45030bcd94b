"""Belief: initial scores, signed propagation and conflict resolution."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom import schemas as S
from factloom.functions import text as T
from factloom.functions.vectors import clamp01, logit, sigmoid
from factloom.operators import graph as G
from factloom.session import cut_lineage

KEY = ["query_id", "claim_id"]


@dataclass(frozen=True)
class Weights:
    retrieval: float = 0.5
    query_relevance: float = 1.0
    extraction: float = 1.0
    source_reliability: float = 1.0
    temporal_validity: float = 0.5
    independent_support: float = 1.0

    def items(self) -> dict[str, float]:
        values = dict(vars(self))
        if min(values.values()) < 0 or sum(values.values()) <= 0:
            raise ValueError("score weights must be non-negative and not all zero")
        return values


def source_reliability(claims: DataFrame, priors: DataFrame | None, default: float = 0.5) -> DataFrame:
    """Add ``source_reliability``: a configured prior per source or the default."""
    if priors is None:
        own = F.col("reliability_prior") if "reliability_prior" in claims.columns else F.lit(None).cast("double")
        return claims.withColumn("source_reliability", F.coalesce(own, F.lit(default)))
    joined = claims.join(priors.select("source_id", F.col("reliability_prior").alias("_prior")), "source_id", "left")
    return joined.withColumn("source_reliability", F.coalesce("_prior", F.lit(default))).drop("_prior")


def initial_scores(
    claims: DataFrame,
    relations: DataFrame,
    queries: DataFrame,
    *,
    priors: DataFrame | None = None,
    retrieval_scores: DataFrame | None = None,
    weights: Weights | None = None,
    superseded_validity: float = 0.5,
    default_retrieval: float = 0.5,
) -> DataFrame:
    """Weighted mean of six signals per claim, plus its utility for the query."""
    share = (weights or Weights()).items()
    total = sum(share.values())
    rows = source_reliability(claims, priors)
    terms = queries.select("query_id", T.token_set(F.col("text")).alias("_q"))
    superseded = (
        G.of_types(relations, [S.SUPERSESSION])
        .select("query_id", F.col("target_claim_id").alias("claim_id"), F.lit(True).alias("_old"))
        .distinct()
    )
    support = G.corroborating_sources(claims, relations).select(*KEY, F.size("sources").alias("_n"))
    rows = rows.join(terms, "query_id").join(superseded, KEY, "left").join(support, KEY, "left")
    if retrieval_scores is not None:
        rows = rows.join(retrieval_scores.select(*KEY, F.col("score").alias("_r")), KEY, "left")
        retrieval = clamp01(F.coalesce("_r", F.lit(default_retrieval)))
    else:
        retrieval = F.lit(default_retrieval)
    n = F.coalesce("_n", F.lit(0))
    rows = (
        rows.withColumn("retrieval", retrieval)
        .withColumn("query_relevance", T.jaccard(T.token_set(F.col("text")), F.col("_q")))
        .withColumn("extraction", clamp01(F.col("extraction_confidence")))
        .withColumn("source_reliability", clamp01(F.col("source_reliability")))
        .withColumn("temporal_validity", F.when(F.col("_old"), F.lit(superseded_validity)).otherwise(F.lit(1.0)))
        .withColumn("provenance_diversity", n)
        .withColumn("independent_support", n / (n + 1))
    )
    parts = {name: F.round(F.lit(w) * F.col(name) / F.lit(total), 6) for name, w in share.items()}
    belief = None
    for part in parts.values():
        belief = part if belief is None else belief + part
    utility = F.round((F.col("query_relevance") + F.col("retrieval")) / 2, 6)
    return rows.select(
        *KEY,
        "source_id",
        "text",
        "retrieval",
        F.round("query_relevance", 6).alias("query_relevance"),
        "extraction",
        "source_reliability",
        "temporal_validity",
        F.round("independent_support", 6).alias("independent_support"),
        clamp01(F.round(belief, 6)).alias("initial_belief"),
        clamp01(utility).alias("query_utility"),
        "provenance_diversity",
    )


def simple_scores(claims: DataFrame, queries: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Belief as confidence times reliability, utility as token overlap."""
    rows = source_reliability(claims, priors).join(
        queries.select("query_id", T.token_set(F.col("text")).alias("_q")), "query_id"
    )
    return rows.select(
        *KEY,
        "source_id",
        F.round(F.col("extraction_confidence") * F.col("source_reliability"), 6).alias("belief"),
        F.round(T.jaccard(T.token_set(F.col("text")), F.col("_q")), 6).alias("query_utility"),
    )


def one_shot_beliefs(beliefs: DataFrame, relations: DataFrame, support_step: float = 0.05, contradiction_step: float = 0.1) -> DataFrame:
    """Add a step per distinct supporting source, subtract one per contradiction."""
    support = G.corroborating_sources(beliefs, relations).select(*KEY, F.size("sources").alias("_s"))
    ends = F.explode(F.array("source_claim_id", "target_claim_id")).alias("claim_id")
    against = (
        G.of_types(relations, [S.CONTRADICTION]).select("query_id", ends).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_c"))
    )
    rows = beliefs.join(support, KEY, "left").join(against, KEY, "left")
    moved = (
        F.coalesce("belief", F.lit(0.5))
        + support_step * F.coalesce("_s", F.lit(0))
        - contradiction_step * F.coalesce("_c", F.lit(0))
    )
    return rows.withColumn("belief", F.round(clamp01(moved), 6)).drop("_s", "_c")


# --- propagation -----------------------------------------------------------------


@dataclass(frozen=True)
class PropagationRules:
    damping: float = 0.5
    tolerance: float = 1e-4
    max_iterations: int = 50
    logit_clamp: float = 12.0
    support_weight: float = 1.0
    contradiction_weight: float = 1.0
    lineage_discount: float = 0.25
    duplicate_discount: float = 0.0


def message_weights(claims: DataFrame, relations: DataFrame, rules: PropagationRules) -> DataFrame:
    """Signed weight per (receiver, sender), fixed before the iteration starts.

    Senders of one receiver are ordered by id; the k-th from the same source is
    discounted k times, and for support so is the k-th of a duplicate cluster.
    """
    source = claims.select("query_id", F.col("claim_id").alias("sender"), "source_id")
    cluster = G.components(relations, [S.DUPLICATE]).select(
        "query_id", F.col("claim_id").alias("sender"), F.col("component").alias("_cluster")
    )
    support = G.of_types(relations, [S.SUPPORT]).select(
        "query_id",
        F.col("target_claim_id").alias("claim_id"),
        F.col("source_claim_id").alias("sender"),
        F.col("relation_confidence").alias("confidence"),
        F.lit(1).alias("sign"),
    )
    ends = F.array(
        F.struct(F.col("source_claim_id").alias("claim_id"), F.col("target_claim_id").alias("sender")),
        F.struct(F.col("target_claim_id").alias("claim_id"), F.col("source_claim_id").alias("sender")),
    )
    against = (
        G.of_types(relations, [S.CONTRADICTION])
        .select("query_id", "relation_confidence", F.explode(ends).alias("_e"))
        .select(
            "query_id",
            "_e.claim_id",
            "_e.sender",
            F.col("relation_confidence").alias("confidence"),
            F.lit(-1).alias("sign"),
        )
    )
    rows = (
        support.unionByName(against)
        .filter(F.col("claim_id") != F.col("sender"))
        .join(source, ["query_id", "sender"])
        .join(cluster, ["query_id", "sender"], "left")
    )
    by_source = W.partitionBy(*KEY, "sign", "source_id").orderBy("sender")
    by_cluster = W.partitionBy(*KEY, "sign", F.coalesce("_cluster", "sender")).orderBy("sender")

    def power(base: float, rank: Column) -> Column:
        return F.when(rank == 0, F.lit(1.0)).otherwise(F.pow(F.lit(base), rank))

    rows = rows.withColumn("_s", F.row_number().over(by_source) - 1).withColumn("_c", F.row_number().over(by_cluster) - 1)
    lineage = power(rules.lineage_discount, F.col("_s"))
    weight = F.when(
        F.col("sign") > 0,
        rules.support_weight * F.col("confidence") * lineage * power(rules.duplicate_discount, F.col("_c")),
    ).otherwise(-rules.contradiction_weight * F.col("confidence") * lineage)
    return rows.select(*KEY, "sender", weight.alias("weight")).filter(F.col("weight") != 0)


#: Rounds that run in one job before the stop test looks at all of them.
ROUNDS_PER_JOB = 5


def propagate(claims: DataFrame, relations: DataFrame, scores: DataFrame, rules: PropagationRules | None = None) -> DataFrame:
    """Damped fixed point of beliefs under support and contradiction.

    Returns ``query_id, claim_id, belief, iterations, converged, error`` for every claim; one without a score starts at
    0.5. Every query stops on its own when its largest change falls below the tolerance. A query that
    does not settle keeps its last beliefs and names the fault in ``error``; the others are not touched by it.

    Edges are static rows by sender, with a row of its own for every claim, so a round is one join and one combinable
    sum: its single shuffle carries messages and beliefs together, and its result already lies where the next join needs
    it. A few rounds run in one job and keep the belief of each; the stop test then finds the first round at which a
    query had settled. Settled queries leave before the next job.
    """
    rules = rules or PropagationRules()
    start = F.least(F.greatest(F.coalesce("initial_belief", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    nodes = claims.select(*KEY).distinct().join(scores.select(*KEY, "initial_belief"), KEY, "left")
    own = nodes.select(*KEY, F.col("claim_id").alias("sender"), start.alias("start"), logit(start, rules.logit_clamp).alias("base"))
    flows = cut_lineage(message_weights(claims, relations, rules).unionByName(own, allowMissingColumns=True), "flows")
    state = flows.filter(F.col("start").isNotNull()).select(*KEY, F.col("start").alias("b0"))
    parts, done = [], 0
    while done < rules.max_iterations:
        rounds = min(ROUNDS_PER_JOB, rules.max_iterations - done)
        for i in range(rounds):
            state = _step(state, flows, i, rules)
        state = cut_lineage(state, "beliefs")
        # the largest changes of a query are a two-phase aggregate, so a query with very many claims is not gathered
        changes = state.groupBy("query_id").agg(*[F.max(F.abs(F.col(f"b{i + 1}") - F.col(f"b{i}"))).alias(f"d{i}") for i in range(rounds)])
        settled = F.coalesce(*[F.when(F.col(f"d{i}") < rules.tolerance, F.lit(i + 1)) for i in range(rounds)])
        changes = changes.select("query_id", settled.alias("at"))
        judged = state.join(changes, "query_id")
        reached = F.element_at(F.array(*[f"b{i + 1}" for i in range(rounds)]), F.col("at"))
        parts.append(
            judged.filter(F.col("at").isNotNull()).select(*KEY, reached.alias("belief"), (F.col("at") + done).alias("iterations"), F.lit(True).alias("converged"))
        )
        state = judged.filter(F.col("at").isNull()).select(*KEY, F.col(f"b{rounds}").alias("b0"))
        done += rounds
        if changes.filter(F.col("at").isNull()).isEmpty():
            break
    parts.append(state.select(*KEY, F.col("b0").alias("belief"), F.lit(done).alias("iterations"), F.lit(False).alias("converged")))
    message = F.lit(f"belief propagation did not settle within {rules.max_iterations} iterations")
    error = F.when(~F.col("converged"), message)
    return reduce(DataFrame.unionByName, parts).select(*KEY, clamp01(F.col("belief")).alias("belief"), "iterations", "converged", error.alias("error"))


def _step(state: DataFrame, flows: DataFrame, done: int, rules: PropagationRules) -> DataFrame:
    """One synchronous update: adds ``b<done+1>`` to the beliefs ``b0`` to ``b<done>`` of every claim."""
    kept = [f"b{i}" for i in range(done + 1)]
    own, last = F.col("start").isNotNull(), F.col(kept[-1])
    met = flows.join(state.withColumnRenamed("claim_id", "sender"), ["query_id", "sender"])
    sums = met.groupBy(*KEY).agg(
        F.sum(F.col("weight") * (2 * (last - 0.5))).alias("_net"),
        F.max("base").alias("_base"),
        *[F.max(F.when(own, F.col(b))).alias(b) for b in kept],
    )
    # a receiver that is no claim has no row of its own
    target = sigmoid(F.col("_base") + F.coalesce("_net", F.lit(0.0)), rules.logit_clamp)
    moved = rules.damping * last + (1 - rules.damping) * target
    return sums.filter(F.col("_base").isNotNull()).select(*KEY, *kept, moved.alias(f"b{done + 1}"))


def keep_initial(scores: DataFrame) -> DataFrame:
    """The baseline without propagation."""
    return scores.select(
        *KEY, F.col("initial_belief").alias("belief"), F.lit(0).alias("iterations"), F.lit(True).alias("converged"),
        F.lit(None).cast("string").alias("error"),
    )


def with_beliefs(scores: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Scores with the propagated belief beside the initial one."""
    joined = scores.join(beliefs.select(*KEY, F.round("belief", 6).alias("belief")), KEY, "left")
    return joined.withColumn("belief", F.coalesce("belief", "initial_belief"))


# --- conflicts ---------------------------------------------------------------------


def conflict_members(relations: DataFrame, board: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Claims connected by contradictions, with the signals that rank them."""
    parts = G.components(relations, [S.CONTRADICTION])
    ends = F.explode(F.array("source_claim_id", "target_claim_id")).alias("claim_id")
    strongest = (
        G.of_types(relations, [S.CONTRADICTION])
        .select("query_id", "relation_confidence", ends)
        .groupBy(*KEY)
        .agg(F.max("relation_confidence").alias("relation_confidence"))
    )
    rows = parts.join(board, KEY).join(strongest, KEY)
    if claims is not None and "valid_from" in claims.columns:
        from factloom.operators.temporal import effective_time

        rows = rows.join(claims.select(*KEY, effective_time().alias("timestamp")), KEY, "left")
    else:
        rows = rows.withColumn("timestamp", F.lit(None).cast("timestamp"))
    return rows.select(
        "query_id",
        "component",
        "claim_id",
        F.round("belief", 6).alias("belief"),
        F.round("source_reliability", 6).alias("source_reliability"),
        F.col("provenance_diversity").alias("independent_support"),
        "relation_confidence",
        "query_utility",
        "timestamp",
    )


def resolve_conflicts(
    relations: DataFrame,
    board: DataFrame,
    claims: DataFrame | None = None,
    *,
    margin: float = 0.1,
    low_evidence: float = 0.15,
    irrelevant: float = 0.0,
) -> DataFrame:
    """One row per conflict set with its outcome and preferred claim.

    The leader and the runner-up come from one two-row aggregate per set, so set
    size does not matter.
    """
    members = cut_lineage(conflict_members(relations, board, claims), "members")
    order = F.struct(
        (-F.col("belief")).alias("b"),
        (-F.col("independent_support")).alias("i"),
        (-F.col("source_reliability")).alias("r"),
        F.col("claim_id").alias("claim_id"),
    )
    keys = ["query_id", "component"]
    sets = members.groupBy(*keys).agg(
        F.min(order).alias("_top"),
        F.sort_array(F.collect_set("claim_id")).alias("claim_ids"),
        F.max("query_utility").alias("_utility"),
    )
    seconds = (
        members.join(sets.select(*keys, "_top.claim_id"), [*keys, "claim_id"], "left_anti")
        .groupBy(*keys)
        .agg(F.max("belief").alias("_second"))
    )
    newer = (
        G.of_types(relations, [S.SUPERSESSION])
        .select("query_id", F.col("source_claim_id").alias("claim_id"), F.col("target_claim_id").alias("older"))
    )
    beats = (
        sets.select(*keys, "_top.claim_id")
        .join(newer, KEY)
        .join(members.select(*keys, F.col("claim_id").alias("older")), [*keys, "older"], "left_semi")
        .select(*keys, F.lit(True).alias("_supersedes"))
        .distinct()
    )
    inside = (
        G.of_types(relations, [S.CONTRADICTION])
        .join(members.select(*keys, F.col("claim_id").alias("source_claim_id")), ["query_id", "source_claim_id"])
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("relation_id")).alias("relation_ids"))
    )
    rows = sets.join(seconds, keys).join(beats, keys, "left").join(inside, keys, "left")
    top = -F.col("_top.b")
    outcome = (
        F.when(F.col("_utility") <= irrelevant, "excluded_irrelevant")
        .when(top < low_evidence, "rejected_low_evidence")
        .when(top - F.col("_second") < margin, "unresolved")
        .when(F.coalesce("_supersedes", F.lit(False)), "superseded")
        .otherwise("preferred")
    )
    rows = rows.withColumn("outcome", outcome)
    return rows.select(
        "query_id",
        F.col("component"),
        "claim_ids",
        "relation_ids",
        "outcome",
        F.when(F.col("outcome").isin("superseded", "preferred"), F.col("_top.claim_id")).alias("preferred_claim_id"),
        (F.col("outcome") != "unresolved").alias("resolved"),
    )


def numbered(conflicts: DataFrame) -> DataFrame:
    """Conflict ids: position of the set among its query's sets."""
    w = W.partitionBy("query_id").orderBy("component")
    return conflicts.withColumn(
        "conflict_id", F.concat(F.lit("conflict:"), (F.row_number().over(w) - 1).cast("string"))
    )
