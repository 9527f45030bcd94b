"""The evidence pipeline for many queries at once, and its system variants.

retrieve -> extract -> relate -> score -> propagate -> resolve -> select ->
package -> answer. Every table carries ``query_id``; shared stages are written
once and reused by all variants.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import metrics as M
from factloom.operators import bridges as BR
from factloom.operators import chunking, extraction, packaging, reasoning, retrieval, selection
from factloom.operators import graph as G
from factloom.operators.pairs import CandidateRules, Classifier
from factloom.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    top_k: int = 4
    budget: selection.Budget = field(default_factory=selection.Budget)
    chunk_size: int = 512
    chunk_overlap: int = 64


@dataclass(frozen=True)
class Variant:
    name: str
    family: str
    rerank: bool = False
    propagation: bool = True
    temporal: bool = True
    contradiction: bool = True
    selection: str = "greedy"
    bridges: bool = False


VARIANTS = {
    v.name: v
    for v in (
        Variant("passage_rag", "passage"),
        Variant("reranked_passage_rag", "passage", rerank=True),
        Variant("claim_only_rag", "claim"),
        Variant("graph_no_propagation", "graph", propagation=False),
        Variant("graph_with_propagation", "graph"),
        Variant("graph_top_claim", "graph", selection="top"),
        Variant("graph_coherent_subgraph", "graph"),
        Variant("graph_no_temporal", "graph", temporal=False),
        Variant("graph_no_contradiction", "graph", contradiction=False),
        Variant("full_graph", "graph"),
    )
}


@dataclass(frozen=True)
class Components:
    """The exchangeable parts of a run; every variant uses the same ones.

    Each is a function over whole tables, keyed by query where queries occur. ``rerank`` may be None: then a reranking
    variant fails instead of passing for the plain one.
    """

    chunk: Callable[[DataFrame, Settings], DataFrame] = lambda docs, s: chunking.sentence_chunks(docs, s.chunk_size, s.chunk_overlap)
    retrieve: Callable[[DataFrame, DataFrame, int], DataFrame] = retrieval.bm25_top_k
    retrieve_within: Callable[[DataFrame, DataFrame, int], DataFrame] = retrieval.bm25_within
    extract: Callable[[DataFrame], DataFrame] = extraction.sentence_claims
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = retrieval.rerank_hits
    classifier: Classifier | None = None
    score: Callable[..., DataFrame] = reasoning.initial_scores
    propagate: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = reasoning.propagate
    resolve: Callable[[DataFrame, DataFrame], DataFrame] = reasoning.resolve_conflicts
    count_tokens: Callable[[Column], Column] | None = None  # else each selector's own estimate


@dataclass(frozen=True)
class Evidence:
    """Stages shared by every variant: passages, hits and claims."""

    queries: DataFrame
    passages: DataFrame
    hits: DataFrame
    claims: DataFrame
    priors: DataFrame | None = None


def retrieve_evidence(
    documents: DataFrame,
    queries: DataFrame,
    settings: Settings | None = None,
    priors: DataFrame | None = None,
    parts: Components | None = None,
) -> Evidence:
    """Chunk the corpus, rank passages per query and extract claims."""
    settings, parts = settings or Settings(), parts or Components()
    # passages are derived twice rather than written: only the hits, at most top_k per query, are cut
    passages = parts.chunk(documents, settings)
    ranked = cut_lineage(parts.retrieve(passages, queries, settings.top_k), "ranked")
    hits = cut_lineage(ranked.join(passages, "passage_id"), "hits")
    claims = cut_lineage(parts.extract(hits), "claims")
    return Evidence(queries, passages, hits, claims, priors)


def retrieve_own_documents(
    documents: DataFrame,
    queries: DataFrame,
    settings: Settings | None = None,
    priors: DataFrame | None = None,
    parts: Components | None = None,
) -> Evidence:
    """The same stages where every query brings its own documents."""
    settings, parts = settings or Settings(), parts or Components()
    passages = parts.chunk(documents, settings)
    ranked = cut_lineage(parts.retrieve_within(passages, queries, settings.top_k), "ranked")
    hits = cut_lineage(ranked.join(passages, ["query_id", "passage_id"]), "hits")
    claims = cut_lineage(parts.extract(hits), "claims")
    return Evidence(queries, passages, hits, claims, priors)


@dataclass(frozen=True)
class Reasoned:
    """A built and scored graph."""

    relations: DataFrame
    scores: DataFrame
    beliefs: DataFrame
    board: DataFrame
    conflicts: DataFrame


def reason(
    claims: DataFrame,
    queries: DataFrame,
    variant: Variant,
    *,
    classifier: Classifier | None = None,
    rules: G.EdgeRules | None = None,
    candidates: CandidateRules | None = None,
    priors: DataFrame | None = None,
    parts: Components | None = None,
) -> Reasoned:
    """Build the graph of each query, score it, propagate and resolve."""
    parts = parts or Components()
    classifier = classifier or parts.classifier
    rules = rules or G.EdgeRules()
    if not variant.contradiction:
        rules = replace(rules, contradict=1.0)
    relations = G.build_relations(
        claims, classifier=classifier, rules=rules, candidates=candidates, temporal=variant.temporal, queries=queries
    )
    if variant.bridges:
        relations = cut_lineage(relations, "evidence-edges")
        found = BR.limit_degree(BR.bridge_candidates(claims, relations, queries))
        relations = relations.unionByName(BR.bridge_relations(found))
    relations = cut_lineage(relations, "relations")
    scores = cut_lineage(parts.score(claims, relations, queries, priors=priors), "scores")
    beliefs = parts.propagate(claims, relations, scores) if variant.propagation else reasoning.keep_initial(scores)
    beliefs = cut_lineage(beliefs, "beliefs")
    board = cut_lineage(reasoning.with_beliefs(scores, beliefs), "board")
    conflicts = cut_lineage(parts.resolve(relations, board), "conflicts")
    return Reasoned(relations, scores, beliefs, board, conflicts)


def choose(
    claims: DataFrame, queries: DataFrame, reasoned: Reasoned, variant: Variant, budget: selection.Budget, parts: Components | None = None
) -> DataFrame:
    """Selected claims with the columns a package needs."""
    goal = selection.Objective()
    own = {"count_tokens": parts.count_tokens} if parts and parts.count_tokens else {}
    ctx = cut_lineage(
        selection.context(claims, reasoned.relations, reasoned.board, queries, reasoned.conflicts, goal, **own), "context"
    )
    pick = {"greedy": selection.select_greedy, "top": selection.select_top, "beam": selection.select_beam}
    picked = pick[variant.selection](ctx, budget)
    return ctx.join(picked, ["query_id", "claim_id"]).select(
        "query_id",
        "claim_id",
        "position",
        "tokens",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round("base", 6))).alias("selection_score"),
        "belief",
        F.col("query_utility").alias("utility"),
        "reason",
    )


def _prefix_selection(claims: DataFrame, order: list, budget: selection.Budget, parts: Components) -> DataFrame:
    own = {"count_tokens": parts.count_tokens} if parts.count_tokens else {}
    near = selection.select_prefix(claims, order, budget, **own)
    return near.select(
        "query_id",
        "claim_id",
        "position",
        "tokens",
        F.col("extraction_confidence").alias("selection_score"),
        F.lit(None).cast("double").alias("belief"),
        F.lit(None).cast("double").alias("utility"),
        F.lit(None).cast("string").alias("reason"),
    )


def _always(packs: DataFrame, selected: DataFrame) -> DataFrame:
    """The prefix rule has decided already, so nothing is dropped afterwards."""
    used = selected.groupBy("query_id").agg(F.sum("tokens").cast("int").alias("_used"))
    return packs.join(used, "query_id", "left").withColumn("budget_used", F.coalesce("_used", F.lit(0))).drop("_used")


def run_variant(evidence: Evidence, variant: Variant, settings: Settings | None = None, parts: Components | None = None, **options) -> DataFrame:
    """One package per query, with graph counts, for one system variant."""
    settings, parts = settings or Settings(), parts or Components()
    if variant.rerank and parts.rerank is None:
        raise ValueError(f"variant {variant.name!r} needs a reranker")
    budget, queries = settings.budget, evidence.queries
    passages = evidence.hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("num_passages"))
    if variant.family == "graph":
        reasoned = reason(evidence.claims, queries, variant, priors=evidence.priors, parts=parts, **options)
        selected = choose(evidence.claims, queries, reasoned, variant, budget, parts)
        packs = packaging.packages(
            queries, evidence.claims, selected, reasoned.relations, reasoned.conflicts, budget
        )
        nodes, edges = F.size("claims"), F.size("relations")
    else:
        if variant.family == "passage":
            hits = parts.rerank(evidence.hits, queries) if variant.rerank else evidence.hits
            claims = extraction.passage_claims(hits)
            order = [F.asc("rank")]
        else:
            claims = evidence.claims
            order = [F.desc("extraction_confidence"), F.asc("claim_id")]
        selected = _prefix_selection(claims, order, budget, parts)
        unlimited = selection.Budget(2**31 - 1, 0)
        packs = packaging.packages(queries, claims, selected, None, None, unlimited)
        packs = _always(packs, selected).withColumn("budget_total", F.lit(budget.total)).withColumn(
            "budget_reserved", F.lit(budget.reserved)
        )
        nodes, edges = F.lit(0), F.lit(0)
    return packs.join(passages, "query_id", "left").withColumn("num_graph_nodes", nodes).withColumn(
        "num_graph_edges", edges
    )


def example_metrics(answers: DataFrame, packs: DataFrame, gold: DataFrame) -> DataFrame:
    """Metric map per query. ``gold`` has answers, gold_source_ids, gold_available."""
    rows = packaging.ordered_sources(answers, "cited_claim_ids", packs, "cited_sources")
    picked = packs.select(
        "query_id",
        F.transform("selected", lambda s: s["claim_id"]).alias("selected_ids"),
        F.transform("selected", lambda s: s["text"]).alias("evidence"),
        F.transform("claims", lambda c: c["claim_id"]).alias("known"),
        F.size("selected").alias("num_selected"),
        F.size("claims").alias("num_claims"),
        "num_passages",
        "num_graph_nodes",
        "num_graph_edges",
        F.col("budget_used").alias("token_estimate"),
    )
    rows = rows.join(picked, "query_id").join(gold, "query_id")
    rows = packaging.ordered_sources(rows, "selected_ids", packs, "selected_sources")
    has_gold, has_answer = F.col("gold_available"), F.size("answers") > 0
    cited = M.set_counts(F.col("cited_sources"), F.col("gold_source_ids"))
    chosen = M.set_counts(F.col("selected_sources"), F.col("gold_source_ids"))
    cp, cr = M.citation_prf(*cited)
    ep, er = M.citation_prf(*chosen)
    answer, evidence = F.col("answer"), F.col("evidence")
    em = M.normalized_exact_match(answer, F.col("answers"))
    values = {
        "exact_match": F.when(has_answer, M.exact_match(answer, F.col("answers"))),
        "normalized_exact_match": F.when(has_answer, em),
        "token_f1": F.when(has_answer, M.token_f1(answer, F.col("answers"))),
        "answer_accuracy": F.when(has_answer, em),
        "empty_prediction": M.is_empty(answer),
        "invalid_citations": M.invalid_citations(F.col("cited_claim_ids"), F.col("known")).cast("double"),
        "citation_precision": F.when(has_gold, cp),
        "citation_recall": F.when(has_gold, cr),
        "citation_completeness": F.when(has_gold, M.completeness(cited[2] - cited[0], cited[2])),
        "evidence_precision": F.when(has_gold, ep),
        "evidence_recall": F.when(has_gold, er),
        "answer_evidence_entailment": M.lexical_entailment(answer, evidence),
        "contradiction_rate": M.contradiction_cue(answer, evidence),
        "unsupported_claim_rate": M.unsupported_rate(M.answer_sentences(answer), evidence),
    }
    for name in ("num_selected", "token_estimate", "num_passages", "num_claims", "num_graph_nodes", "num_graph_edges"):
        values[name] = F.col(name).cast("double")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in values.items()])
    failed = F.col("error").isNotNull()
    present = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return rows.select(
        F.col("query_id").alias("example_id"),
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("cited_claim_ids", F.array().cast("array<string>")).alias("citations"),
        F.col("selected_sources").alias("evidence_source_ids"),
        F.when(failed, F.create_map().cast("map<string,double>")).otherwise(present).alias("metrics"),
        failed.alias("failed"),
        F.col("error"),
        F.col("warnings"),
    )


def prior_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Reliability per source: the mean quality label of its documents."""
    return (
        labels.join(documents.select("document_id", "source_id"), "document_id")
        .groupBy("source_id")
        .agg(F.round(F.avg("quality"), 6).alias("reliability_prior"))
    )


__all__ = ["Settings", "Variant", "VARIANTS", "Evidence", "retrieve_evidence", "reason", "choose", "run_variant"]
