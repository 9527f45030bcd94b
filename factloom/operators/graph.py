"""Evidence graphs for many queries: construction, lookups, components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schemas as S
from factloom.components import components as connected
from factloom.functions import text as T
from factloom.operators.pairs import CandidateRules, Classifier, candidate_pairs, lexical_classifier
from factloom.operators.temporal import supersession_edges
from factloom.scale import SALTS, salted_copies
from factloom.session import cut_lineage, release

PAIR = ["query_id", "a_id", "b_id"]


@dataclass(frozen=True)
class EdgeRules:
    entail: float = 0.5
    contradict: float = 0.5
    duplicate: float = 0.8
    keep_neutral: bool = False
    contradiction_needs_subject: bool = False


# --- construction -------------------------------------------------------------


def lexical_duplicates(claims: DataFrame) -> DataFrame:
    """Pairs of a query's claims with the same normalised text."""
    rows = claims.select("query_id", F.sha2(T.normalize(F.col("text")), 256).alias("key"), "claim_id", "text")
    a = rows.select("query_id", "key", F.col("claim_id").alias("a_id"), F.col("text").alias("a_text"))
    b = rows.select("query_id", "key", F.col("claim_id").alias("b_id"), F.col("text").alias("b_text"))
    kind = F.when(F.col("a_text") == F.col("b_text"), "exact").otherwise("normalized")
    return a.join(b, ["query_id", "key"]).filter(F.col("a_id") < F.col("b_id")).select(*PAIR, kind.alias("kind"))


def duplicate_clusters(rows: DataFrame, row_id: str) -> DataFrame:
    """Cluster a whole table by normalised text: one edge per row, to its head.

    A text that fills a third of the table yields as many edges as it has copies,
    not their square. Copies are counted per exact text before the shuffle on the
    normalised key, and the join back is salted.
    """
    keyed = rows.select(
        row_id, F.sha2(T.normalize(F.col("text")), 256).alias("cluster"), F.sha2("text", 256).alias("exact")
    )
    keyed = cut_lineage(keyed, "text-keys")  # the texts are read and hashed once
    heads = (
        keyed.groupBy("cluster")
        .agg(
            F.min(F.struct(row_id, "exact")).alias("head"),
            F.count(F.lit(1)).alias("cluster_size"),
        )
        .filter(F.col("cluster_size") > 1)
    )
    salt = F.pmod(F.xxhash64(row_id), F.lit(SALTS))
    joined = keyed.withColumn("_salt", salt).join(salted_copies(heads, SALTS), ["cluster", "_salt"])
    kind = (
        F.when(F.col(row_id) == F.col(f"head.{row_id}"), "head")
        .when(F.col("exact") == F.col("head.exact"), "exact")
        .otherwise("normalized")
    )
    return joined.select(row_id, F.col(f"head.{row_id}").alias("head_id"), kind.alias("kind"), "cluster_size")


def _relations(df: DataFrame, kind: str, source: str, target: str, confidence: Column, rationale: Column) -> DataFrame:
    directed = kind in (S.SUPPORT, S.SUPERSESSION)
    return df.select(
        "query_id",
        T.relation_id(F.lit(kind), F.col(source), F.col(target)).alias("relation_id"),
        F.col(source).alias("source_claim_id"),
        F.col(target).alias("target_claim_id"),
        F.lit(kind).alias("relation_type"),
        confidence.cast("double").alias("relation_confidence"),
        F.lit("directed" if directed else "symmetric").alias("direction"),
        rationale.alias("rationale"),
    )


def _unpaired(df: DataFrame, used: DataFrame) -> DataFrame:
    return df.join(used, PAIR, "left_anti")


def build_relations(
    claims: DataFrame,
    *,
    classifier: Classifier | None = None,
    rules: EdgeRules | None = None,
    candidates: CandidateRules | None = None,
    temporal: bool = True,
    queries: DataFrame | None = None,
) -> DataFrame:
    """Evidential edges: duplicates, then supersession, then classified pairs.

    A pair related by an earlier step is dropped before it is classified.
    Contradiction outranks support here.
    """
    rules = rules or EdgeRules()
    duplicates = lexical_duplicates(claims)
    edges = _relations(
        duplicates, S.DUPLICATE, "a_id", "b_id", F.lit(1.0), F.concat("kind", F.lit(" duplicate (symmetric)"))
    )
    used = duplicates.select(*PAIR)
    if temporal:
        newer = supersession_edges(claims).select(
            "*", F.least("newer_id", "older_id").alias("a_id"), F.greatest("newer_id", "older_id").alias("b_id")
        )
        newer = _unpaired(newer, used)
        note = F.lit("same subject/predicate with a newer, differing value")
        edges = edges.unionByName(
            _relations(newer, S.SUPERSESSION, "newer_id", "older_id", F.round("confidence", 6), note)
        )
        used = used.unionByName(newer.select(*PAIR))
    pairs = candidate_pairs(claims, candidates, queries)
    scored = (classifier or lexical_classifier())(_unpaired(pairs, used))
    return edges.unionByName(classified_edges(scored, rules))


def classified_edges(scored: DataFrame, rules: EdgeRules | None = None) -> DataFrame:
    """Apply the edge thresholds to scored pairs; a pair may support both ways."""
    rules = rules or EdgeRules()
    contra = F.greatest("c_ab", "c_ba")
    allowed = contra >= rules.contradict
    if rules.contradiction_needs_subject:
        allowed &= (F.col("a_subject_key") != "") & (F.col("a_subject_key") == F.col("b_subject_key"))
    both = F.least("e_ab", "e_ba") >= rules.duplicate

    def edge(kind: str, flip: bool, confidence: Column, note: str) -> Column:
        source, target = ("b_id", "a_id") if flip else ("a_id", "b_id")
        return F.struct(
            F.lit(kind).alias("kind"),
            F.col(source).alias("source"),
            F.col(target).alias("target"),
            F.round(confidence, 6).alias("confidence"),
            F.lit(note).alias("note"),
        )

    entailed = "entailment above threshold"
    supports = F.array_compact(
        F.array(
            F.when(F.col("e_ab") >= rules.entail, edge(S.SUPPORT, False, F.col("e_ab"), entailed)),
            F.when(F.col("e_ba") >= rules.entail, edge(S.SUPPORT, True, F.col("e_ba"), entailed)),
        )
    )
    neutral = F.array(edge(S.NEUTRAL, False, F.greatest("n_ab", "n_ba"), "neutral (debug mode)"))
    rest = F.when(F.size(supports) > 0, supports).otherwise(neutral) if rules.keep_neutral else supports
    chosen = (
        F.when(
            both, F.array(edge(S.DUPLICATE, False, F.least("e_ab", "e_ba"), "semantic duplicate (symmetric)"))
        )
        .when(allowed, F.array(edge(S.CONTRADICTION, False, contra, "contradiction above threshold (symmetric)")))
        .otherwise(rest)
    )
    rows = scored.select("query_id", F.explode(chosen).alias("_e"))
    return rows.select(
        "query_id",
        T.relation_id(F.col("_e.kind"), F.col("_e.source"), F.col("_e.target")).alias("relation_id"),
        F.col("_e.source").alias("source_claim_id"),
        F.col("_e.target").alias("target_claim_id"),
        F.col("_e.kind").alias("relation_type"),
        F.col("_e.confidence").alias("relation_confidence"),
        F.when(F.col("_e.kind") == S.SUPPORT, "directed").otherwise("symmetric").alias("direction"),
        F.col("_e.note").alias("rationale"),
    )


# --- lookups -----------------------------------------------------------------


def of_types(relations: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return relations if types is None else relations.filter(F.col("relation_type").isin(*types))


def both_ways(relations: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Undirected incidence: one row per endpoint and distinct neighbour."""
    kept = of_types(relations, types)
    ends = F.array(
        F.struct(F.col("source_claim_id").alias("claim_id"), F.col("target_claim_id").alias("neighbor_id")),
        F.struct(F.col("target_claim_id").alias("claim_id"), F.col("source_claim_id").alias("neighbor_id")),
    )
    return kept.select("query_id", F.explode(ends).alias("_e")).select("query_id", "_e.*").distinct()


def neighbors(relations: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Sorted neighbour ids per claim."""
    return both_ways(relations, types).groupBy("query_id", "claim_id").agg(
        F.sort_array(F.collect_set("neighbor_id")).alias("neighbors")
    )


def adjacency(claims: DataFrame, relations: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Out-edges per claim; claims without edges keep an empty list."""
    out = (
        of_types(relations, types)
        .groupBy("query_id", F.col("source_claim_id").alias("claim_id"))
        .agg(F.sort_array(F.collect_list(F.struct("target_claim_id", "relation_type", "relation_confidence"))).alias("edges"))
    )
    kind = "array<struct<target_claim_id:string,relation_type:string,relation_confidence:double>>"
    return claims.select("query_id", "claim_id").join(out, ["query_id", "claim_id"], "left").withColumn(
        "edges", F.coalesce("edges", F.array().cast(kind))
    )


def directed_lookup(relations: DataFrame, kind: str, *, incoming: bool) -> DataFrame:
    """Sorted other ends of one relation type: supporters, superseders, ..."""
    here, there = ("target_claim_id", "source_claim_id") if incoming else ("source_claim_id", "target_claim_id")
    return (
        of_types(relations, [kind])
        .groupBy("query_id", F.col(here).alias("claim_id"))
        .agg(F.sort_array(F.collect_set(there)).alias("ids"))
    )


def corroborating_sources(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct supporting sources other than the claim's own."""
    source = claims.select("query_id", F.col("claim_id").alias("source_claim_id"), F.col("source_id").alias("their_source"))
    own = claims.select("query_id", "claim_id", F.col("source_id").alias("own_source"))
    support = of_types(relations, [S.SUPPORT]).join(source, ["query_id", "source_claim_id"])
    joined = support.withColumnRenamed("target_claim_id", "claim_id").join(own, ["query_id", "claim_id"])
    return (
        joined.filter(F.col("their_source") != F.col("own_source"))
        .groupBy("query_id", "claim_id")
        .agg(F.sort_array(F.collect_set("their_source")).alias("sources"))
    )


def induced(relations: DataFrame, selected: DataFrame) -> DataFrame:
    """Relations with both ends among the selected claims."""
    ids = selected.select("query_id", "claim_id")
    at_source = ids.withColumnRenamed("claim_id", "source_claim_id")
    at_target = ids.withColumnRenamed("claim_id", "target_claim_id")
    return relations.join(at_source, ["query_id", "source_claim_id"], "left_semi").join(
        at_target, ["query_id", "target_claim_id"], "left_semi"
    )


# --- components ---------------------------------------------------------------


def components(relations: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Label every touched claim with the smallest claim id it is connected to."""
    ends = both_ways(relations, types)
    found = connected(ends, "claim_id", "neighbor_id", ("query_id",))
    return found.select("query_id", F.col("node").alias("claim_id"), "component")


def clusters(claims: DataFrame, relations: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Component of every claim; an unconnected claim is its own component."""
    labels = components(relations, types)
    return claims.select("query_id", "claim_id").join(labels, ["query_id", "claim_id"], "left").withColumn(
        "component", F.coalesce("component", "claim_id")
    )


def summary(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """Nodes, edges by type, components and sources per query."""
    nodes = claims.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("num_nodes"), F.count_distinct("source_id").alias("num_sources")
    )
    kinds = [*S.EVIDENTIAL, S.BRIDGE]
    edges = relations.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("num_edges"),
        *[F.count_if(F.col("relation_type") == k).alias(f"{k}_edges") for k in kinds],
    )
    parts = clusters(claims, relations).groupBy("query_id").agg(F.count_distinct("component").alias("num_components"))
    joined = nodes.join(edges, "query_id", "left").join(parts, "query_id", "left")
    return joined.na.fill(0)


def _jumps(step: DataFrame) -> DataFrame:
    """query_id, claim_id, head for claims that lead into a cycle of ``step`` (query_id, claim_id, next): ``head`` is
    the smallest claim of the cycle for claims on it and null for claims before it.

    Pointers double, so after round r a claim knows where 2^r steps lead and the smallest claim on the way. Once that is
    more steps than a query has claims, only claims that lead into a cycle have a pointer, and it is on the cycle.
    """
    key = ["query_id", "claim_id"]
    jumps = cut_lineage(step.select(*key, F.col("next").alias("to"), F.least("claim_id", "next").alias("least")), "jumps")
    longest = jumps.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= longest:
        on = jumps.select("query_id", F.col("claim_id").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        more = jumps.join(on, ["query_id", "to"]).select(*key, F.col("_to").alias("to"), F.least("least", "_least").alias("least"))
        more = cut_lineage(more, "jumps")
        release(jumps)
        jumps, reach = more, 2 * reach
        if jumps.isEmpty():
            break
    ring = jumps.select("query_id", F.col("to").alias("claim_id"), F.lit(True).alias("_on")).distinct()
    return jumps.join(ring, key, "left").select(*key, F.when(F.col("_on"), F.col("least")).alias("head"))


def _paths(claims: DataFrame, step: DataFrame) -> DataFrame:
    """query_id, claim_id, lineage: the chain of ``step``, which has no cycle, from each claim, by path doubling."""
    key = ["query_id", "claim_id"]
    paths = claims.select(*key).join(step.withColumnRenamed("next", "_end"), key, "left").withColumn("lineage", F.array("claim_id"))
    while True:
        paths = cut_lineage(paths, "lineage")
        if paths.filter(F.col("_end").isNotNull()).isEmpty():
            return paths.drop("_end")
        tail = paths.select("query_id", F.col("claim_id").alias("_end"), F.col("lineage").alias("_tail"), F.col("_end").alias("_next"))
        paths = paths.join(tail, ["query_id", "_end"], "left").select(
            *key, F.concat("lineage", F.coalesce("_tail", F.array().cast("array<string>"))).alias("lineage"), F.col("_next").alias("_end")
        )


def source_lineage(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """Chain of superseded claims from each claim, smallest id first at each step, up to the first claim met again.

    Cycles are found first and opened at their smallest claim and where chains enter them; what follows there, the rest of the
    cycle, is put behind the paths. Without a cycle this is path doubling alone.
    """
    key = ["query_id", "claim_id"]
    step = of_types(relations, [S.SUPERSESSION]).groupBy("query_id", F.col("source_claim_id").alias("claim_id"))
    step = cut_lineage(step.agg(F.min("target_claim_id").alias("next")).join(claims.select(*key), key, "left_semi"), "steps")
    caught = cut_lineage(_jumps(step), "caught")
    if caught.isEmpty():
        return _paths(claims, step)
    heads = caught.filter("head IS NOT NULL")
    into = step.join(heads.select("query_id", F.col("claim_id").alias("next"), F.col("head").alias("_head")), ["query_id", "next"], "left")
    into = into.join(heads, key, "left")  # _head: the next claim is on a cycle; head: this one is
    opened = F.col("_head").isNotNull() & (F.col("head").isNull() | (F.col("next") == F.col("_head")))
    into = cut_lineage(into.withColumn("opened", opened), "opened")
    paths = _paths(claims, into.filter("NOT opened").select(*key, "next"))
    rings = paths.join(heads, key)
    whole = rings.filter(F.col("claim_id") == F.col("head")).select("query_id", "head", F.col("lineage").alias("_whole"))
    before = F.slice("_whole", 1, F.size("_whole") - F.size("lineage"))
    rings = cut_lineage(rings.join(whole, ["query_id", "head"]).select(*key, F.concat("lineage", before).alias("ring")), "rings")
    entries = into.filter("opened AND head IS NULL").select("query_id", F.col("claim_id").alias("_last"), F.col("next").alias("_entry"))
    rest = entries.join(rings.select("query_id", F.col("claim_id").alias("_entry"), F.col("ring").alias("_rest")), ["query_id", "_entry"]).drop("_entry")
    joined = paths.withColumn("_last", F.element_at("lineage", -1)).join(rings, key, "left").join(rest, ["query_id", "_last"], "left")
    return joined.select(*key, F.coalesce("ring", F.concat("lineage", "_rest"), "lineage").alias("lineage"))


# --- validation ----------------------------------------------------------------


def validate(claims: DataFrame, relations: DataFrame, *, allow_neutral: bool = False) -> DataFrame:
    """Violations of the graph invariants, one row per kind and offending id."""
    known = claims.select("query_id", "claim_id")

    def issue(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.select("query_id", F.lit(kind).alias("issue"), F.col(key).alias("id"))

    found = [
        issue(known.groupBy("query_id", "claim_id").count().filter("count > 1"), "duplicate_claim", "claim_id"),
        issue(
            relations.groupBy("query_id", "relation_id").count().filter("count > 1"), "duplicate_relation", "relation_id"
        ),
        issue(relations.filter("source_claim_id = target_claim_id"), "self_relation", "relation_id"),
        issue(
            relations.filter(~F.col("relation_confidence").between(0.0, 1.0)), "confidence_out_of_range", "relation_id"
        ),
    ]
    for end in ("source_claim_id", "target_claim_id"):
        dangling = relations.join(known.withColumnRenamed("claim_id", end), ["query_id", end], "left_anti")
        found.append(issue(dangling, f"dangling_{end.split('_')[0]}", "relation_id"))
    if "span_start" in claims.columns:
        found.append(issue(claims.filter("span_end <= span_start"), "empty_span", "claim_id"))
    if not allow_neutral:
        found.append(issue(relations.filter(F.col("relation_type") == S.NEUTRAL), "stored_neutral", "relation_id"))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def graphml_elements(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """One GraphML element per claim and relation, ordered by ``part`` and ``id``."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    node = F.format_string(
        '<node id="%s"><data key="text">%s</data><data key="source_id">%s</data>'
        '<data key="extraction_confidence">%s</data></node>',
        escape(F.col("claim_id")),
        escape(F.col("text")),
        escape(F.col("source_id")),
        F.col("extraction_confidence").cast("string"),
    )
    edge = F.format_string(
        '<edge source="%s" target="%s" id="%s"><data key="relation_type">%s</data>'
        '<data key="direction">%s</data><data key="confidence">%s</data></edge>',
        escape(F.col("source_claim_id")),
        escape(F.col("target_claim_id")),
        F.col("relation_id"),
        F.col("relation_type"),
        F.col("direction"),
        F.col("relation_confidence").cast("string"),
    )
    nodes = claims.select("query_id", F.lit("node").alias("part"), F.col("claim_id").alias("id"), node.alias("xml"))
    edges = relations.select("query_id", F.lit("edge").alias("part"), F.col("relation_id").alias("id"), edge.alias("xml"))
    return nodes.unionByName(edges)
