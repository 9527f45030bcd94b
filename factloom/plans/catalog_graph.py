"""Queries over evidence graphs built from retrieved claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas as S
from factloom.functions import text as T
from factloom.operators import bridges as BR
from factloom.operators import extraction, packaging, pairs, reasoning, selection, temporal
from factloom.operators import graph as G
from factloom.plans import oracle as O
from factloom.plans import pipeline as P
from factloom.plans.registry import benchmark_queries, documents, joined, longs, quality_labels, query, table
from factloom.scale import spread
from factloom.session import cut_lineage

KEY = ["query_id", "claim_id"]


def evidence(spark: SparkSession, folder: str) -> P.Evidence:
    docs = documents(spark, folder)
    priors = P.prior_table(docs, quality_labels(spark, folder))
    return P.retrieve_evidence(docs, benchmark_queries(spark, folder), priors=priors)


# looser thresholds than the defaults: they relate more claims, so edges of every
# kind occur in the results that are compared
LOOSE = {
    "classifier": pairs.lexical_classifier(0.05),
    "rules": G.EdgeRules(entail=0.1, contradict=0.05),
    "candidates": pairs.CandidateRules(min_overlap=0.05),
}


def _loose(claims: DataFrame) -> DataFrame:
    return G.build_relations(claims, **LOOSE)


def _relations(found: P.Evidence) -> DataFrame:
    return cut_lineage(_loose(found.claims), "relations")


def _scores(found: P.Evidence, relations: DataFrame) -> DataFrame:
    return cut_lineage(reasoning.initial_scores(found.claims, relations, found.queries, priors=found.priors), "scores")


def _sql(parts: list[str], final: str, *more: str) -> str:
    return O.chain(*parts, *more, final=final, recursive=True)


@query("retrieved_claims", _sql(O.CLAIMS, "SELECT query_id, claim_id, passage_id, source_id, md5(text) AS text, subject FROM claims"))
def retrieved_claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence(spark, folder).claims
    return rows.select("query_id", "claim_id", "passage_id", "source_id", F.md5("text").alias("text"), "subject")


@query(
    "passage_claims",
    _sql([*O.EVIDENCE, O.PRIORS], """SELECT query_id, passage_id AS claim_id, source_id, 1.0::DOUBLE AS extraction_confidence,
       coalesce(reliability_prior, 0.5) AS source_reliability FROM hits LEFT JOIN priors USING (source_id)"""),
)
def passage_claims(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence(spark, folder)
    rows = reasoning.source_reliability(extraction.passage_claims(found.hits), found.priors)
    return rows.select("query_id", "claim_id", "source_id", "extraction_confidence", "source_reliability")


@query("candidate_pairs", _sql([*O.CLAIMS, O.FEATURES, O.PAIRS], "SELECT query_id, a_id, b_id, array_to_string(reasons, '|') AS reasons FROM pairs"))
def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = pairs.candidate_pairs(evidence(spark, folder).claims)
    return found.select("query_id", "a_id", "b_id", joined("reasons").alias("reasons"))


@query(
    "candidate_budget",
    _sql(
        [*O.CLAIMS, O.FEATURES, O.PAIRS],
        """SELECT query_id, a_id, b_id FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY len(reasons) DESC, a_id, b_id) AS r FROM pairs) WHERE r <= 10""",
    ),
)
def candidate_budget(spark: SparkSession, folder: str) -> DataFrame:
    rules = pairs.CandidateRules(max_pairs=10)
    return pairs.candidate_pairs(evidence(spark, folder).claims, rules).select("query_id", "a_id", "b_id")


@query(
    "candidate_stats",
    _sql(
        [*O.CLAIMS, O.FEATURES, O.PAIRS],
        """SELECT n.query_id, num_claims, num_claims * (num_claims - 1) // 2 AS possible_pairs, coalesce(g, 0) AS generated_pairs,
       num_claims * (num_claims - 1) // 2 - coalesce(g, 0) AS pruned_pairs, 0::BIGINT AS budget_truncated
FROM (SELECT query_id, count(*) AS num_claims FROM claims GROUP BY 1) n
LEFT JOIN (SELECT query_id, count(*) AS g FROM pairs GROUP BY 1) p ON p.query_id = n.query_id""",
    ),
)
def candidate_stats(spark: SparkSession, folder: str) -> DataFrame:
    claims = evidence(spark, folder).claims
    found = cut_lineage(pairs.candidate_pairs(claims).select("query_id", "a_id", "b_id"), "pairs")
    return pairs.candidate_stats(claims, found)


_MEETINGS = """
claim_words AS MATERIALIZED (SELECT query_id, claim_id, len(terms) AS n, unnest(terms) AS word FROM feats),
word_counts AS (SELECT query_id, word, count(*) AS c FROM claim_words GROUP BY ALL),
ranked_words AS MATERIALIZED (
  SELECT w.*, row_number() OVER (PARTITION BY w.query_id, w.claim_id ORDER BY c, w.word) AS place
  FROM claim_words w JOIN word_counts s ON s.query_id = w.query_id AND s.word = w.word
),
word_pairs AS (SELECT a.query_id, a.claim_id AS a_id, b.claim_id AS b_id, a.n AS a_n, b.n AS b_n, a.place AS a_place, b.place AS b_place
  FROM ranked_words a JOIN ranked_words b ON a.query_id = b.query_id AND a.word = b.word AND a.claim_id < b.claim_id),
overlap_steps AS (SELECT unnest([2, 5, 8]) AS tenths),
met_pairs AS (
  SELECT query_id, tenths, a_id, b_id, count(*) * 10 >= tenths * (a_n + b_n - count(*)) AS alike,
    bool_or(10 * (a_n - a_place) + 10 >= tenths * a_n AND 10 * (b_n - b_place) + 10 >= tenths * b_n
      AND 10 * least(a_n, b_n) >= tenths * greatest(a_n, b_n)
      AND (10 + tenths) * (1 + least(a_n - a_place, b_n - b_place)) >= tenths * (a_n + b_n)) AS met
  FROM word_pairs CROSS JOIN overlap_steps GROUP BY query_id, tenths, a_id, b_id, a_n, b_n
)
"""


@query(
    "overlap_meetings",
    _sql(
        [*O.CLAIMS, O.FEATURES, _MEETINGS],
        """SELECT query_id, CAST(tenths AS BIGINT) AS tenths, count(*) AS sharing, count(*) FILTER (met) AS met, count(*) FILTER (alike) AS alike
FROM met_pairs GROUP BY 1, 2""",
    ),
)
def overlap_meetings(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of claims that share a word, that the overlap join lets meet, and that reach overlaps of 0.2, 0.5 and 0.8."""
    claims = evidence(spark, folder).claims
    rows = cut_lineage(claims.select("query_id", "claim_id", T.token_set(F.col("text")).alias("terms")), "claim-words")
    words = rows.select("query_id", "claim_id", F.size("terms").alias("n"), F.explode("terms").alias("word"))
    sides = [words.select("query_id", "word", F.col("claim_id").alias(f"{x}_claim_id"), F.col("n").alias(f"{x}_n")) for x in "ab"]
    both = sides[0].join(sides[1], ["query_id", "word"]).filter("a_claim_id < b_claim_id")
    pair = ["query_id", "a_claim_id", "b_claim_id"]
    sharing = cut_lineage(both.groupBy(*pair, "a_n", "b_n").agg(F.count(F.lit(1)).alias("shared")), "sharing")
    parts = []
    for tenths in (2, 5, 8):
        met = pairs.overlap_meetings(rows, tenths / 10).withColumn("met", F.lit(True))
        alike = F.col("shared") * 10 >= tenths * (F.col("a_n") + F.col("b_n") - F.col("shared"))
        parts.append(sharing.join(met, pair, "left").select("query_id", F.lit(tenths).alias("tenths"), F.coalesce("met", F.lit(False)).alias("met"), alike.alias("alike")))
    judged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    found = judged.groupBy("query_id", "tenths").agg(
        F.count(F.lit(1)).alias("sharing"), F.count_if("met").alias("met"), F.count_if("alike").alias("alike")
    )
    return longs(found, "tenths")


@query(
    "candidate_budget_stats",
    _sql(
        [*O.CLAIMS, O.FEATURES, O.PAIRS],
        """SELECT n.query_id, num_claims, num_claims * (num_claims - 1) // 2 AS possible_pairs, least(coalesce(g, 0), 5) AS generated_pairs,
       num_claims * (num_claims - 1) // 2 - coalesce(g, 0) AS pruned_pairs, greatest(coalesce(g, 0) - 5, 0) AS budget_truncated
FROM (SELECT query_id, count(*) AS num_claims FROM claims GROUP BY 1) n
LEFT JOIN (SELECT query_id, count(*) AS g FROM pairs GROUP BY 1) p ON p.query_id = n.query_id""",
    ),
)
def candidate_budget_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs under a budget of five a query, and how many it cut off."""
    claims = evidence(spark, folder).claims
    found = cut_lineage(pairs.candidate_pairs(claims).select("query_id", "a_id", "b_id"), "pairs")
    kept = pairs.candidate_pairs(claims, pairs.CandidateRules(max_pairs=5))
    return pairs.candidate_stats(claims, cut_lineage(kept.select("query_id", "a_id", "b_id"), "kept"), found)


@query(
    "lexical_relation_scores",
    _sql([*O.CLAIMS, O.FEATURES, O.PAIRS, O.SCORED], "SELECT query_id, a_id, b_id, entail, contra, neutral FROM scored"),
)
def lexical_relation_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = pairs.lexical_classifier()(pairs.candidate_pairs(evidence(spark, folder).claims))
    return scored.select(
        "query_id", "a_id", "b_id", F.col("e_ab").alias("entail"), F.col("c_ab").alias("contra"), F.col("n_ab").alias("neutral")
    )


@query(
    "gated_relation_scores",
    _sql(
        [*O.CLAIMS, O.FEATURES, O.PAIRS, O.SCORED],
        """SELECT query_id, a_id, b_id, CASE WHEN demote THEN 0.0 ELSE contra END AS contra,
       CASE WHEN demote THEN round(neutral + contra, 6) ELSE neutral END AS neutral
FROM (SELECT *, contra >= 0.2 AND NOT (by_entity OR by_subject) AS demote FROM scored)""",
    ),
)
def gated_relation_scores(spark: SparkSession, folder: str) -> DataFrame:
    classify = pairs.gated(pairs.lexical_classifier(), 0.2)
    scored = classify(pairs.candidate_pairs(evidence(spark, folder).claims))
    return scored.select("query_id", "a_id", "b_id", F.col("c_ab").alias("contra"), F.col("n_ab").alias("neutral"))


@query(
    "relation_decisions",
    _sql(
        [*O.CLAIMS, O.FEATURES, O.PAIRS, O.SCORED],
        """SELECT query_id, a_id, b_id, CASE WHEN entail >= 0.8 THEN 'duplicate' WHEN entail >= 0.5 THEN 'supports'
       WHEN contra >= 0.5 THEN 'contradicts' ELSE 'neutral' END AS relation FROM scored""",
    ),
)
def relation_decisions(spark: SparkSession, folder: str) -> DataFrame:
    scored = pairs.lexical_classifier()(pairs.candidate_pairs(evidence(spark, folder).claims))
    return pairs.decide_relations(scored).select("query_id", "a_id", "b_id", "relation")


_SIMPLE_NEG = O.listing(["not", "no", "never", "cannot", "without"])


def _without(side: str) -> str:
    return f"list_filter({side}_terms, lambda t: NOT list_contains({_SIMPLE_NEG}, t))"


@query(
    "simple_relations",
    _sql(
        [*O.CLAIMS, O.FEATURES, O.PAIRS],
        f"""SELECT query_id, a_id, b_id, kind AS relation_type,
       CASE kind WHEN 'duplicate' THEN 0.99 WHEN 'contradiction' THEN 0.7 ELSE round(o, 6) END AS relation_confidence
FROM (
  SELECT *, CASE WHEN list_sort(a_terms) = list_sort(b_terms) THEN 'duplicate'
                 WHEN list_has_any(a_terms, {_SIMPLE_NEG}) <> list_has_any(b_terms, {_SIMPLE_NEG}) AND c >= 0.3 THEN 'contradiction'
                 WHEN o >= 0.3 THEN 'support' END AS kind
  FROM (SELECT *, {O.jaccard('a_terms', 'b_terms')} AS o, {O.jaccard(_without('a'), _without('b'))} AS c FROM pairs)
) WHERE kind IS NOT NULL""",
    ),
)
def simple_relations(spark: SparkSession, folder: str) -> DataFrame:
    found = pairs.simple_relations(pairs.candidate_pairs(evidence(spark, folder).claims), 0.3)
    return found.select("query_id", "a_id", "b_id", "relation_type", "relation_confidence")


@query(
    "evidence_relations",
    _sql(O.STRICT, "SELECT query_id, relation_id, source_claim_id, target_claim_id, relation_type, relation_confidence::DOUBLE AS relation_confidence FROM relations"),
)
def evidence_relations(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.build_relations(evidence(spark, folder).claims)
    return rows.select("query_id", "relation_id", "source_claim_id", "target_claim_id", "relation_type", "relation_confidence")


@query(
    "loose_relations",
    _sql(O.GRAPH, "SELECT query_id, relation_id, source_claim_id, target_claim_id, relation_type, relation_confidence::DOUBLE AS relation_confidence FROM relations"),
)
def loose_relations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _loose(evidence(spark, folder).claims)
    return rows.select("query_id", "relation_id", "source_claim_id", "target_claim_id", "relation_type", "relation_confidence")


@query(
    "text_duplicates",
    O.chain(
        f"d AS (SELECT doc_id, text, {O.casefolded(O.collapsed('text'))} AS key FROM documents)",
        "heads AS (SELECT key, min(doc_id) AS head_id, arg_min(text, doc_id) AS head_text, count(*) AS cluster_size FROM d GROUP BY key HAVING count(*) > 1)",
        final="""SELECT doc_id, head_id, CASE WHEN doc_id = head_id THEN 'head' WHEN text = head_text THEN 'exact' ELSE 'normalized' END AS kind,
       cluster_size FROM d JOIN heads USING (key)""",
    ),
)
def text_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return G.duplicate_clusters(spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id"), "doc_id")


@query(
    "latest_supersession",
    """SELECT e.event_id, max(n).event_id AS superseded_by, max(n).ts AS superseded_at
FROM events e LEFT JOIN (SELECT user_id, event_type, value, ts, event_id, {'ts': ts, 'event_id': event_id} AS n FROM events) x
  ON x.user_id = e.user_id AND x.event_type = e.event_type AND x.value <> e.value AND x.ts > e.ts
GROUP BY e.event_id""",
)
def latest_supersession(spark: SparkSession, folder: str) -> DataFrame:
    """Facts keyed by user and event type: which newer value replaces each?"""
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "ts")
    found = temporal.latest_superseding(rows, ["user_id", "event_type"], "value", "ts", "event_id")
    return found.select("event_id", "superseded_by", "superseded_at")


@query(
    "claim_neighbors",
    _sql(
        O.GRAPH,
        """SELECT query_id, claim_id, string_agg(DISTINCT n, '|' ORDER BY n) AS neighbors FROM (
  SELECT query_id, source_claim_id AS claim_id, target_claim_id AS n FROM relations
  UNION ALL SELECT query_id, target_claim_id, source_claim_id FROM relations) GROUP BY 1, 2""",
    ),
)
def claim_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.neighbors(_loose(evidence(spark, folder).claims))
    return rows.select(*KEY, joined("neighbors").alias("neighbors"))


@query(
    "claim_adjacency",
    _sql(
        O.GRAPH,
        """SELECT c.query_id, c.claim_id, count(r.relation_id) AS out_degree, coalesce(round(sum(r.relation_confidence), 6), 0.0)::DOUBLE AS weight
FROM claims c LEFT JOIN relations r ON r.query_id = c.query_id AND r.source_claim_id = c.claim_id GROUP BY 1, 2""",
    ),
)
def claim_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    claims = evidence(spark, folder).claims
    rows = G.adjacency(claims, _loose(claims))
    weight = F.aggregate("edges", F.lit(0.0), lambda acc, e: acc + e["relation_confidence"])
    return longs(rows.select(*KEY, F.size("edges").alias("out_degree"), F.round(weight, 6).alias("weight")), "out_degree")


@query(
    "claim_components",
    _sql(
        O.GRAPH,
        "SELECT c.query_id, c.claim_id, coalesce(p.component, c.claim_id) AS component FROM claims c LEFT JOIN parts p ON p.query_id = c.query_id AND p.claim_id = c.claim_id",
        O.component_cte("parts", "true"),
    ),
)
def claim_components(spark: SparkSession, folder: str) -> DataFrame:
    claims = evidence(spark, folder).claims
    return G.clusters(claims, _loose(claims))


@query(
    "corroborating_sources",
    _sql(
        O.GRAPH,
        """SELECT r.query_id, r.target_claim_id AS claim_id, string_agg(DISTINCT s.source_id, '|' ORDER BY s.source_id) AS sources
FROM relations r JOIN claims s ON s.query_id = r.query_id AND s.claim_id = r.source_claim_id
JOIN claims t ON t.query_id = r.query_id AND t.claim_id = r.target_claim_id
WHERE r.relation_type = 'support' AND s.source_id <> t.source_id GROUP BY 1, 2""",
    ),
)
def corroborating_sources(spark: SparkSession, folder: str) -> DataFrame:
    claims = evidence(spark, folder).claims
    rows = G.corroborating_sources(claims, _loose(claims))
    return rows.select(*KEY, joined("sources").alias("sources"))


@query(
    "relation_lookup",
    _sql(
        O.GRAPH,
        """SELECT c.query_id, c.claim_id,
       (SELECT count(DISTINCT source_claim_id) FROM relations r WHERE r.query_id = c.query_id AND r.target_claim_id = c.claim_id AND relation_type = 'support') AS supporters,
       (SELECT count(*) FROM relations r WHERE r.query_id = c.query_id AND c.claim_id IN (r.target_claim_id, r.source_claim_id) AND relation_type = 'contradiction') AS opponents,
       (SELECT count(*) FROM relations r WHERE r.query_id = c.query_id AND c.claim_id IN (r.target_claim_id, r.source_claim_id) AND relation_type = 'duplicate') AS duplicates
FROM claims c""",
    ),
)
def relation_lookup(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence(spark, folder)
    relations = _relations(found)
    rows = found.claims.select(*KEY)
    parts = {
        "supporters": G.directed_lookup(relations, S.SUPPORT, incoming=True).withColumnRenamed("ids", "v"),
        "opponents": G.neighbors(relations, [S.CONTRADICTION]).withColumnRenamed("neighbors", "v"),
        "duplicates": G.neighbors(relations, [S.DUPLICATE]).withColumnRenamed("neighbors", "v"),
    }
    for name, part in parts.items():
        rows = rows.join(part.select(*KEY, F.size("v").cast("bigint").alias(name)), KEY, "left")
    return rows.na.fill(0)


@query(
    "graph_summary",
    _sql(
        O.GRAPH,
        """SELECT n.query_id, num_nodes, num_sources, coalesce(num_edges, 0) AS num_edges, coalesce(support_edges, 0) AS support_edges,
       coalesce(contradiction_edges, 0) AS contradiction_edges, coalesce(duplicate_edges, 0) AS duplicate_edges, num_components
FROM (SELECT query_id, count(*) AS num_nodes, count(DISTINCT source_id) AS num_sources FROM claims GROUP BY 1) n
LEFT JOIN (SELECT query_id, count(*) AS num_edges, count_if(relation_type = 'support')::BIGINT AS support_edges,
                  count_if(relation_type = 'contradiction')::BIGINT AS contradiction_edges,
                  count_if(relation_type = 'duplicate')::BIGINT AS duplicate_edges FROM relations GROUP BY 1) e ON e.query_id = n.query_id
JOIN (SELECT c.query_id, count(DISTINCT coalesce(p.component, c.claim_id)) AS num_components
      FROM claims c LEFT JOIN parts p ON p.query_id = c.query_id AND p.claim_id = c.claim_id GROUP BY 1) k ON k.query_id = n.query_id""",
        O.component_cte("parts", "true"),
    ),
)
def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence(spark, folder)
    rows = G.summary(found.claims, _relations(found))
    return rows.drop("supersession_edges", "bridges_edges")


@query(
    "relation_composition",
    _sql(O.GRAPH, "SELECT relation_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM relations GROUP BY 1"),
)
def relation_composition(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.operators.stats import composition

    return composition(_relations(evidence(spark, folder)))


@query(
    "graph_violations",
    _sql(
        O.GRAPH,
        """SELECT query_id, issue, id FROM (
  SELECT query_id, 'duplicate_claim' AS issue, claim_id AS id FROM claims GROUP BY 1, 3 HAVING count(*) > 1
  UNION ALL SELECT query_id, 'low_confidence_support', relation_id FROM relations WHERE relation_type = 'support' AND relation_confidence < 0.12
)""",
    ),
)
def graph_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Invariant violations (none expected) beside weak edges worth a look."""
    found = evidence(spark, folder)
    relations = _relations(found)
    weak = relations.filter((F.col("relation_type") == S.SUPPORT) & (F.col("relation_confidence") < 0.12)).select(
        "query_id", F.lit("low_confidence_support").alias("issue"), F.col("relation_id").alias("id")
    )
    return G.validate(found.claims, relations).unionByName(weak)


@query(
    "graphml_elements",
    _sql(
        O.GRAPH,
        """SELECT query_id, 'node' AS part, claim_id AS id, md5('<node id="' || claim_id || '"><data key="text">' ||
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</data><data key="source_id">' || source_id ||
         '</data><data key="extraction_confidence">0.9</data></node>') AS xml FROM claims
UNION ALL
SELECT query_id, 'edge', relation_id, md5('<edge source="' || source_claim_id || '" target="' || target_claim_id || '" id="' || relation_id ||
         '"><data key="relation_type">' || relation_type || '</data><data key="direction">' ||
         CASE relation_type WHEN 'support' THEN 'directed' ELSE 'symmetric' END || '</data><data key="confidence">' ||
         CAST(relation_confidence::DOUBLE AS VARCHAR) || '</data></edge>') FROM relations""",
    ),
)
def graphml_elements(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence(spark, folder)
    rows = G.graphml_elements(found.claims, _relations(found))
    return rows.withColumn("xml", F.md5("xml"))


_BRIDGES = f"""
goals AS (SELECT query_id, {O.bridge_entities('text')} AS goals FROM queries),
bnames AS (
  SELECT query_id, claim_id, text, CASE WHEN len(own) > 0 THEN own ELSE {O.bridge_entities('text')} END AS names FROM (
    SELECT *, list_sort(list_distinct(list_filter(entities, lambda e: NOT list_contains({O.listing([*O.V.BRIDGE_GENERIC_WORDS, *O.V.BRIDGE_STOP_WORDS])}, lower(e))))) AS own FROM claims)
),
bridge_pairs AS (
  SELECT a.query_id, a.claim_id AS a_id, b.claim_id AS b_id, a.names AS an, b.names AS bn, g.goals,
         list_sort(list_intersect(a.names, b.names)) AS shared
  FROM bnames a JOIN bnames b ON a.query_id = b.query_id AND a.claim_id < b.claim_id AND a.text <> b.text
  JOIN goals g ON g.query_id = a.query_id WHERE list_has_any(a.names, b.names)
),
open_pairs AS (
  SELECT *, list_sort(list_intersect(shared, goals)) AS asked FROM bridge_pairs p
  WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.query_id = p.query_id
                    AND least(r.source_claim_id, r.target_claim_id) = p.a_id AND greatest(r.source_claim_id, r.target_claim_id) = p.b_id)
    AND (list_has_any(an, goals) OR list_has_any(bn, goals))
    AND len(list_filter(an, lambda x: NOT list_contains(shared, x))) > 0 AND len(list_filter(bn, lambda x: NOT list_contains(shared, x))) > 0
)
"""


@query(
    "bridge_candidates",
    _sql(
        O.STRICT,
        """SELECT query_id, a_id, b_id, coalesce(asked[1], shared[1]) AS bridge_entity, array_to_string(shared, '|') AS bridge_terms,
       round(least(1.0, 0.6 + CASE WHEN len(asked) > 0 THEN 0.2 ELSE 0 END
                   + CASE WHEN list_has_any(an, goals) AND list_has_any(bn, goals) THEN 0.2 ELSE 0 END), 4)::DOUBLE AS confidence FROM open_pairs""",
        _BRIDGES,
    ),
)
def bridge_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence(spark, folder)
    rows = BR.bridge_candidates(found.claims, G.build_relations(found.claims), found.queries)
    return rows.withColumn("bridge_terms", joined("bridge_terms"))


@query("bridges_by_degree")
def bridges_by_degree(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence(spark, folder)
    rows = BR.limit_degree(BR.bridge_candidates(found.claims, G.build_relations(found.claims), found.queries))
    return BR.bridge_relations(rows)


@query(
    "initial_scores",
    _sql(O.SCORING, "SELECT query_id, claim_id, query_relevance, source_reliability, provenance_diversity, initial_belief::DOUBLE AS initial_belief, query_utility::DOUBLE AS query_utility FROM scores"),
)
def initial_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence(spark, folder)
    rows = _scores(found, _relations(found))
    return longs(
        rows.select(*KEY, "query_relevance", "source_reliability", "provenance_diversity", "initial_belief", "query_utility"),
        "provenance_diversity",
    )


@query(
    "one_shot_beliefs",
    _sql(
        O.SCORING,
        """SELECT s.query_id, s.claim_id, round(greatest(0, least(1, round(0.9 * s.source_reliability, 6)
       + 0.05 * s.provenance_diversity - 0.1 * coalesce(c.n, 0))), 6)::DOUBLE AS belief, round(s.query_relevance, 6) AS query_utility
FROM scores s LEFT JOIN (
  SELECT query_id, unnest([source_claim_id, target_claim_id]) AS claim_id, 1 AS one FROM relations WHERE relation_type = 'contradiction'
) x ON false LEFT JOIN (
  SELECT query_id, claim_id, count(*) AS n FROM (
    SELECT query_id, unnest([source_claim_id, target_claim_id]) AS claim_id FROM relations WHERE relation_type = 'contradiction') GROUP BY 1, 2
) c ON c.query_id = s.query_id AND c.claim_id = s.claim_id""",
    ),
)
def one_shot_beliefs(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence(spark, folder)
    start = cut_lineage(reasoning.simple_scores(found.claims, found.queries, found.priors), "start")
    moved = reasoning.one_shot_beliefs(start, _relations(found))
    return moved.select(*KEY, "belief", "query_utility")


@query("propagated_beliefs", _sql(O.BELIEF, "SELECT query_id, claim_id, belief, CAST(iterations AS BIGINT) AS iterations FROM beliefs"))
def propagated_beliefs(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence(spark, folder)
    relations = _relations(found)
    rows = reasoning.propagate(found.claims, relations, _scores(found, relations))
    return longs(rows.select(*KEY, F.round("belief", 6).alias("belief"), "iterations"), "iterations")


def reasoned(spark: SparkSession, folder: str, variant: str = "full_graph") -> tuple[P.Evidence, P.Reasoned]:
    found = evidence(spark, folder)
    return found, P.reason(found.claims, found.queries, P.VARIANTS[variant], priors=found.priors, **LOOSE)


@query(
    "conflict_outcomes",
    _sql(
        [*O.BELIEF, O.CONFLICTS],
        """SELECT query_id, component, members, outcome,
       CASE WHEN outcome = 'preferred' THEN top_id END AS preferred_claim_id FROM conflict_sets""",
    ),
)
def conflict_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    _, r = reasoned(spark, folder)
    return r.conflicts.select("query_id", "component", F.array_join("claim_ids", ",").alias("members"), "outcome", "preferred_claim_id")


@query(
    "conflict_groups",
    _sql(
        O.GRAPH,
        "SELECT query_id, component, string_agg(claim_id, ',' ORDER BY claim_id) AS members FROM parts GROUP BY 1, 2",
        O.component_cte("parts", "relation_type = 'contradiction'"),
    ),
)
def conflict_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Contradiction groups as such, none of them resolved."""
    parts = G.components(_relations(evidence(spark, folder)), [S.CONTRADICTION])
    return parts.groupBy("query_id", "component").agg(F.array_join(F.sort_array(F.collect_set("claim_id")), ",").alias("members"))


_TOP = """
ordered_base AS (
  SELECT s.query_id, s.claim_id, s.query_utility + b.belief AS base, CAST(ceil(length(s.text) / 4.0) AS BIGINT) AS cost,
         row_number() OVER (PARTITION BY s.query_id ORDER BY s.query_utility + b.belief DESC, s.claim_id) AS place
  FROM scores s JOIN beliefs b ON b.query_id = s.query_id AND b.claim_id = s.claim_id
),
filling AS (
  SELECT query_id, claim_id, place, base, cost, cost <= 192 AS kept, CASE WHEN cost <= 192 THEN cost ELSE 0 END AS used FROM ordered_base WHERE place = 1
  UNION ALL
  SELECT o.query_id, o.claim_id, o.place, o.base, o.cost, f.used + o.cost <= 192, CASE WHEN f.used + o.cost <= 192 THEN f.used + o.cost ELSE f.used END
  FROM filling f JOIN ordered_base o ON o.query_id = f.query_id AND o.place = f.place + 1
)
"""


@query(
    "top_selection",
    _sql(
        O.BELIEF,
        """SELECT query_id, claim_id, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS position,
       round(base, 6)::DOUBLE AS contribution FROM filling WHERE kept""",
        _TOP,
    ),
)
def top_selection(spark: SparkSession, folder: str) -> DataFrame:
    found, r = reasoned(spark, folder)
    ctx = selection.context(found.claims, r.relations, r.board, found.queries, r.conflicts, selection.Objective())
    rows = selection.select_top(ctx, selection.Budget())
    return longs(rows.select(*KEY, "position", "contribution"), "position")


@query(
    "best_utility_selection",
    _sql(
        O.BELIEF,
        """SELECT query_id, claim_id, place - 1 AS position FROM (
  SELECT s.query_id, s.claim_id, row_number() OVER (PARTITION BY s.query_id ORDER BY query_utility DESC, belief DESC, s.claim_id) AS place
  FROM scores s JOIN beliefs b ON b.query_id = s.query_id AND b.claim_id = s.claim_id) WHERE place <= 3""",
    ),
)
def best_utility_selection(spark: SparkSession, folder: str) -> DataFrame:
    _, r = reasoned(spark, folder)
    return longs(selection.select_best(r.board, 3).select(*KEY, "position"), "position")


@query(
    "induced_relations",
    _sql(
        O.BELIEF,
        """SELECT r.query_id, r.relation_id FROM relations r
JOIN filling a ON a.query_id = r.query_id AND a.claim_id = r.source_claim_id AND a.kept
JOIN filling b ON b.query_id = r.query_id AND b.claim_id = r.target_claim_id AND b.kept""",
        _TOP,
    ),
)
def induced_relations(spark: SparkSession, folder: str) -> DataFrame:
    found, r = reasoned(spark, folder)
    ctx = selection.context(found.claims, r.relations, r.board, found.queries, r.conflicts, selection.Objective())
    picked = cut_lineage(selection.select_top(ctx, selection.Budget()), "picked")
    return G.induced(r.relations, picked).select("query_id", "relation_id")


@query(
    "term_coverage",
    _sql(
        O.BELIEF,
        f"""SELECT a.query_id, round(coalesce(h.covered, 0)::DOUBLE / greatest(len({O.token_set('q.text')}), 1), 6) AS coverage
FROM (SELECT DISTINCT query_id FROM claims) a JOIN queries q ON q.query_id = a.query_id LEFT JOIN (
  SELECT f.query_id, count(DISTINCT t) AS covered FROM (
    SELECT f.query_id, unnest({O.token_set('c.text')}) AS t FROM filling f JOIN claims c ON c.query_id = f.query_id AND c.claim_id = f.claim_id WHERE f.kept
  ) f JOIN queries q ON q.query_id = f.query_id AND list_contains({O.token_set('q.text')}, f.t) GROUP BY 1) h ON h.query_id = a.query_id""",
        _TOP,
    ),
)
def term_coverage(spark: SparkSession, folder: str) -> DataFrame:
    found, r = reasoned(spark, folder)
    ctx = cut_lineage(
        selection.context(found.claims, r.relations, r.board, found.queries, r.conflicts, selection.Objective()), "context"
    )
    rows = selection.term_coverage(ctx, selection.select_top(ctx, selection.Budget()))
    return rows.select("query_id", F.round("coverage", 6).alias("coverage"))


@query(
    "evidence_status",
    _sql(
        [*O.BELIEF, O.CONFLICTS],
        """SELECT s.query_id, s.claim_id, CASE WHEN c.outcome = 'preferred' AND c.top_id <> s.claim_id OR c.outcome = 'rejected_low_evidence' THEN 'rejected'
       WHEN c.outcome = 'unresolved' THEN 'disputed' ELSE 'accepted' END AS status
FROM scores s LEFT JOIN conflict_parts p ON p.query_id = s.query_id AND p.claim_id = s.claim_id
LEFT JOIN conflict_sets c ON c.query_id = p.query_id AND c.component = p.component""",
    ),
)
def evidence_status(spark: SparkSession, folder: str) -> DataFrame:
    found, r = reasoned(spark, folder)
    return packaging.evidence_status(found.claims.select(*KEY), r.relations, r.conflicts)


_BOARD = f"""
sides AS (
  SELECT query_id, relation_type, source_claim_id AS claim_id, target_claim_id AS other FROM relations
  UNION SELECT query_id, relation_type, target_claim_id, source_claim_id FROM relations
),
around AS (
  SELECT query_id, claim_id, list(DISTINCT other) AS linked, list(DISTINCT other) FILTER (relation_type = 'contradiction') AS opponents,
         list(DISTINCT other) FILTER (relation_type = 'duplicate') AS duplicates FROM sides GROUP BY 1, 2
),
backed AS (SELECT query_id, target_claim_id AS claim_id, list(DISTINCT source_claim_id) AS supporters FROM relations WHERE relation_type = 'support' GROUP BY 1, 2),
undecided AS (SELECT DISTINCT p.query_id, p.claim_id FROM conflict_parts p JOIN conflict_sets c ON c.query_id = p.query_id AND c.component = p.component WHERE c.outcome = 'unresolved'),
ctx AS MATERIALIZED (
  SELECT s.query_id, s.claim_id, s.source_id, CAST(s.query_utility AS DOUBLE) + CAST(b.belief AS DOUBLE) AS base, CAST(ceil(length(s.text) / 4.0) AS BIGINT) AS cost,
         list_intersect({O.token_set('s.text')}, {O.token_set('q.text')}) AS covers, greatest(len({O.token_set('q.text')}), 1) AS terms,
         coalesce(a.linked, []) AS linked, coalesce(a.opponents, []) AS opponents, coalesce(a.duplicates, []) AS duplicates, coalesce(k.supporters, []) AS supporters,
         u.claim_id IS NOT NULL AS undecided
  FROM scores s JOIN beliefs b ON b.query_id = s.query_id AND b.claim_id = s.claim_id JOIN queries q ON q.query_id = s.query_id
  LEFT JOIN around a ON a.query_id = s.query_id AND a.claim_id = s.claim_id LEFT JOIN backed k ON k.query_id = s.query_id AND k.claim_id = s.claim_id
  LEFT JOIN undecided u ON u.query_id = s.query_id AND u.claim_id = s.claim_id
)
"""
_GAIN = """round(c.base + CAST(0.5 AS DOUBLE) * (len(list_filter(c.covers, lambda t: NOT list_contains(w.covered, t))) / c.terms)
  + CASE WHEN list_has_any(c.supporters, w.chosen) THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN list_contains(w.sources, c.source_id) THEN CAST(-0.5 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END
  + CASE WHEN list_has_any(c.opponents, w.chosen) THEN CAST(0.2 AS DOUBLE) ELSE 0 END - CASE WHEN list_has_any(c.duplicates, w.chosen) THEN CAST(0.5 AS DOUBLE) ELSE 0 END
  - CASE WHEN c.undecided AND NOT list_has_any(c.opponents, w.chosen) THEN CAST(0.3 AS DOUBLE) ELSE 0 END, 9)"""
_NEXT = """list_append(w.chosen, c.claim_id) AS chosen, list_distinct(w.covered || c.covers) AS covered, list_distinct(list_append(w.sources, c.source_id)) AS sources, w.used + c.cost AS used"""
_TOUCHES = "c.query_id = w.query_id AND list_has_any(c.linked, w.chosen) AND NOT list_contains(w.chosen, c.claim_id) AND w.used + c.cost <= 192"
_REPORT = """SELECT c.query_id, c.claim_id, round(c.base, 6) AS selection_score, coalesce(p.contribution, 0) AS contribution, p.position IS NOT NULL AS selected,
  coalesce(p.position, -1) AS position, coalesce(p.reason, CASE WHEN min(c.cost) OVER (PARTITION BY c.query_id) > 192 THEN 'rejected: exceeds token budget' ELSE '{other}' END) AS reason, c.cost AS tokens
FROM ctx c LEFT JOIN picked p ON p.query_id = c.query_id AND p.claim_id = c.claim_id"""

_GREEDY = f"""
growth AS (
  SELECT query_id, CAST(0 AS BIGINT) AS k, min({{'less': -round(base, 9), 'claim_id': claim_id, 'chosen': [claim_id], 'covered': covers, 'sources': [source_id], 'used': cost}}) AS b
  FROM ctx WHERE cost <= 192 GROUP BY query_id
  UNION ALL
  SELECT query_id, k, min({{'less': -gain, 'claim_id': claim_id, 'chosen': chosen, 'covered': covered, 'sources': sources, 'used': used}}) FROM (
    SELECT w.query_id, w.k + 1 AS k, c.claim_id, {_GAIN} AS gain, {_NEXT}
    FROM (SELECT query_id, k, b.chosen, b.covered, b.sources, b.used FROM growth) w JOIN ctx c ON {_TOUCHES}) WHERE gain > 0 GROUP BY query_id, k
),
ended AS (SELECT query_id, arg_max(b, k) AS b FROM growth GROUP BY query_id),
counter AS (
  SELECT e.query_id, other, min(w.k) AS k FROM growth w JOIN ended e ON e.query_id = w.query_id JOIN (SELECT query_id, claim_id, unnest(opponents) AS other FROM ctx WHERE undecided) o
    ON o.query_id = w.query_id AND o.claim_id = w.b.claim_id WHERE NOT list_contains(e.b.chosen, other) GROUP BY 1, 2
),
counters AS (SELECT n.query_id, n.other, c.cost, row_number() OVER (PARTITION BY n.query_id ORDER BY n.k, n.other) AS place FROM counter n JOIN ctx c ON c.query_id = n.query_id AND c.claim_id = n.other),
both_sides AS (
  SELECT query_id, CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS claim_id, b.used AS used, CAST(len(b.chosen) AS BIGINT) AS position FROM ended
  UNION ALL
  SELECT s.query_id, n.place, CASE WHEN s.used + n.cost <= 192 THEN n.other END, CASE WHEN s.used + n.cost <= 192 THEN s.used + n.cost ELSE s.used END,
         s.position + CASE WHEN s.claim_id IS NULL THEN 0 ELSE 1 END FROM both_sides s JOIN counters n ON n.query_id = s.query_id AND n.place = s.place + 1
),
picked AS (
  SELECT query_id, b.claim_id AS claim_id, k AS position, round(-b.less, 6) AS contribution, CASE WHEN k = 0 THEN 'first: largest base value that fits' ELSE 'added: gain above zero' END AS reason FROM growth
  UNION ALL SELECT query_id, claim_id, position, 0.2, 'kept: other side of an open contradiction' FROM both_sides WHERE claim_id IS NOT NULL
)
"""

_BEAM = f"""
firsts AS (SELECT w.*, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, claim_id) AS place, {_GAIN.replace("c.", "w.").replace("w.covered", "[]").replace("w.chosen", "[]").replace("w.sources", "[]")} AS gain FROM ctx w WHERE cost <= 192),
growth AS (
  SELECT query_id, CAST(1 AS BIGINT) AS k, place, gain AS value, max(gain) OVER (PARTITION BY query_id) AS best, [claim_id] AS chosen, covers AS covered, [source_id] AS sources, cost AS used FROM firsts WHERE place <= 4
  UNION ALL
  SELECT query_id, k, place, value, lead AS best, chosen, covered, sources, used FROM (
    SELECT *, max(value) OVER (PARTITION BY query_id) AS lead FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, sorted, before, base DESC, claim_id) AS place FROM (
        SELECT w.query_id, w.k + 1 AS k, w.best, w.place AS before, c.base, c.claim_id, round(w.value + {_GAIN}, 9) AS value, list_sort(list_append(w.chosen, c.claim_id)) AS sorted, {_NEXT}
        FROM growth w JOIN ctx c ON {_TOUCHES})) WHERE place <= 4) WHERE lead > best
),
ended AS (SELECT query_id, max({{'k': k, 'value': value, 'chosen': CASE WHEN k = 1 OR place = 1 THEN chosen END}}) FILTER (k = 1 OR place = 1) AS b FROM growth GROUP BY query_id),
picked AS (SELECT e.query_id, e.claim_id, e.position, round(c.base, 6) AS contribution, 'on the best path found' AS reason
  FROM (SELECT query_id, unnest(b.chosen) AS claim_id, unnest(range(0, len(b.chosen))) AS position FROM ended) e JOIN ctx c ON c.query_id = e.query_id AND c.claim_id = e.claim_id)
"""


def _selected(spark: SparkSession, folder: str, rule, rejected: str) -> DataFrame:
    found, r = reasoned(spark, folder)
    ctx = cut_lineage(
        selection.context(found.claims, r.relations, r.board, found.queries, r.conflicts, selection.Objective()), "context"
    )
    budget = selection.Budget()
    picked = cut_lineage(rule(ctx, budget), "picked")
    rows = selection.explain(ctx, picked, budget, rejected).join(picked.select(*KEY, "position"), KEY, "left")
    rows = rows.select(*KEY, "selection_score", "contribution", "selected", F.coalesce("position", F.lit(-1)).alias("position"), "reason", "tokens")
    return longs(rows, "position", "tokens")


_NO_GAIN, _NO_STATE = "rejected: no positive connected marginal gain", "rejected: not on the best path found"


@query("greedy_selection", _sql([*O.BELIEF, O.CONFLICTS], _REPORT.format(other=_NO_GAIN), _BOARD, _GREEDY))
def greedy_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _selected(spark, folder, selection.select_greedy, _NO_GAIN)


@query("beam_selection", _sql([*O.BELIEF, O.CONFLICTS], _REPORT.format(other=_NO_STATE), _BOARD, _BEAM))
def beam_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _selected(spark, folder, selection.select_beam, _NO_STATE)


_PREFIX = """
costed AS (
  SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY place) AS used FROM (
    SELECT query_id, claim_id, source_id, text, greatest(1, length(text) // 4) AS cost,
           row_number() OVER (PARTITION BY query_id ORDER BY claim_id) - 1 AS place FROM claims)
)
"""


@query("prefix_selection", _sql(O.CLAIMS, "SELECT query_id, claim_id, place AS position, CAST(used AS BIGINT) AS used FROM costed WHERE place = 0 OR used <= 192", _PREFIX))
def prefix_selection(spark: SparkSession, folder: str) -> DataFrame:
    claims = evidence(spark, folder).claims
    order = [F.desc("extraction_confidence"), F.asc("claim_id")]
    rows = selection.select_prefix(claims, order, selection.Budget())
    return longs(rows.select(*KEY, "position", "used"), "position", "used")


_CITED = """
picked AS (SELECT * FROM costed WHERE place = 0 OR used <= 192),
answers AS (
  SELECT query_id, 'The selected claims ' || string_agg('[' || claim_id || ']', ' ' ORDER BY place) || ' answer the query.' AS answer,
         string_agg(claim_id, '|' ORDER BY place) AS citations FROM picked GROUP BY 1
)
"""


@query("claim_answers", _sql(O.CLAIMS, "SELECT query_id, answer, citations, NULL::VARCHAR AS error FROM answers", _PREFIX, _CITED))
def claim_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Claim-level answers from selection to parsed and attributed output."""
    packs = cut_lineage(P.run_variant(evidence(spark, folder), P.VARIANTS["claim_only_rag"]), "packages")
    rows = packaging.generate(packs)
    return rows.select("query_id", "answer", joined("cited_claim_ids").alias("citations"), "error")


@query(
    "cited_sources",
    _sql(
        O.CLAIMS,
        """SELECT query_id, string_agg(source_id, '|' ORDER BY first) AS sources FROM (
  SELECT query_id, source_id, min(place) AS first FROM picked GROUP BY 1, 2) GROUP BY 1""",
        _PREFIX, _CITED,
    ),
)
def cited_sources(spark: SparkSession, folder: str) -> DataFrame:
    packs = cut_lineage(P.run_variant(evidence(spark, folder), P.VARIANTS["claim_only_rag"]), "packages")
    answers = packaging.parse_answers(packaging.template_answers(packs))
    rows = packaging.ordered_sources(answers, "cited_claim_ids", packs, "sources")
    return rows.select("query_id", joined("sources").alias("sources"))


def _packages(spark: SparkSession, folder: str, variant: str) -> DataFrame:
    return cut_lineage(P.run_variant(evidence(spark, folder), P.VARIANTS[variant]), "packages")


@query("evidence_packages")
def evidence_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Full-graph packages, written to JSON and read back."""
    packs = _packages(spark, folder, "full_graph")
    back = packaging.from_json(packaging.to_json(packs), packs)
    return back.select(
        "query_id", F.size("claims").alias("claims"), F.size("relations").alias("relations"), F.size("conflicts").alias("conflicts"),
        F.size("selected").alias("selected"), F.size("duplicate_groups").alias("duplicate_groups"), "budget_used",
        F.sha2(F.to_json(F.struct(*back.columns)), 256).alias("digest"),
    )


@query("rendered_prompts")
def rendered_prompts(spark: SparkSession, folder: str) -> DataFrame:
    packs = _packages(spark, folder, "full_graph")
    styles = [packaging.render(packs, s).select("query_id", F.lit(s).alias("style"), "prompt") for s in ("plain", "markdown", "chat")]
    return styles[0].unionByName(styles[1]).unionByName(styles[2])


@query("grounded_answers")
def grounded_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = packaging.generate(_packages(spark, folder, "full_graph"))
    return rows.select("query_id", "answer", "cited_claim_ids", "uncertainty", "error", "abstained", "warnings")


@query("listed_answers")
def listed_answers(spark: SparkSession, folder: str) -> DataFrame:
    return packaging.list_answers(_packages(spark, folder, "graph_top_claim"))


@query("system_variants")
def system_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Passage, claim and graph systems on the same evidence, with their metrics.

    The best hit's source is the gold source and the query text the gold answer.
    """
    from factloom.plans.experiment import variant_results

    found = evidence(spark, folder)
    gold = found.hits.filter(F.col("rank") == 0).select("query_id", F.array("source_id").alias("gold_source_ids"))
    gold = found.queries.join(gold, "query_id", "left").select(
        "query_id", F.array("text").alias("answers"), F.coalesce("gold_source_ids", F.array().cast("array<string>")).alias("gold_source_ids"),
        F.col("gold_source_ids").isNotNull().alias("gold_available"),
    )
    parts = None
    for name in ("passage_rag", "claim_only_rag", "full_graph"):
        options = LOOSE if P.VARIANTS[name].family == "graph" else {}
        rows = variant_results(found, P.VARIANTS[name], gold, P.Settings(), **options)
        rows = rows.select(F.lit(name).alias("variant"), "example_id", "failed", F.explode("metrics").alias("metric", "value"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.withColumn("value", F.round("value", 6))
