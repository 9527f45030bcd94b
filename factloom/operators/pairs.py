"""Candidate pairs of claims and pair classification.

Claims of one query come from its top passages, so a query's claim set is bounded
by the retrieval settings. Pairs are found by equality joins on the values that
can make two claims a candidate (a rare enough shared token, an entity or a subject),
never by enumerating all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import fixed_values as V
from factloom.functions import text as T
from factloom.scale import top_per_key


@dataclass(frozen=True)
class CandidateRules:
    shared_entities: bool = True
    lexical_overlap: bool = True
    same_subject: bool = True
    known_times: bool = False
    query_relevance: bool = False
    other_source: bool = False
    same_polarity: bool = False
    min_entities: int = 1
    min_overlap: float = 0.2
    min_relevance: float = 0.1
    max_pairs: int | None = None
    brute_force: bool = False

    def blockable(self) -> bool:
        """True if every candidate shares a token, an entity or a subject."""
        unblocked = self.known_times or self.other_source or self.same_polarity or self.brute_force
        unblocked = unblocked or (self.query_relevance and self.min_relevance <= 0) or (self.shared_entities and self.min_entities <= 0)
        return not unblocked and not (self.lexical_overlap and self.min_overlap <= 0)


def _features(claims: DataFrame) -> DataFrame:
    """The columns pair rules look at, computed once per claim."""
    has = set(claims.columns)
    column = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    return claims.select(
        "query_id",
        "claim_id",
        "text",
        "source_id",
        T.token_set(F.col("text")).alias("terms"),
        T.folded(F.coalesce(column("entities", "array<string>"), F.array().cast("array<string>"))).alias("names"),
        T.casefold(F.coalesce(column("subject", "string"), F.lit(""))).alias("subject_key"),
        F.coalesce(column("negation", "boolean"), F.lit(False)).alias("negation"),
        column("asserted_at", "timestamp").alias("asserted_at"),
    )


def _keys(rules: CandidateRules) -> Column:
    """Values other than tokens that make two claims a candidate."""
    none = F.array().cast("array<string>")
    parts = [none]
    if rules.shared_entities:
        parts.append(F.transform("names", lambda t: F.concat(F.lit("e:"), t)))
    if rules.same_subject:
        parts.append(F.when(F.col("subject_key") != "", F.array(F.concat(F.lit("s:"), "subject_key"))).otherwise(none))
    if rules.query_relevance:
        parts.append(F.when(F.col("relevance") >= rules.min_relevance, F.array(F.lit("q:relevant"))).otherwise(none))
    return F.array_distinct(F.concat(*parts))


#: Slack of the bounds below, so that a ratio rounded in its last place is never lost.
_SLACK = 1e-9


def overlap_prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """``query_id, claim_id, n, word, place``: the words by which claims of a given overlap must meet.

    The ``n`` words of a claim are ordered from the rarest of its query to the most frequent, ties by the word. Two claims
    with a Jaccard overlap of ``threshold`` share at least ``ceil(threshold * n)`` words of each, so they share one within
    the first ``n - ceil(threshold * n) + 1`` places of both. Frequent words stand last and mostly fall outside.
    Frequencies are combined before the shuffle.
    """
    words = rows.select("query_id", "claim_id", F.size("terms").alias("n"), F.explode("terms").alias("word"))
    spread = words.groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("_claims"))
    order = W.partitionBy("query_id", "claim_id").orderBy("_claims", "word")
    placed = words.join(spread, ["query_id", "word"]).withColumn("place", F.row_number().over(order))
    least = F.greatest(F.ceil(threshold * F.col("n") - _SLACK), F.lit(1))
    return placed.filter(F.col("place") <= F.col("n") - least + 1).select("query_id", "claim_id", "n", "word", "place")


def overlap_meetings(rows: DataFrame, threshold: float) -> DataFrame:
    """``query_id, a_claim_id, b_claim_id``: every pair that can reach the overlap, most others left out.

    ``rows`` holds ``query_id, claim_id`` and the distinct words ``terms``; ``threshold`` must be above 0. Beside the prefixes,
    a pair must have lengths that allow the overlap, and enough words after the place where it meets: at the first
    word it shares, both claims have nothing in common before.
    """
    if threshold <= 0:
        raise ValueError("an overlap of 0 holds for every pair")
    placed = overlap_prefixes(rows, threshold)
    sides = [placed.select("query_id", "word", *[F.col(c).alias(f"{side}_{c}") for c in ("claim_id", "n", "place")]) for side in "ab"]
    met = sides[0].join(sides[1], ["query_id", "word"]).filter(F.col("a_claim_id") < F.col("b_claim_id"))
    lengths = F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n") - _SLACK
    left = 1 + F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    enough = left >= threshold / (1 + threshold) * (F.col("a_n") + F.col("b_n")) - _SLACK
    return met.filter(lengths & enough).select("query_id", "a_claim_id", "b_claim_id").distinct()


def _meetings(rows: DataFrame, rules: CandidateRules) -> DataFrame:
    """Distinct pairs that at least one equality rule can make a candidate."""
    keyed = rows.select("query_id", "claim_id", F.explode(_keys(rules)).alias("key"))
    left = keyed.select("query_id", "key", F.col("claim_id").alias("a_claim_id"))
    right = keyed.select("query_id", "key", F.col("claim_id").alias("b_claim_id"))
    met = left.join(right, ["query_id", "key"]).filter(F.col("a_claim_id") < F.col("b_claim_id")).select("query_id", "a_claim_id", "b_claim_id")
    if rules.lexical_overlap:
        met = met.unionByName(overlap_meetings(rows, rules.min_overlap))
    return met.distinct()


def candidate_pairs(claims: DataFrame, rules: CandidateRules | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Unordered pairs ``a_id < b_id`` per query with the reasons for each."""
    rules = rules or CandidateRules()
    rows = _features(claims)
    relevance = F.lit(0.0)
    if rules.query_relevance and queries is not None:
        terms = queries.select("query_id", T.token_set(F.col("text")).alias("_q"))
        rows, relevance = rows.join(terms, "query_id"), T.jaccard(F.col("terms"), F.col("_q"))
    rows = rows.withColumn("relevance", relevance).drop("_q")
    a = rows.select([F.col(c).alias(c if c == "query_id" else f"a_{c}") for c in rows.columns])
    b = rows.select([F.col(c).alias(c if c == "query_id" else f"b_{c}") for c in rows.columns])
    ordered = F.col("a_claim_id") < F.col("b_claim_id")
    if rules.blockable():
        met = _meetings(rows, rules)
        pairs = met.join(a, ["query_id", "a_claim_id"]).join(b, ["query_id", "b_claim_id"])
    else:
        pairs = a.join(b, "query_id").filter(ordered)

    overlap = T.jaccard(F.col("a_terms"), F.col("b_terms"))
    same_subject = (F.col("a_subject_key") != "") & (F.col("a_subject_key") == F.col("b_subject_key"))
    shared = F.size(F.array_intersect("a_names", "b_names"))
    signals = [
        (rules.brute_force, "brute_force", F.lit(True)),
        (rules.shared_entities, "shared_entities", shared >= rules.min_entities),
        (rules.lexical_overlap, "lexical_overlap", overlap >= rules.min_overlap),
        (rules.same_subject, "subject_predicate", same_subject),
        (rules.known_times, "temporal_overlap", F.col("a_asserted_at").isNotNull() & F.col("b_asserted_at").isNotNull()),
        (
            rules.query_relevance and queries is not None,
            "query_relevance",
            (F.col("a_relevance") >= rules.min_relevance) & (F.col("b_relevance") >= rules.min_relevance),
        ),
        (rules.other_source, "source_diversity", F.col("a_source_id") != F.col("b_source_id")),
        (rules.same_polarity, "claim_type", F.col("a_negation") == F.col("b_negation")),
    ]
    active = signals[:1] if rules.brute_force else [s for s in signals if s[0]]
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for _, name, test in active]))
    found = pairs.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    found = found.withColumnRenamed("a_claim_id", "a_id").withColumnRenamed("b_claim_id", "b_id")
    if rules.max_pairs is not None:
        order = [F.desc(F.size("reasons")), F.asc("a_id"), F.asc("b_id")]
        found = top_per_key(found, ["query_id"], order, rules.max_pairs, "_r").drop("_r")
    return found


def candidate_stats(claims: DataFrame, pairs: DataFrame, all_pairs: DataFrame | None = None) -> DataFrame:
    """Possible, kept, pruned and budget-truncated pairs per query."""
    n = F.col("num_claims")
    sizes = claims.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_claims"))
    kept = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("generated_pairs"))
    found = (all_pairs if all_pairs is not None else pairs).groupBy("query_id").agg(F.count(F.lit(1)).alias("_found"))
    joined = sizes.join(kept, "query_id", "left").join(found, "query_id", "left").na.fill(0)
    possible = (n * (n - 1) / 2).cast("bigint")
    return joined.select(
        "query_id",
        "num_claims",
        possible.alias("possible_pairs"),
        "generated_pairs",
        (possible - F.col("_found")).alias("pruned_pairs"),
        (F.col("_found") - F.col("generated_pairs")).alias("budget_truncated"),
    )


Classifier = Callable[[DataFrame], DataFrame]
"""Adds e_ab, e_ba, c_ab, c_ba, n_ab and n_ba to candidate pairs."""


def lexical_classifier(min_overlap: float = 0.2) -> Classifier:
    """Content overlap decides the strength, negation parity the direction."""

    def classify(pairs: DataFrame) -> DataFrame:
        cues = F.array(*[F.lit(w) for w in V.NEGATION_WORDS])

        def content(side: str) -> Column:
            return F.array_except(F.col(f"{side}_terms"), cues)

        def negated(side: str) -> Column:
            return F.col(f"{side}_negation") | F.arrays_overlap(F.col(f"{side}_terms"), cues)

        scored = pairs.withColumn("overlap", T.jaccard(content("a"), content("b")))
        enough = F.col("overlap") >= min_overlap
        opposed = negated("a") != negated("b")
        value = F.round("overlap", 6)
        entail = F.when(enough & ~opposed, value).otherwise(F.lit(0.0))
        contra = F.when(enough & opposed, value).otherwise(F.lit(0.0))
        neutral = F.when(enough, F.round(1 - F.col("overlap"), 6)).otherwise(F.lit(1.0))
        for column, expr in (("e", entail), ("c", contra), ("n", neutral)):
            scored = scored.withColumn(f"{column}_ab", expr).withColumn(f"{column}_ba", expr)
        return scored

    return classify


def gated(base: Classifier, threshold: float = 0.5) -> Classifier:
    """Turn contradictions without a shared entity or subject into neutral."""

    def classify(pairs: DataFrame) -> DataFrame:
        scored = base(pairs)
        same = (F.col("a_subject_key") != "") & (F.col("a_subject_key") == F.col("b_subject_key"))
        aligned = F.arrays_overlap("a_names", "b_names") | same
        for way in ("ab", "ba"):
            demote = (F.col(f"c_{way}") >= threshold) & ~aligned
            scored = scored.withColumn(
                f"n_{way}",
                F.when(demote, F.round(F.col(f"n_{way}") + F.col(f"c_{way}"), 6)).otherwise(F.col(f"n_{way}")),
            ).withColumn(f"c_{way}", F.when(demote, F.lit(0.0)).otherwise(F.col(f"c_{way}")))
        return scored

    return classify


def table_classifier(labels: DataFrame, probabilities: dict[str, tuple[float, float, float]]) -> Classifier:
    """Look pairs up in ``labels(query_id, a_id, b_id, relation)``; others are neutral."""

    def classify(pairs: DataFrame) -> DataFrame:
        scored = pairs.join(labels, ["query_id", "a_id", "b_id"], "left")
        for i, column in enumerate("ecn"):
            expr = F.lit(1.0 if column == "n" else 0.0)
            for name, values in probabilities.items():
                expr = F.when(F.col("relation") == name, F.lit(values[i])).otherwise(expr)
            scored = scored.withColumn(f"{column}_ab", expr).withColumn(f"{column}_ba", expr)
        return scored.drop("relation")

    return classify


def decide_relations(
    scored: DataFrame, entail: float = 0.5, contradict: float = 0.5, duplicate: float = 0.8
) -> DataFrame:
    """Directional decision: duplicate, then support, then contradiction."""
    weakest, best = F.least("e_ab", "e_ba"), F.greatest("e_ab", "e_ba")
    relation = (
        F.when(weakest >= duplicate, "duplicate")
        .when(best >= entail, "supports")
        .when(F.greatest("c_ab", "c_ba") >= contradict, "contradicts")
        .otherwise("neutral")
    )
    first = F.when(relation == "supports", F.col("e_ab") >= F.col("e_ba"))
    return scored.withColumn("relation", relation).withColumn("source_first", first)


def simple_relations(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One undirected relation per pair by token overlap and negation words."""
    cues = F.array(*[F.lit(w) for w in V.SIMPLE_NEGATIONS])
    a, b = F.col("a_terms"), F.col("b_terms")
    overlap = T.jaccard(a, b)
    content = T.jaccard(F.array_except(a, cues), F.array_except(b, cues))
    opposed = F.arrays_overlap(a, cues) != F.arrays_overlap(b, cues)
    same = F.array_sort(a) == F.array_sort(b)
    kind = (
        F.when(same, "duplicate")
        .when(opposed & (content >= threshold), "contradiction")
        .when(overlap >= threshold, "support")
    )
    confidence = F.when(same, 0.99).when(kind == "contradiction", 0.7).otherwise(F.round(overlap, 6))
    return pairs.withColumn("relation_type", kind).withColumn("relation_confidence", confidence).filter(
        F.col("relation_type").isNotNull()
    )


def validate_label_mapping(cases: DataFrame) -> DataFrame:
    """Check that the strongest of three scores has the expected label."""
    scores = F.array(
        F.struct(F.col("entailment").alias("p"), F.lit("entailment").alias("label")),
        F.struct(F.col("contradiction").alias("p"), F.lit("contradiction").alias("label")),
        F.struct(F.col("neutral").alias("p"), F.lit("neutral").alias("label")),
    )
    return cases.withColumn("predicted", F.array_max(scores)["label"]).withColumn(
        "valid", F.col("predicted") == F.col("expected")
    )
