"""Atomic claims from passages, with offsets into the source document.

Input passages carry ``passage_id, source_id, span_start, text`` and any further
columns (such as ``query_id``), which are kept. All claims of a passage are built
inside its row and exploded once, so extraction needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed_values as V
from factloom.functions import text as T

CONFIDENCE = 0.9
STRUCTURED_CONFIDENCE = 0.7
TIMES = ("asserted_at", "valid_from", "observed_at", "published_at")


def _clauses_of(text: Column, split: bool) -> Column:
    """All clause spans of a passage, offsets relative to the passage."""
    assertions = F.filter(T.claim_sentences(text), lambda s: ~F.contains(s["text"], F.lit("?")))

    def placed(sentence: Column) -> Column:
        return F.transform(
            T.clauses(sentence["text"]),
            lambda c: F.struct(
                (sentence["start"] + c["start"]).cast("int").alias("start"), c["text"].alias("text")
            ),
        )

    if split:
        return F.flatten(F.transform(assertions, placed))
    return F.transform(assertions, lambda s: F.struct(s["start"].alias("start"), s["text"].alias("text")))


def _first_of_each(claims: Column) -> Column:
    """Keep the first claim per case-folded text."""

    def first(found: Column) -> Column:
        return T.let(
            F.transform(found, lambda c: T.casefold(c["claim"])),
            lambda keys: F.filter(found, lambda c, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1),
        )

    return T.let(claims, first)


_PRONOUN_EDGES = r"^[,.;:]+|[,.;:]+$"


def _antecedent(clause: Column, normalized: Column) -> Column:
    """The one entity before a clause that starts with a pronoun, else NULL."""
    first = F.regexp_extract(normalized, r"^(\S+)", 1)
    is_pronoun = F.lower(F.regexp_replace(first, _PRONOUN_EDGES, "")).isin(V.PRONOUNS)
    before = T.named_entities(F.substring(F.col("text"), F.lit(1), clause["start"]))
    return T.let(before, lambda e: F.when(is_pronoun & (F.size(e) == 1), F.element_at(e, 1)))


def sentence_claims(
    passages: DataFrame,
    *,
    split_conjunctions: bool = True,
    deduplicate: bool = True,
    resolve_pronouns: bool = False,
    default_confidence: float = CONFIDENCE,
    min_confidence: float = 0.0,
    max_claims: int | None = None,
) -> DataFrame:
    """Rule-based claims: one per declarative clause with two or more words.

    Only what needs the whole passage happens before the explode; the fields of a
    claim are plain columns after it, where generated code shares common parts.
    """
    kept = F.filter(
        _clauses_of(F.col("text"), split_conjunctions), lambda c: T.lettered_word_count(c["text"]) >= 2
    )

    def placed(c: Column) -> Column:
        normalized = T.collapse(c["text"])
        resolved = F.lit(None).cast("string")
        if resolve_pronouns:
            resolved = _antecedent(c, normalized)
            normalized = F.coalesce(F.concat(resolved, F.regexp_replace(normalized, r"^\S+", "")), normalized)
        return F.struct(
            c["start"].alias("start"), c["text"].alias("clause"), normalized.alias("claim"), resolved.alias("resolved")
        )

    claims = F.transform(kept, placed)
    if deduplicate:
        claims = _first_of_each(claims)
    if default_confidence < min_confidence:
        claims = F.slice(claims, 1, 0)
    if max_claims is not None:
        claims = F.slice(claims, 1, max_claims)
    carried = [c for c in passages.columns if c not in ("text", "span_start", "span_end", "score", "rank")]
    clause, claim = F.col("_c.clause"), F.col("_c.claim")
    rows = (
        passages.select(*carried, "span_start", F.explode_outer(claims).alias("_c"))
        .filter(F.col("_c").isNotNull())
        .withColumn("span_start", (F.col("span_start") + F.col("_c.start")).cast("int"))
        .withColumn("entities", T.named_entities(clause))
        .withColumn("_first", F.regexp_extract(T.collapse(clause), r"^(\S+)", 1))
        .withColumn("_leading", F.lower(F.regexp_replace("_first", _PRONOUN_EDGES, "")))
    )
    is_pronoun = F.col("_leading").isin(V.PRONOUNS)
    resolved = F.col("_c.resolved")
    warning = F.when(
        resolved.isNotNull(),
        F.concat(F.lit("resolved pronoun '"), "_leading", F.lit("' -> '"), resolved, F.lit("'")),
    ).when(is_pronoun, F.concat(F.lit("ambiguous pronoun '"), "_leading", F.lit("' left unresolved")))
    return rows.select(
        *carried,
        T.claim_id(F.col("passage_id"), claim, F.col("span_start")).alias("claim_id"),
        claim.alias("text"),
        "span_start",
        (F.col("span_start") + F.length(clause)).cast("int").alias("span_end"),
        clause.alias("span_text"),
        F.lit(default_confidence).alias("extraction_confidence"),
        F.coalesce(
            resolved, F.when(is_pronoun, F.col("_first")).otherwise(F.try_element_at("entities", F.lit(1)))
        ).alias("subject"),
        "entities",
        T.attribution(clause).alias("attribution"),
        T.dates(clause).alias("dates"),
        T.quantities(clause).alias("quantities"),
        T.negated(clause).alias("negation"),
        T.modality(clause).alias("modality"),
        warning.alias("warning"),
        # sentences carry no predicate, object or time; other extractors fill these
        *[F.lit(None).cast("string").alias(c) for c in ("predicate", "object") if c not in carried],
        *[F.lit(None).cast("timestamp").alias(c) for c in TIMES if c not in carried],
    )


def simple_claims(passages: DataFrame) -> DataFrame:
    """One claim per terminator-free run, ids numbered within the passage."""
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[^.!?]+|[.!?]+"), F.lit(0))
    terminators = F.lit(r"^[.!?]+$")
    spans = T.filled_spans(pieces, lambda p: F.when(F.regexp_like(p, terminators), F.lit("")).otherwise(T.strip(p)))
    rows = passages.select("passage_id", "source_id", "span_start", F.posexplode_outer(spans).alias("_i", "_s"))
    rows = rows.filter(F.col("_s").isNotNull())
    return rows.select(
        F.concat("passage_id", F.lit("#c"), F.col("_i").cast("string")).alias("claim_id"),
        "passage_id",
        "source_id",
        F.col("_s.text").alias("text"),
        (F.col("span_start") + F.col("_s.start")).cast("int").alias("span_start"),
        (F.col("span_start") + F.col("_s.end")).cast("int").alias("span_end"),
        F.lit(0.9).alias("extraction_confidence"),
    )


def passage_claims(hits: DataFrame) -> DataFrame:
    """Treat each retrieved passage as one fully trusted claim."""
    return hits.withColumn("claim_id", F.col("passage_id")).withColumn("extraction_confidence", F.lit(1.0))


STRUCTURED_OUTPUT = (
    "claims array<struct<claim_text:string,source_span_text:string,subject:string,predicate:string,"
    "object:string,attribution:string,named_entities:array<string>,temporal_expressions:array<string>,"
    "quantities:array<string>,negation:boolean,modality:array<string>,confidence:double>>"
)


def structured_claims(outputs: DataFrame, *, min_confidence: float = 0.0) -> DataFrame:
    """Claims from model output, each marked as grounded in its passage or not.

    ``outputs`` holds ``passage_id, source_id, span_start, text, raw``. Output that
    is not valid JSON is kept as one row with ``parsed`` false.
    """
    parsed = outputs.withColumn("_o", F.from_json("raw", STRUCTURED_OUTPUT, {"mode": "PERMISSIVE"}))
    valid = F.col("_o.claims").isNotNull()
    rows = parsed.select(
        "passage_id", "source_id", "span_start", "text", valid.alias("parsed"), F.explode_outer("_o.claims").alias("_c")
    )
    claim = T.collapse(F.col("_c.claim_text"))
    at = T.find_start(F.col("text"), F.col("_c.source_span_text"))
    start = (F.col("span_start") + at).cast("int")
    grounded = F.coalesce(at >= 0, F.lit(False))
    confidence = F.coalesce(F.col("_c.confidence"), F.lit(STRUCTURED_CONFIDENCE))
    return rows.filter(~F.col("parsed") | (confidence >= min_confidence)).select(
        "passage_id",
        "source_id",
        "parsed",
        grounded.alias("grounded"),
        F.when(grounded, T.claim_id(F.col("passage_id"), claim, start)).alias("claim_id"),
        claim.alias("text"),
        F.when(grounded, start).alias("span_start"),
        F.when(grounded, (start + F.length("_c.source_span_text")).cast("int")).alias("span_end"),
        confidence.alias("extraction_confidence"),
    )


def extraction_prompt(template: str, passage: Column, query: Column | None = None) -> Column:
    """Fill ``{query_section}`` and ``{passage}`` of a prompt template."""
    section = (
        F.concat(F.lit("## Query context\nThe user query is: "), query, F.lit("\n")) if query is not None else F.lit("")
    )
    return F.replace(F.replace(F.lit(template), F.lit("{query_section}"), section), F.lit("{passage}"), passage)


def first_per_source(claims: DataFrame, order: list[str]) -> DataFrame:
    """Keep the first claim per source and case-folded text over a whole table.

    The first row is an aggregate, so copies are combined before the shuffle and
    a text repeated in most rows costs no more than any other.
    """
    key = F.sha2(T.normalize(F.col("text")), 256).alias("_key")
    payload = F.struct(*[c for c in claims.columns if c != "source_id"])
    best = claims.select("source_id", key, F.struct(*order).alias("_order"), payload.alias("_row")).groupBy(
        "source_id", "_key"
    ).agg(F.min_by("_row", "_order").alias("_row"), F.count(F.lit(1)).alias("copies"))
    return best.select("source_id", "copies", "_row.*")
