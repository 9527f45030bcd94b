"""Explicit schemas and the value sets of constrained columns."""

from __future__ import annotations

QUERIES = "query_id string, text string"
DOCUMENTS = "document_id string, text string, source_id string"
SOURCES = "source_id string, title string, published_at timestamp, reliability_prior double"
PASSAGES = (
    "passage_id string, document_id string, source_id string, span_start int, span_end int, text string"
)
CLAIMS = (
    "query_id string, claim_id string, text string, source_id string, passage_id string, "
    "span_start int, span_end int, extraction_confidence double, subject string, predicate string, "
    "object string, attribution string, entities array<string>, dates array<string>, "
    "quantities array<string>, negation boolean, modality array<string>, asserted_at timestamp, "
    "valid_from timestamp, observed_at timestamp, published_at timestamp, reliability_prior double"
)
RELATIONS = (
    "query_id string, relation_id string, source_claim_id string, target_claim_id string, "
    "relation_type string, relation_confidence double, direction string, rationale string"
)
RESULTS = (
    "example_id string, variant string, seed int, answer string, citations array<string>, "
    "evidence_source_ids array<string>, metrics map<string,double>, counts map<string,int>, "
    "latency_ms double, peak_memory_kb bigint, failed boolean, error string, warnings array<string>"
)
EXAMPLES = (
    "id string, question string, claim string, "
    "documents array<struct<source_id:string,text:string,title:string>>, answers array<string>, "
    "answer string, label string, gold_source_ids array<string>, split string"
)
FEVER = (
    "id string, claim string, label string, evidence array<array<string>>, verifiable string, "
    "original_id string"
)

SUPPORT = "support"
CONTRADICTION = "contradiction"
DUPLICATE = "duplicate"
SUPERSESSION = "supersession"
BRIDGE = "bridges"
NEUTRAL = "neutral"
EVIDENTIAL = [SUPPORT, CONTRADICTION, DUPLICATE, SUPERSESSION]

CLAIM_COLUMNS = [field.strip().split(" ")[0] for field in CLAIMS.split(", ")]
RELATION_COLUMNS = [field.strip().split(" ")[0] for field in RELATIONS.split(", ")]
