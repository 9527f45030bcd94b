"""SQL fragments that state each operator's result for another engine.

Every fragment is a list of common table expressions; ``chain`` joins fragments in
order and appends the final SELECT. Nothing here is used to compute results.
"""

from __future__ import annotations

from factloom.functions import fixed_values as V

WORD_CHARS = r"\p{L}\p{N}_"


def chain(*parts: str, final: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(p.strip() for p in parts) + "\n" + final.strip()


def listing(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def lead(x: str) -> str:
    return rf"(length({x}) - length(regexp_replace({x}, '^\s+', '')))"


def collapsed(x: str) -> str:
    return trimmed(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def casefolded(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def token_set(x: str) -> str:
    return f"list_distinct({tokens(x)})"


def word_count(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def ascii_view(x: str) -> str:
    """Letters outside ASCII become an underscore, which is a word character."""
    return rf"regexp_replace({x}, '[^\x00-\x7F]', '_', 'g')"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) - {shared} > 0 THEN {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) ELSE 0.0 END)"


def phrases(x: str, leading: list[str]) -> str:
    found = rf"regexp_extract_all({ascii_view(x)}, '\b[A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*)*\b')"
    drop = rf"^(?:(?i:{'|'.join(leading)})(?:\s+|$))+"
    return f"list_transform({found}, lambda p: {collapsed(f'regexp_replace(p, {chr(39)}{drop}{chr(39)}, {chr(39)}{chr(39)})')})"


def named_entities(x: str) -> str:
    kept = f"list_filter({phrases(x, V.NON_ENTITY_WORDS)}, lambda e: e <> '' AND NOT list_contains({listing(V.MONTHS)}, e))"
    return ordered_distinct(kept)


def bridge_entities(x: str) -> str:
    banned = listing(["", *V.BRIDGE_GENERIC_WORDS, *V.BRIDGE_STOP_WORDS])
    return f"list_sort(list_distinct(list_filter({phrases(x, V.BRIDGE_STOP_WORDS)}, lambda e: NOT list_contains({banned}, lower(e)))))"


def negated(x: str) -> str:
    return rf"regexp_matches({ascii_view(x)}, '(?i)\b(?:{'|'.join(V.NEGATION_WORDS)})\b|n''t')"


def modality(x: str) -> str:
    return ordered_distinct(rf"regexp_extract_all({ascii_view(x)}, '(?i)\b(?:{'|'.join(V.MODALITY_WORDS)})\b')")


def dates(x: str) -> str:
    pattern = (
        rf"(?i)\b(?:{'|'.join(V.MONTHS)})\s+\d{{1,2}}(?:,\s*\d{{4}})?\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b(?:19|20)\d{{2}}\b"
    )
    return ordered_distinct(f"regexp_extract_all({ascii_view(x)}, '{pattern}')")


def quantities(x: str) -> str:
    pattern = (
        r"(?i)\$\d[\d,]*(?:\.\d+)?(?:\s?(?:million|billion|thousand))?|\b\d[\d,]*\.\d+\b"
        r"|\b\d[\d,]*\s?(?:%|percent|million|billion|thousand|kg|km|miles|dollars)\b|\b\d[\d,]*%"
    )
    return ordered_distinct(f"regexp_extract_all({ascii_view(x)}, '{pattern}')")


def attribution(x: str) -> str:
    first = rf"regexp_extract({x}, '(?i)according to ([A-Z][{WORD_CHARS}.\-]*)', 1)"
    second = (
        rf"regexp_extract({x}, '(?:^|[^{WORD_CHARS}])([A-Z][{WORD_CHARS}.\-]*)\s+(?:{'|'.join(V.ATTRIBUTION_VERBS)})\b', 1)"
    )
    return f"coalesce(nullif({first}, ''), nullif({second}, ''))"


def answer_words(x: str) -> str:
    bare = r"""regexp_replace(lower({x}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g')""".format(x=x)
    return rf"list_filter(regexp_extract_all({bare}, '\S+'), lambda w: NOT list_contains(['a', 'an', 'the'], w))"


def short_hash(prefix: str, *parts: str) -> str:
    return f"'{prefix}-' || left(sha256({' || chr(0) || '.join(parts)}), 16)"


DOCS = f"docs AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, {trimmed('text')} AS text, source AS source_id FROM documents)"
QUERIES = "queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark)"
WHOLE = "passages AS (SELECT document_id || '::p0' AS passage_id, document_id, source_id, text FROM docs)"

CHUNK_SENTENCES = rf"""
pieces AS (
  SELECT document_id, source_id, text, unnest(p) AS piece, unnest(range(len(p))) AS i
  FROM (SELECT *, regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+\z') AS p FROM docs)
),
placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY document_id ORDER BY i) - length(piece) AS pos FROM pieces
),
sentences AS (
  SELECT document_id, source_id, text, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS k,
         pos + {lead('piece')} AS s, pos + {lead('piece')} + length({trimmed('piece')}) AS e
  FROM placed WHERE {trimmed('piece')} <> ''
)
"""


def chunks(size: int = 512, overlap: int = 64) -> str:
    return f"""
counted AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM sentences),
reach AS MATERIALIZED (
  SELECT a.document_id, a.k, any_value(a.s) AS s, any_value(a.n) AS n, max(b.k) AS j, max(b.e) AS e
  FROM counted a JOIN counted b ON a.document_id = b.document_id AND (b.k = a.k OR (b.k > a.k AND b.e - a.s <= {size}))
  GROUP BY a.document_id, a.k
),
hop AS MATERIALIZED (
  SELECT r.document_id, r.k, any_value(r.s) AS s, any_value(r.e) AS e,
         CASE WHEN any_value(r.j) + 1 < any_value(r.n)
              THEN greatest(r.k + 1, least(count(b.k), any_value(r.j) + 1)) END AS nxt
  FROM reach r LEFT JOIN counted b ON r.document_id = b.document_id AND b.s < r.e - {overlap}
  GROUP BY r.document_id, r.k
),
walk AS (
  SELECT document_id, k, 0 AS i, s, e, nxt FROM hop WHERE k = 0
  UNION ALL
  SELECT h.document_id, h.k, w.i + 1, h.s, h.e, h.nxt FROM walk w JOIN hop h ON w.document_id = h.document_id AND w.nxt = h.k
),
passages AS MATERIALIZED (
  SELECT w.document_id || '::p' || w.i AS passage_id, w.document_id, d.source_id, w.s AS span_start, w.e AS span_end,
         substring(d.text, CAST(w.s AS BIGINT) + 1, CAST(w.e - w.s AS BIGINT)) AS text
  FROM walk w JOIN docs d USING (document_id)
)
"""


def bm25(k: int) -> str:
    return f"""
tok AS MATERIALIZED (SELECT passage_id, len(t) AS dl, unnest(t) AS term FROM (SELECT passage_id, {tokens('text')} AS t FROM passages)),
lengths AS (SELECT count(*) AS n, avg(len({tokens('text')})) AS avgdl FROM passages),
tf AS MATERIALIZED (SELECT passage_id, dl, term, count(*) AS tf FROM tok GROUP BY ALL),
qt AS (SELECT query_id, unnest({token_set('text')}) AS term FROM queries),
idf AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25_scores AS (
  SELECT query_id, passage_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term), lengths
  GROUP BY query_id, passage_id
),
bm25_hits AS MATERIALIZED (
  SELECT query_id, passage_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) - 1 AS rank FROM bm25_scores WHERE score > 0
  ) WHERE rank < {k}
)
"""


def hashed(table: str, key: str, dim: int = 8) -> str:
    """``{table}_vec(key, v)``: hashed token counts, L2-normalised to six places."""
    bucket = f"('0x' || left(sha256(t), 16))::UBIGINT % {dim}"
    return f"""
{table}_counts AS (
  SELECT {key}, list_transform(range({dim}), lambda d: len(list_filter(b, lambda x: x = d))::DOUBLE) AS c
  FROM (SELECT {key}, list_transform({tokens('text')}, lambda t: {bucket}) AS b FROM {table})
),
{table}_vec AS MATERIALIZED (
  SELECT {key}, list_transform(c, lambda x: round(x / (CASE WHEN nn > 0 THEN nn ELSE 1 END), 6)) AS v
  FROM (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS nn FROM {table}_counts)
)
"""


def dense(k: int) -> str:
    return f"""
dense_scores AS (
  SELECT q.query_id, p.passage_id,
         CASE WHEN list_sum(q.v) > 0 AND list_sum(p.v) > 0 THEN round(list_cosine_similarity(q.v, p.v), 6) ELSE 0.0 END AS score
  FROM queries_vec q, passages_vec p
),
dense_hits AS MATERIALIZED (
  SELECT query_id, passage_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) - 1 AS rank FROM dense_scores
  ) WHERE rank < {k}
)
"""


HITS = "hits AS MATERIALIZED (SELECT h.query_id, h.score, h.rank, p.* FROM bm25_hits h JOIN passages p USING (passage_id))"


def claims(source: str = "hits", key: str = "query_id, ") -> str:
    """``claims`` from a passage table that has ``key``, passage_id and text."""
    return rf"""
claim_pieces AS (
  SELECT {key}passage_id, source_id, span_start, unnest(p) AS piece, unnest(range(len(p))) AS i
  FROM (SELECT *, string_split(regexp_replace(text, '([.!?]+)(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM {source})
),
claim_placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY {key}passage_id ORDER BY i) - length(piece) + {lead('piece')} AS pos,
         {trimmed('piece')} AS sentence
  FROM claim_pieces
),
clause_pieces AS (
  SELECT {key}passage_id, source_id, span_start, pos, sentence, i, p,
         list_transform(p, lambda x: regexp_replace(x, '\s+and\s+$', '')) AS parts
  FROM (SELECT *, string_split(regexp_replace(sentence, '(\s+and\s+)', '\1' || chr(1), 'g'), chr(1)) AS p
        FROM claim_placed WHERE sentence <> '' AND NOT contains(sentence, '?'))
),
clause_split AS (
  SELECT *, len(list_filter(parts, lambda x: {word_count('x')} < 3)) = 0 AS split FROM clause_pieces
),
clauses AS (
  SELECT {key}passage_id, source_id, span_start, i, unnest(CASE WHEN split THEN range(len(parts)) ELSE [0::BIGINT] END) AS c,
         pos, sentence, split, p, parts FROM clause_split
),
clause_text AS (
  SELECT {key}passage_id, source_id, span_start,
         pos + CASE WHEN split THEN coalesce(list_sum(list_transform(p[1:c], lambda x: length(x))), 0) ELSE 0 END AS off,
         CASE WHEN split THEN parts[c + 1] ELSE sentence END AS clause
  FROM clauses
),
described AS (
  SELECT *, {collapsed('clause')} AS text, {named_entities('clause')} AS entities,
         {casefolded(collapsed('clause'))} AS folded
  FROM clause_text WHERE len(regexp_extract_all(clause, '\S*\p{{L}}\S*')) >= 2
),
first_claims AS (
  SELECT *, row_number() OVER (PARTITION BY {key}passage_id, folded ORDER BY off) AS copy,
         regexp_extract(text, '^(\S+)', 1) AS first_word FROM described
),
claims AS MATERIALIZED (
  SELECT {key}{short_hash('clm', 'passage_id', 'text', 'CAST(CAST(span_start + off AS BIGINT) AS VARCHAR)')} AS claim_id,
         passage_id, source_id, text, clause, CAST(span_start + off AS BIGINT) AS span_start,
         CAST(span_start + off + length(clause) AS BIGINT) AS span_end, 0.9::DOUBLE AS extraction_confidence, entities,
         CASE WHEN list_contains({listing(V.PRONOUNS)}, lower(regexp_replace(first_word, '^[,.;:]+|[,.;:]+$', '', 'g')))
              THEN first_word ELSE entities[1] END AS subject,
         {negated('clause')} AS negation
  FROM first_claims WHERE copy = 1
)
"""


FEATURES = f"""
feats AS MATERIALIZED (
  SELECT query_id, claim_id, text, source_id, {token_set('text')} AS terms,
         list_distinct(list_transform(entities, lambda e: {casefolded('e')})) AS names,
         {casefolded("coalesce(subject, '')")} AS subject_key, negation, entities
  FROM claims
)
"""

NEG = listing(V.NEGATION_WORDS)

def pairs(overlap: float = 0.2) -> str:
    return f"""
both_pairs AS (
  SELECT a.query_id, a.claim_id AS a_id, b.claim_id AS b_id, a.text AS a_text, b.text AS b_text,
         a.terms AS a_terms, b.terms AS b_terms, a.names AS a_names, b.names AS b_names,
         a.subject_key AS a_subject, b.subject_key AS b_subject, a.negation AS a_neg, b.negation AS b_neg
  FROM feats a JOIN feats b ON a.query_id = b.query_id AND a.claim_id < b.claim_id
),
signals AS (
  SELECT *, list_has_any(a_names, b_names) AS by_entity, {jaccard('a_terms', 'b_terms')} >= {overlap} AS by_overlap,
         a_subject <> '' AND a_subject = b_subject AS by_subject FROM both_pairs
),
pairs AS MATERIALIZED (
  SELECT *, list_filter([CASE WHEN by_entity THEN 'shared_entities' END, CASE WHEN by_overlap THEN 'lexical_overlap' END,
                         CASE WHEN by_subject THEN 'subject_predicate' END], lambda x: x IS NOT NULL) AS reasons
  FROM signals WHERE by_entity OR by_overlap OR by_subject
)
"""

_CONTENT = lambda side: f"list_filter({side}_terms, lambda t: NOT list_contains({NEG}, t))"

def scored(minimum: float = 0.2) -> str:
    return f"""
overlap_rows AS (
  SELECT *, {jaccard(_CONTENT('a'), _CONTENT('b'))} AS o,
         (a_neg OR list_has_any(a_terms, {NEG})) <> (b_neg OR list_has_any(b_terms, {NEG})) AS opposed FROM pairs
),
scored AS MATERIALIZED (
  SELECT *, CASE WHEN o >= {minimum} AND NOT opposed THEN round(o, 6) ELSE 0.0 END AS entail,
         CASE WHEN o >= {minimum} AND opposed THEN round(o, 6) ELSE 0.0 END AS contra,
         CASE WHEN o >= {minimum} THEN round(1 - o, 6) ELSE 1.0 END AS neutral FROM overlap_rows
)
"""

def relations(entail: float = 0.5, contra: float = 0.5) -> str:
    return f"""
text_copies AS (
  SELECT query_id, a_id, b_id FROM both_pairs WHERE {casefolded(collapsed('a_text'))} = {casefolded(collapsed('b_text'))}
),
edge_rows AS (
  SELECT query_id, a_id AS source_claim_id, b_id AS target_claim_id, 'duplicate' AS relation_type, 1.0 AS relation_confidence FROM text_copies
  UNION ALL
  SELECT query_id, a_id, b_id, CASE WHEN entail >= 0.8 THEN 'duplicate' ELSE 'contradiction' END,
         CASE WHEN entail >= 0.8 THEN entail ELSE contra END
  FROM scored s WHERE (entail >= 0.8 OR contra >= {contra})
    AND NOT EXISTS (SELECT 1 FROM text_copies t WHERE t.query_id = s.query_id AND t.a_id = s.a_id AND t.b_id = s.b_id)
  UNION ALL
  SELECT query_id, unnest([a_id, b_id]), unnest([b_id, a_id]), 'support', entail
  FROM scored s WHERE entail >= {entail} AND entail < 0.8
    AND NOT EXISTS (SELECT 1 FROM text_copies t WHERE t.query_id = s.query_id AND t.a_id = s.a_id AND t.b_id = s.b_id)
),
relations AS MATERIALIZED (
  SELECT *, {short_hash('rel', 'relation_type', 'source_claim_id', 'target_claim_id')} AS relation_id FROM edge_rows
)
"""

PRIORS = """
priors AS (
  SELECT d.source AS source_id, round(avg(l.quality), 6) AS reliability_prior
  FROM labels l JOIN documents d USING (doc_id) GROUP BY 1
)
"""

SCORES = f"""
support_counts AS (
  SELECT r.query_id, r.target_claim_id AS claim_id, count(DISTINCT s.source_id) AS n
  FROM relations r JOIN claims s ON s.query_id = r.query_id AND s.claim_id = r.source_claim_id
  JOIN claims t ON t.query_id = r.query_id AND t.claim_id = r.target_claim_id
  WHERE r.relation_type = 'support' AND s.source_id <> t.source_id GROUP BY 1, 2
),
signals6 AS (
  SELECT c.query_id, c.claim_id, c.source_id, c.text, {jaccard(token_set('c.text'), token_set('q.text'))} AS relevance,
         greatest(0.0, least(1.0, coalesce(p.reliability_prior, 0.5))) AS reliability, coalesce(s.n, 0) AS n
  FROM claims c JOIN queries q USING (query_id) LEFT JOIN priors p USING (source_id)
  LEFT JOIN support_counts s ON s.query_id = c.query_id AND s.claim_id = c.claim_id
),
scores AS MATERIALIZED (
  SELECT query_id, claim_id, source_id, text, round(relevance, 6) AS query_relevance, reliability AS source_reliability,
         n AS provenance_diversity,
         round(round(0.5 * 0.5 / 5, 6) + round(relevance / 5, 6) + round(0.9 / 5, 6) + round(reliability / 5, 6)
               + round(0.5 / 5, 6) + round((n / (n + 1)) / 5, 6), 6) AS initial_belief,
         round((relevance + 0.5) / 2, 6) AS query_utility
  FROM signals6
)
"""


def component_cte(name: str, kind: str) -> str:
    """``{name}(query_id, claim_id, component)`` over one relation type."""
    return f"""
{name}_ends AS MATERIALIZED (
  SELECT DISTINCT query_id, source_claim_id AS a, target_claim_id AS b FROM relations WHERE {kind}
  UNION SELECT query_id, target_claim_id, source_claim_id FROM relations WHERE {kind}
),
{name}_reach AS (
  SELECT query_id, a AS claim_id, a AS reached FROM {name}_ends
  UNION
  SELECT r.query_id, r.claim_id, e.b FROM {name}_reach r JOIN {name}_ends e ON e.query_id = r.query_id AND e.a = r.reached
),
{name} AS MATERIALIZED (SELECT query_id, claim_id, min(reached) AS component FROM {name}_reach GROUP BY 1, 2)
"""


PROPAGATION = f"""
{component_cte('copy_sets', "relation_type = 'duplicate'")},
incoming AS (
  SELECT query_id, target_claim_id AS claim_id, source_claim_id AS sender, relation_confidence AS conf, 1 AS sign
  FROM relations WHERE relation_type = 'support'
  UNION ALL
  SELECT query_id, unnest([target_claim_id, source_claim_id]), unnest([source_claim_id, target_claim_id]), relation_confidence, -1
  FROM relations WHERE relation_type = 'contradiction'
),
ranked_in AS (
  SELECT i.*, row_number() OVER (PARTITION BY i.query_id, i.claim_id, sign, c.source_id ORDER BY sender) - 1 AS s,
         row_number() OVER (PARTITION BY i.query_id, i.claim_id, sign, coalesce(k.component, sender) ORDER BY sender) - 1 AS d
  FROM incoming i JOIN claims c ON c.query_id = i.query_id AND c.claim_id = i.sender
  LEFT JOIN copy_sets k ON k.query_id = i.query_id AND k.claim_id = i.sender
),
message_weights AS MATERIALIZED (
  SELECT query_id, claim_id, sender,
         CASE WHEN sign < 0 THEN -conf * pow(0.25, s) WHEN d = 0 THEN conf * pow(0.25, s) ELSE 0.0 END AS w
  FROM ranked_in
),
out_edges AS MATERIALIZED (
  SELECT query_id, claim_id AS receiver, sender, w, false AS own FROM message_weights
  UNION ALL SELECT query_id, claim_id, claim_id, 0.0, true FROM scores
),
rounds AS (
  SELECT query_id, claim_id, ln(initial_belief / (1 - initial_belief))::DOUBLE AS base, initial_belief::DOUBLE AS belief, 0 AS t, 1.0::DOUBLE AS delta
  FROM scores
  UNION ALL
  SELECT query_id, receiver, base, after, t + 1, max(abs(after - belief)) OVER (PARTITION BY query_id) AS delta
  FROM (
    SELECT *, 0.5 * belief + 0.5 / (1 + exp(-(base + net))) AS after
    FROM (
      SELECT o.query_id, o.receiver, max(CASE WHEN own THEN base END) AS base, max(CASE WHEN own THEN belief END) AS belief,
             max(t) AS t, sum(w * 2 * (belief - 0.5)) AS net
      FROM rounds r JOIN out_edges o ON o.query_id = r.query_id AND o.sender = r.claim_id
      WHERE r.delta >= 1e-4 AND r.t < 50 GROUP BY 1, 2
    )
  )
),
beliefs AS MATERIALIZED (
  SELECT query_id, claim_id, round(arg_max(belief, t), 6) AS belief, max(t) AS iterations FROM rounds GROUP BY 1, 2
)
"""

CONFLICTS = f"""
{component_cte('conflict_parts', "relation_type = 'contradiction'")},
member_rows AS MATERIALIZED (
  SELECT p.query_id, p.component, p.claim_id, b.belief, s.provenance_diversity, round(s.source_reliability, 6) AS rel, s.query_utility,
         row_number() OVER (PARTITION BY p.query_id, p.component
                            ORDER BY b.belief DESC, s.provenance_diversity DESC, round(s.source_reliability, 6) DESC, p.claim_id) AS place
  FROM conflict_parts p JOIN beliefs b ON b.query_id = p.query_id AND b.claim_id = p.claim_id
  JOIN scores s ON s.query_id = p.query_id AND s.claim_id = p.claim_id
),
conflict_sets AS MATERIALIZED (
  SELECT query_id, component, count(*) AS size, string_agg(claim_id, ',' ORDER BY claim_id) AS members,
         CASE WHEN max(query_utility) <= 0 THEN 'excluded_irrelevant'
              WHEN max(CASE WHEN place = 1 THEN belief END) < 0.15 THEN 'rejected_low_evidence'
              WHEN max(CASE WHEN place = 1 THEN belief END) - max(CASE WHEN place = 2 THEN belief END) < 0.1 THEN 'unresolved'
              ELSE 'preferred' END AS outcome,
         max(CASE WHEN place = 1 THEN claim_id END) AS top_id
  FROM member_rows GROUP BY 1, 2
)
"""

PAIRS, SCORED, RELATIONS = pairs(), scored(), relations()
EVIDENCE = [DOCS, QUERIES, CHUNK_SENTENCES, chunks(), bm25(4), HITS]
CLAIMS = [*EVIDENCE, claims()]
STRICT = [*CLAIMS, FEATURES, PAIRS, SCORED, RELATIONS]
# looser thresholds relate more claims, so every kind of edge occurs
GRAPH = [*CLAIMS, FEATURES, pairs(0.05), scored(0.05), relations(0.1, 0.05)]
SCORING = [*GRAPH, PRIORS, SCORES]
BELIEF = [*SCORING, PROPAGATION]
