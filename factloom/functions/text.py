"""Text expressions: tokens, spans, entities, normalisation, safety.

Everything here is a Column expression, so it stays in the JVM and can be fused
into the scan that feeds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed_values as V

STRINGS = "array<string>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A Column used twice inside a lambda would otherwise be computed twice.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(V.SPACES))


def casefold(text: Column) -> Column:
    """Lower case plus the one full case folding Latin text needs (ß)."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"[{V.SPACE}]+", " "))


def normalize(text: Column) -> Column:
    return casefold(collapse(text))


def words(text: Column) -> Column:
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words between whitespace, counted by the single spaces that remain."""
    gaps = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return let(collapse(text), lambda c: F.when(c == "", F.lit(0)).otherwise(gaps(c) + 1))


def lettered_word_count(text: Column) -> Column:
    """Words that contain at least one letter."""
    return word_count(F.regexp_replace(text, rf"[^\p{{L}}{V.SPACE}]+", ""))


def tokens(text: Column) -> Column:
    return _all(F.lower(text), V.TOKEN)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def overlap_ratio(shared: Column, a: Column, b: Column) -> Column:
    """Jaccard from three counts; 0 when both sets are empty."""
    union = a + b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays that hold no duplicates."""
    return overlap_ratio(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def lead(text: Column) -> Column:
    """How many whitespace characters start the text."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(V.SPACES)))


def filled_spans(pieces: Column, content) -> Column:
    """Offsets of the non-empty ``content(piece)`` of contiguous text pieces."""
    span = "array<struct<start:int,end:int,text:string>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(span).alias("spans"))

    sized = F.transform(
        pieces,
        lambda p: F.struct(F.length(p).alias("size"), lead(p).alias("lead"), content(p).alias("text")),
    )

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["pos"] + piece["lead"]
        item = F.struct(
            begin.cast("int").alias("start"),
            (begin + F.length(piece["text"])).cast("int").alias("end"),
            piece["text"].alias("text"),
        )
        spans = F.when(piece["text"] != "", F.concat(acc["spans"], F.array(item))).otherwise(acc["spans"])
        return F.struct((acc["pos"] + piece["size"]).cast("int").alias("pos"), spans.alias("spans"))

    return F.aggregate(sized, start, step, lambda acc: acc["spans"])


def chunk_sentence_pieces(text: Column) -> Column:
    """Contiguous pieces of the text, each ending at a run of terminators."""
    return _all(text, V.CHUNK_SENTENCE)


def chunk_sentences(text: Column) -> Column:
    return filled_spans(chunk_sentence_pieces(text), strip)


def claim_sentences(text: Column) -> Column:
    """Sentences that end at terminators followed by whitespace or the end."""
    return filled_spans(_all(text, V.CLAIM_SENTENCE), strip)


def clauses(sentence: Column) -> Column:
    """Split on " and " when every part keeps at least three words."""
    joins = F.regexp_like(sentence, F.lit(rf"[{V.SPACE}]and[{V.SPACE}]"))
    parts = filled_spans(_all(sentence, V.CLAUSE), lambda p: F.regexp_replace(p, V.CLAUSE_DELIMITER, ""))
    whole = F.array(
        F.struct(F.lit(0).alias("start"), F.length(sentence).alias("end"), sentence.alias("text"))
    )
    split = let(
        parts, lambda found: F.when(F.forall(found, lambda p: word_count(p["text"]) >= 3), found).otherwise(whole)
    )
    return F.when(joins, split).otherwise(whole)


def simple_sentences(text: Column) -> Column:
    """Stripped non-empty runs without terminators."""
    return F.filter(F.transform(_all(text, V.SIMPLE_SENTENCE), strip), lambda s: F.length(s) > 0)


def find_start(text: Column, part: Column) -> Column:
    """0-based offset of ``part`` or -1; an empty part is never found."""
    return F.when(F.length(part) > 0, F.instr(text, part) - 1).otherwise(F.lit(-1))


def span_matches(text: Column, start: Column, end: Column, part: Column) -> Column:
    inside = (start >= 0) & (end <= F.length(text))
    return inside & (F.substring(text, start + 1, end - start) == part)


def _phrases(text: Column, leading: Sequence[str]) -> Column:
    """Capitalised runs without their leading function words."""
    drop = rf"\A(?:(?i:{'|'.join(leading)})(?:[{V.SPACE}]++|\z))++"
    return F.transform(_all(text, V.ENTITY), lambda p: collapse(F.regexp_replace(p, drop, "")))


def _not_in(values: Sequence[str]):
    listed = F.array(*[F.lit(v) for v in values])
    return lambda c: ~F.array_contains(listed, c)


def named_entities(text: Column) -> Column:
    keep = _not_in(["", *V.MONTHS])
    return F.array_distinct(F.filter(_phrases(text, V.NON_ENTITY_WORDS), keep))


def bridge_entities(text: Column) -> Column:
    keep = _not_in(["", *V.BRIDGE_GENERIC_WORDS, *V.BRIDGE_STOP_WORDS])
    found = F.filter(_phrases(text, V.BRIDGE_STOP_WORDS), lambda p: keep(F.lower(p)))
    return F.sort_array(F.array_distinct(found))


def claim_bridge_entities(entities: Column, text: Column) -> Column:
    """A claim's own entities unless none of them is usable for a bridge."""
    keep = _not_in([*V.BRIDGE_GENERIC_WORDS, *V.BRIDGE_STOP_WORDS])
    own = F.sort_array(F.array_distinct(F.filter(entities, lambda e: keep(F.lower(e)))))
    return let(own, lambda e: F.when(F.size(e) > 0, e).otherwise(bridge_entities(text)))


def folded(values: Column) -> Column:
    return F.array_distinct(F.transform(values, casefold))


def attribution(text: Column) -> Column:
    first = F.regexp_extract(text, V.ATTRIBUTION_ACCORDING, 1)
    second = F.regexp_extract(text, V.ATTRIBUTION_VERB, 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def negated(text: Column) -> Column:
    return F.regexp_like(text, F.lit(V.NEGATION))


def modality(text: Column) -> Column:
    return F.array_distinct(_all(text, V.MODALITY))


def dates(text: Column) -> Column:
    return F.array_distinct(_all(text, V.DATE))


def quantities(text: Column) -> Column:
    return F.array_distinct(_all(text, V.QUANTITY))


def normalize_answer(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), V.ASCII_PUNCTUATION, "")
    articles = rf"{V.WORD_START}(?:{'|'.join(V.ARTICLES)}){V.WORD_END}"
    return collapse(F.regexp_replace(bare, articles, " "))


def answer_words(text: Column) -> Column:
    return words(normalize_answer(text))


def short_hash(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and 16 hex digits over the NUL-joined parts."""
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.char(F.lit(0)), part)
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(joined, 256), F.lit(16)))


def claim_id(passage_id: Column, text: Column, start: Column) -> Column:
    return short_hash("clm", passage_id, text, start.cast("string"))


def relation_id(kind: Column, source: Column, target: Column) -> Column:
    return short_hash("rel", kind, source, target)


def injection_flags(text: Column) -> dict[str, Column]:
    return {name: F.regexp_like(text, F.lit(pattern)) for name, pattern in V.INJECTION.items()}


def injection_matches(text: Column) -> Column:
    found = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in V.INJECTION.values()]
    return F.array_compact(F.array(*found))


def sanitize(text: Column) -> Column:
    """Prefix lines that could pass for framework structure."""
    return F.regexp_replace(text, V.FORGED_STRUCTURE, "| $1")


def delimit(text: Column) -> Column:
    return F.concat(F.lit(V.EVIDENCE_BEGIN + "\n"), sanitize(text), F.lit("\n" + V.EVIDENCE_END))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, V.SECRET_VALUE, V.REDACTED.replace("$", r"\$"))


def redact_map(values: Column) -> Column:
    """Hide values under secret-looking keys and secret-looking values."""
    return F.transform_values(
        values, lambda k, v: F.when(F.regexp_like(k, F.lit(V.SECRET_KEY)), F.lit(V.REDACTED)).otherwise(redact(v))
    )


def url_allowed(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return scheme.isin(V.URL_SCHEMES) & (host != "")


def character_tokens(text: Column, per_token: int = 4) -> Column:
    return F.ceil(F.length(text) / F.lit(float(per_token))).cast("int")


def prefix_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))
