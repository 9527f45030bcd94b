"""Per-row evaluation metrics as Column expressions.

Three empty-set policies exist for precision and recall; each has its own
function because results differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed_values as V
from factloom.functions import text as T


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def exact_match(prediction: Column, golds: Column) -> Column:
    return _flag(F.exists(golds, lambda g: g == prediction))


def normalized_exact_match(prediction: Column, golds: Column) -> Column:
    return _flag(
        T.let(T.normalize_answer(prediction), lambda said: F.exists(golds, lambda g: T.normalize_answer(g) == said))
    )


def f1_from_counts(common: Column, predicted: Column, gold: Column) -> Column:
    """Token F1 from counts; 1 when both sides are empty."""
    p, r = common / predicted, common / gold
    return (
        F.when((predicted == 0) & (gold == 0), F.lit(1.0))
        .when((predicted == 0) | (gold == 0) | (common == 0), F.lit(0.0))
        .otherwise(2 * p * r / (p + r))
    )


def token_f1(prediction: Column, golds: Column) -> Column:
    """Best F1 over the golds. For short answers: it scans words per word."""

    def times(words: Column, word: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == word))

    def one(said: Column, wanted: Column) -> Column:
        common = F.aggregate(
            F.array_distinct(said), F.lit(0), lambda acc, t: acc + F.least(times(said, t), times(wanted, t))
        )
        return T.let(common, lambda c: f1_from_counts(c, F.size(said), F.size(wanted)))

    best = T.let(
        T.answer_words(prediction),
        lambda said: F.array_max(F.transform(F.transform(golds, T.answer_words), lambda wanted: one(said, wanted))),
    )
    return F.coalesce(best, F.lit(0.0))


def is_empty(prediction: Column) -> Column:
    return _flag(T.strip(prediction) == "")


def citation_prf(hits: Column, predicted: Column, gold: Column) -> tuple[Column, Column]:
    """No prediction: precision 1 only without gold. No gold: recall 1."""
    p = F.when(predicted == 0, F.when(gold == 0, 1.0).otherwise(0.0)).otherwise(hits / predicted)
    r = F.when(gold == 0, F.lit(1.0)).otherwise(hits / gold)
    return p, r


def benchmark_prf(hits: Column, predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Both empty: all 1. One empty: all 0."""
    both, one = (predicted == 0) & (gold == 0), (predicted == 0) | (gold == 0)
    p = F.when(both, 1.0).when(one, 0.0).otherwise(hits / predicted)
    r = F.when(both, 1.0).when(one, 0.0).otherwise(hits / gold)
    f = F.when(both, 1.0).when(one | (hits == 0), 0.0).otherwise(2 * p * r / (p + r))
    return p, r, f


def mechanism_pr(hits: Column, predicted: Column, gold: Column) -> tuple[Column, Column]:
    """No prediction: precision 1. No gold: recall 1."""
    p = F.when(predicted == 0, F.lit(1.0)).otherwise(hits / predicted)
    r = F.when(gold == 0, F.lit(1.0)).otherwise(hits / gold)
    return p, r


def set_counts(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    a, b = F.array_distinct(predicted), F.array_distinct(gold)
    return F.size(F.array_intersect(a, b)), F.size(a), F.size(b)


def completeness(missing: Column, gold: Column) -> Column:
    return F.when(gold == 0, F.lit(1.0)).otherwise(_flag(missing == 0))


def invalid_citations(citations: Column, known: Column) -> Column:
    return F.size(F.filter(citations, lambda c: ~F.array_contains(known, c)))


def covered_words(premises: Column) -> Column:
    """All distinct words of the premises."""
    return F.array_distinct(F.flatten(F.transform(premises, T.answer_words)))


def _covered_share(hypothesis: Column, covered: Column) -> Column:
    return T.let(
        F.array_distinct(T.answer_words(hypothesis)),
        lambda wanted: F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(wanted, covered)) / F.size(wanted)
        ),
    )


def lexical_entailment(hypothesis: Column, premises: Column) -> Column:
    """Share of hypothesis words found in the premises; 1 for an empty one."""
    return _covered_share(hypothesis, covered_words(premises))


def contradiction_cue(answer: Column, premises: Column) -> Column:
    """1 when the answer negates and shares a word with the premises."""
    cues = F.array(*[F.lit(w) for w in V.CONTRADICTION_CUES])
    return _flag(
        T.let(
            T.answer_words(answer),
            lambda said: F.arrays_overlap(said, cues) & F.arrays_overlap(said, covered_words(premises)),
        )
    )


def answer_sentences(answer: Column) -> Column:
    return F.filter(F.split(F.replace(answer, F.lit("!"), F.lit(".")), r"\."), lambda s: T.strip(s) != "")


def unsupported_rate(sentences: Column, premises: Column) -> Column:
    """Share of sentences with less than half of their words covered."""

    def weak(covered: Column) -> Column:
        return F.size(F.filter(sentences, lambda s: _covered_share(s, covered) < 0.5))

    share = T.let(covered_words(premises), weak) / F.nullif(F.size(sentences), F.lit(0))
    return F.coalesce(share, F.lit(0.0))


def joint(answer_em: Column, answer_f1: Column, support_f1: Column) -> tuple[Column, Column]:
    return answer_em * _flag(support_f1 == 1.0), answer_f1 * support_f1


def label_accuracy(prediction: Column, gold: Column) -> Column:
    return _flag(F.upper(T.strip(prediction)) == F.upper(T.strip(gold)))


def fever_score(label_ok: Column, gold: Column, recovered: Column) -> Column:
    """Right label and, unless no evidence is required, one complete set."""
    free = F.upper(T.strip(gold)) == "NOT ENOUGH INFO"
    return _flag((label_ok == 1.0) & (free | recovered))


def metric_kind(name: Column) -> Column:
    return F.when(name.isin(V.DETERMINISTIC_METRICS), "deterministic").otherwise("heuristic")


def error_category(error: Column) -> Column:
    return (
        F.when(error.startswith("GenerationError: answer cites unknown claim id"), "hallucinated_citation_id")
        .when(
            error.contains("truncated or unterminated JSON") | error.contains("no valid top-level JSON"),
            "generation_truncated_or_malformed_json",
        )
        .when(error.startswith("GenerationError:"), "other_generation_error")
        .otherwise(F.concat(F.lit("other:"), F.substring_index(error, ":", 1)))
    )


def citation_id_pattern(cited: Column) -> Column:
    return (
        F.when(cited.contains("[") | cited.contains("]"), "bracket_formatting_artifact")
        .when(cited.contains("source=") | cited.contains("belief="), "evidence_metadata_leaked_as_id")
        .when(F.regexp_like(cited, F.lit("^c[0-9a-f]{16,}$")), "clm_prefix_truncated")
        .when(F.regexp_like(cited, F.lit("^[0-9a-f]{16,}$")), "hash_prefix_dropped_entirely")
        .otherwise("short_or_compound_id_mismatch")
    )
