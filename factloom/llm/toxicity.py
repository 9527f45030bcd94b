"""Toxic passages as maximal scoring segments over token log-odds.

Training compares in how many toxic and clean labelled texts a token occurs; copies, recognised by their smallest
word shingle, count once, so that a much copied text does not make its words toxic. Log-odds under an informative Dirichlet prior (the
pooled counts, scaled to ``PRIOR_SHARE`` of the tokens), are kept where they lie ``Z_LEAST`` standard deviations from
zero. Every other token costs ``STEP``, so clean text drifts downwards. One linear scan finds all maximal scoring
segments of a text; a segment of score S in n tokens is expected K n exp(-lambda S) times by chance. A text's
evidence is the sum of log(1 / expected) over its significant segments, and a logistic curve fitted on the
training texts turns it into a score.

The labelled rows may be a bounded sample (``MOST_ROWS`` of each label); sampled texts then stand for all of their label, in the
log-odds and in the curve, so the scores keep the labels' natural shares. The vocabulary are all tokens of these
rows that pass ``Z_LEAST``. Defined cases: a null or wordless text has no passages and gets the score of no evidence; without rows of
both labels every score is 0; a doc_id labelled twice counts as toxic if any label says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import wordhash as H
from factloom.llm.common import bounded_sample
from factloom.session import cut_lineage

MOST_ROWS = 20_000
PRIOR_SHARE = 0.1
Z_LEAST = 3.0
STEP = 0.05
#: Chance segments expected per text below which a segment is significant.
EXPECTED = 0.05
RESULT = "struct<score:double,passages:array<struct<start:int,end:int,evidence:double>>>"


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes
    weights: np.ndarray
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    intercept: float = -np.inf
    slope: float = 0.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for found in H.words(batch.column("text"), H.NON_ALNUM):
            row, value = H.distinct(found.row, found.hash)
            token, at = np.unique(value, return_inverse=True)
            bad = toxic[found.first + row]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(token.view(np.int64)),
                    pa.array(np.bincount(at, bad, len(token)).astype(np.int64)),
                    pa.array(np.bincount(at, ~bad, len(token)).astype(np.int64)),
                ],
                ["token", "bad", "good"],
            )


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest shingle of every text; near copies mostly share it."""
    for batch in batches:
        mark = np.zeros(batch.num_rows, np.uint64)
        for found in H.words(batch.column("text"), H.NON_ALNUM):
            row, value = H.shingles(found, 5)
            full, heads = np.unique(row, return_index=True)
            if len(full):
                mark[found.first + full] = np.minimum.reduceat(value, heads)
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("text"), pa.array(mark.view(np.int64))], ["toxic", "text", "mark"])


def segments(weights: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) in linear time; ends are exclusive."""
    total = np.concatenate([[0.0], np.cumsum(weights)])
    stack: list[list] = []  # left sum, right sum, start, end, number of the nearest earlier one that begins lower
    for k in np.flatnonzero(weights > 0).tolist():
        low, high, start = total[k], total[k + 1], k
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][0] >= low:
                at = stack[at][4]
            if at < 0 or stack[at][1] >= high:
                break
            low, start = stack[at][0], stack[at][2]
            del stack[at:]
            at = len(stack) - 1
        stack.append([low, high, start, k + 1, at])
    return [(high - low, start, end) for low, high, start, end, _ in stack]


def _rows(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[float, int, int]]]]:
    """(row, words, segments) of the rows that have a positive token; only the words near them are looked at."""
    for found in H.words(texts, H.NON_ALNUM):
        at = np.minimum(np.searchsorted(model.tokens, found.hash), max(len(model.tokens) - 1, 0))
        weights = np.full(len(found.hash), -STEP)
        if len(model.tokens):
            known = model.tokens[at] == found.hash
            weights[known] = model.weights[at[known]]
        begins = H.bounds(found.row, found.rows)
        for row in np.unique(found.row[weights > 0]).tolist():
            own = weights[begins[row] : begins[row + 1]]
            yield found.first + row, len(own), segments(own)


def _evidence(model: Model, score: float, words: int) -> float:
    """log(1 / segments of this score expected by chance)."""
    return model.rate * score - float(np.log(model.scale * words))


def _significant(model: Model, words: int, found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    least = -float(np.log(EXPECTED))
    scored = [(_evidence(model, s, words), a, b) for s, a, b in found]
    return [x for x in scored if x[0] >= least]


def _measure(model: Model):
    """Per training text: words, best segment score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.concatenate([x.counts() for x in H.words(batch.column("text"), H.NON_ALNUM)] or [np.empty(0, np.int64)])
            best = np.zeros(batch.num_rows)
            for row, _, found in _rows(model, batch.column("text")):
                best[row] = max(s for s, _, _ in found)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words), pa.array(best)], ["toxic", "words", "best"])

    return run


def _collect(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for row, words, found in _rows(model, batch.column("text")):
                total[row] = sum(x[0] for x in _significant(model, words, found))
            bins = np.minimum(np.round(total * 4), 4000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(bins)], ["toxic", "bin"])

    return run


def _positive_root(p: np.ndarray, s: np.ndarray) -> float:
    """The lambda > 0 with sum p exp(lambda s) = 1; 1 if there is none."""
    if not (s > 0).any() or float(np.dot(p, s)) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    excess = lambda x: float(np.dot(p, np.exp(np.minimum(x * s, 700.0)))) - 1
    while excess(high) < 0:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def _logistic(x: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a slightly ridged logistic curve over a histogram."""
    beta = np.zeros(2)
    features = np.stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ features, -40, 40)))
        n = bad + good
        gradient = features @ (bad - n * p) - 1e-3 * beta
        hessian = (features * (n * p * (1 - p))) @ features.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS) -> Model:
    """Fit on labelled texts: docs (doc_id, text), labels (doc_id, toxic)."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = cut_lineage(bounded_sample(known, "doc_id", "toxic", most_rows), "chosen")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    stands = {r["toxic"]: sizes[r["toxic"]] / r["count"] for r in chosen.groupBy("toxic").count().collect()}
    each_bad, each_good = stands.get(1, 1.0), stands.get(0, 1.0)
    # the sample is bounded by most_rows for each of two labels
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    marked = rows.select("toxic", "text").mapInArrow(_mark, "toxic int, text string, mark bigint")
    rows = cut_lineage(marked.groupBy("toxic", "mark").agg(F.min("text").alias("text")).drop("mark"), "labelled")

    counts = rows.mapInArrow(_count, "token bigint, bad bigint, good bigint")
    counts = cut_lineage(counts.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "tokens")
    n_bad, n_good = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not n_bad or not n_good:
        return Model(np.empty(0, np.uint64), np.empty(0))
    counts = counts.select("token", (F.col("bad") * each_bad).alias("bad"), (F.col("good") * each_good).alias("good"))
    n_bad, n_good = n_bad * each_bad, n_good * each_good
    mass = PRIOR_SHARE * (n_bad + n_good)
    prior = mass * (F.col("bad") + F.col("good")) / (n_bad + n_good)
    odds = lambda y, n: F.log((y + prior) / (n + mass - y - prior))
    weight = odds(F.col("bad"), n_bad) - odds(F.col("good"), n_good)
    # a sampled text that stands for several tells no more than one
    spread = F.sqrt(each_bad / (F.col("bad") + prior) + each_good / (F.col("good") + prior))
    scored = counts.select("token", weight.alias("weight"), (weight / spread).alias("z"), ((F.col("good") + prior) / (n_good + mass)).alias("share"))
    kept = scored.filter(F.abs("z") >= Z_LEAST).toPandas()  # tokens of the bounded sample
    token = kept["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    weights = kept["weight"].to_numpy(float)
    share = kept["share"].to_numpy(float)
    model = Model(token[order], weights[order])
    model.rate = _positive_root(np.append(share, max(1 - share.sum(), 0)), np.append(weights, -STEP))

    measured = rows.mapInArrow(_measure(model), "toxic int, words bigint, best double").filter("words > 0 AND toxic = 0")
    chance = measured.agg(F.count(F.lit(1)), F.sum(F.col("words") * F.exp(-model.rate * F.col("best")))).first()
    model.scale = float(chance[0] / chance[1]) if chance[0] and chance[1] else 1.0
    bins = rows.mapInArrow(_collect(model), "toxic int, bin bigint").groupBy("bin")
    bins = bins.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).toPandas()
    x = bins["bin"].to_numpy(float) / 4
    model.intercept, model.slope = _logistic(x, each_bad * bins["bad"].to_numpy(float), each_good * bins["good"].to_numpy(float))
    return model


def toxicity(text: Column, model: Model) -> Column:
    """A struct of the score and the significant passages, as word ranges of the whole text."""

    @F.arrow_udf(RESULT)
    def score(texts: pa.Array) -> pa.Array:
        n = len(texts)
        total, counts = np.zeros(n), np.zeros(n, np.int32)
        kept: list[tuple[float, int, int]] = []
        for row, words, found in _rows(model, texts):
            own = _significant(model, words, found)
            total[row], counts[row] = sum(x[0] for x in own), len(own)
            kept += own
        p = 1 / (1 + np.exp(np.where(np.isinf(model.intercept), np.inf, -np.clip(model.intercept + model.slope * total, -500, 500))))
        items = pa.StructArray.from_arrays(
            [pa.array([x[1] for x in kept], pa.int32()), pa.array([x[2] for x in kept], pa.int32()), pa.array([x[0] for x in kept], pa.float64())],
            ["start", "end", "evidence"],
        )
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.StructArray.from_arrays([pa.array(p), pa.ListArray.from_arrays(offsets, items)], ["score", "passages"])

    return score(text)
