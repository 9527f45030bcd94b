import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom import scale
from factloom.operators import chunking, retrieval
from factloom.operators.chunking import _pack


def passages(spark, rows):
    return spark.createDataFrame(rows, "passage_id string, text string")


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def ranked(df, key="passage_id"):
    return [(r[key], r.score) for r in df.orderBy("query_id", "rank").collect()]


CORPUS = [("p1", "red fox runs"), ("p2", "red red dog"), ("p3", "blue whale"), ("p4", "fox fox fox jumps over")]


def brute_bm25(corpus, text):
    docs = {p: t.split() for p, t in corpus}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for p, words in docs.items():
        score = 0.0
        for term in set(text.split()):
            tf, df = words.count(term), sum(term in w for w in docs.values())
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
        if score > 0:
            out[p] = round(score, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_bm25_matches_the_formula_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "within_rows", lambda df: limit > 0)
    found = ranked(retrieval.bm25_top_k(passages(spark, CORPUS), queries(spark, "red fox"), 3))
    assert found == brute_bm25(CORPUS, "red fox")[:3]


def test_bm25_edges(spark):
    corpus = passages(spark, CORPUS)
    assert ranked(retrieval.bm25_top_k(corpus, queries(spark, "?!"), 3)) == []
    assert ranked(retrieval.bm25_top_k(corpus, queries(spark, "fox"), 0)) == []
    with pytest.raises(ValueError):
        retrieval.bm25_top_k(corpus, queries(spark, "fox"), -1)


def test_bm25_within_uses_each_querys_own_corpus(spark):
    rows = spark.createDataFrame(
        [("q0", p, t) for p, t in CORPUS] + [("q1", "p9", "red fox"), ("q1", "p8", "dog")],
        "query_id string, passage_id string, text string",
    )
    found = retrieval.bm25_within(rows, queries(spark, "red fox", "red fox"), 5)
    assert ranked(found.filter("query_id = 'q0'")) == brute_bm25(CORPUS, "red fox")
    assert ranked(found.filter("query_id = 'q1'")) == brute_bm25([("p9", "red fox"), ("p8", "dog")], "red fox")


def test_lexical_fills_up_with_unmatched_ids(spark):
    found = ranked(retrieval.lexical_top_k(passages(spark, CORPUS), queries(spark, "blue"), 3))
    assert found == [("p3", 0.5), ("p1", 0.0), ("p2", 0.0)]


@pytest.mark.parametrize("block", [4096, 1])
def test_cosine_blocks_agree(spark, block):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0])], "passage_id string, embedding array<double>")
    asked = spark.createDataFrame([("q0", [2.0, 0.0]), ("q1", [0.0, 1.0])], "query_id string, embedding array<double>")
    found = retrieval.cosine_top_k(corpus, asked, 2, block_rows=block)
    assert ranked(found) == [("a", 1.0), ("b", 0.707107), ("b", 0.707107), ("a", 0.0)]


def test_fusion(spark):
    make = lambda rows: spark.createDataFrame([("q", *r) for r in rows], "query_id string, passage_id string, score double, rank int")
    parts = {"sparse": make([("p1", 5.0, 0), ("p2", 3.0, 1)]), "dense": make([("p2", 0.9, 0), ("p3", 0.8, 1)])}
    rrf = ranked(retrieval.fuse_reciprocal(parts, {"sparse": 1, "dense": 1}, 5))
    assert rrf[0] == ("p2", round(0.5 / 61 + 0.5 / 62, 8)) and {p for p, _ in rrf} == {"p1", "p2", "p3"}
    assert ranked(retrieval.fuse_weighted(parts, {"sparse": 3, "dense": 1}, 1)) == [("p1", 0.75)]
    for bad in ({"sparse": -1, "dense": 2}, {"sparse": 0}, {"other": 1}):
        with pytest.raises(ValueError):
            retrieval.fuse_weighted(parts, bad, 5)


def test_rerank_puts_missing_scores_last(spark):
    hits = spark.createDataFrame([("q", "b", None, 0), ("q", "a", None, 1), ("q", "c", 0.1, 2)], "query_id string, passage_id string, score double, rank int")
    assert [p for p, _ in ranked(retrieval.rerank_by_score(hits, 5))] == ["c", "a", "b"]


def slow_pack(spans, size, overlap):
    """Plain transcription of the packing rule, for comparison."""
    out, i = [], 0
    while i < len(spans):
        j = i
        while j + 1 < len(spans) and spans[j + 1][1] - spans[i][0] <= size:
            j += 1
        out.append((spans[i][0], spans[j][1]))
        if j + 1 >= len(spans):
            break
        nxt = j + 1
        if overlap:
            while nxt - 1 > i and spans[j][1] - spans[nxt - 1][0] <= overlap:
                nxt -= 1
        i = max(nxt, i + 1)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 30)), min_size=1, max_size=30), st.integers(1, 64), st.data())
def test_packing_matches_the_rule(parts, size, data):
    import numpy as np

    overlap = data.draw(st.integers(0, size - 1))
    leads, bodies = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    lengths = leads + bodies
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) + leads
    spans = list(zip(starts.tolist(), (starts + bodies).tolist(), strict=True))
    got = [(s["start"], s["end"]) for s in _pack(leads, bodies, lengths, size, overlap)]
    assert got == slow_pack(spans, size, overlap)


def test_chunks_reproduce_the_text(spark):
    texts = ["One here. Two there! Three? Four.", "no terminator here", "   ", "A. " * 50]
    docs = spark.createDataFrame([(f"d{i}", t, "s") for i, t in enumerate(texts)], "document_id string, text string, source_id string")
    rows = chunking.sentence_chunks(docs, 20, 8).collect()
    for r in rows:
        assert texts[int(r.document_id[1:])].strip()[r.span_start : r.span_end] == r.text
    assert len({r.passage_id for r in rows}) == len(rows)
    with pytest.raises(ValueError):
        chunking.sentence_chunks(docs, 5, 5)
    assert chunking.whole_documents(docs).filter(F.col("document_id") == "d1").first().text == texts[1]


def test_bm25_shuffles_no_pairs_and_counts_repeated_ids_as_the_scores_do(spark):
    rows = [*CORPUS, ("p1", "red fox runs"), ("p2", "red"), (None, "red fox"), ("p9", None), ("p8", ""), ("p0", "blue whale")]
    corpus, asked = passages(spark, rows), queries(spark, "red fox", "whale?", "fox red red", "none")
    found = retrieval.bm25_top_k(corpus, asked, 3)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    scores = retrieval.bm25_scores(corpus, asked)
    want = {}
    for r in sorted(scores.collect(), key=lambda r: (-r["score"], r["passage_id"] is not None, r["passage_id"])):
        want.setdefault(r["query_id"], []).append((r["passage_id"], r["score"]))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["passage_id"], r["score"]))
    assert got == {q: v[:3] for q, v in want.items()} and [p for p, _ in got["q1"]] == ["p0", "p3"]


def test_chunks_skip_texts_that_are_missing(spark):
    docs = spark.createDataFrame([("1", None, "a"), ("2", "", "b"), ("3", "One. Two!", None)], "document_id string, text string, source_id string")
    rows = chunking.sentence_chunks(docs, 5, 0).orderBy("passage_id").collect()
    assert [(r["passage_id"], r["span_start"], r["span_end"], r["text"]) for r in rows] == [("2::p0", 0, 0, ""), ("3::p0", 0, 4, "One."), ("3::p1", 5, 9, "Two!")]


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_many_query_terms_take_the_search_and_only_more_take_the_join(spark, monkeypatch, limit):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(retrieval, "SEARCH_TERMS", limit)
    joined, scores = [], retrieval.bm25_scores
    monkeypatch.setattr(retrieval, "within_rows", lambda df: False)
    monkeypatch.setattr(retrieval, "bm25_scores", lambda *a, **k: joined.append(1) or scores(*a, **k))
    asked = spark.createDataFrame([("a", "red fox"), (None, "blue"), ("a", "red"), ("b", "?!")], "query_id string, text string")
    found = [(r.query_id, r.passage_id, r["rank"]) for r in retrieval.bm25_top_k(passages(spark, CORPUS), asked, 2).orderBy("query_id", "rank").collect()]
    assert found == [(None, "p3", 0), ("a", "p1", 0), ("a", "p2", 1)]
    assert bool(joined) == (limit == 0)


def test_a_task_returns_only_passages_among_its_best_so_far():
    texts = pa.array([[{"length": 2, "words": [0, 1]}], [{"length": 2, "words": [0]}], [{"length": 2, "words": [0, 1]}]], pa.list_(pa.struct([("length", pa.int32()), ("words", pa.list_(pa.int32()))])))
    met = np.zeros((1, 1))
    batch = pa.RecordBatch.from_pydict({"passage_id": pa.array(["b", "c", "a"]), "texts": texts})
    weigh, starts, words = (np.array([1.0, 2.0]), 2.0), np.array([0, 2]), np.array([0, 1])
    first = retrieval._best(batch, weigh, starts, words, met, retrieval.K1, retrieval.B)
    assert first[1].tolist() == [2] and met[0, 0] == first[2][0] == 3.0
    assert len(retrieval._best(batch.slice(1, 1), weigh, starts, words, met, retrieval.K1, retrieval.B)[1]) == 0
    # a tie may still win by its id
    assert retrieval._best(batch.slice(0, 1), weigh, starts, words, met, retrieval.K1, retrieval.B)[2].tolist() == [3.0]


def _zipf_texts(rng, n, longest):
    return [" ".join(f"w{w}" for w in np.minimum(rng.zipf(1.3, rng.integers(1, longest)), 3000)) for _ in range(n)]


def test_search_meets_few_passages_and_loses_none():
    rng = np.random.default_rng(5)
    found = [[int(w[1:]) for w in t.split()] for t in _zipf_texts(rng, 3000, 60)]
    found += found[:500]  # ties
    kind = pa.list_(pa.struct([("length", pa.int32()), ("words", pa.list_(pa.int32()))]))
    batch = pa.RecordBatch.from_pydict({"passage_id": pa.array([f"p{i * 7 % 3500:04}" for i in range(3500)]), "texts": pa.array([[{"length": len(w), "words": w}] for w in found], kind)})
    df = np.bincount([w for t in found for w in set(t)], minlength=3001)
    weigh = np.where(df > 0, np.log(1 + (3500 - df + 0.5) / (df + 0.5)), 0), float(np.mean([len(t) for t in found]))
    asked = [sorted({int(w[1:]) for w in t.split()}) for t in _zipf_texts(rng, 60, 40)]
    starts, words = np.concatenate(([0], np.cumsum([len(t) for t in asked]))), np.array([w for t in asked for w in t], "int32")
    place, part, bounds = retrieval._index(batch, weigh, retrieval.K1, retrieval.B)
    full = np.zeros((60, 3500))
    for query, terms in enumerate(asked):
        for w in terms:
            full[query, place[bounds[w] : bounds[w + 1]] % 3500] += part[bounds[w] : bounds[w + 1]]
    ids = batch["passage_id"].to_pylist()
    want = [sorted(((-round(s, 6), ids[i]) for i, s in enumerate(row) if round(s, 6) > 0))[:4] for row in full]

    met, got = np.zeros((60, 4)), [[] for _ in asked]
    for at in range(0, 3500, 1000):
        block = batch.slice(at, 1000)
        for query, row, score in zip(*retrieval._best(block, weigh, starts, words, met, retrieval.K1, retrieval.B)):
            got[query].append((-score, block["passage_id"][row].as_py()))
    assert [[(round(s, 6), i) for s, i in sorted(rows)[:4]] for rows in got] == want
    met = np.repeat(np.array([-w[3][0] if len(w) > 3 else 0.0 for w in want])[:, None], 4, axis=1)
    pairs = retrieval._candidates(place, part, bounds, 3500, starts, retrieval._by_rarity(weigh[0], starts, words), met)[0]
    assert len(pairs) < (full > 0).sum() / 20


def test_rows_that_are_scored_reach_the_floor_also_for_queries_of_many_frequent_words(monkeypatch):
    rng = np.random.default_rng(8)
    found = [rng.choice(700, rng.integers(1, 400), replace=False).tolist() for _ in range(600)]
    kind = pa.list_(pa.struct([("length", pa.int32()), ("words", pa.list_(pa.int32()))]))
    batch = pa.RecordBatch.from_pydict({"passage_id": pa.array([f"p{i}" for i in range(600)]), "texts": pa.array([[{"length": len(w), "words": w}] for w in found], kind)})
    df = np.bincount([w for t in found for w in t], minlength=700)
    weigh = np.log(1 + (600 - df + 0.5) / (df + 0.5)), float(np.mean([len(t) for t in found]))
    asked = [np.arange(700), *[np.sort(rng.choice(700, 30, replace=False)) for _ in range(20)]]
    starts, words = np.concatenate(([0], np.cumsum([len(t) for t in asked]))), np.concatenate(asked).astype("int32")
    place, part, bounds = retrieval._index(batch, weigh, retrieval.K1, retrieval.B)
    full = np.array([np.bincount(place[np.isin(place // 600, t)] % 600, part[np.isin(place // 600, t)], 600) for t in asked])
    met = np.sort(full, axis=1)[:, -4:]
    for values in (retrieval.TABLE_VALUES, 100 * 600, 0):  # all, some and no words by row
        monkeypatch.setattr(retrieval, "TABLE_VALUES", values)
        query, row = retrieval._candidates(place, part, bounds, 600, starts, retrieval._by_rarity(weigh[0], starts, words), met)
        assert {(q, r) for q, r in zip(*np.nonzero(full >= met[:, :1]))} <= set(zip(query, row))
        # sums are rounded up to units of some 0.01 for each term
        assert (full[query, row] > met[query, 0] - 0.02 * np.diff(starts)[query]).all()


def test_search_of_many_queries_equals_the_scores(spark):
    rng = np.random.default_rng(6)
    rows = [(f"p{i % 380}", t) for i, t in enumerate(_zipf_texts(rng, 400, 50))]  # some ids repeat
    corpus, asked = passages(spark, rows), queries(spark, *_zipf_texts(rng, 80, 30))
    want = {}
    for r in sorted(retrieval.bm25_scores(corpus, asked).collect(), key=lambda r: (-r["score"], r["passage_id"])):
        want.setdefault(r["query_id"], []).append((r["passage_id"], r["score"]))
    got = {}
    for r in retrieval.bm25_top_k(corpus, asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["passage_id"], r["score"]))
    assert got == {q: v[:3] for q, v in want.items()}
