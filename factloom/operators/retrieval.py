"""Ranking passages for many queries at once.

Inputs are ``passages(passage_id, text, ...)`` and ``queries(query_id, text)``;
results are ``(query_id, passage_id, score, rank)`` with a 0-based rank ordered by
score, then id. Scores are rounded before ranking so that ties are real ties.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import scale
from factloom.functions import fixed_values as V
from factloom.functions import text as T
from factloom.functions.vectors import hashed_embedding
from factloom.session import cut_lineage
from factloom.scale import lookup_join, top_per_key, within_rows

K1, B = 1.5, 0.75


def _ordered(score: str = "score", key: str = "passage_id") -> list:
    return [F.desc(score), F.asc(key)]


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(T.token_set(F.col("text"))).alias("term"))


def term_frequencies(passages: DataFrame, vocabulary: DataFrame, *, bounded: bool) -> DataFrame:
    """passage_id, length, term, tf of the vocabulary's terms; the empty term stands for the passage itself.

    One pass over the text. Tokens outside the vocabulary are dropped beside the scan and the others counted per task, so
    the shuffle holds a row for each passage and vocabulary term that meet.
    """
    rows = passages.select("passage_id", T.tokens(F.col("text")).alias("_t")).select(
        "passage_id", F.size("_t").alias("length"),
        # the outer form keeps Spark from tokenizing again for a "not empty" filter
        F.explode_outer(F.concat(F.array(F.lit("")), "_t")).alias("term"),
    )
    corpus = vocabulary.sparkSession.createDataFrame([("",)], "term string")
    wanted = vocabulary.select("term").union(corpus).distinct()
    kept = lookup_join(rows, wanted, ["term"], "left_semi", small_is_bounded=bounded, salt_by=F.col("passage_id"))
    return kept.groupBy("passage_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_scores(passages: DataFrame, queries: DataFrame, *, k1: float = K1, b: float = B) -> DataFrame:
    """Okapi BM25 of every passage that shares a term with a query.

    The term frequencies are written once; corpus statistics and scores both come from that table. Its rows are dealt
    by passage, so scores are summed where a passage's terms are and (query, passage) pairs are not shuffled again.
    """
    terms = query_terms(queries)
    bounded = within_rows(terms)
    frequencies = cut_lineage(term_frequencies(passages, terms.select("term").distinct(), bounded=bounded), "frequencies")
    # one row per vocabulary term, read three times below
    statistics = frequencies.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("total_length"))
    statistics = cut_lineage(statistics, "terms")
    corpus = statistics.filter(F.col("term") == "")
    n = corpus.select(F.col("df").cast("double")).scalar()
    mean_length = corpus.select(F.col("total_length") / F.col("df")).scalar()
    df = F.col("df")
    weights = (
        terms.join(statistics, "term")
        .withColumn("n", n)
        .withColumn("mean_length", mean_length)
        .select("query_id", "term", "mean_length", F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)).alias("idf"))
    )
    counts = frequencies.filter(F.col("term") != "").repartition("passage_id")
    matched = lookup_join(counts, weights, ["term"], small_is_bounded=bounded, salt_by=F.col("passage_id"))
    ratio = F.when(F.col("mean_length") > 0, F.col("length") / F.col("mean_length")).otherwise(F.lit(0.0))
    penalty = F.when(F.col("mean_length") > 0, k1 * (1 - b + b * ratio)).otherwise(F.lit(k1))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + penalty)
    return (
        matched.groupBy("query_id", "passage_id")
        .agg(F.round(F.sum(part), 6).alias("score"))
        .filter(F.col("score") > 0)
    )


def bm25_within(passages: DataFrame, queries: DataFrame, k: int, *, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 where every query has its own small corpus (``passages.query_id``).

    Corpus statistics are per query, so every join carries the query id.
    """
    counted = passages.select("query_id", "passage_id", T.tokens(F.col("text")).alias("_t"))
    corpora = counted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_t")).alias("mean_length"))
    tf = (
        counted.select("query_id", "passage_id", F.size("_t").alias("length"), F.explode("_t").alias("term"))
        .join(query_terms(queries), ["query_id", "term"])
        .groupBy("query_id", "passage_id", "length", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(df, ["query_id", "term"]).join(corpora, "query_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    penalty = F.when(
        F.col("mean_length") > 0, k1 * (1 - b + b * F.col("length") / F.col("mean_length"))
    ).otherwise(F.lit(k1))
    scored = rows.groupBy("query_id", "passage_id").agg(
        F.round(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + penalty)), 6).alias("score")
    )
    return top_per_key(scored.filter(F.col("score") > 0), ["query_id"], _ordered(), k, "rank")


#: Query terms that every task of a search may hold, as numbers. Beyond, terms and passages meet by the join of ``bm25_scores``.
SEARCH_TERMS = 4_000_000
#: Passages whose postings a task holds at once.
BLOCK_PASSAGES = 32_768
#: Postings of a query's rarest terms that are scored first, for a floor under its best scores.
FLOOR_POSTINGS = 128
#: Pairs of a query's term and a passage that are looked up at once.
PAIRS_AT_ONCE = 1_000_000
#: A word in more than one of so many rows of a batch is read from a table by row, of so many values at most.
TABLE_SHARE, TABLE_VALUES = 48, 16_000_000
#: Scores that round alike differ by less.
SLACK = 2e-6


def bm25_top_k(passages: DataFrame, queries: DataFrame, k: int, *, k1: float = K1, b: float = B) -> DataFrame:
    """The best ``k`` passages of each query by ``bm25_scores``.

    While the terms of all queries fit a task, every block of passages is scored as one small inverted index, so no
    (query, passage) pairs are shuffled. The passages of a query's rarest terms are scored first: their k-th best score is a
    floor. Queries whose terms cannot lift a passage of a block to their floor are left out there (the most a term adds is known), and
    only passages that sums of upper bounds leave above it are scored exactly. This loses no passage. A task returns a
    passage only if it is among the best ``k`` it has met so far.
    """
    if k < 0:
        raise ValueError(f"top_k must be >= 0, got {k}")
    terms = query_terms(queries)
    if not scale.within_rows(terms, SEARCH_TERMS):
        return top_per_key(bm25_scores(passages, queries, k1=k1, b=b), ["query_id"], _ordered(), k, "rank")
    query_ids, vocabulary, starts, words = _numbered_terms(terms)
    counted = cut_lineage(_vocabulary_words(passages, vocabulary), "counted")
    weigh, texts = _idf(counted, len(vocabulary))
    rare = _by_rarity(weigh[0], starts, words)
    floors = _floors(counted, weigh, texts, starts, words, rare, k, k1, b)
    id_type, query_type = passages.schema["passage_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.repeat(floors[:, None], k, axis=1)  # the best scores of each query, from the lowest on
        for block in _blocks(batches):
            asked, rows, scores = _best(block, weigh, starts, words, met, k1, b, rare)
            columns = {"query_id": query_ids.take(pa.array(asked, "int64")), "passage_id": block["passage_id"].take(pa.array(rows, "int64")), "score": pa.array(scores, "float64")}
            yield pa.RecordBatch.from_pydict(columns)

    hits = counted.mapInArrow(search, f"query_id {query_type}, passage_id {id_type}, score double")
    return top_per_key(hits, ["query_id"], _ordered(), k, "rank")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to blocks of at most ``BLOCK_PASSAGES`` rows, larger batches as they are."""
    held, rows = [], 0
    for batch in batches:
        if held and rows + batch.num_rows > BLOCK_PASSAGES:
            yield pa.concat_batches(held)
            held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.concat_batches(held)


def _numbered_terms(terms: DataFrame) -> tuple[pa.Array, dict[str, int], np.ndarray, np.ndarray]:
    """The query ids, the number of every term in sorted order, and the terms of the queries as numbers: those of query i from ``starts[i]`` on, sorted."""
    rows = terms.toArrow()
    asked = pc.dictionary_encode(rows["query_id"], null_encoding="encode").combine_chunks()
    found = pc.dictionary_encode(rows["term"]).combine_chunks()
    if isinstance(asked, pa.ChunkedArray):  # no rows, no chunks
        return pa.array([], rows.schema.field("query_id").type), {}, np.zeros(1, "int64"), np.empty(0, "int32")
    vocabulary = {term: i for i, term in enumerate(sorted(found.dictionary.to_pylist()))}
    numbers = np.array([vocabulary[t] for t in found.dictionary.to_pylist()], "int32")
    query, words = asked.indices.to_numpy(), numbers[found.indices.to_numpy()]
    order = np.lexsort((words, query))
    return asked.dictionary, vocabulary, np.searchsorted(query[order], np.arange(len(asked.dictionary) + 1)), words[order]


def _vocabulary_words(passages: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """passage_id and, for each of its texts, the number of tokens and the numbers of those in the vocabulary, with repeats.

    Rows come in the order of their length: what a word can add to a score depends on it, so its most in a block is seldom far off.
    """
    rows = passages.filter(F.col("text").isNotNull()).select("passage_id", F.lower("text").alias("text"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(V.TOKEN)
        for batch in batches:
            found = [token.findall(t) for t in batch["text"].to_pylist()]
            words = [[n for n in map(vocabulary.get, tokens) if n is not None] for tokens in found]
            columns = {"passage_id": batch["passage_id"], "length": pa.array([len(t) for t in found], "int32"), "words": pa.array(words, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"passage_id {passages.schema['passage_id'].dataType.simpleString()}, length int, words array<int>"
    whole = rows.mapInArrow(look_up, schema).groupBy("passage_id")
    found = whole.agg(F.collect_list(F.struct("length", "words")).alias("texts"), F.max("length").alias("span"))
    return found.repartitionByRange("span", F.xxhash64("passage_id")).sortWithinPartitions("span").drop("span")


def _postings(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, ...]:
    """Passage and length of every text, and text, word and frequency of every posting; texts of one passage with equal lengths count as one."""
    texts = batch["texts"]
    passage = np.repeat(np.arange(len(texts)), texts.value_lengths().to_numpy(zero_copy_only=False))
    flat = texts.flatten()
    length, found = flat.field("length").to_numpy(zero_copy_only=False).astype("int64"), flat.field("words")
    span = int(length.max(initial=0)) + 1
    places, text = np.unique(passage * span + length, return_inverse=True)
    of_word = np.repeat(text, found.value_lengths().to_numpy(zero_copy_only=False))
    pairs, tf = np.unique(of_word * words + found.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    return places // span, places % span, pairs // max(words, 1), pairs % max(words, 1), tf


def _idf(counted: DataFrame, words: int) -> tuple[tuple[np.ndarray, float], int]:
    """The inverse document frequency of every word of the vocabulary, the mean length of texts, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, length, _, word, _ = _postings(batch, words)
            df = np.bincount(word, minlength=words)
            seen = np.flatnonzero(df)
            # the word -1 stands for the corpus
            columns = {"word": pa.array([-1, *seen], "int32"), "df": pa.array([len(length), *df[seen]], "int64"), "length": pa.array([int(length.sum()), *[0] * len(seen)], "int64")}
            yield pa.RecordBatch.from_pydict(columns)

    rows = counted.mapInArrow(count, "word int, df bigint, length bigint").groupBy("word").agg(F.sum("df"), F.sum("length")).collect()
    n, total = next(((df, length) for word, df, length in rows if word < 0), (0, 0))
    idf = np.zeros(words)
    for word, df, _ in rows:
        if word >= 0:
            idf[word] = math.log(1 + (n - df + 0.5) / (df + 0.5))
    return (idf, total / n if n else 0.0), n


def _by_rarity(idf: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The terms of every query from the rarest on."""
    query = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return words[np.lexsort((-idf[words], query))] if len(words) else words


def _index(batch: pa.RecordBatch, weigh: tuple[np.ndarray, float], k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings of a batch by word, then row, as word * rows + row, what each adds to a score, and where those of a word begin."""
    idf, mean = weigh
    passage, length, text, word, tf = _postings(batch, len(idf))
    penalty = k1 * (1 - b + b * length / mean) if mean > 0 else np.full(len(length), k1)
    part = idf[word] * tf * (k1 + 1) / (tf + penalty[text])
    place = word * batch.num_rows + passage[text]
    order = np.argsort(place, kind="stable")
    place, part = place[order], part[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))  # the texts of a passage add up
    if len(first) < len(place):
        place, part = place[first], np.add.reduceat(part, first)
    counts = np.bincount(place // max(batch.num_rows, 1), minlength=len(idf))
    return place, part, np.concatenate(([0], np.cumsum(counts)))


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all spans one after the other: ``counts[i]`` of them from ``starts[i]`` on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _pieces(counts: np.ndarray) -> Iterator[slice]:
    """Runs of rows whose counts add up to some ``PAIRS_AT_ONCE``, or of one row."""
    group = (np.cumsum(counts) - counts) // PAIRS_AT_ONCE
    edges = np.concatenate((np.flatnonzero(np.diff(group, prepend=-1)), [len(counts)]))
    return (slice(start, end) for start, end in zip(edges, edges[1:]))


def _scores(place: np.ndarray, part: np.ndarray, n: int, starts: np.ndarray, words: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The scores of pairs of a query and one of ``n`` rows, summed in the order of the words."""
    counts, scores = starts[query + 1] - starts[query], [np.empty(0)]
    for piece in _pieces(counts):
        own = counts[piece]
        pair = np.repeat(np.arange(len(own)), own)
        wanted = words[_spans(starts[query[piece]], own)].astype("int64") * n + row[piece][pair]
        at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
        hit = place[at] == wanted
        scores.append(np.bincount(pair[hit], part[at[hit]], len(own)))
    return np.round(np.concatenate(scores), 6)


def _keep(met: np.ndarray, query: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which pairs, sorted by query and from the best score on, are among the best of their query in the batch; ``met`` takes their scores."""
    k = met.shape[1]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    asked, at = np.unique(query[nth < k], return_inverse=True)
    own = np.zeros((len(asked), k))
    own[at, nth[nth < k]] = score[nth < k]
    met[asked] = np.sort(np.concatenate((met[asked], own), axis=1), axis=1)[:, -k:]
    return nth < k


def _floors(counted: DataFrame, weigh: tuple[np.ndarray, float], texts: int, starts: np.ndarray, words: np.ndarray, rare: np.ndarray, k: int, k1: float, b: float) -> np.ndarray:
    """A score for each query that ``k`` of its passages reach, or 0: the k-th best among some passages of its rarest terms."""
    queries, idf = len(starts) - 1, weigh[0]
    if not (queries and k and texts):
        return np.zeros(queries)
    df = np.where(idf > 0, np.rint((texts + 1) / np.exp(idf) - 0.5), 0).astype("int64")
    before = np.concatenate(([0], np.cumsum(df[rare])))
    reach = np.minimum(np.searchsorted(before, before[starts[:-1]] + FLOOR_POSTINGS), starts[1:])
    chosen = np.concatenate(([0], np.cumsum(reach - starts[:-1])))
    term, asker = rare[_spans(starts[:-1], np.diff(chosen))], np.repeat(np.arange(queries), np.diff(chosen))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((queries, k))
        for block in _blocks(batches):
            n = block.num_rows
            place, part, bounds = _index(block, weigh, k1, b)
            counts = np.minimum(bounds[term + 1] - bounds[term], math.ceil(FLOOR_POSTINGS * n / texts) + 1)
            read = np.concatenate(([0], np.cumsum(counts)))
            # a query stays in one piece, so that no passage counts twice
            for piece in _pieces(np.diff(read[chosen])):
                terms = slice(chosen[piece.start], chosen[piece.stop])
                row = place[_spans(bounds[term[terms]], counts[terms])] % n
                pairs = np.unique(np.repeat(asker[terms], counts[terms]) * n + row)
                if len(pairs):
                    query, row = pairs // n, pairs % n
                    score = _scores(place, part, n, starts, words, query, row)
                    order = np.lexsort((-score, query))
                    _keep(met, query[order], score[order])
        query, nth = np.nonzero(met)
        yield pa.RecordBatch.from_pydict({"query": pa.array(query, "int64"), "score": pa.array(met[query, nth], "float64")})

    found = top_per_key(counted.mapInArrow(sample, "query bigint, score double"), ["query"], [F.desc("score")], k, "rank")
    rows = found.filter(F.col("rank") == k - 1).select("query", "score").toArrow()
    floors = np.zeros(queries)
    floors[rows["query"].to_numpy()] = rows["score"].to_numpy()
    return floors


def _best(
    batch: pa.RecordBatch, weigh: tuple[np.ndarray, float], starts: np.ndarray, words: np.ndarray, met: np.ndarray, k1: float, b: float, rare: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Query, row in the batch and score of the rows of one batch among the best of a query so far; ``met`` takes their scores."""
    n, k = batch.num_rows, met.shape[1]
    place, part, bounds = _index(batch, weigh, k1, b)
    if not (k and len(place) and len(met)):
        return np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
    rare = _by_rarity(weigh[0], starts, words) if rare is None else rare
    query, row = _candidates(place, part, bounds, n, starts, rare, met)
    score = _scores(place, part, n, starts, words, query, row)
    kept = (score > 0) & (score >= met[query, 0])
    query, row, score = query[kept], row[kept], score[kept]
    rank = np.empty(n, "int64")
    rank[pc.array_sort_indices(batch["passage_id"], null_placement="at_start").to_numpy()] = np.arange(n)
    order = np.lexsort((rank[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    kept = _keep(met, query, score)
    return query[kept], row[kept], score[kept]


def _by_row(rows: np.ndarray, part: np.ndarray, bounds: np.ndarray, n: int, asked: np.ndarray, most: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """A line for each frequent word: what it adds to every row of a batch, rounded up to whole units. Returns the line of every word, or -1, the table and the unit.

    ``query`` has the query of each of the terms ``asked``; in units, the lines of a query add up to 16 bits at most.
    """
    counts = np.diff(bounds)
    frequent = np.argsort(-counts, kind="stable")[: TABLE_VALUES // max(n, 1)]
    frequent = frequent[counts[frequent] * TABLE_SHARE > n]
    line, table = np.full(len(counts), -1), np.zeros((len(frequent), n), "uint16")
    line[frequent] = np.arange(len(frequent))
    tabled = line[asked] >= 0
    unit = float(np.bincount(query[tabled], most[asked[tabled]]).max(initial=0)) / (2**16 - 2 - len(frequent)) or 1.0
    for values, word in zip(table, frequent):
        own = slice(bounds[word], bounds[word + 1])
        values[rows[own]] = np.ceil(part[own] / unit)
    return line, table, unit


def _candidates(place: np.ndarray, part: np.ndarray, bounds: np.ndarray, n: int, starts: np.ndarray, rare: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a row that may be among the best of the query; no other row of the batch is.

    A query is left out if the most its terms add in this batch does not reach its floor. Otherwise its frequent terms are
    added line by line from a table of small whole numbers, the others from their postings; rows whose sum, at least their score, stays
    below the floor are dropped.
    """
    k, rows, queries = met.shape[1], place % n, len(starts) - 1
    most, present = np.zeros(len(bounds) - 1), np.flatnonzero(np.diff(bounds))
    most[present] = np.maximum.reduceat(part, bounds[present])
    query = np.repeat(np.arange(queries), np.diff(starts))
    floors, total = met[:, 0] - SLACK, np.bincount(query, most[rare], queries)
    line, table, unit = _by_row(rows, part, bounds, n, rare, most, query)
    begin, close, lines = bounds[rare], bounds[rare + 1], line[rare]
    asked, found = [np.empty(0, "int64")], [np.empty(0, "int64")]
    for query in np.flatnonzero((total > floors) & (total > 0)):
        terms, floor = slice(int(starts[query]), int(starts[query + 1])), max(float(floors[query]), 0.0)
        tabled, own, score = [], [], np.zeros(n)
        for x, y, i in zip(begin[terms].tolist(), close[terms].tolist(), lines[terms].tolist()):
            if i >= 0:
                tabled.append(i)
            elif x < y:
                own.append(slice(x, y))
        if own:
            score = np.bincount(np.concatenate([rows[s] for s in own]), np.concatenate([part[s] for s in own]), n)
        if tabled:
            units = table[tabled[0]].copy()
            for i in tabled[1:]:
                np.add(units, table[i], out=units)
            score += units * unit
        alive = np.flatnonzero(score > floor)
        if len(alive) > 2 * k:
            # the best of these rows stay as good, so they raise the floor
            reached = score[alive]
            best = np.partition(reached, len(reached) - k)[len(reached) - k]
            alive = alive[reached > best - len(tabled) * unit - SLACK]
        asked.append(np.full(len(alive), query))
        found.append(alive)
    return np.concatenate(asked), np.concatenate(found)


def lexical_top_k(passages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rank by token-set overlap; passages without overlap fill up by id."""
    terms = query_terms(queries)
    bounded = within_rows(terms)
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_q"))
    wanted = terms.join(sizes, "query_id")
    own = T.token_set(F.col("text"))
    rows = passages.select("passage_id", own.alias("_t")).select("passage_id", F.size("_t").alias("_p"), F.explode_outer("_t").alias("term"))
    # only terms of queries are dealt by passage
    known = terms.select("term").distinct()
    rows = lookup_join(rows, known, ["term"], "left_semi", small_is_bounded=bounded, salt_by=F.col("passage_id")).repartition("passage_id")
    shared = (
        lookup_join(rows, wanted, ["term"], small_is_bounded=bounded, salt_by=F.col("passage_id"))
        .groupBy("query_id", "passage_id", "_p", "_q")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    scored = shared.select(
        "query_id", "passage_id", F.round(T.overlap_ratio(F.col("_n"), F.col("_p"), F.col("_q")), 6).alias("score")
    )
    # k matches at most hide k of the first 2k ids, so those always suffice
    first = passages.select("passage_id").orderBy("passage_id").limit(2 * k)
    fill = queries.select("query_id").withColumn(
        "passage_id", F.explode(first.agg(F.collect_list("passage_id").alias("ids")).scalar())
    )
    best = cut_lineage(top_per_key(scored, ["query_id"], _ordered(), k, "rank").drop("rank"), "best")
    rest = fill.join(best, ["query_id", "passage_id"], "left_anti").withColumn("score", F.lit(0.0))
    # a filler may itself match below the top k; its true score decides nothing then
    return top_per_key(best.unionByName(rest), ["query_id"], _ordered(), k, "rank")


#: Query blocks, of ``block_rows`` rows each, that may be broadcast.
BROADCAST_BLOCKS = 8


def cosine_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    id_column: str = "passage_id",
    vector_column: str = "embedding",
    block_rows: int = 4096,
) -> DataFrame:
    """Exact cosine search: one matrix product per Arrow batch of the corpus and block of queries.

    Query blocks are packed into rows on the executors and joined with packed batches of the corpus, which is read
    once. A product returns its best ``k`` rows per query, so neither all pairs nor whole query groups are
    shuffled. Up to ``BROADCAST_BLOCKS`` blocks are broadcast, more meet the batches by a join on the block.
    """
    total = queries.count()
    if total == 0 or k == 0:
        return _no_hits(corpus, queries, id_column)
    blocks = math.ceil(total / block_rows)
    id_type, query_type = corpus.schema[id_column].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", vector_column, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))

    def pack_queries(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("query_id")
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "query_ids": [rows["query_id"].tolist()], "asked": [_packed(rows[vector_column])]})

    def pack_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                batch = batch.sort_values(id_column, kind="stable")
                yield pd.DataFrame({"ids": [batch[id_column].tolist()], "vectors": [_packed(batch[vector_column])]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vectors, query_ids, matrix in zip(batch["ids"], batch["vectors"], batch["query_ids"], batch["asked"], strict=True):
                yield _nearest(ids, vectors, query_ids, matrix, k, id_column)

    packed = asked.groupBy("block").applyInPandas(pack_queries, f"block bigint, query_ids array<{query_type}>, asked binary")
    packed = packed if blocks > BROADCAST_BLOCKS else F.broadcast(packed)
    parts = corpus.select(id_column, vector_column).mapInPandas(pack_batches, f"ids array<{id_type}>, vectors binary")
    parts = parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    joined = parts.join(packed, "block").select("ids", "vectors", "query_ids", "asked")
    hits = joined.mapInPandas(search, f"query_id {query_type}, {id_column} {id_type}, score double")
    return top_per_key(hits, ["query_id"], _ordered(key=id_column), k, "rank")


def _packed(vectors: pd.Series) -> bytes:
    """Rows of unit length, the row length in front."""
    matrix = np.array([np.asarray(v, dtype="float64") for v in vectors])
    return np.int64(matrix.shape[1]).tobytes() + _unit_rows(matrix).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "float64", offset=8).reshape(-1, int(np.frombuffer(data, "int64", 1)[0]))


def _nearest(ids, vectors: bytes, query_ids, asked: bytes, k: int, id_column: str) -> pd.DataFrame:
    """The best ``k`` rows of one batch, sorted by id, for every query of one block."""
    rows, matrix = _unpacked(vectors), _unpacked(asked)
    if rows.shape[1] != matrix.shape[1]:
        raise ValueError("vectors differ in length")
    scores = np.round(matrix @ rows.T, 6) + 0.0
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        query, row = np.nonzero(scores >= least[:, None])
    else:
        query, row = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((row, -scores[query, row], query))
    query, row = query[order], row[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    query, row = query[kept], row[kept]
    return pd.DataFrame({"query_id": np.asarray(query_ids)[query], id_column: np.asarray(ids)[row], "score": scores[query, row]})


def _no_hits(corpus: DataFrame, queries: DataFrame, id_column: str) -> DataFrame:
    empty = corpus.select(id_column).limit(0)
    return queries.select("query_id").limit(0).join(empty, F.lit(True)).select(
        "query_id", id_column, F.lit(0.0).alias("score"), F.lit(0).alias("rank")
    )


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def hashed_dense_top_k(passages: DataFrame, queries: DataFrame, k: int, dim: int = 8) -> DataFrame:
    """Dense retrieval over hashed bag-of-token vectors."""
    embed = hashed_embedding(F.col("text"), dim).alias("embedding")
    return cosine_top_k(passages.select("passage_id", embed), queries.select("query_id", embed), k)


def min_max(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Scale scores to [0, 1] per key; equal scores all become 1.

    ``hits`` is a ranked list cut to its top k, so the bounds are a small table.
    """
    bounds = hits.groupBy(*keys).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span > 0, (F.col("score") - F.col("_low")) / span).otherwise(F.lit(1.0))
    return hits.join(bounds, keys).withColumn("normalized", scaled).drop("_low", "_high")


def _weights(weights: Mapping[str, float], names: list[str]) -> dict[str, float]:
    unknown = set(weights) - set(names)
    if unknown or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError(f"bad fusion weights {dict(weights)} for components {names}")
    total = sum(weights.values())
    return {name: weights.get(name, 0.0) / total for name in names}


def _tagged(components: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    share = _weights(weights, list(components))
    tagged = None
    for name, hits in components.items():
        rows = hits.withColumn("component", F.lit(name)).withColumn("weight", F.lit(share[name]))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged


def fuse_weighted(components: Mapping[str, DataFrame], weights: Mapping[str, float], k: int) -> DataFrame:
    """Weighted sum of min-max scores over component lists; missing counts 0."""
    rows = min_max(_tagged(components, weights), ["query_id", "component"])
    fused = rows.groupBy("query_id", "passage_id").agg(
        F.round(F.sum(F.col("weight") * F.col("normalized")), 6).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "score")))).alias("components"),
    )
    return top_per_key(fused, ["query_id"], _ordered(), k, "rank")


def fuse_reciprocal(components: Mapping[str, DataFrame], weights: Mapping[str, float], k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of w / (rrf_k + rank + 1), ranks from 0."""
    rows = _tagged(components, weights)
    part = F.col("weight") / (F.lit(rrf_k) + F.col("rank") + 1)
    fused = rows.groupBy("query_id", "passage_id").agg(
        F.round(F.sum(part), 8).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "score")))).alias("components"),
    )
    return top_per_key(fused, ["query_id"], _ordered(), k, "rank")


def rerank_by_score(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Reorder by an existing score; rows without one go last, by id."""
    order = [F.col(score).desc_nulls_last(), F.asc("passage_id")]
    return top_per_key(hits.drop("rank"), ["query_id"], order, k, "rank")


def rerank_lexical(hits: DataFrame, passages: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Retrieve-then-rerank: reorder hits by token overlap with the query."""
    texts = hits.join(passages.select("passage_id", F.col("text").alias("_p")), "passage_id").join(
        queries.select("query_id", F.col("text").alias("_q")), "query_id"
    )
    overlap = T.jaccard(T.token_set(F.col("_p")), T.token_set(F.col("_q")))
    rescored = texts.withColumn("rerank_score", F.round(overlap, 6)).drop("_p", "_q", "rank")
    return top_per_key(rescored, ["query_id"], _ordered("rerank_score"), n, "rank")


def rerank_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with their texts, reordered by token overlap with the query; ``rank`` and ``score`` are replaced."""
    asked = queries.select("query_id", F.col("text").alias("_q"))
    overlap = F.round(T.jaccard(T.token_set(F.col("text")), T.token_set(F.col("_q"))), 6)
    rows = hits.join(asked, "query_id").withColumn("score", overlap).drop("_q", "rank")
    w = Window.partitionBy("query_id").orderBy(*_ordered())
    return rows.withColumn("rank", F.row_number().over(w) - 1)
