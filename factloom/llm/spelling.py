"""Spelling variants by a bidirectional FM-index with search schemes.

Two words are near if one inserted, deleted or replaced letter turns one into the other. A word is cut into halves; at most
one of them holds the error, so two searches find every near word: one matches the left half with the delimiter before it
exactly and extends to the right with one error, the other matches the right half with the delimiter after it and
extends to the left. A word that both would find counts for the first.

The index is the Burrows-Wheeler transform of the delimited vocabulary in both directions, kept as wavelet matrices.
A search holds an interval of suffix ranks per direction and keeps both in step; as words are in order, the interval of
a whole delimited word is its number. All searches of a task move in step, one letter at a time, in NumPy.

The vocabulary is cut by ranges into shards of about ``SHARD_WORDS`` words, once by its words and once by the reversed words. A
half is a range of such an order, so a word is only sought in the one or few shards that its half lies in. A shard that is
asked by many words is indexed several times, each for a part of them.

Defined cases: null and letterless texts have no words; repeated rows count as often as they occur; null keys hash as
an empty text; ties go to the word first in code-point order; an empty vocabulary gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scale import numbered
from factloom.session import cut_lineage, release

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DAMAGE = 31
LEAST_LETTERS, LEAST_COUNT, LEAST_RATIO = 7, 2, 10
SHARD_WORDS = 20_000
ASKED = 60_000
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
#: Letters are numbered from 1 in code-point order; the delimiter is 0.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
LEVELS = len(LETTERS).bit_length()
_NUMBER = np.zeros(256, np.uint8)
_NUMBER[LETTERS] = np.arange(1, len(LETTERS) + 1)


def damaged(run: str, key: str) -> str:
    """A lower-cased run, without one letter where a hash of the key and the run says so."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def passed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            for run, n in Counter(RUN.findall(text.translate(_LOWER))).items():
                if len(run) >= LEAST_LETTERS:
                    word = damaged(run, key)
                    if len(word) >= LEAST_LETTERS:
                        held[word] += n
            if len(held) > HELD:
                yield passed()
    if held:
        yield passed()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of the damaged words of ``docs`` with enough letters and occurrences."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    counts = rows.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


class Ranks:
    """A wavelet matrix: counts of symbols in prefixes of a sequence, for many queries at once."""

    def __init__(self, symbols: np.ndarray):
        self.zeros, self.ones = [], []
        for level in range(LEVELS - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = symbols[np.argsort(bit, kind="stable")]

    def within(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of the symbol before ``low`` and before ``high``, and smaller symbols between them."""
        start, smaller = np.zeros_like(low), np.zeros_like(low)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (LEVELS - 1 - level)) & 1).astype(bool)
            a, b, s = ones[low], ones[high], ones[start]
            smaller = smaller + np.where(bit, (high - low) - (b - a), 0)
            low, high, start = (np.where(bit, zeros + x, y - x) for x, y in ((a, low), (b, high), (s, start)))
        return low - start, high - start, smaller

    def symbols(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, symbol) for every distinct symbol between ``low`` and ``high``."""
        query, symbol = np.arange(len(low)), np.zeros(len(low), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[low], ones[high]
            left, right = (high - b) > (low - a), b > a
            query, symbol = np.concatenate([query[left], query[right]]), np.concatenate([symbol[left] << 1, (symbol[right] << 1) | 1])
            low, high = np.concatenate([(low - a)[left], (zeros + a)[right]]), np.concatenate([(high - b)[left], (zeros + b)[right]])
        return query, symbol


def _ordered(text: np.ndarray) -> np.ndarray:
    """Start positions of all rotations in order, by doubling."""
    n, step = len(text), 1
    rank = text.astype(np.int64)
    while True:
        pair = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(pair, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class Index:
    """A bidirectional FM-index over ``words`` in code-point order; a word's number is the rank of its delimited rotation."""

    def __init__(self, words: list[str]):
        text = np.concatenate([np.concatenate([[0], encoded(w)]) for w in words]).astype(np.uint8)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << LEVELS))])
        self.size = len(text)
        self.ranks = []
        for own in (text, text[::-1]):
            order = _ordered(own)
            self.ranks.append(Ranks(own[order - 1]))

    def extend(self, side: int, symbol: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Spans (low, high, low in the other direction) after one more symbol on a side: 0 left, 1 right."""
        own, other = (spans[:, 0], spans[:, 2]) if side == 0 else (spans[:, 2], spans[:, 0])
        size = spans[:, 1] - spans[:, 0]
        before, after, smaller = self.ranks[side].within(symbol, own, own + size)
        low, away = self.first[symbol] + before, other + smaller
        size = after - before
        return np.stack([low, low + size, away] if side == 0 else [away, away + size, low], axis=1)

    def near(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, number) of the near words found by matching one half exactly and extending to ``side`` (0 left, 1 right)."""
        coded = [encoded(w) for w in words]
        half = [len(c) // 2 for c in coded]
        # letters in the order of the extension, with the delimiter last
        exact = [np.append(c[:k][::-1], 0) if side else np.append(c[k:], 0) for c, k in zip(coded, half)]
        loose = [np.append(c[k:], 0) if side else np.append(c[:k][::-1], 0) for c, k in zip(coded, half)]
        spans = np.tile(np.array([[0, self.size, 0]]), (len(words), 1))
        query = np.arange(len(words))
        letters, at = _packed(exact)
        step = 0
        while len(query) and step < max(map(len, exact)):
            more = at[query] + step < at[query + 1]
            moved = self.extend(1 - side, letters[at[query[more]] + step], spans[more])
            alive = np.ones(len(query), bool)
            spans[more], alive[more] = moved, moved[:, 1] > moved[:, 0]
            query, spans = query[alive], spans[alive]
            step += 1
        letters, at = _packed(loose)
        # states: query, letters matched, errors, spans
        state = (query, np.zeros(len(query), np.int64), np.zeros(len(query), np.int64), spans)
        found_query, found_number = [], []
        while len(state[0]):
            state = self._advanced(side, letters, at, state)
            query, done, errors, spans = state
            ended = done == at[query + 1] - at[query]
            whole = ended & (errors == 1)
            found_query.append(query[whole])
            found_number.append(spans[whole, 0])
            state = tuple(x[~ended] for x in state)
        if not found_query:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(found_query), np.concatenate(found_number)], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def _advanced(self, side: int, letters: np.ndarray, at: np.ndarray, state: tuple) -> tuple:
        """All states after one step: a match, and for states without error each way to make one."""
        query, done, errors, spans = state
        wanted = letters[at[query] + done].astype(np.int64)
        last = letters[np.minimum(at[query] + done + 1, len(letters) - 1)]
        parts = []
        # matches
        matched = self.extend(side, wanted, spans)
        alive = matched[:, 1] > matched[:, 0]
        parts.append((query[alive], done[alive] + 1, errors[alive], matched[alive]))
        free = np.flatnonzero(errors == 0)
        # a letter of the word left out; of equal letters in a row the last
        out = free[(wanted[free] != 0) & (last[free] != wanted[free])]
        parts.append((query[out], done[out] + 1, np.ones(len(out), np.int64), spans[out]))
        # another letter in its place, or one more letter before it
        own = spans[free, 0] if side == 0 else spans[free, 2]
        which, symbol = self.ranks[side].symbols(own, own + spans[free, 1] - spans[free, 0])
        which = free[which]
        other = (symbol != 0) & (symbol != wanted[which])
        which, symbol = which[other], symbol[other]
        moved = self.extend(side, symbol, spans[which])
        for skip in (0, 1):
            use = np.flatnonzero((wanted[which] != 0) | (skip == 0))
            parts.append((query[which[use]], done[which[use]] + skip, np.ones(len(use), np.int64), moved[use]))
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def encoded(word: str) -> np.ndarray:
    return _NUMBER[np.frombuffer(word.encode("latin-1"), np.uint8)]


def _packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


#: Words whose searches move in step.
_BATCH = 4096


def _search(side: int):
    """Pairs of asked words and near words of one shard; only words of other halves for the left side."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"word": [], "near": [], "near_n": []}
        if index.num_rows and asked.num_rows:
            index = index.sort_by("word")
            known, counts = index.column("word").to_pylist(), index.column("n").to_pylist()
            tree = Index(known)
            words = asked.column("word").to_pylist()
            for first in range(0, len(words), _BATCH):
                part = words[first : first + _BATCH]
                for query, number in zip(*(x.tolist() for x in tree.near(part, side))):
                    word, near = part[query], known[number]
                    if side or near[: len(word) // 2] != word[: len(word) // 2]:
                        out["word"].append(word)
                        out["near"].append(near)
                        out["near_n"].append(counts[number])
        return pa.table({"word": pa.array(out["word"], pa.string()), "near": pa.array(out["near"], pa.string()), "near_n": pa.array(out["near_n"], pa.int64())})

    return run


def _turned(words: pa.Array, side: int) -> list[str]:
    return [w if side else w[::-1] for w in words.to_pylist()]


def _routed(starts: list[str], side: int):
    """Every word with the shards that its exact half lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(starts, object)
        for batch in batches:
            words = batch.column("word").to_pylist()
            halves = np.array([w[: len(w) // 2] if side else w[len(w) // 2 :][::-1] for w in words], object)
            low = np.maximum(np.searchsorted(edges, halves, "right") - 1, 0)
            high = np.searchsorted(edges, np.array([h + "\U0010ffff" for h in halves], object), "right")
            spans = np.maximum(high - low, 1)
            row = np.repeat(np.arange(len(words)), spans)
            shard = np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans) + low[row]
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in row], pa.string()), pa.array(shard, pa.int64())], ["word", "shard"])

    return run


def near_pairs(words: DataFrame, *, shard_words: int = SHARD_WORDS, asked: int = ASKED) -> DataFrame:
    """word, near, near_n: every ordered pair of near words of a vocabulary (word, n) of distinct words."""
    pairs = None
    for side in (1, 0):
        turned = words.select("word", "n", (F.col("word") if side else F.reverse("word")).alias("turned"))
        index = numbered(turned, "turned").withColumn("shard", F.floor(F.col("number") / shard_words))
        index = cut_lineage(index.select("word", "n", "turned", "shard"), "shards")
        starts = [r[0] for r in index.groupBy("shard").agg(F.min("turned").alias("least")).orderBy("shard").select("least").collect()]  # one per shard
        routed = cut_lineage(words.select("word").mapInArrow(_routed(starts, side), "word string, shard bigint"), "asked")
        blocks = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / asked).alias("blocks"))  # a row for each shard
        block = F.pmod(F.xxhash64("word"), F.col("blocks")).alias("block")
        questions = routed.join(F.broadcast(blocks), "shard").select("word", "shard", block)
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
        copies = index.join(F.broadcast(blocks), "shard").select("word", "n", "shard", every)
        found = copies.groupBy("shard", "block").cogroup(questions.groupBy("shard", "block")).applyInArrow(_search(side), "word string, near string, near_n bigint")
        pairs = found if pairs is None else pairs.union(found)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms of every word of forms (word, form) ends, by pointer doubling."""
    rows = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = rows.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = cut_lineage(moved, "roots")
        release(rows)
        rows = moved
        if rows.filter("moved").isEmpty():
            return rows.drop("moved")
        rows = rows.drop("moved")


def variants(words: DataFrame, *, ratio: int = LEAST_RATIO, shard_words: int = SHARD_WORDS, asked: int = ASKED) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n) of distinct words."""
    words = cut_lineage(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words, shard_words=shard_words, asked=asked).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    form_n = -F.col("best.less")
    large = form_n >= ratio * F.col("n")
    marked = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"), F.when(large, form_n).alias("form_n"),
    )
    marked = cut_lineage(marked, "forms")
    roots = _roots(marked.filter("form IS NOT NULL").select("word", "form"))
    out = marked.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
