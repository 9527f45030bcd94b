"""Token counts of a unigram tokenizer without its tokens.

A text is split before every space, which becomes the word mark; an Aho-Corasick automaton lists all vocabulary
pieces of a word, and dynamic programming over its characters carries the best score and the number of pieces. Rules
are those of the public unigram tokenizers: double-precision sums from left to right, a candidate replaces another only if it is
strictly better, candidates in order of their start (so the longest last piece wins ties), a character without a piece of
its own may be unknown at the smallest score less 10, and unknown characters count as their bytes if the vocabulary
has all byte pieces, else a run of them as one.

The vocabulary is read from a SentencePiece file whose pieces are ordered by frequency; a piece of rank r gets the log
probability of Zipf's law, -log((r + 2) H) with H the sum of 1 / (r + 2). Nothing is trained.

Defined cases: null and empty texts have no tokens and score 0; every input row gives one row.
"""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words remembered by one worker; the memory is emptied when full, which changes no result.
REMEMBERED = 600_000


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, log probability) in order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)) for i in ids]
    ranks = [-model.get_score(i) if plain[i] else None for i in ids]
    last = max(r for r in ranks if r is not None)
    ranks = [last if r is None else r for r in ranks]
    total = math.fsum(1 / (r + 2) for r in ranks)
    return [(model.id_to_piece(i), -math.log((ranks[i] + 2) * total)) for i in ids]


class Counter:
    """Best score and number of pieces of words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.memory: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count, open_run, single = [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)

        def settle(to: int) -> None:
            """The unknown character before ``to``, where no piece is that character."""
            if single[to]:
                return
            score = best[to - 1] + self.unknown
            if best[to] is None or score > best[to]:
                more = len(text[to - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not open_run[to - 1])
                best[to], count[to], open_run[to] = score, count[to - 1] + more, True

        done = 0
        for end, (length, piece_score) in self.automaton.iter(text):
            to = end + 1
            while done < end:
                done += 1
                settle(done)
            score = best[to - length] + piece_score
            if best[to] is None or score > best[to]:
                best[to], count[to], open_run[to] = score, count[to - length] + 1, False
            if length == 1:
                single[to] = True
        while done < n:
            done += 1
            settle(done)
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(" ", MARK)
        words = (words[1:] if words[0] == MARK else words).split(MARK)
        memory = self.memory
        missing = set(words).difference(memory)
        if len(memory) + len(missing) > REMEMBERED:
            memory.clear()
            missing = set(words)
        for word in missing:
            memory[word] = self.word(MARK + word)
        found = list(map(memory.__getitem__, words))
        return sum(c for c, _ in found), math.fsum(s for _, s in found)


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    """One per worker process."""
    return Counter(vocabulary(path))


def token_counts(text: Column, path: str = VOCABULARY) -> Column:
    """A struct of n_tokens and log_prob. Every executor reads the vocabulary file from ``path``."""

    @F.arrow_udf("struct<n_tokens:bigint,log_prob:double>")
    def count(texts: pa.Array) -> pa.Array:
        counter = _counter(path)
        found = [counter.text(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["n_tokens", "log_prob"])

    return count(text)
