"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases: the next phrase is the longest known one and one byte more, and
joins the dictionary. The set of phrases is hashed and reduced to ``SIZE`` minimum hashes, of which the fingerprint
keeps one byte each. Two texts that share long passages learn the same phrases, so the share of equal bytes, less
what chance gives, estimates the Jaccard likeness of the phrase sets, as a compressor would see it.

Texts are dealt to tasks by ranges of the key and sorted once, so that every document meets its follower as it streams by; only
the first and last document of each task are paired by a join. A text's first two thirds are parsed once for it
and its edited form.

Defined cases: a null text is an empty one; an empty text has no phrases and the empty fingerprint, which is like
another empty one (1.0) and unlike all others (0.0). Rows without key come after all others; rows of one key stand by
a hash of their texts, so repeated rows follow each other. A lone row follows itself; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.llm.wordhash import mix
from factloom.session import cut_lineage

SIZE = 128
_MASK = (1 << 64) - 1
_PULLS = np.random.default_rng(20_131_107).integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 2048


class Parse:
    """An incremental parse: the dictionary as a trie, its phrases' hashes, and the phrase that is under way."""

    def __init__(self):
        self.trie: dict[int, int] = {}
        self.hashes = [0x9E3779B97F4A7C15]
        self.node = 0
        self.least: np.ndarray | None = None  # minimum hashes of the first ``done`` phrases
        self.done = 1

    def copy(self) -> Parse:
        out = Parse()
        out.trie, out.hashes, out.node = self.trie.copy(), self.hashes.copy(), self.node
        out.least, out.done = self.least, self.done
        return out

    def feed(self, data: bytes) -> None:
        trie, hashes, node = self.trie, self.hashes, self.node
        known = trie.get
        for byte in data:
            step = node << 8 | byte
            node = known(step, 0)
            if not node:
                trie[step] = len(hashes)
                h = ((hashes[step >> 8] ^ (byte + 1)) * 0xBF58476D1CE4E5B9) & _MASK
                hashes.append(h ^ (h >> 29))
        self.node = node

    def minima(self) -> np.ndarray | None:
        """``SIZE`` minimum hashes of the phrases so far; none without phrases."""
        while self.done < len(self.hashes):
            part = np.array(self.hashes[self.done : self.done + _CHUNK], np.uint64)
            least = (part[:, None] * _PULLS).min(axis=0)
            self.least = least if self.least is None else np.minimum(self.least, least)
            self.done += len(part)
        return self.least

    def fingerprint(self) -> str:
        least = self.minima()
        return "" if least is None else (mix(least) & np.uint64(255)).astype(np.uint8).tobytes().hex()


def fingerprint(text: str) -> str:
    parse = Parse()
    parse.feed(text.encode("utf-8", "replace"))
    return parse.fingerprint()


def likeness(left: str, right: str) -> float:
    """Estimated Jaccard likeness of two phrase sets, from 0 to 1."""
    if not left or not right:
        return float(left == right)
    equal = np.frombuffer(bytes.fromhex(left), np.uint8) == np.frombuffer(bytes.fromhex(right), np.uint8)
    return max(0.0, (float(equal.mean()) - 1 / 256) / (1 - 1 / 256))


@dataclass
class Seen:
    """A document that waits for its follower."""

    doc_id: int | None
    text: str
    head: Parse  # of the part that the edit keeps
    mark: str

    @classmethod
    def of(cls, doc_id: int | None, text: str) -> Seen:
        keep = len(text) - len(text) // 3
        head = Parse()
        head.feed(text[:keep].encode("utf-8", "replace"))
        head.minima()
        whole = head.copy()
        whole.feed(text[keep:].encode("utf-8", "replace"))
        return cls(doc_id, text, head, whole.fingerprint())

    def row(self, follower: str, mark: str) -> dict:
        """The result for a follower's text and fingerprint."""
        cut = len(self.text) // 3
        tail = follower[:cut]
        if tail == self.text[len(self.text) - cut :]:
            edited = self.mark
        else:
            self.head.feed(tail.encode("utf-8", "replace"))  # nobody needs the bare head any more
            edited = self.head.fingerprint()
        digest = hashlib.sha256((self.text[: len(self.text) - cut] + tail).encode("utf-8", "replace")).hexdigest()
        return {
            "doc_id": self.doc_id, "n_chars": len(self.text), "edited_sha256": digest, "fingerprint": self.mark, "edited_fingerprint": edited,
            "near_edited": likeness(self.mark, edited), "near_next": likeness(self.mark, mark),
        }


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")],
     ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_EDGES = pa.schema([*_TYPES, ("part", pa.int64()), ("edge", pa.string()), ("text", pa.string())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a task's sorted rows, and its first and last row as edges."""
    part, last = TaskContext.get().partitionId(), None
    edge = lambda kind, seen: {"doc_id": seen.doc_id, "fingerprint": seen.mark, "part": part, "edge": kind, "text": seen.text}
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            seen = Seen.of(doc_id, text)
            out.append(last.row(text, seen.mark) if last else edge("first", seen))
            last = seen
        yield pa.RecordBatch.from_pylist(out, _EDGES)
    if last:
        yield pa.RecordBatch.from_pylist([edge("last", last)], _EDGES)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [Seen.of(r["doc_id"], r["text"]).row(r["follower"], r["mark"]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, _TYPES)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per row of ``docs``.

    The edited text of a document ends, instead of with its last floor(n_chars / 3) code points, with as many first ones of the
    document of the next smaller key (all, if there are fewer); the smallest key is followed by the largest.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the row's place is there for hot keys alone: equal rows may stand in any order
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h"), F.col("_n")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = cut_lineage(dealt.mapInArrow(_stream, _RESULT + ", part bigint, edge string, text string"), "phrases")

    firsts = found.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("follower"), F.col("fingerprint").alias("mark"))
    lasts = found.filter("edge = 'last'").select("doc_id", "text", "part")
    parts = lasts.select("part")  # a row for each task of the sort
    after = F.coalesce(F.lead("part").over(W.orderBy("part")), F.first("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    joined = lasts.join(parts.select("part", after.alias("next")), "part").join(firsts, "next").select("doc_id", "text", "follower", "mark")
    return found.filter("edge IS NULL").drop("part", "edge", "text").unionByName(joined.mapInArrow(_pairs, _RESULT))
