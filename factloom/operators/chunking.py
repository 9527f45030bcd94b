"""Documents to passages with exact offsets into the stripped text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed_values as V
from factloom.functions import text as T
from factloom.scale import spread

#: The pieces of ``T.chunk_sentence_pieces``.
_PIECE = re.compile(V.CHUNK_SENTENCE.replace(r"\z", r"\Z"))
#: Documents of an Arrow batch whose chunks are built together.
DOCUMENTS_AT_ONCE = 1000


def _pack(leads: np.ndarray, bodies: np.ndarray, lengths: np.ndarray, size: int, overlap: int) -> list[dict]:
    """Greedy whole-sentence packing over the pieces of one document."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) + leads
    kept = np.flatnonzero(bodies > 0)
    starts, ends = starts[kept], (starts + bodies)[kept]
    spans, i, n = [], 0, len(kept)
    while i < n:
        # ends grow, so the last sentence that still fits is found by bisection
        j = max(i, int(np.searchsorted(ends, starts[i] + size, side="right")) - 1)
        spans.append({"first": int(kept[i]), "last": int(kept[j]), "start": int(starts[i]), "end": int(ends[j])})
        if j + 1 >= n:
            break
        # the next chunk may re-read trailing sentences that fit the overlap
        reread = int(np.searchsorted(starts, ends[j] - overlap, side="left")) if overlap else j + 1
        i = max(i + 1, min(reread, j + 1))
    return spans


def _sentences(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading spaces, stripped length and length of every piece of a text; the pieces cover it."""
    pieces = _PIECE.findall(text)
    lengths = [len(p) for p in pieces]
    leads = [n - len(p.lstrip(V.SPACES)) for n, p in zip(lengths, pieces, strict=True)]
    bodies = [len(p.strip(V.SPACES)) for p in pieces]
    return np.array(leads, "int64"), np.array(bodies, "int64"), np.array(lengths, "int64")


def _chunks(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """Start, end and text of the chunks of one stripped text; a text without any sentence is kept whole."""
    if not text:
        return [(0, 0, text)]
    return [(s["start"], s["end"], text[s["start"] : s["end"]]) for s in _pack(*_sentences(text), size, overlap)]


def whole_documents(documents: DataFrame) -> DataFrame:
    """One passage per document."""
    text = T.strip(F.col("text"))
    return documents.select(
        F.concat("document_id", F.lit("::p0")).alias("passage_id"),
        "document_id",
        "source_id",
        F.lit(0).alias("span_start"),
        F.length(text).alias("span_end"),
        text.alias("text"),
    )


def sentence_chunks(documents: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Pack whole sentences into passages of at most ``size`` characters.

    An oversized sentence is its own passage; a text without any sentence is kept
    whole. Texts are cut in one pass over Arrow batches, so a long text costs no more per character than a short one.
    """
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("need size >= 1 and 0 <= overlap < size")
    keys = [c for c in ("query_id", "document_id", "source_id") if c in documents.columns]
    base = spread(documents, "document_id").filter(F.col("text").isNotNull()).select(*keys, T.strip(F.col("text")).alias("text"))
    fields = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(at, DOCUMENTS_AT_ONCE)
                found = [_chunks(t, size, overlap) for t in batch["text"].to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]), "int64")
                flat = [c for chunks in found for c in chunks]
                columns = {c: batch[c].take(rows) for c in keys}
                columns["place"] = pa.array([i for chunks in found for i in range(len(chunks))], "int32")
                for k, (name, kind) in enumerate((("span_start", "int32"), ("span_end", "int32"), ("text", "string"))):
                    columns[name] = pa.array([c[k] for c in flat], kind)
                yield pa.RecordBatch.from_pydict(columns)

    rows = base.mapInArrow(cut, f"{fields}, place int, span_start int, span_end int, text string")
    passage = F.concat("document_id", F.lit("::p"), F.col("place").cast("string"))
    return rows.select(passage.alias("passage_id"), *keys, "span_start", "span_end", "text")
