"""MinHash near-duplicates by a multi-index Hamming join.

A text's set holds the hashes of its distinct word shingles; its signature is the low ``BITS`` bits of ``SYMBOLS``
minimum hashes. Signatures are split into chunks of ``CHUNK`` symbols. Two signatures that differ in at most
``RADIUS`` symbols have, by pigeonhole, a chunk with at most one wrong symbol, so both write the same key when every
chunk is written once with each of its symbols left out. All pairs within the radius therefore meet, and
links are confirmed on the full sets.

Work per key stays linear in its size where texts are alike: every member is first compared with the key's smallest
member, the confirmed links give components, and only members of different components are compared again, in
blocks. Nothing is left unchecked: two members of one key end up in one component or have been compared.

Defined cases: a null or wordless text has an empty set and no links. Equal sets form one class before any
comparison. Rows that share a doc_id are one document for linking. Rows without doc_id link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.components import components
from factloom.llm import wordhash as H
from factloom.llm.common import bounded
from factloom.session import cut_lineage

SYMBOLS = 48
BITS = 16
CHUNK = 4
CHUNKS = SYMBOLS // CHUNK
#: Largest distance at which one of the chunks must have one wrong symbol at most.
RADIUS = 2 * CHUNKS - 1
#: Members of a residual key that are compared in one block.
BLOCK = 256
#: Bits per shingle of the bitmaps that refute such pairs.
BITMAP = 8

_rng = np.random.default_rng(5)
_SALT = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_FACTOR = _rng.integers(1, 1 << 62, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _binary(values: np.ndarray, width: int) -> pa.Array:
    """One binary of ``width`` bytes for every row of a two-dimensional array."""
    n = len(values)
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _symbols(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.empty(0, np.uint8)
    return data[first : first + len(column) * SYMBOLS * 2].view(np.uint16).reshape(-1, SYMBOLS)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for found in H.words(batch.column("text"), H.BLANKS):
                row, value = H.distinct(*H.shingles(found, size))
                at = H.bounds(row, found.rows)
                counts = np.diff(at)
                full = np.flatnonzero(counts)
                symbols = np.zeros((found.rows, SYMBOLS), np.uint16)
                class_1, class_2 = np.zeros(found.rows, np.uint64), np.zeros(found.rows, np.uint64)
                if len(full):
                    heads = at[full]
                    for k in range(SYMBOLS):
                        least = np.minimum.reduceat((value ^ _SALT[k]) * _FACTOR[k], heads)
                        symbols[full, k] = H.mix(least).astype(np.uint16)
                    class_1[full] = np.add.reduceat(H.mix(value), heads)
                    class_2[full] = np.add.reduceat(H.mix(value ^ _SALT[0]), heads)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(found.first, found.rows), pa.array(counts), _signed(class_1), _signed(class_2), _binary(symbols, SYMBOLS * 2)],
                    ["doc_id", "n_shingles", "class_1", "class_2", "signature"],
                )

    return run


def _write_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk once with each of its symbols left out."""
    places = [(c, out) for c in range(CHUNKS) for out in range(CHUNK)]
    for batch in batches:
        symbols = _symbols(batch.column("signature")).astype(np.uint64)
        ids = batch.column("rep").to_numpy(zero_copy_only=False)
        keys = np.empty((len(ids), len(places)), np.uint64)
        for p, (c, out) in enumerate(places):
            packed = np.full(len(ids), p, np.uint64)
            for k in range(CHUNK):
                if k != out:
                    packed = (packed << np.uint64(BITS)) | symbols[:, c * CHUNK + k]
            keys[:, p] = H.mix(packed)
        columns = [_signed(keys.reshape(-1)), pa.array(np.tile(np.arange(len(places), dtype=np.int16), len(ids))), pa.array(np.repeat(ids, len(places)))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "place", "rep"])


def _within_radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        away = (_symbols(batch.column("sig_a")) != _symbols(batch.column("sig_b"))).sum(axis=1)
        kept = batch.filter(pa.array(away <= RADIUS))
        yield kept.select(["a", "b"])


def _alike(size: int, percent: int):
    def sets(texts: pa.Array) -> list[np.ndarray]:
        out = []
        for found in H.words(texts, H.BLANKS):
            row, value = H.distinct(*H.shingles(found, size))
            out += np.split(value, H.bounds(row, found.rows)[1:-1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:  # some hundred pairs at a time bound the memory
                part = batch.slice(at, 200)
                at += 200
                # a hub's text comes in runs: its set is made once for each run
                right = part.column("text_b").dictionary_encode()
                left, known = sets(part.column("text_a")), sets(right.dictionary)
                keep = np.zeros(part.num_rows, bool)
                for k, (x, code) in enumerate(zip(left, right.indices.to_pylist())):
                    y = known[code] if code is not None else x[:0]
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) > 0:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
                yield part.filter(pa.array(keep)).select(["a", "b"])

    return run


def _bitmaps(size: int):
    """A bit per hash value of every shingle, at ``BITMAP`` bits a shingle and a power of two in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for found in H.words(batch.column("text"), H.BLANKS):
                row, value = H.distinct(*H.shingles(found, size))
                for own in np.split(value, H.bounds(row, found.rows)[1:-1]):
                    bits = np.zeros(max(64, 1 << (len(own) * BITMAP - 1).bit_length()), bool)
                    bits[(own & np.uint64(len(bits) - 1)).astype(np.int64)] = True
                    maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(maps, pa.binary())], ["rep", "bitmap"])

    return run


def _folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    """The bitmap of fewer hash bits."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, width), axis=0)


def _meet(percent: int):
    def run(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        """Pairs of one block that may be linked: other components, within the radius, and not refuted by bitmaps.

        An element of A whose bit is clear in B is not in B, so the intersection is at most |A| less those bits. A pair
        that shares several keys is looked at under the first of them.
        """
        symbols = np.frombuffer(b"".join(members["signature"]), np.uint16).reshape(-1, SYMBOLS)
        rep, part, own, n, place = (members[c].to_numpy() for c in ("rep", "component", "own", "n_shingles", "place"))
        maps = [np.frombuffer(m, np.uint8) for m in members["bitmap"]]
        widths = np.array([len(m) for m in maps])
        stacked: dict[int, np.ndarray] = {}
        one_block, place = key[1] == key[2], int(place[0])
        left = np.arange(len(rep)) if one_block else np.flatnonzero(own == key[1])
        right = left if one_block else np.flatnonzero(own == key[2])
        found = []
        for i in left:
            close = (part[right] != part[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))
            others = right[close & (rep[right] > rep[i])] if one_block else right[close]
            if not len(others):
                continue
            same = symbols[others] == symbols[i]
            others, same = (x[same.sum(axis=1) >= SYMBOLS - RADIUS] for x in (others, same))
            chunks = same.reshape(-1, CHUNKS, CHUNK)
            wrong = np.where(chunks.all(axis=2), 0, chunks.argmin(axis=2))
            first = np.where(chunks.sum(axis=2) >= CHUNK - 1, np.arange(CHUNKS) * CHUNK + wrong, len(symbols[0])).min(axis=1)
            others = others[first == place]
            for width in np.unique(np.minimum(widths[others], widths[i])).tolist():
                if width not in stacked:
                    stacked[width] = np.stack([_folded(m, width) if len(m) >= width else np.zeros(width, np.uint8) for m in maps])
                now = others[np.minimum(widths[others], widths[i]) == width]
                a, b = stacked[width][i], stacked[width][now]
                most = np.minimum(n[i] - np.bitwise_count(a & ~b).sum(axis=1, dtype=int), n[now] - np.bitwise_count(b & ~a).sum(axis=1, dtype=int))
                found += [(max(rep[i], rep[j]), min(rep[i], rep[j])) for j in now[100 * most >= percent * (n[i] + n[now] - most)]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough; only texts of paired documents are shuffled."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(bounded(nodes), "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_alike(size, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id bigint, text): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links of Jaccard similarity ``percent``/100 or more;
    ``kept`` marks the document that carries it.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = rows.mapInArrow(
        _signatures(shingle), "doc_id bigint, n_shingles bigint, class_1 bigint, class_2 bigint, signature binary"
    )
    signed = cut_lineage(signed, "signatures")
    linkable = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # one representative per set; a document may stand for several sets if its doc_id repeats
    classes = linkable.groupBy("class_1", "class_2").agg(
        F.min(F.struct("doc_id", "n_shingles", "signature")).alias("m")
    )
    classes = classes.select("class_1", "class_2", F.col("m.doc_id").alias("rep"), "m.n_shingles", "m.signature")
    classes = cut_lineage(classes, "classes")
    marks = classes.select("rep", "signature", "n_shingles")

    keys = marks.mapInArrow(_write_keys, "key bigint, place smallint, rep bigint")
    sizes = keys.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("_last"), F.count(F.lit(1)).alias("size"))
    sizes = cut_lineage(sizes.filter(F.col("center") < F.col("_last")).drop("_last"), "keys")
    met = cut_lineage(keys.join(bounded(sizes), "key"), "met")
    stars = met.filter(F.col("rep") != F.col("center")).select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    close = stars.join(marks.select(F.col("rep").alias("a"), F.col("signature").alias("sig_a")), "a")
    close = close.join(marks.select(F.col("rep").alias("b"), F.col("signature").alias("sig_b")), "b")
    close = cut_lineage(close.mapInArrow(_within_radius, "a bigint, b bigint").distinct(), "close")
    # a doc_id that repeats with other texts joins its classes
    own = linkable.join(classes.select("class_1", "class_2", "rep"), ["class_1", "class_2"])
    own = own.filter(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = cut_lineage(_confirm(close, rows, shingle, percent), "links")
    shared = own.join(classes.select(F.col("rep").alias("a")).distinct(), "a", "left_semi")
    links = links.union(shared)
    found = components(links, "a", "b")

    # keys whose members are not of one component: the rest of their pairs
    named = met.filter(F.col("size") > 2).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = cut_lineage(named.withColumn("component", F.coalesce("component", "rep")), "named")
    mixed = named.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    mixed = mixed.filter("_lo < _hi").select("key")
    parts = F.ceil(F.col("size") / BLOCK)
    left = cut_lineage(named.join(mixed, "key", "left_semi"), "mixed")
    members = left.select(F.col("rep").alias("doc_id")).distinct()
    maps = rows.join(bounded(members), "doc_id", "left_semi").mapInArrow(_bitmaps(shingle), "rep bigint, bitmap binary")
    left = left.join(marks, "rep").join(maps, "rep").withColumn("parts", parts)
    left = left.withColumn("own", F.pmod(F.xxhash64("rep"), "parts"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    columns = ["rep", "component", "signature", "n_shingles", "bitmap", "place", "own"]
    left = left.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)
    more = left.groupBy("key", "i", "j").applyInPandas(_meet(percent), "a bigint, b bigint").distinct()
    more = cut_lineage(more.join(close, ["a", "b"], "left_anti"), "more")
    links_2 = cut_lineage(_confirm(more, rows, shingle, percent), "links")
    if not links_2.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links_2), "a", "b")

    labels = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.select("class_1", "class_2", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("signature").join(labels, ["class_1", "class_2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
