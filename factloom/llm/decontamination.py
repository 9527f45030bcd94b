"""Benchmark passages in documents, by SimHash windows and a multi-index Hamming join.

Only DataFrame functions run here. Words are runs of characters outside ASCII signs, lower-cased; an item's set holds
its distinct shingles of five words (an item with fewer words is one shingle). Steps:

1. One scan keeps the regions of documents around shingles that may belong to an item. A bit table of bounded size
   tests them; it has no false negatives, and a window without any item shingle could never pass step 4.
2. Every shingle of a region that stands at word o of an item of L words gives the window of L words it is aligned
   with. Windows and items get 128-bit SimHash fingerprints over their shingles, weighted by how rare they are in the corpus.
3. Fingerprints are cut into 16 blocks of 8 bits. Two that differ in at most ``RADIUS`` bits agree in some block up
   to two bits (pigeonhole), so items are indexed under all blocks with up to two bits changed, beside L.
4. Candidates within the radius are verified: weight of the item's shingles in the window over the item's weight.
5. Weights fall as copies spread, so a passage altered in one word and copied often would be lost. Windows that may hold
   ``SIMILARITY`` of an item's shingles, all counted alike, get a second fingerprint of equal pulls and meet and are verified by it
   in the same way. A document found by its windows' weights is reported by these alone.

Defined cases: documents without doc_id or text and items without item_id or words are left out; repeated rows
give one result row; a passage found in several windows of a document is counted by ``n_windows``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bound_to, bounded
from factloom.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 16
ERRORS = 2
RADIUS = BLOCKS * (ERRORS + 1) - 1
#: Bits of the table that finds regions, per shingle and at most, and the places that each shingle sets.
BITS_PER_SHINGLE, MOST_BITS, PROBES = 128, 1 << 24, 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _hash_at(found: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(found, at + k) for k in range(size)])


def _positions(found: Column, size: int) -> Column:
    last = F.size(found) - size
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hashes(found: Column, size: int) -> Column:
    return F.transform(_positions(found, size), lambda i: _hash_at(found, i, size))


def _shingles(found: Column, length: Column, sizes: list[int]) -> Column:
    """Hash of every shingle; items shorter than ``SHINGLE`` words use their own length."""
    out = F.array().cast("array<bigint>")
    for size in sizes:
        own = _hashes(found, size)
        out = F.when(F.least(length, F.lit(SHINGLE)) == size, own).otherwise(out)
    return out


def _item_shingles(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """item_id, length, offset, h of all items, and the shingle sizes that occur."""
    known = items.filter(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w"))
    known = known.filter(F.size("w") > 0).withColumn("length", F.size("w"))
    all_sizes = list(range(1, SHINGLE + 1))
    rows = known.select("item_id", "length", F.posexplode(_shingles(F.col("w"), F.col("length"), all_sizes)).alias("offset", "h"))
    rows = cut_lineage(rows.distinct(), "items")
    sizes = sorted(r[0] for r in rows.select(F.least("length", F.lit(SHINGLE))).distinct().collect())
    return rows, sizes


def _places(h: Column, bits: int) -> list[Column]:
    return [F.shiftright(h, 20 * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)]


def _bit_table(shingles: DataFrame) -> tuple[Column, int]:
    """The table as a literal of at most ``MOST_BITS`` bits, whatever the number of items."""
    n = max(shingles.select("h").distinct().count(), 1)
    bits = min(MOST_BITS, 1 << (n * BITS_PER_SHINGLE - 1).bit_length())
    place = F.explode(F.array(*_places(F.col("h"), bits))).alias("p")
    set_ = shingles.select(place).groupBy(F.shiftright("p", 6).alias("at"))
    set_ = set_.agg(F.bit_or(_shift(F.lit(1).cast("bigint"), F.col("p").bitwiseAND(63), "shiftleft")).alias("v")).toPandas()
    table = np.zeros(bits // 64 or 1, np.int64)
    table[set_["at"].to_numpy(np.int64)] = set_["v"].to_numpy(np.int64)
    return F.lit(table), bits


def _shift(value: Column, by: Column, name: str) -> Column:
    return F.call_function(name, value, by.cast("int"))


def _may_hold(h: Column, table: Column, bits: int) -> Column:
    tests = []
    for place in _places(h, bits):
        word = F.get(table, F.shiftright(place, 6).cast("int"))
        tests.append(_shift(word, place.bitwiseAND(63), "shiftright").bitwiseAND(F.lit(1)) == 1)
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _hits(found: Column, size: int, table: Column, bits: int) -> Column:
    return F.filter(_positions(found, size), lambda i: _may_hold(_hash_at(found, i, size), table, bits))


def _stretches(w: Column, hits: Column, margin: int) -> Column:
    """(base, w) for every group of hits, with ``margin`` words on both sides; hits further apart begin a new group."""
    apart = F.lit(2 * margin)
    first = F.filter(hits, lambda p, j: (j == 0) | (p - F.get(hits, j - 1) > apart))
    last = F.filter(hits, lambda p, j: (j == F.size(hits) - 1) | (F.get(hits, j + 1) - p > apart))
    base = lambda s: F.greatest(s - margin, F.lit(0))
    part = lambda s, e: F.struct(base(s).alias("base"), F.slice(w, base(s) + 1, e + SHINGLE + margin - base(s)).alias("w"))
    return F.zip_with(first, last, part)


def _regions(docs: DataFrame, table: Column, bits: int, sizes: list[int], margin: int) -> DataFrame:
    """doc_id, base, w: stretches of words around possible item shingles."""

    def of_words(w: Column) -> Column:
        hits = [_hits(w, k, table, bits) for k in sizes]
        hits = hits[0] if len(hits) == 1 else F.array_sort(F.array_distinct(F.flatten(F.array(*hits))))
        return bound_to(hits, lambda h: _stretches(w, h, margin))

    cut = bound_to(words(F.col("text")), of_words)
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select("doc_id", F.explode(cut).alias("r")).select("doc_id", "r.base", "r.w")


_SIGNS = "aggregate(s, 0L, (t, x) -> t + IF((shiftright(x.{h}, b) & 1L) = 1L, {pull}, -{pull}))"
_BITS = "aggregate(sequence(0, 63), 0L, (a, b) -> a | shiftleft(IF(" + _SIGNS + " > 0L, 1L, 0L), b))"


def _fingerprints(rows: DataFrame, keys: list[str], needs: DataFrame, similarity: float) -> DataFrame:
    """``keys``, s, f, g, f1, g1: weighted shingles and the two halves of the weighted and of the plain fingerprint.

    A shingle pulls with the root of its weight, so the angle between two fingerprinted sets follows their shared weight; in
    the plain fingerprint, which only rows with ``plain`` have, all pull alike. Pulls are integers, so sums are exact.
    """
    pull = F.round(100 * F.sqrt("weight")).cast("bigint")
    item = F.struct("h", F.xxhash64(F.lit(9), "h").alias("h2"), "weight", pull.alias("pull"))
    sets = rows.groupBy(*keys).agg(F.collect_list(item).alias("s"), F.count_if("known").alias("n_known"))
    sets = sets.join(F.broadcast(needs), "length").withColumn("plain", F.col("n_known") / F.col("need") >= similarity)
    for name, h in (("f", "h"), ("g", "h2")):
        sets = sets.withColumn(name, F.expr(_BITS.format(h=h, pull="x.pull")))
        sets = sets.withColumn(f"{name}1", F.expr(f"IF(plain, {_BITS.format(h=h, pull='1L')}, NULL)"))
    return sets.drop("n_known", "need", "plain")


def _block_keys(changes: list[int], end: str = "") -> Column:
    """Every (block number, its value with each change applied), in one number each."""
    halves = F.array("f" + end, "g" + end)
    block = lambda c: _shift(F.get(halves, (c / 8).cast("int")), 8 * (c % 8), "shiftrightunsigned").bitwiseAND(F.lit(255)).cast("int")
    changed = lambda c: F.transform(F.lit(np.array(changes, np.int32)), lambda x: c * 256 + block(c).bitwiseXOR(x))
    return F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), changed))).alias("key")


def contaminated(docs: DataFrame, items: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """Rows doc_id, item_id, similarity, first_word, n_windows of docs (doc_id, text) that hold items (item_id, text)."""
    index, sizes = _item_shingles(items.select("item_id", "text"))
    margin = index.agg(F.coalesce(F.max("length"), F.lit(1))).first()[0]
    table, bits = _bit_table(index)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    regions = cut_lineage(_regions(docs, table, bits, sizes or [SHINGLE], margin), "regions")

    placed = None
    for k in sizes or [SHINGLE]:
        own = regions.select("doc_id", "base", "w", F.posexplode(_hashes(F.col("w"), k)).alias("i", "h"))
        placed = own if placed is None else placed.union(own)
    shapes = index.select("h", "offset", "length").distinct()
    aligned = placed.join(bounded(shapes), "h").withColumn("start", F.col("base") + F.col("i") - F.col("offset"))
    left = F.greatest(F.col("start"), F.col("base"))
    part = F.slice("w", (left - F.col("base") + 1).cast("int"), F.greatest(F.col("start") + F.col("length") - left, F.lit(0)).cast("int"))
    windows = aligned.select("doc_id", "start", "length", part.alias("w")).distinct()
    held = windows.select("doc_id", "start", "length", F.explode(F.array_distinct(_shingles(F.col("w"), F.col("length"), sizes or [SHINGLE]))).alias("h"))
    held = cut_lineage(held.distinct(), "windows")

    # how rare an item's shingle is among all documents; shingles of no item weigh least, as they decide nothing
    total = docs.filter(F.col("doc_id").isNotNull()).count()
    seen = held.join(bounded(index.select("h").distinct()), "h", "left_semi").groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
    seen = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"))
    rare = lambda n: F.round(1000 * (1 + F.log(F.lit(total + 1.0) / (n + 1)))).cast("bigint")
    weights = cut_lineage(index.select("h").distinct().join(seen, "h", "left").select("h", rare(F.coalesce("n_docs", F.lit(0))).alias("weight")), "weights")
    weigh = lambda rows: rows.join(bounded(weights), "h", "left").select(
        *rows.columns, F.col("weight").isNotNull().alias("known"), F.coalesce("weight", F.lit(1000)).alias("weight"))
    # of a length, the fewest distinct shingles of an item
    needs = index.groupBy("length", "item_id").agg(F.count_distinct("h").alias("n")).groupBy("length").agg(F.min("n").alias("need"))
    needs = cut_lineage(needs, "needs")

    keys = ["doc_id", "start", "length"]
    left_side = cut_lineage(_fingerprints(weigh(held), keys, needs, similarity), "fingerprints")
    own_shingles = weigh(index.select("item_id", "length", "h").distinct())
    right_side = cut_lineage(_fingerprints(own_shingles, ["item_id", "length"], needs, similarity), "items")
    changes = [x for x in range(256) if x.bit_count() <= ERRORS]
    near = None
    for end in ("", "1"):
        f, g = "f" + end, "g" + end
        index_keys = right_side.select("item_id", "length", F.col(f).alias("_f"), F.col(g).alias("_g"), _block_keys(changes, end))
        window_keys = left_side.filter(F.col(f).isNotNull()).select(*keys, f, g, _block_keys([0], end))
        met = window_keys.join(bounded(index_keys), ["length", "key"])
        away = F.bit_count(F.col(f).bitwiseXOR(F.col("_f"))) + F.bit_count(F.col(g).bitwiseXOR(F.col("_g")))
        met = met.filter(away <= RADIUS).select(*keys, "item_id")
        near = met if near is None else near.union(met)

    pairs = near.distinct().join(left_side.select(*keys, F.col("s.h").alias("own")), keys)
    pairs = pairs.join(bounded(right_side.select("item_id", "s")), "item_id")
    weight = lambda s: F.aggregate(s, F.lit(0).cast("bigint"), lambda t, x: t + x["weight"])
    shared = F.filter("s", lambda x: F.array_contains("own", x["h"]))
    pairs = pairs.select(
        "doc_id", "item_id", "start", (weight(shared) / weight(F.col("s"))).alias("by_weight"), (F.size(shared) / F.size("s")).alias("alike"))
    heavy = F.col("by_weight") >= similarity
    found = pairs.filter(heavy | (F.col("alike") >= similarity)).groupBy("doc_id", "item_id")
    either = lambda f, value, other: F.coalesce(f(F.when(heavy, F.col(value))), f(other))
    return found.agg(
        F.round(either(F.max, "by_weight", "alike"), 6).alias("similarity"), F.greatest(either(F.min, "start", "start"), F.lit(0)).cast("bigint").alias("first_word"),
        F.when(F.count_if(heavy) > 0, F.count_if(heavy)).otherwise(F.count(F.lit(1))).alias("n_windows"),
    )
