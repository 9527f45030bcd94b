"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the largest length are cut into pieces of that length, each a full sequence of its own; remainders
and shorter texts are packed. Pieces are taken from the longest down; each goes to the open sequence with the least room that
still holds it. If none does, a sequence is opened at the length that costs least per token it can still get:
(length + overhead) / min(length, tokens left). At the end every sequence shrinks to the smallest permitted length
that holds its contents. Pieces are dealt by hash into shards of about ``SHARD_ROWS``, packed independently.

Every row has an identity of its own, which names its full sequences and deals its pieces.

Defined cases: a null or wordless text has length 0 and gets one row without a sequence; repeated rows and rows without
doc_id are packed as often as they occur; ties go to the smaller doc_id, then to the earlier row, the smaller piece and the sequence opened later.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage

LENGTHS = (512, 1024, 2048, 4096)
#: What a sequence costs besides its tokens, in tokens.
OVERHEAD = 16
SHARD_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def pack(sizes: Sequence[int], lengths: Sequence[int], overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Sequence number, offset of every piece and length of every sequence; ``sizes`` fall and fit the largest length."""
    lengths = sorted(lengths)
    left = int(sum(sizes))
    by_room: dict[int, list[int]] = {}
    rooms = 0  # a bit for every room that some open sequence has
    bin_of, offset, room_of, opened = [], [], [], []
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room = min((x for x in lengths if x >= size), key=lambda x: ((x + overhead) / min(x, left), x))
            at = len(opened)
            opened.append(room)
            room_of.append(room)
        bin_of.append(at)
        offset.append(opened[at] - room)
        left -= size
        room_of[at] = room - size
        if room > size:
            by_room.setdefault(room - size, []).append(at)
            rooms |= 1 << (room - size)
    final = [next(x for x in lengths if x >= a - b) for a, b in zip(opened, room_of)]
    return bin_of, offset, final


def best_fit(docs: DataFrame, key: str, length: Column, *, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows doc_id, piece, start, length, sequence, offset, capacity: which part of a text stands where."""
    most = max(lengths)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), length.alias("total"), F.monotonically_increasing_id().alias("row"))
    last = F.greatest(F.ceil(F.col("total") / most), F.lit(1)) - 1
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = (F.col("piece") * most).cast("bigint")
    pieces = pieces.select("doc_id", "row", "piece", start.alias("start"), F.least(F.lit(most), F.col("total") - start).cast("bigint").alias("length"))
    pieces = cut_lineage(pieces, "pieces")  # numbers only, and from here on rows keep their identity
    shards = max(1, -(-pieces.filter(F.col("length").between(1, most - 1)).count() // shard_rows))
    name = F.concat_ws("-", F.lit("full"), "row", "piece")
    full = pieces.filter(F.col("length") == most).select("*", name.alias("sequence"), F.lit(0).cast("bigint").alias("offset"), F.lit(most).cast("bigint").alias("capacity"))
    none = pieces.filter(F.col("length") == 0).select("*", F.lit(None).cast("string").alias("sequence"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("capacity"))
    open_ = pieces.filter(F.col("length").between(1, most - 1)).withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offset, final = pack(part["length"].tolist(), lengths, overhead)
        out = part.drop(columns=["shard", "row"])
        out["sequence"] = [f"{key[0]}-{b}" for b in bins]
        out["offset"] = np.array(offset, "int64")
        out["capacity"] = np.array(final, "int64")[bins]
        return out

    schema = "doc_id bigint, piece bigint, start bigint, length bigint, sequence string, offset bigint, capacity bigint"
    return open_.groupBy("shard").applyInPandas(packed, schema).unionByName(full.drop("row")).unionByName(none.drop("row"))
