"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are extended by one component so that all have the length of the longest; the largest inner product is then the
smallest angle. Codes of 64 bits are the signs of a projection to principal axes and a rotation learned by iterative
quantisation on at most ``SAMPLE`` vectors. All vectors are indexed: shards of about ``SHARD_ROWS`` hold one table per
substring of 8 bits. By pigeonhole a code within the radius agrees with the query in some substring up to
radius // 8 bits, so probing those entries of all tables finds every code within the radius; these are reranked by the
inner product of the original vectors in double precision.

The radius is learned too: the distance within which ``COVER`` of the true neighbours of at most ``PROBES`` queries lie, found
by comparing these queries with all rows. It is the price of recall on vectors without structure. A query with fewer than k
rows within it, such as an outlier, is searched again over all rows.

Defined cases: rows without id, null or zero vectors, vectors with null or non-finite components and vectors of another
length than most take no part; a query's own id is no candidate; ties go to the smaller id. Components may be as large or
small as doubles are: codes are made of vectors scaled by their largest component, scores may be infinite.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.session import cut_lineage

BITS = 64
PARTS = 8
SAMPLE = 20_000
PROBES = 128
COVER = 0.985
SHARD_ROWS = 20_000
QUERY_ROWS = 4_000


@dataclass
class Coder:
    longest: float
    mean: np.ndarray
    axes: np.ndarray

    def extended(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        lengths = _lengths(vectors)
        if query:
            return np.column_stack([vectors / lengths[:, None], np.zeros(len(vectors))])
        return np.column_stack([vectors / self.longest, np.sqrt(np.maximum(1 - (lengths / self.longest) ** 2, 0))])

    def codes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        bits = (self.extended(vectors, query) - self.mean) @ self.axes > 0
        return np.packbits(bits, axis=1)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths without squares of extreme components."""
    largest = np.abs(vectors).max(axis=1, initial=0.0)
    return largest * np.sqrt(((vectors / np.where(largest > 0, largest, 1.0)[:, None]) ** 2).sum(axis=1))


def _products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products; what is no number (an infinite part on both sides) counts as the least."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (rows * vector).sum(axis=1)
    return np.where(np.isnan(out), -np.inf, out)


def learn(vectors: np.ndarray, longest: float, rounds: int = 20) -> Coder:
    """Axes of iterative quantisation; several rotations are stacked if there are fewer dimensions than bits."""
    coder = Coder(longest, np.zeros(vectors.shape[1] + 1), np.zeros((vectors.shape[1] + 1, BITS)))
    rows = coder.extended(vectors, query=False)
    mean = rows.mean(axis=0)
    _, axes = np.linalg.eigh((rows - mean).T @ (rows - mean))
    axes = axes[:, ::-1][:, : min(BITS, rows.shape[1])]
    projected = (rows - mean) @ axes
    rng, columns = np.random.default_rng(3), []
    while sum(c.shape[1] for c in columns) < BITS:
        turn = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (u @ vt).T
        columns.append(axes @ turn)
    return Coder(longest, mean, np.column_stack(columns)[:, :BITS])


def _matrix(column) -> np.ndarray:
    rows = [np.frombuffer(x, np.float64) for x in column]
    return np.stack(rows) if rows else np.empty((0, 1))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v, length of the rows that take part."""
    rows = df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("largest", largest).filter("largest > 0")
    share = F.aggregate("v", F.lit(0.0), lambda t, x: t + (x / F.col("largest")) * (x / F.col("largest")))
    return rows.select("vec_id", "v", F.least(F.col("largest") * F.sqrt(share), F.lit(float(np.finfo(float).max))).alias("length"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("v")
        packed = [np.asarray(x, np.float64).tobytes() for x in lists.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary()), batch.column("length")], ["vec_id", "vector", "length"])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, smaller ids first among equal ones."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))[:k]


def _exact(queries: list[tuple[int, bytes]], k: int):
    """Nearest rows of every batch for some queries, by comparing all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector").to_pylist())
            out = []
            for query, vector in queries:
                other = np.flatnonzero(ids != query)
                scores = _products(rows[other], np.frombuffer(vector, np.float64)) if len(other) else np.empty(0)
                out += [(query, int(ids[other[j]]), float(scores[j])) for j in _best(ids[other], scores, k)]
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.float64())})

    return run


_SCORED = "query_id bigint, vec_id bigint, score double"


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_neighbours(rows: DataFrame, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """The true neighbours of a bounded list of queries among all rows of ``usable``'s packed form."""
    return _first(rows.mapInArrow(_exact(queries, k), _SCORED), k)


def _radius(rows: DataFrame, probes: list[tuple[int, bytes]], coder: Coder, k: int) -> int:
    near = exact_neighbours(rows, probes, k).join(rows.select("vec_id", "vector"), "vec_id").select("query_id", "vector").toPandas()
    if near.empty:
        return BITS
    known = dict(probes)
    left = coder.codes(_matrix([known[q] for q in near["query_id"]]), query=True)
    right = coder.codes(_matrix(near["vector"]), query=False)
    return int(np.quantile(np.bitwise_count(left ^ right).sum(axis=1), COVER, method="higher"))


def _search(coder: Coder, radius: int, k: int):
    changes = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= radius // PARTS)

    def run(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if index.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, rows, asked = index["vec_id"].to_numpy(), _matrix(index["vector"]), _matrix(queries["vector"])
        codes = coder.codes(rows, query=False)
        whole = np.ascontiguousarray(codes).view(np.uint64)[:, 0]
        tables = []
        for part in range(PARTS):
            order = np.argsort(codes[:, part], kind="stable")
            tables.append((order, np.searchsorted(codes[order, part], np.arange(257))))
        lists: dict[tuple[int, int], np.ndarray] = {}

        def probed(part: int, value: int) -> np.ndarray:
            """Rows whose substring is within the allowed errors of ``value``."""
            if (part, value) not in lists:
                order, at = tables[part]
                lists[part, value] = np.concatenate([order[at[v] : at[v + 1]] for v in (value ^ changes).tolist()])
            return lists[part, value]

        out = []
        for query, vector, code in zip(queries["vec_id"].tolist(), asked, coder.codes(asked, query=True)):
            met = np.full(len(ids), radius >= BITS)
            for part in range(PARTS if radius < BITS else 0):
                met[probed(part, int(code[part]))] = True
            near = np.flatnonzero(met)
            near = near[(np.bitwise_count(whole[near] ^ code.view(np.uint64)[0]) <= radius) & (ids[near] != query)]
            scores = _products(rows[near], vector)
            best = _best(ids[near], scores, k)
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][best], "score": scores[best]}))
        return pd.concat(out)

    return run


def neighbours(df: DataFrame, key: str, vector: str, is_query: Column, *, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that satisfies ``is_query`` (over vec_id)."""
    fine = usable(df, key, vector)
    lengths = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    schema = "vec_id bigint, vector binary, length double"
    fine = fine.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))
    rows = cut_lineage(fine.mapInArrow(_pack, schema), "vectors")
    total, longest = rows.agg(F.count(F.lit(1)), F.max("length")).first()
    if not total:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    share = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(share * total < SAMPLE).orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toPandas()
    coder = learn(_matrix(sample["vector"]), float(longest))
    asked = rows.filter(is_query)
    chosen = asked.orderBy(F.xxhash64(F.lit(6), "vec_id"), "vec_id").limit(PROBES).collect()
    radius = _radius(rows, [(r["vec_id"], bytes(r["vector"])) for r in chosen], coder, k)

    n_queries = asked.count()
    shards, blocks = -(-total // SHARD_ROWS), max(1, -(-n_queries // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")

    def search(asked: DataFrame, blocks: int, radius: int) -> DataFrame:
        index = rows.select("vec_id", "vector", place(shards, 1).alias("shard"), every(blocks).alias("block"))
        queries = asked.select("vec_id", "vector", place(blocks, 2).alias("block"), every(shards).alias("shard"))
        met = index.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(_search(coder, radius, k), _SCORED)
        return cut_lineage(_first(met, k).select("query_id", "rank", "vec_id", "score"), "found")

    found = search(asked, blocks, radius)
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    lacking = cut_lineage(asked.join(full, "vec_id", "left_anti"), "lacking")
    n_lacking = lacking.count() if radius < BITS else 0
    if not n_lacking:
        return found
    again = search(lacking, -(-n_lacking // QUERY_ROWS), BITS)
    kept = found.join(lacking.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
    return kept.select(found.columns).union(again)
