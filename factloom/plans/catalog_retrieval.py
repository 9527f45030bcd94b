"""Queries that rank passages: sparse, dense, lexical, fused, reranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import chunking, retrieval
from factloom.plans import oracle as O
from factloom.plans.registry import benchmark_queries, documents, longs, query, table
from factloom.scale import spread
from factloom.session import cut_lineage

_COLUMNS = "query_id, passage_id, score, rank"


def whole(spark: SparkSession, folder: str) -> DataFrame:
    return spread(chunking.whole_documents(documents(spark, folder)), "passage_id")


def _ranked(hits: DataFrame, *more: str) -> DataFrame:
    return longs(hits.select("query_id", "passage_id", "score", "rank", *more), "rank")


@query("bm25_topk", O.chain(O.DOCS, O.QUERIES, O.WHOLE, O.bm25(5), final=f"SELECT {_COLUMNS} FROM bm25_hits"))
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(retrieval.bm25_top_k(whole(spark, folder), benchmark_queries(spark, folder), 5))


@query(
    "bm25_passages",
    O.chain(*O.EVIDENCE, recursive=True, final="SELECT query_id, passage_id, score, rank, md5(text) AS text FROM hits"),
)
def bm25_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: chunk the corpus, rank passages, return them with text."""
    passages = chunking.sentence_chunks(documents(spark, folder))
    hits = retrieval.bm25_top_k(passages, benchmark_queries(spark, folder), 4)
    return _ranked(hits.join(passages.select("passage_id", F.md5("text").alias("text")), "passage_id"), "text")


@query(
    "lexical_topk",
    O.chain(
        O.DOCS, O.QUERIES, O.WHOLE,
        f"""
q AS (SELECT query_id, {O.token_set('text')} AS t FROM queries),
p AS (SELECT passage_id, {O.token_set('text')} AS t FROM passages),
qx AS (SELECT query_id, len(t) AS n, unnest(t) AS term FROM q),
px AS (SELECT passage_id, len(t) AS n, unnest(t) AS term FROM p),
met AS (SELECT query_id, passage_id, any_value(qx.n) AS qn, any_value(px.n) AS pn, count(*) AS c FROM qx JOIN px USING (term) GROUP BY 1, 2),
scores AS (
  SELECT q.query_id, p.passage_id, coalesce(round(c::DOUBLE / (qn + pn - c), 6), 0.0) AS score
  FROM q CROSS JOIN p LEFT JOIN met m ON m.query_id = q.query_id AND m.passage_id = p.passage_id
)""",
        final=f"""SELECT {_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) - 1 AS rank FROM scores) WHERE rank < 5""",
    ),
)
def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(retrieval.lexical_top_k(whole(spark, folder), benchmark_queries(spark, folder), 5))


_DENSE = [O.DOCS, O.QUERIES, O.WHOLE, O.hashed("passages", "passage_id"), O.hashed("queries", "query_id")]


@query("hashed_dense_topk", O.chain(*_DENSE, O.dense(5), final=f"SELECT {_COLUMNS} FROM dense_hits"))
def hashed_dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(retrieval.hashed_dense_top_k(whole(spark, folder), benchmark_queries(spark, folder), 5))


_CENTROIDS = """
items AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
means AS (SELECT label, i, round(avg(x), 6) AS x FROM items GROUP BY 1, 2),
centroids AS (SELECT label, list(x ORDER BY i) AS c FROM means GROUP BY label)
"""


def _centroids(spark: SparkSession, folder: str) -> DataFrame:
    """One query vector per label: the mean of its vectors, by coordinate."""
    rows = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return packed.select(F.col("label").alias("query_id"), F.transform("v", lambda s: s["x"]).alias("embedding"))


@query(
    "centroid_topk",
    O.chain(
        _CENTROIDS,
        """scores AS (SELECT c.label AS query_id, vec_id, round(list_cosine_similarity(c.c, e.embedding::DOUBLE[]), 6) AS score
           FROM centroids c, embeddings e)""",
        final="""SELECT query_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM scores) WHERE rank < 10""",
    ),
)
def centroid_topk(spark: SparkSession, folder: str) -> DataFrame:
    corpus = table(spark, folder, "embeddings").select("vec_id", "embedding")
    hits = retrieval.cosine_top_k(corpus, _centroids(spark, folder), 10, id_column="vec_id")
    return longs(hits, "rank")


@query(
    "label_cosine",
    O.chain(
        _CENTROIDS,
        final="""SELECT vec_id, e.label, round(list_cosine_similarity(c.c, e.embedding::DOUBLE[]), 6) AS cosine,
       round(sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings e JOIN centroids c USING (label)""",
    ),
)
def label_cosine(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.functions.vectors import cosine, l2_norm

    vectors = table(spark, folder, "embeddings")
    centers = _centroids(spark, folder).select(F.col("query_id").alias("label"), F.col("embedding").alias("c"))
    return vectors.join(centers, "label").select(
        "vec_id", "label", F.round(cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"),
        F.round(l2_norm(F.col("embedding")), 6).alias("norm"),
    )


_HYBRID = [*_DENSE, O.bm25(10), O.dense(10)]
_NORMALIZED = """
ranked_lists AS (
  SELECT *, 'bm25' AS component FROM bm25_hits UNION ALL BY NAME SELECT *, 'dense' AS component FROM dense_hits
),
bounds AS (SELECT query_id, component, min(score) AS low, max(score) AS high FROM ranked_lists GROUP BY 1, 2),
normalized AS (
  SELECT l.*, CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1.0 END AS normalized
  FROM ranked_lists l JOIN bounds USING (query_id, component)
)
"""


def _components(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    passages = whole(spark, folder)
    queries = benchmark_queries(spark, folder)
    return {
        "bm25": cut_lineage(retrieval.bm25_top_k(passages, queries, 10), "bm25"),
        "dense": cut_lineage(retrieval.hashed_dense_top_k(passages, queries, 10), "dense"),
    }


@query(
    "minmax_scores",
    O.chain(*_HYBRID, _NORMALIZED, final="SELECT component, query_id, passage_id, round(normalized, 6) AS normalized FROM normalized"),
)
def minmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    parts = [hits.withColumn("component", F.lit(name)) for name, hits in _components(spark, folder).items()]
    scaled = retrieval.min_max(parts[0].unionByName(parts[1]), ["query_id", "component"])
    return scaled.select("component", "query_id", "passage_id", F.round("normalized", 6).alias("normalized"))


_FUSED = f"""SELECT {_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) - 1 AS rank FROM fused) WHERE rank < 5"""


@query(
    "weighted_fusion",
    O.chain(
        *_HYBRID, _NORMALIZED,
        """fused AS (SELECT query_id, passage_id, round(sum(CASE component WHEN 'bm25' THEN 0.7 ELSE 0.3 END * normalized), 6) AS score
           FROM normalized GROUP BY 1, 2)""",
        final=_FUSED,
    ),
)
def weighted_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(retrieval.fuse_weighted(_components(spark, folder), {"bm25": 7, "dense": 3}, 5))


@query(
    "rrf_fusion",
    O.chain(
        *_HYBRID, _NORMALIZED,
        "fused AS (SELECT query_id, passage_id, round(sum(0.5 / (60 + rank + 1)), 8) AS score FROM ranked_lists GROUP BY 1, 2)",
        final=_FUSED,
    ),
)
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(retrieval.fuse_reciprocal(_components(spark, folder), {"bm25": 1, "dense": 1}, 5))


@query(
    "score_rerank",
    O.chain(
        *_HYBRID, _NORMALIZED,
        """merged AS (
  SELECT query_id, passage_id, max(CASE WHEN component = 'bm25' THEN score END) AS score FROM ranked_lists GROUP BY 1, 2
)""",
        final=f"""SELECT {_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, passage_id) - 1 AS rank FROM merged) WHERE rank < 15""",
    ),
)
def score_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Rerank the union of both lists by sparse score; dense-only hits go last."""
    parts = _components(spark, folder)
    union = parts["bm25"].withColumn("own", F.col("score")).unionByName(
        parts["dense"].withColumn("own", F.lit(None).cast("double"))
    )
    merged = union.groupBy("query_id", "passage_id").agg(F.max("own").alias("score"), F.min("rank").alias("rank"))
    return _ranked(retrieval.rerank_by_score(merged, 15))


@query(
    "retrieve_then_rerank",
    O.chain(
        O.DOCS, O.QUERIES, O.WHOLE, O.bm25(10),
        f"""rescored AS (
  SELECT h.query_id, h.passage_id, round({O.jaccard(O.token_set('p.text'), O.token_set('q.text'))}, 6) AS score
  FROM bm25_hits h JOIN passages p USING (passage_id) JOIN queries q USING (query_id)
)""",
        final=f"""SELECT {_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) - 1 AS rank FROM rescored) WHERE rank < 3""",
    ),
)
def retrieve_then_rerank(spark: SparkSession, folder: str) -> DataFrame:
    passages = whole(spark, folder)
    queries = benchmark_queries(spark, folder)
    hits = cut_lineage(retrieval.bm25_top_k(passages, queries, 10), "hits")
    best = retrieval.rerank_lexical(hits, passages, queries, 3)
    return _ranked(best.withColumn("score", F.col("rerank_score")))
