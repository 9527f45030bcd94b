"""Evidence graphs of many queries as a versioned snapshot.

Claims and relations lie in chunks, each an array of objects in a VARIANT column, so that no graph is one row however large
it is. A header, written last, names the version, the columns and the number of rows and chunks; a snapshot without one, of another
version or with lost rows is refused.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.scale import lookup_join

VERSION = 2
IDS = {"claims": "claim_id", "relations": "relation_id"}
_HEADER = "version int, kind string, columns string, rows bigint, chunks bigint"


def _chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of a query dealt by the hash of their id to as many chunks as ``size`` rows each take on average."""
    counts = df.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    dealt = df.select("query_id", F.xxhash64(key).alias("_h"), F.struct(*df.columns).alias("_row"))
    dealt = lookup_join(dealt, counts, ["query_id"], small_is_bounded=False, salt_by=F.col("_h"))
    chunk = F.pmod("_h", F.ceil(F.col("_n") / size))
    found = dealt.groupBy("query_id", chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.collect_list("_row").alias("_rows"))
    return found.select("query_id", "chunk", "n", F.to_variant_object("_rows").alias("body"))


def write_graph(claims: DataFrame, relations: DataFrame, path: str, *, size: int = 1000, version: int = VERSION) -> None:
    """Write a snapshot to a new folder. Ids are unique within a query, query ids not null."""
    spark = claims.sparkSession
    header = []
    for kind, df in (("claims", claims), ("relations", relations)):
        where = f"{path}/{kind}"
        _chunks(df, IDS[kind], size).write.parquet(where)
        total = spark.read.parquet(where).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("chunks")).first()
        header.append((version, kind, df.schema.simpleString(), total["rows"], total["chunks"]))
    spark.createDataFrame(header, _HEADER).coalesce(1).write.json(f"{path}/header")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Claims and relations of a snapshot, with the columns they were written with."""
    try:
        header = {r["kind"]: r for r in spark.read.schema(_HEADER).json(f"{path}/header", mode="FAILFAST").collect()}
    except AnalysisException as error:
        raise ValueError(f"no graph snapshot at {path}") from error
    return _read_kind(spark, path, header, "claims"), _read_kind(spark, path, header, "relations")


def _read_kind(spark: SparkSession, path: str, header: dict, kind: str) -> DataFrame:
    about = header.get(kind)
    if about is None:
        raise ValueError(f"the graph snapshot at {path} lists no {kind}")
    if about["version"] != VERSION:
        raise ValueError(f"the graph snapshot at {path} has version {about['version']}, not {VERSION}")
    chunks = spark.read.parquet(f"{path}/{kind}")
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("chunks")).first()
    if (total["rows"], total["chunks"]) != (about["rows"], about["chunks"]):
        raise ValueError(f"the graph snapshot at {path} holds {total['rows']} {kind} in {total['chunks']} chunks, not {about['rows']} in {about['chunks']}")
    whole = F.variant_get("body", "$", f"array<{about['columns']}>")
    checked = F.when(F.assert_true(F.size(whole) == F.col("n"), F.lit("a chunk of the graph snapshot lost rows")).isNull(), whole)
    return chunks.select(F.explode(checked).alias("_row")).select("_row.*")
