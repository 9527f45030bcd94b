"""Stores that notice damage and graph snapshots."""

import glob
import uuid

import pytest
from pyspark.sql import functions as F

from factloom.plans.catalog_store import damage
from factloom.session import shared_dir
from factloom.sources import snapshots, store


def fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def compute(df):
    return df.select("key", F.length("text").cast("bigint").alias("size"))


def texts(spark, *values):
    return spark.createDataFrame([(v, None if v is None else v * 2) for v in values], "key string, text string")


def sizes(probe):
    return sorted((r["key"], r["size"]) for r in probe.rows.collect())


def outcomes(probe):
    return {r["key"]: (r["hit"], r["damaged"]) for r in probe.outcomes.collect()}


def test_hits_misses_repeats_and_nulls(spark):
    where = store.Store(fresh(spark, "store"), digits=1)
    first = store.lookup(where, texts(spark, "a", "bb", "a", None, ""), compute)
    assert sizes(first) == [("", 0), ("a", 2), ("bb", 4)] and first.counts().first() == (0, 3, 0)
    second = store.lookup(where, texts(spark, "bb", "ccc"), compute)
    assert sizes(second) == [("bb", 4), ("ccc", 6)]
    assert outcomes(second) == {"bb": (True, False), "ccc": (False, False)}
    empty = store.lookup(where, texts(spark, "a").limit(0), compute)
    assert sizes(empty) == [] and empty.counts().first() == (0, 0, 0)


@pytest.mark.parametrize("fault", ["altered", "cut"])
def test_a_damaged_part_is_set_aside_and_computed_again(spark, fault):
    where = store.Store(fresh(spark, "store"), digits=1)
    keys = [f"k{i}" for i in range(40)]
    before = store.lookup(where, texts(spark, *keys), compute)
    part = before.outcomes.first()["store_part"]
    if fault == "altered":
        damage(where, spark, part, {"size": F.col("size") + 1})
    else:
        for name in glob.glob(f"{where.path.removeprefix('file:')}/entries/*/store_part={part}/*.parquet"):
            with open(name, "r+b") as file:
                file.truncate(20)
    after = store.lookup(where, texts(spark, *keys), compute)
    assert sizes(after) == sorted((k, 2 * len(k)) for k in keys)
    here = {r["key"] for r in after.outcomes.filter(F.col("store_part") == part).collect()}
    assert here and outcomes(after) == {k: (k not in here, k in here) for k in keys}
    again = store.lookup(where, texts(spark, *keys), compute)  # the new batch is sound, the old one stays aside
    assert again.counts().first() == (40, 0, 0) and sizes(again) == sizes(after)


def test_unequal_rows_and_columns_are_refused(spark):
    where = store.Store(fresh(spark, "store"), digits=1)
    store.append(where, spark.createDataFrame([("a", 1)], "key string, size bigint"))
    store.append(where, spark.createDataFrame([("a", 2)], "key string, size bigint"))
    with pytest.raises(ValueError, match="unequal"):
        store.lookup(where, texts(spark, "a"), compute)
    store.append(where, spark.createDataFrame([("b", "x")], "key string, other string"))
    with pytest.raises(ValueError, match="different columns"):
        store.lookup(where, texts(spark, "b"), compute)


CLAIMS = "query_id string, claim_id string, text string, tags array<string>, score double, at timestamp_ntz"
RELATIONS = "query_id string, relation_id string, weight double"


def graph(spark, n=50):
    claims = spark.sql(f"""SELECT CAST(id % 2 AS STRING) AS query_id, 'c' || id AS claim_id, IF(id % 7 = 0, NULL, 'tï"' || id) AS text,
      IF(id % 3 = 0, array(), array('x', NULL)) AS tags, id / 3 AS score, TIMESTAMP_NTZ'2024-01-02 03:04:05.000006' AS at FROM range({n})""")
    return claims, spark.createDataFrame([("0", "r1", 0.5), ("1", "r1", None)], RELATIONS)


@pytest.mark.parametrize("size", [1, 8, 1000])
def test_snapshot_round_trip(spark, size):
    claims, relations = graph(spark)
    path = fresh(spark, "graph")
    snapshots.write_graph(claims, relations, path, size=size)
    for found, given in zip(snapshots.read_graph(spark, path), (claims, relations), strict=True):
        assert found.columns == given.columns and [f.dataType for f in found.schema] == [f.dataType for f in given.schema]
        assert sorted(map(repr, found.collect())) == sorted(map(repr, given.collect()))
    if size == 8:
        assert spark.read.parquet(f"{path}/claims").count() > 4


def test_empty_old_and_damaged_snapshots(spark):
    claims, relations = graph(spark)
    path = fresh(spark, "graph")
    snapshots.write_graph(claims.limit(0), relations.limit(0), path)
    assert [df.count() for df in snapshots.read_graph(spark, path)] == [0, 0]
    path = fresh(spark, "graph")
    snapshots.write_graph(claims, relations, path, version=1)
    with pytest.raises(ValueError, match="version 1"):
        snapshots.read_graph(spark, path)
    path = fresh(spark, "graph")
    snapshots.write_graph(claims, relations, path)
    spark.read.parquet(f"{path}/claims").limit(1).write.mode("append").parquet(f"{path}/claims")
    with pytest.raises(ValueError, match="chunks"):
        snapshots.read_graph(spark, path)
    with pytest.raises(ValueError, match="no graph snapshot"):
        snapshots.read_graph(spark, path + "-none")
