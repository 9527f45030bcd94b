"""A keyed store of computed rows that notices damage.

Rows lie in folders by batch and by the first digits of the key's hash. Every folder has a row in ``sums`` with the number
of its rows and a checksum that does not depend on their order. A probe reads only the folders its keys can lie in, checks
them, sets damaged ones aside in ``quarantine`` and computes their keys again, so a damaged row is never returned.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from factloom.session import cut_lineage

PLACE = ["store_part", "store_batch"]


@dataclass(frozen=True)
class Store:
    """``digits`` hash digits name a folder, so a batch has at most ``16 ** digits`` of them."""

    path: str
    key: str = "key"
    digits: int = 2

    def part(self) -> Column:
        # the letter keeps folder names from being read as numbers
        return F.concat(F.lit("p"), F.substring(F.md5(F.col(self.key)), 1, self.digits))


@dataclass(frozen=True)
class Probe:
    """``rows`` of the wanted keys; ``outcomes`` has key, store_part, hit and damaged (its folder was set aside in this probe)."""

    rows: DataFrame
    outcomes: DataFrame

    def counts(self) -> DataFrame:
        """Hits, misses and keys in damaged folders."""
        return self.outcomes.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if("damaged").alias("damaged"))


def _read(spark: SparkSession, path: str, schema: TT.StructType | None = None) -> DataFrame | None:
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _sums(rows: DataFrame) -> DataFrame:
    values = sorted(c for c in rows.columns if c not in PLACE)
    return rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*values)).alias("checksum"))


def append(store: Store, rows: DataFrame) -> DataFrame:
    """Write a batch of rows and then its sums; a batch that stopped in between has no sums and is never read."""
    spark, batch = rows.sparkSession, f"b{uuid.uuid4().hex}"
    placed = rows.withColumns({"store_part": store.part(), "store_batch": F.lit(batch)})
    placed.hint("rebalance", "store_part").write.mode("append").partitionBy("store_batch", "store_part").parquet(f"{store.path}/entries")
    columns = rows.schema.json()
    written = _entries(store, spark, columns).filter(F.col("store_batch") == batch)
    _sums(written).withColumn("columns", F.lit(columns)).write.mode("append").parquet(f"{store.path}/sums")
    return written.drop(*PLACE)


def _entries(store: Store, spark: SparkSession, columns: str) -> DataFrame | None:
    schema = TT.StructType.fromJson(json.loads(columns)).add("store_batch", "string").add("store_part", "string")
    return _read(spark, f"{store.path}/entries", schema)


def _checked(store: Store, spark: SparkSession, parts: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of the sound folders among ``parts``, and the folders that turn out damaged, which are set aside."""
    sums = _read(spark, f"{store.path}/sums")
    if sums is None:
        return None, None
    kinds = [r["columns"] for r in sums.select("columns").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError(f"the store {store.path} holds rows of different columns")
    aside = _read(spark, f"{store.path}/quarantine")
    listed = sums.filter(F.col("store_part").isin(parts))
    if aside is not None:
        listed = listed.join(aside, PLACE, "left_anti")
    entries = _entries(store, spark, kinds[0]) if kinds else None
    if entries is None:
        return None, listed.select(*PLACE).distinct() if kinds else None
    entries = entries.filter(F.col("store_part").isin(parts))
    found = _sums(entries).withColumnsRenamed({"n": "found_n", "checksum": "found_checksum"})
    same = F.col("n").eqNullSafe(F.col("found_n")) & F.col("checksum").eqNullSafe(F.col("found_checksum"))
    state = cut_lineage(listed.join(found, PLACE, "left").withColumn("sound", same), "store-state")
    damaged = state.filter(~F.col("sound")).select(*PLACE, "n", "found_n")
    if not damaged.isEmpty():
        damaged.write.mode("append").parquet(f"{store.path}/quarantine")
    return entries.join(state.filter("sound").select(*PLACE), PLACE, "left_semi").drop(*PLACE), damaged


def lookup(store: Store, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> Probe:
    """Rows of the wanted keys: stored ones where their folder is sound, others computed in one batch and stored.

    ``compute`` takes the missing rows of ``wanted``, one for each key, and returns the key with its values. A key stands for its
    content: of several wanted rows with a key any is taken, a null key has no row, and unequal stored rows of a key fail the probe.
    """
    spark, key = wanted.sparkSession, store.key
    distinct = cut_lineage(wanted.filter(F.col(key).isNotNull()).dropDuplicates([key]), "wanted")
    keys = distinct.select(key, store.part().alias("store_part"))
    parts = [r["store_part"] for r in keys.select("store_part").distinct().collect()]  # at most 16 ** digits
    stored, damaged = _checked(store, spark, parts)
    if stored is None:
        rows, missing = None, distinct
        outcomes = keys.withColumn("hit", F.lit(False))
    else:
        rows = cut_lineage(stored.join(keys.select(key), key, "left_semi").distinct(), "known")
        if not rows.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"the store {store.path} holds unequal rows of one key")
        missing = distinct.join(rows.select(key), key, "left_anti")
        outcomes = keys.join(rows.select(key, F.lit(True).alias("hit")), key, "left").na.fill(False, ["hit"])
    if damaged is None:
        outcomes = outcomes.withColumn("damaged", F.lit(False))
    else:
        broken = damaged.select("store_part", F.lit(True).alias("damaged")).distinct()
        outcomes = outcomes.join(broken, "store_part", "left").na.fill(False, ["damaged"])
    fresh = append(store, compute(missing))
    return Probe(fresh if rows is None else rows.unionByName(fresh), outcomes.select(key, "store_part", "hit", "damaged"))
