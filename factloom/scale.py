"""Helpers that keep joins, ranks and running sums safe under skewed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.session import cut_lineage

BROADCAST_ROWS = 200_000
SALTS = 32
#: Value ranges of a running total: enough for about RANGE_ROWS rows each.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1_000_000, 16, 512


def within_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` is proven to hold at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


#: Input that one core reads in a few seconds.
BYTES_PER_CORE = 32 << 20


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal a small scan over the cores by ``key``: a small file may be one split. Larger scans have splits enough."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan if size > cores * BYTES_PER_CORE else scan.repartition(cores, key)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Add ``number``: the row's place in the order, from 0, without gathering the rows in one task.

    Rows are sorted by ranges and written with their partition and place in it; the sizes of the partitions give
    each one's first number.
    """
    place = F.monotonically_increasing_id()
    rows = df.orderBy(order).select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    rows = cut_lineage(rows, "numbered")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    firsts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(F.broadcast(firsts), "_part").withColumn("number", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def salted_copies(df: DataFrame, salts: int) -> DataFrame:
    """One copy of each row per salt, in ``_salt``."""
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    return df.withColumn("_salt", F.explode(every))


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    small_is_bounded: bool,
    salt_by: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table with a lookup table whose keys may be hot in ``big``.

    A lookup with a proven bound is broadcast. Otherwise both sides shuffle on the
    key plus a salt, so one hot key is spread over ``salts`` tasks; ``salt_by`` is
    the deterministic expression that picks a row's salt.
    """
    keys = list(on)
    if small_is_bounded:
        return big.join(F.broadcast(small), keys, how)
    salt = F.pmod(F.xxhash64(salt_by if salt_by is not None else F.struct(*big.columns)), F.lit(salts))
    return big.withColumn("_salt", salt).join(salted_copies(small, salts), [*keys, "_salt"], how).drop("_salt")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows per key with a 0-based ``rank``.

    Spark pushes the rank filter below the shuffle (WindowGroupLimit), so each
    task sends at most ``n`` rows per key, however hot the key is.
    """
    if n < 0:
        raise ValueError(f"top_k must be >= 0, got {n}")
    w = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return ranked.withColumn(rank, F.col("_rn") - 1).drop("_rn")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    weight: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over earlier rows of the same key.

    ``order`` must be numeric and unique per key. Rows are cut into value ranges
    taken from the data, ranges are summed first, and the window only sorts
    inside one (key, range), so a key that holds most rows is still spread.
    """
    buckets = min(MOST_RANGES, max(LEAST_RANGES, df.count() // RANGE_ROWS))
    probabilities = [i / buckets for i in range(1, buckets)]
    bounds = df.select(F.percentile_approx(order, probabilities, F.lit(10 * MOST_RANGES)).alias("b")).first()["b"]
    edges = sorted({float(b) for b in bounds}) if bounds else []
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(order).cast("double"))) if edges else F.lit(0)
    rows = df.withColumn("_bucket", bucket).withColumn("_weight", weight)
    ranges = rows.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_range"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_range").over(before), F.lit(0))).drop("_range")
    inside = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    joined = summed.join(offsets, [*keys, "_bucket"])
    return joined.withColumn(out, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside", "_bucket", "_weight")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key.

    Works on the histogram of distinct values (combined map-side) and a bucketed
    running count instead of gathering a key's values in one task.
    """
    keys = list(keys)
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    hist = cut_lineage(hist, "histogram")  # read several times
    placed = running_total(hist, keys, value, F.col("_n"), "_before")
    totals = hist.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rows = placed.join(totals, keys)
    aggs = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n"))
        low_value = F.max(F.when(holds(low), F.col(value)))
        high_value = F.max(F.when(holds(high), F.col(value)))
        share = F.max(position - low)
        aggs.append((low_value + (high_value - low_value) * share).alias(name))
    return rows.groupBy(*keys).agg(*aggs)
