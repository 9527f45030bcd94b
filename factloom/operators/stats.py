"""Aggregation of result rows: seeds, comparisons, taxonomies, thresholds.

Result rows have ``variant, seed, example_id, failed, error`` and either a
``metrics`` map or one metric column; ``long_metrics`` turns the map into rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import metrics as M
from factloom.scale import exact_quantiles, running_total


def long_metrics(results: DataFrame) -> DataFrame:
    """One row per successful result and metric."""
    ok = results.filter(~F.col("failed"))
    return ok.select("variant", "seed", "example_id", F.explode("metrics").alias("metric", "value"))


def variant_seed_means(rows: DataFrame) -> DataFrame:
    """Mean of each metric per variant and seed over rows that have it."""
    return rows.groupBy("variant", "seed", "metric").agg(F.avg("value").alias("mean"))


def run_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("variant", "seed").agg(
        F.count(F.lit(1)).alias("num_examples"), F.count_if("failed").alias("num_failed")
    )


def run_warnings(results: DataFrame) -> DataFrame:
    """Distinct warnings of a run, ordered by the first example that raised each."""
    rows = results.select("variant", "seed", "example_id", F.posexplode("warnings").alias("_p", "warning"))
    return rows.groupBy("variant", "seed", "warning").agg(F.min(F.struct("example_id", "_p")).alias("first"))


def aggregate_seeds(means: DataFrame) -> DataFrame:
    """Mean, deviation and median over seeds, for metrics every seed has."""
    seeds = means.groupBy("variant").agg(F.count_distinct("seed").alias("_seeds"))
    per = means.groupBy("variant", "metric").agg(
        F.count_distinct("seed").alias("_n"),
        F.avg("mean").alias("mean"),
        F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("std"),
        F.median("mean").alias("median"),
    )
    return per.join(seeds, "variant").filter(F.col("_n") == F.col("_seeds")).drop("_n", "_seeds")


def describe(rows: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float] = (5, 50, 95)) -> DataFrame:
    """Mean, sample deviation (0 below two values) and exact percentiles."""
    basics = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev")
    )
    quantiles = exact_quantiles(rows, keys, value, {f"p{p:g}": p / 100 for p in percentiles})
    return basics.join(quantiles, list(keys))


def coverage_adjusted(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum over successes divided by all rows, so failures count as zero."""
    total = F.sum(F.when(~F.col("failed"), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0)))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(~F.col("failed"), F.col(value))).alias("success_mean"),
        (total / F.count(F.lit(1))).alias("adjusted_mean"),
    )


def group_summary(rows: DataFrame, keys: Sequence[str], value: str, latency: str, memory: str) -> DataFrame:
    """Failure rate, metric means, latency and memory in one aggregate."""
    ok = F.when(~F.col("failed"), F.col(value))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        F.count_if("failed").alias("failed"),
        (F.count_if("failed") / n).alias("failure_rate"),
        F.avg(ok).alias("metric_mean"),
        F.count(ok).alias("metric_n"),
        (F.sum(ok) / n).alias("metric_adjusted"),
        F.avg(latency).alias("latency_mean"),
        F.stddev_samp(latency).alias("latency_stdev"),
        F.avg(memory).alias("memory_mean"),
        F.max(memory).alias("memory_max"),
    )


def failure_taxonomy(results: DataFrame, model: str) -> DataFrame:
    """Failure counts per model and category with an overall line per category."""
    failed = results.filter("failed").select(model, M.error_category(F.col("error")).alias("category"))
    return (
        failed.rollup("category", model)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("category").isNotNull())
        .select(F.coalesce(model, F.lit("overall")).alias(model), "category", "n")
    )


def cited_id_patterns(results: DataFrame, model: str) -> DataFrame:
    """What unknown citation ids look like, from the error text."""
    listed = F.regexp_extract("error", r"unknown claim id\(s\): \[(.*)\]", 1)
    ids = F.regexp_extract_all(listed, F.lit("'([^']*)'"), F.lit(1))
    rows = results.filter("failed").select(model, F.explode(ids).alias("cited"))
    return rows.groupBy(model, M.citation_id_pattern(F.col("cited")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def composition(relations: DataFrame) -> DataFrame:
    """Edge counts by type with their share of all edges."""
    per = relations.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))
    total = relations.agg(F.count(F.lit(1))).scalar()
    return per.withColumn("total", total).select("relation_type", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"))


def threshold_grid(samples: DataFrame, grid: Sequence[float] = (0.4, 0.5, 0.6, 0.7), duplicate: float = 0.8, floor: float = 0.8) -> DataFrame:
    """Macro F1 for every pair of thresholds over ``gold, entail, contra`` rows.

    Equal samples are counted first and only the distinct ones meet the grid, so
    the table is read once and nothing is multiplied by the grid size.
    """
    distinct = samples.groupBy("gold", "entail", "contra").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(e).alias("entail_thr"), F.lit(c).alias("contra_thr")) for e in grid for c in grid])
    rows = distinct.select("*", F.explode(cells).alias("_g")).select("gold", "entail", "contra", "n", "_g.*")
    predicted = (
        F.when(F.col("entail") >= duplicate, "neutral")
        .when(F.col("entail") >= F.col("entail_thr"), "supports")
        .when(F.col("contra") >= F.col("contra_thr"), "contradicts")
        .otherwise("neutral")
    )
    rows = rows.withColumn("predicted", predicted)
    classes = ("supports", "contradicts", "neutral")
    counts = []
    for c in classes:
        is_gold, is_pred = F.col("gold") == c, F.col("predicted") == c
        counts += [
            F.sum(F.when(is_gold & is_pred, F.col("n")).otherwise(0)).alias(f"tp_{c}"),
            F.sum(F.when(~is_gold & is_pred, F.col("n")).otherwise(0)).alias(f"fp_{c}"),
            F.sum(F.when(is_gold & ~is_pred, F.col("n")).otherwise(0)).alias(f"fn_{c}"),
        ]
    table = rows.groupBy("entail_thr", "contra_thr").agg(*counts)
    for c in classes:
        tp, fp, fn = F.col(f"tp_{c}"), F.col(f"fp_{c}"), F.col(f"fn_{c}")
        p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))
        r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(1.0))
        table = table.withColumn(f"p_{c}", p).withColumn(f"r_{c}", r)
        p, r = F.col(f"p_{c}"), F.col(f"r_{c}")
        table = table.withColumn(f"f_{c}", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    macro = (F.col("f_supports") + F.col("f_contradicts") + F.col("f_neutral")) / 3
    return table.select(
        "entail_thr",
        "contra_thr",
        F.round(macro, 4).alias("macro_f1"),
        F.round("p_supports", 4).alias("support_precision"),
        F.round("p_contradicts", 4).alias("contradiction_precision"),
        ((F.col("p_supports") >= floor) & (F.col("p_contradicts") >= floor)).alias("meets_floor"),
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """The best cell; one that meets the floor wins over one that does not."""
    key = F.struct("meets_floor", "macro_f1", -F.col("entail_thr"), -F.col("contra_thr"))
    return curve.agg(F.max_by(F.struct(*curve.columns), key).alias("_b")).select("_b.*")


def paired(rows: DataFrame, a: str, b: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows of two variants aligned by example, and the examples only one has."""
    left = rows.filter(F.col("variant") == a).select("example_id", F.col(value).alias("a"))
    right = rows.filter(F.col("variant") == b).select("example_id", F.col(value).alias("b"))
    both = left.join(right, "example_id").withColumn("delta", F.col("a") - F.col("b"))
    alone = left.join(right, "example_id", "full_outer").filter(F.col("a").isNull() | F.col("b").isNull())
    return both, alone.select("example_id", F.when(F.col("a").isNull(), b).otherwise(a).alias("only_in"))


def comparison(aligned: DataFrame) -> DataFrame:
    return aligned.agg(
        F.count(F.lit(1)).alias("n_paired"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg("delta").alias("mean_delta"),
    )


#: A Mersenne prime; draws are whole numbers below it, so that other engines can repeat them exactly.
DRAWS = (1 << 31) - 1


def poisson_steps() -> list[int]:
    """Draws from which on a row counts at least 1, 2, ... times; all that a draw below ``DRAWS`` can reach."""
    steps, total, term, k = [], 0.0, math.exp(-1.0), 0
    while True:
        total += term
        if int(total * DRAWS) >= DRAWS:
            return steps
        steps.append(int(total * DRAWS))
        k += 1
        term /= k


def bootstrap_ci(
    values: DataFrame,
    keys: Sequence[str],
    value: str,
    order: str,
    *,
    samples: int = 1000,
    seed: int = 0,
    confidence: float = 0.95,
) -> DataFrame:
    """Percentile bootstrap interval of the mean per group, by one estimator at every size.

    In replicate b a row counts as often as a Poisson(1) draw says, which resamples with replacement. The draw is x^5
    modulo ``DRAWS`` with x = (p + b q), where p and q come from the digest of the seed and ``order`` (unique within
    a group). Each task sums its rows' replicates, so nothing but sums is shuffled: ``samples`` rows per group and task.
    """
    keys = list(keys)
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(order).cast("string")))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % DRAWS
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = values.filter(F.col(value).isNotNull())
    drawn = rows.select(group.alias("group"), part(1).alias("p"), part(9).alias("q"), F.col(value).cast("double").alias("v"))
    steps = np.array(poisson_steps())

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(samples, dtype=np.int64)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            group, p, q, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "p", "q", "v"))
            names, at = np.unique(group.astype(str), return_inverse=True)
            for low in range(0, len(v), 2000):
                cut = slice(low, low + 2000)
                x = (p[cut, None] + number * q[cut, None]) % DRAWS
                x4 = x * x % DRAWS
                x4 = x4 * x4 % DRAWS
                times = np.searchsorted(steps, x4 * x % DRAWS, "right")
                for g in np.unique(at[cut]).tolist():
                    own = at[cut] == g
                    total = sums.setdefault(names[g], np.zeros((2, samples)))
                    total += np.stack([times[own].sum(axis=0), (times[own] * v[cut][own, None]).sum(axis=0)])
            if len(sums) * samples > 4_000_000:  # many groups: hand over what is there
                yield from flush(sums, number)
        yield from flush(sums, number)

    def flush(sums: dict[str, np.ndarray], number: np.ndarray) -> Iterator[pa.RecordBatch]:
        for name, total in sums.items():
            yield pa.RecordBatch.from_pydict({"group": pa.array([name] * len(number)), "b": number, "n": total[0], "s": total[1]})
        sums.clear()

    sums = drawn.mapInArrow(replicate, "group string, b bigint, n double, s double").groupBy("group", "b")
    means = sums.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m")).filter(F.col("m").isNotNull())
    alpha = (1 - confidence) / 2
    ends = means.groupBy("group").agg(F.percentile("m", F.lit(alpha)).alias("ci_low"), F.percentile("m", F.lit(1 - alpha)).alias("ci_high"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("group", group)
    return sizes.join(ends, "group").select(*keys, "n", "ci_low", "ci_high")


def best_by_mean(rows: DataFrame, keys: Sequence[str], candidate: str, value: str) -> DataFrame:
    """The candidate with the highest mean; equal means go to the smaller name."""
    means = rows.groupBy(*keys, candidate).agg(F.round(F.avg(value), 6).alias("mean"))
    ranked = F.struct((-F.col("mean")).alias("m"), F.col(candidate).alias("c"))
    return means.groupBy(*keys).agg(F.min(ranked).alias("_b")).select(
        *keys, F.col("_b.c").alias("best"), (-F.col("_b.m")).alias("mean")
    )


def identical_across_seeds(rows: DataFrame, keys: Sequence[str], seed: str, fingerprint: Column) -> DataFrame:
    """Did every seed of a group produce the same values?"""
    return rows.groupBy(*keys).agg(
        F.count_distinct(seed).alias("seeds"), (F.count_distinct(fingerprint) <= 1).alias("identical")
    )


def alternating_split(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Even positions of each category become dev, odd ones test."""
    placed = running_total(rows, [key], order, F.lit(1), "position")
    return placed.withColumn("split", F.when(F.pmod("position", F.lit(2)) == 0, "dev").otherwise("test"))


def stratified_sample(rows: DataFrame, stratum: str, row_id: str, quotas: dict[str, int], size: int, seed: int) -> DataFrame:
    """Seeded sample without replacement by stratum, topped up to ``size``.

    Rows are ordered by a seeded hash; the quota filter is pushed below the
    shuffle, so each task keeps at most one quota per stratum.
    """
    from factloom.scale import top_per_key

    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(row_id).cast("string"))))
    biggest = max([*quotas.values(), size])
    near = top_per_key(hashed, [stratum], [F.asc("_h"), F.asc(row_id)], biggest, "_r")
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for q in quotas.items() for x in q]), F.col(stratum)), F.lit(0))
    near = near.withColumn("_first", (F.col("_r") < quota))
    order = [F.desc("_first"), F.asc("_h"), F.asc(row_id)]
    return near.orderBy(*order).limit(size).drop("_h", "_r", "_first")


def remaining_work(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned (variant, seed, example) keys without a finished result."""
    keys = ["variant", "seed", "example_id"]
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def plan_runs(examples: DataFrame, variants: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Every variant and seed for every example."""
    return examples.select(
        F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"), "example_id"
    ).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def differing_examples(results: DataFrame, reference: str) -> DataFrame:
    """Examples a variant lacks or has in addition to the reference variant."""
    ids = results.select("variant", "example_id").distinct()
    base = ids.filter(F.col("variant") == reference).select("example_id", F.lit(1).alias("_base"))
    variants = ids.select("variant").distinct()
    names = F.array_sort(F.collect_set("variant"))
    table = variants.agg(names.alias("v")).scalar()
    expected = base.withColumn("variant", F.explode(table)).select("variant", "example_id")
    missing = expected.join(ids, ["variant", "example_id"], "left_anti").withColumn("issue", F.lit("missing"))
    extra = ids.join(base.select("example_id"), "example_id", "left_anti").select(
        "variant", "example_id", F.lit("extra").alias("issue")
    )
    return missing.unionByName(extra)


def cost_estimate(counts: DataFrame, *, pairs_per_example: int = 40, extract_s: float = 12.0, pair_s: float = 0.06, call_s: float = 1.6) -> DataFrame:
    """Rough dry-run cost from ``examples, variants, graph_variants`` rows."""
    n, v = F.col("examples"), F.col("variants")
    pairs = F.when(F.col("graph_variants") > 0, n * pairs_per_example).otherwise(F.lit(0))
    seconds = n * extract_s + pairs * pair_s + n * v * call_s
    return counts.select(
        "*",
        pairs.alias("classified_pairs"),
        (n * v).alias("generation_calls"),
        F.round(seconds / 3600, 2).alias("total_hours"),
        F.round((n + pairs + n * v) * 1024 / F.lit(1024.0**2), 1).alias("cache_mb"),
    )


def first_matches(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """For each named condition the smallest example id that meets it."""
    found = rows.agg(*[F.min(F.when(test, F.col("example_id"))).alias(name) for name, test in conditions.items()])
    return found.unpivot([], list(conditions), "picked_for", "example_id")
