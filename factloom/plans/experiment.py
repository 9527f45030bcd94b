"""Evaluation runs: variants x seeds x examples, resumable, with aggregates."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas as S
from factloom.operators import integrity, packaging, stats
from factloom.plans import pipeline as P
from factloom.session import cut_lineage
from factloom.sources import readers, sinks

GOLD_HINTS = ("gold", "answer", "label", "target", "reference")


@dataclass(frozen=True)
class Experiment:
    name: str
    output: str
    variants: tuple[str, ...] = ("passage_rag", "claim_only_rag", "full_graph")
    seeds: tuple[int, ...] = (42,)
    settings: P.Settings = field(default_factory=P.Settings)
    overrides: dict[str, dict] = field(default_factory=dict)
    enforce_fairness: bool = True


def fairness_issues(experiment: Experiment) -> list[str]:
    """Hidden differences between variants, and names that suggest tuning."""
    issues = []
    if experiment.enforce_fairness:
        for setting in ("generator", "top_k", "budget"):
            values = {str(v[setting]) for v in experiment.overrides.values() if setting in v}
            if values:
                issues.append(f"{setting} differs between variants: {sorted(values)}")
    if "tuned" in experiment.name.lower():
        issues.append(f"experiment name {experiment.name!r} suggests test-set tuning")
    return issues


def gold_parameters(names: Sequence[str]) -> list[str]:
    """Parameters of a system function that look like gold data."""
    return [n for n in names if any(hint in n.lower() for hint in GOLD_HINTS)]


def run(spark: SparkSession, experiment: Experiment, examples: DataFrame, *, resume: bool = False) -> DataFrame:
    """Run what is missing, append result rows and return all of them.

    A failed example stays in the log as a failed row. With ``resume``, finished
    (variant, seed, example) keys are skipped by an anti join.
    """
    unknown = set(experiment.variants) - set(P.VARIANTS)
    if unknown:
        raise KeyError(f"unknown variants {sorted(unknown)}; known: {sorted(P.VARIANTS)}")
    issues = fairness_issues(experiment)
    if issues and experiment.enforce_fairness:
        raise ValueError("fairness violations: " + "; ".join(issues))
    log = f"{experiment.output}/results"
    planned = stats.plan_runs(examples.select("example_id"), experiment.variants, experiment.seeds)
    if resume:
        done, _ = readers.results_log(spark, log)
        planned = stats.remaining_work(planned, done)
    planned = cut_lineage(planned, "planned")
    queries = examples.select(F.col("example_id").alias("query_id"), F.col("question").alias("text"))
    gold = examples.select(F.col("example_id").alias("query_id"), "answers", "gold_source_ids", "gold_available")
    todo = planned.select(F.col("example_id").alias("query_id")).distinct()
    documents = readers.example_documents(examples).join(todo, "query_id", "left_semi")
    evidence = P.retrieve_own_documents(documents, queries.join(todo, "query_id", "left_semi"), experiment.settings)
    for name in experiment.variants:
        work = planned.filter(F.col("variant") == name)
        if work.isEmpty():
            continue
        started = time.perf_counter()
        rows = cut_lineage(variant_results(evidence, P.VARIANTS[name], gold, experiment.settings), "results")
        # a batch has no latency per example; this is its share of the stage time
        spent = (time.perf_counter() - started) * 1000 / max(rows.count(), 1)
        complete = work.join(rows, "example_id").select(
            "example_id", "variant", "seed", "answer", "citations", "evidence_source_ids", "metrics",
            F.create_map().cast("map<string,int>").alias("counts"), F.lit(spent).alias("latency_ms"),
            F.lit(None).cast("bigint").alias("peak_memory_kb"), "failed", "error", "warnings",
        )
        sinks.append_results(complete, log)
    return readers.results_log(spark, log)[0]


def variant_results(evidence: P.Evidence, variant: P.Variant, gold: DataFrame, settings: P.Settings, **options) -> DataFrame:
    """Metric rows of one variant. Gold data only meets finished answers."""
    packs = cut_lineage(P.run_variant(evidence, variant, settings, **options), "packages")
    answers = cut_lineage(packaging.generate(packs), "answers")
    return P.example_metrics(answers, packs, gold)


def write_artifacts(spark: SparkSession, experiment: Experiment, examples: DataFrame, results: DataFrame) -> None:
    """Manifest, per-seed aggregates, seed aggregates, warnings and failures."""
    out = experiment.output
    means = stats.variant_seed_means(stats.long_metrics(results))
    sinks.write_json(means.join(stats.run_counts(results), ["variant", "seed"]), f"{out}/aggregate")
    sinks.write_json(stats.aggregate_seeds(means), f"{out}/seed_aggregate")
    sinks.write_json(stats.run_warnings(results), f"{out}/warnings")
    sinks.write_json(results.filter("failed").select("variant", "seed", "example_id", "error"), f"{out}/failures")
    content = examples.select(
        "example_id", "question", F.to_json("documents").alias("content"), "split", F.col("gold_available").alias("has_gold")
    )
    sinks.write_json(integrity.issues(content), f"{out}/integrity")
    content_of_run = {
        "experiment": asdict(experiment),
        "schema": S.RESULTS,
        "fingerprint": integrity.fingerprint(examples, "example_id", "question").first()["fingerprint"],
        "spark": spark.version,
    }
    sinks.write_manifest(spark, f"{out}/manifest", content_of_run)


def compare(results: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """Paired comparison of two variants with a bootstrap interval."""
    rows = stats.long_metrics(results).filter(F.col("metric") == metric)
    both, _ = stats.paired(rows.groupBy("variant", "example_id").agg(F.avg("value").alias("value")), a, b)
    both = both.withColumn("metric", F.lit(metric))
    interval = stats.bootstrap_ci(both, ["metric"], "delta", "example_id")
    return stats.comparison(both).withColumn("metric", F.lit(metric)).join(interval.drop("n"), "metric")


def inspect_example(results: DataFrame, example_id: str) -> DataFrame:
    return results.filter(F.col("example_id") == example_id)
