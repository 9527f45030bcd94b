"""Queries over result rows: metrics, aggregates, comparisons, integrity.

Orders stand in for experiment results: priority is the variant, order year the
seed, customer the example, price the metric, and status F a failed run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import metrics as M
from factloom.operators import evaluation, integrity, stats
from factloom.plans import oracle as O
from factloom.plans.registry import longs, query, table
from factloom.scale import exact_quantiles
from factloom.session import cut_lineage


def results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("variant"),
        F.year("o_orderdate").cast("bigint").alias("seed"),
        F.col("o_custkey").alias("example_id"),
        F.col("o_totalprice").alias("value"),
        (F.col("o_orderstatus") == "F").alias("failed"),
        F.col("o_orderstatus").alias("status"),
    )


_R = """r AS (SELECT o_orderkey AS row_id, o_orderpriority AS variant, year(o_orderdate) AS seed, o_custkey AS example_id,
       o_totalprice AS value, o_orderstatus = 'F' AS failed, o_orderstatus AS status FROM orders)"""


def _r(final: str, *parts: str) -> str:
    return O.chain(_R, *parts, final=final)


def _rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- aggregates over results ---------------------------------------------------------


@query(
    "variant_seed_means",
    _r("SELECT variant, seed, 'price' AS metric, round(avg(value), 4) AS mean FROM r WHERE NOT failed GROUP BY 1, 2"),
)
def variant_seed_means(spark: SparkSession, folder: str) -> DataFrame:
    ok = results(spark, folder).filter(~F.col("failed")).withColumn("metric", F.lit("price"))
    return _rounded(stats.variant_seed_means(ok), "mean")


@query("run_counts", _r("SELECT variant, seed, count(*) AS num_examples, count_if(failed)::BIGINT AS num_failed FROM r GROUP BY 1, 2"))
def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.run_counts(results(spark, folder))


@query(
    "seed_aggregate",
    _r(
        """SELECT variant, 'price' AS metric, round(avg(m), 4) AS mean, round(coalesce(stddev_samp(m), 0), 4) AS std, round(median(m), 4) AS median
FROM (SELECT variant, seed, avg(value) AS m FROM r WHERE NOT failed GROUP BY 1, 2) GROUP BY 1"""
    ),
)
def seed_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    ok = results(spark, folder).filter(~F.col("failed")).withColumn("metric", F.lit("price"))
    return _rounded(stats.aggregate_seeds(stats.variant_seed_means(ok)), "mean", "std", "median")


@query(
    "metric_percentiles",
    _r(
        """SELECT variant, count(value) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stdev,
       round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95
FROM r GROUP BY 1"""
    ),
)
def metric_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.describe(results(spark, folder), ["variant"], "value"), "mean", "stdev", "p5", "p50", "p95")


@query(
    "event_value_median",
    "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
)
def event_value_median(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_quantiles(table(spark, folder, "events"), ["event_type"], "value", {"median": 0.5, "p99": 0.99})
    return _rounded(rows, "median", "p99", places=6)


@query(
    "coverage_adjusted",
    _r(
        """SELECT variant, count(*) AS n, round(avg(value) FILTER (NOT failed), 4) AS success_mean,
       round(sum(CASE WHEN failed THEN 0 ELSE value END) / count(*), 4) AS adjusted_mean FROM r GROUP BY 1"""
    ),
)
def coverage_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    rows = stats.coverage_adjusted(results(spark, folder), ["variant"], "value")
    return _rounded(rows, "success_mean", "adjusted_mean")


@query(
    "group_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count_if(l_tax > 0.06)::BIGINT AS failed, round(count_if(l_tax > 0.06) / count(*), 6) AS failure_rate,
       round(avg(l_discount) FILTER (l_tax <= 0.06), 6) AS metric_mean, count(*) FILTER (l_tax <= 0.06) AS metric_n,
       round(sum(l_discount) FILTER (l_tax <= 0.06) / count(*), 6) AS metric_adjusted, round(avg(l_extendedprice), 4) AS latency_mean,
       round(stddev_samp(l_extendedprice), 4) AS latency_stdev, round(avg(l_quantity), 6) AS memory_mean, max(l_quantity) AS memory_max
FROM lineitem GROUP BY 1, 2""",
)
def group_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").withColumn("failed", F.col("l_tax") > 0.06)
    out = stats.group_summary(rows, ["l_returnflag", "l_linestatus"], "l_discount", "l_extendedprice", "l_quantity")
    out = _rounded(out, "failure_rate", "metric_mean", "metric_adjusted", "memory_mean", places=6)
    return _rounded(out, "latency_mean", "latency_stdev")


_ERRORS = """e AS (SELECT event_id, event_type AS model, value > 5 AS failed,
  CASE event_id % 4 WHEN 0 THEN 'GenerationError: answer cites unknown claim id(s): [''clm-' || user_id || ''', ''source=' || user_id || ''']'
    WHEN 1 THEN 'GenerationError: malformed structured output: truncated or unterminated JSON object'
    WHEN 2 THEN 'GenerationError: model output has an empty answer' ELSE 'TimeoutError: ' || user_id END AS error FROM events)"""


def _errors(spark: SparkSession, folder: str) -> DataFrame:
    form, user = F.pmod("event_id", F.lit(4)), F.col("user_id").cast("string")
    error = (
        F.when(form == 0, F.concat(F.lit("GenerationError: answer cites unknown claim id(s): ['clm-"), user, F.lit("', 'source="), user, F.lit("']")))
        .when(form == 1, F.lit("GenerationError: malformed structured output: truncated or unterminated JSON object"))
        .when(form == 2, F.lit("GenerationError: model output has an empty answer"))
        .otherwise(F.concat(F.lit("TimeoutError: "), user))
    )
    rows = table(spark, folder, "events")
    return rows.select("event_id", F.col("event_type").alias("model"), (F.col("value") > 5).alias("failed"), error.alias("error"))


@query(
    "failure_taxonomy",
    O.chain(
        _ERRORS,
        """c AS (SELECT model, CASE WHEN error LIKE 'GenerationError: answer cites unknown claim id%' THEN 'hallucinated_citation_id'
  WHEN error LIKE '%truncated or unterminated JSON%' THEN 'generation_truncated_or_malformed_json'
  WHEN error LIKE 'GenerationError:%' THEN 'other_generation_error' ELSE 'other:' || split_part(error, ':', 1) END AS category FROM e WHERE failed)""",
        final="SELECT model, category, count(*) AS n FROM c GROUP BY 1, 2 UNION ALL SELECT 'overall', category, count(*) FROM c GROUP BY 2",
    ),
)
def failure_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    return stats.failure_taxonomy(_errors(spark, folder), "model")


@query(
    "cited_id_patterns",
    O.chain(
        _ERRORS,
        final="""SELECT model, CASE WHEN contains(id, 'source=') THEN 'evidence_metadata_leaked_as_id' ELSE 'short_or_compound_id_mismatch' END AS pattern, count(*) AS n
FROM (SELECT model, unnest(regexp_extract_all(regexp_extract(error, 'unknown claim id\\(s\\): \\[(.*)\\]', 1), '''([^'']*)''', 1)) AS id FROM e WHERE failed) GROUP BY 1, 2""",
    ),
)
def cited_id_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return stats.cited_id_patterns(_errors(spark, folder), "model")


_SAMPLES = """s AS (SELECT CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'R' THEN 'contradicts' ELSE 'neutral' END AS gold,
  round(l_discount * 10, 4) AS entail, round(l_tax * 10, 4) AS contra FROM lineitem)"""
_GRID = _SAMPLES + """,
g AS (SELECT e.v AS entail_thr, c.v AS contra_thr FROM (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) e(v), (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) c(v)),
p AS (SELECT entail_thr, contra_thr, gold, CASE WHEN entail >= 0.8 THEN 'neutral' WHEN entail >= entail_thr THEN 'supports'
      WHEN contra >= contra_thr THEN 'contradicts' ELSE 'neutral' END AS predicted FROM s, g),
k AS (SELECT entail_thr, contra_thr, c.name, count_if(gold = c.name AND predicted = c.name) AS tp, count_if(gold <> c.name AND predicted = c.name) AS fp,
      count_if(gold = c.name AND predicted <> c.name) AS fn FROM p, (VALUES ('supports'), ('contradicts'), ('neutral')) c(name) GROUP BY 1, 2, 3),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS re FROM k),
curve AS (SELECT entail_thr, contra_thr, round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 4) AS macro_f1,
      round(max(CASE WHEN name = 'supports' THEN pr END), 4) AS support_precision, round(max(CASE WHEN name = 'contradicts' THEN pr END), 4) AS contradiction_precision,
      min(CASE WHEN name <> 'neutral' THEN pr END) >= 0.8 AS meets_floor FROM m GROUP BY 1, 2)"""


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    gold = F.when(flag == "A", "supports").when(flag == "R", "contradicts").otherwise("neutral")
    return table(spark, folder, "lineitem").select(
        gold.alias("gold"), F.round(F.col("l_discount") * 10, 4).alias("entail"), F.round(F.col("l_tax") * 10, 4).alias("contra")
    )


@query("threshold_grid", O.chain(_GRID, final="SELECT * FROM curve"))
def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    return stats.threshold_grid(_samples(spark, folder))


@query(
    "best_threshold",
    O.chain(_GRID, final="SELECT * FROM curve ORDER BY meets_floor DESC, macro_f1 DESC, entail_thr, contra_thr LIMIT 1"),
)
def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return stats.best_threshold(stats.threshold_grid(_samples(spark, folder)))


_MEANS = "m AS (SELECT variant, example_id, avg(value) AS value FROM r WHERE NOT failed GROUP BY 1, 2)"


def _means(spark: SparkSession, folder: str) -> DataFrame:
    ok = results(spark, folder).filter(~F.col("failed"))
    return ok.groupBy("variant", "example_id").agg(F.avg("value").alias("value"))


@query(
    "paired_deltas",
    _r(
        """SELECT a.example_id, round(a.value, 4) AS a, round(b.value, 4) AS b, round(a.value - b.value, 4) AS delta
FROM m a JOIN m b ON a.example_id = b.example_id AND a.variant = '1-URGENT' AND b.variant = '5-LOW'""",
        _MEANS,
    ),
)
def paired_deltas(spark: SparkSession, folder: str) -> DataFrame:
    both, _ = stats.paired(_means(spark, folder), "1-URGENT", "5-LOW")
    return _rounded(both, "a", "b", "delta")


@query(
    "unpaired_examples",
    _r(
        """SELECT coalesce(a.example_id, b.example_id) AS example_id, CASE WHEN a.example_id IS NULL THEN '5-LOW' ELSE '1-URGENT' END AS only_in
FROM (SELECT * FROM m WHERE variant = '1-URGENT') a FULL JOIN (SELECT * FROM m WHERE variant = '5-LOW') b ON a.example_id = b.example_id
WHERE a.example_id IS NULL OR b.example_id IS NULL""",
        _MEANS,
    ),
)
def unpaired_examples(spark: SparkSession, folder: str) -> DataFrame:
    return stats.paired(_means(spark, folder), "1-URGENT", "5-LOW")[1]


@query(
    "paired_comparison",
    _r(
        """SELECT count(*) AS n_paired, round(avg(a.value), 4) AS mean_a, round(avg(b.value), 4) AS mean_b, round(avg(a.value - b.value), 4) AS mean_delta
FROM m a JOIN m b ON a.example_id = b.example_id AND a.variant = '1-URGENT' AND b.variant = '5-LOW'""",
        _MEANS,
    ),
)
def paired_comparison(spark: SparkSession, folder: str) -> DataFrame:
    both, _ = stats.paired(_means(spark, folder), "1-URGENT", "5-LOW")
    return _rounded(stats.comparison(both), "mean_a", "mean_b", "mean_delta")


_STEPS = "[" + ", ".join(map(str, stats.poisson_steps())) + "]"
_DIGEST = "CAST('0x' || substr(md5('0:' || o.example_id), {at}, 8) AS BIGINT) % 2147483647"


@query(
    "bootstrap_interval",
    _r(
        """SELECT variant, CAST(max(n) AS INT) AS n, round(quantile_cont(mean, 0.025), 4) AS ci_low, round(quantile_cont(mean, 0.975), 4) AS ci_high
FROM means GROUP BY variant""",
        _MEANS,
        f"""d AS (SELECT o.variant, a.value - o.value AS delta, {_DIGEST.format(at=1)} AS p, {_DIGEST.format(at=9)} AS q
FROM m o JOIN m a ON a.example_id = o.example_id AND a.variant = '1-URGENT' AND o.variant <> '1-URGENT')""",
        "x1 AS (SELECT variant, delta, b, (p + b * q) % 2147483647 AS x FROM d, range(1000) r(b))",
        "x2 AS (SELECT *, x * x % 2147483647 AS y FROM x1)",
        "x4 AS (SELECT *, y * y % 2147483647 AS z FROM x2)",
        f"t AS (SELECT variant, delta, b, len(list_filter({_STEPS}, lambda s: s <= z * x % 2147483647)) AS t FROM x4)",
        "means AS (SELECT variant, b, count(*) AS n, sum(t * delta) / nullif(sum(t), 0) AS mean FROM t GROUP BY variant, b)",
    ),
)
def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of the paired delta between the first variant and each other."""
    means = cut_lineage(_means(spark, folder), "means")
    first = means.filter(F.col("variant") == "1-URGENT").select("example_id", F.col("value").alias("a"))
    pairs = means.filter(F.col("variant") != "1-URGENT").join(first, "example_id")
    deltas = pairs.select("variant", "example_id", (F.col("a") - F.col("value")).alias("delta"))
    return _rounded(stats.bootstrap_ci(deltas, ["variant"], "delta", "example_id"), "ci_low", "ci_high")


@query(
    "best_baseline",
    _r(
        """SELECT seed, arg_min(variant, {'m': -mean, 'v': variant}) AS best, max(mean) AS mean FROM (
  SELECT seed, variant, round(avg(value), 6) AS mean FROM r GROUP BY 1, 2) GROUP BY 1"""
    ),
)
def best_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return stats.best_by_mean(results(spark, folder), ["seed"], "variant", "value")


@query(
    "seed_determinism",
    _r(
        """SELECT variant, example_id, count(DISTINCT seed) AS seeds, count(DISTINCT {'f': failed, 'v': round(value, 2)}) <= 1 AS identical
FROM r GROUP BY variant, example_id"""
    ),
)
def seed_determinism(spark: SparkSession, folder: str) -> DataFrame:
    """Do the seeds of a variant agree on an example's outcome and value?"""
    rows = results(spark, folder)
    return stats.identical_across_seeds(rows, ["variant", "example_id"], "seed", F.struct("failed", F.round("value", 2).alias("value")))


@query(
    "parity_split",
    """SELECT c_custkey, CASE WHEN (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM customer""",
)
def parity_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return stats.alternating_split(rows, "c_mktsegment", "c_custkey").select("c_custkey", "split")


@query(
    "stratified_sample",
    """WITH q(lang, quota) AS (VALUES ('en', 55), ('fr', 25), ('de', 15)),
h AS (SELECT doc_id, lang, md5('20260629:' || doc_id) AS h FROM documents),
p AS (SELECT h.*, row_number() OVER (PARTITION BY h.lang ORDER BY h, doc_id) <= coalesce(quota, 0) AS within FROM h LEFT JOIN q ON q.lang = h.lang)
SELECT doc_id, lang FROM p ORDER BY within DESC, h, doc_id LIMIT 100""",
)
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    return stats.stratified_sample(rows, "lang", "doc_id", {"en": 55, "fr": 25, "de": 15}, 100, 20260629)


@query(
    "remaining_runs",
    _r(
        """SELECT v.variant, s.seed, x.example_id FROM (SELECT DISTINCT example_id FROM r) x, (SELECT unnest(['1-URGENT', '5-LOW']) AS variant) v,
     (SELECT unnest([1995::BIGINT, 1996::BIGINT]) AS seed) s
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.variant = v.variant AND r.seed = s.seed AND r.example_id = x.example_id)"""
    ),
)
def remaining_runs(spark: SparkSession, folder: str) -> DataFrame:
    done = results(spark, folder)
    plan = stats.plan_runs(done.select("example_id").distinct(), ["1-URGENT", "5-LOW"], [1995, 1996])
    return longs(stats.remaining_work(plan, done), "seed").select("variant", "seed", "example_id")


@query(
    "differing_examples",
    _r(
        """SELECT variant, example_id, issue FROM (
  SELECT v.variant, b.example_id, 'missing' AS issue FROM (SELECT DISTINCT variant FROM r) v, (SELECT DISTINCT example_id FROM r WHERE variant = '1-URGENT') b
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.variant = v.variant AND r.example_id = b.example_id)
  UNION ALL SELECT DISTINCT variant, example_id, 'extra' FROM r WHERE example_id NOT IN (SELECT example_id FROM r WHERE variant = '1-URGENT'))"""
    ),
)
def differing_examples(spark: SparkSession, folder: str) -> DataFrame:
    return stats.differing_examples(results(spark, folder), "1-URGENT")


@query(
    "cost_estimates",
    _r(
        """SELECT seed, examples, variants, graph_variants, CASE WHEN graph_variants > 0 THEN examples * 40 ELSE 0 END AS classified_pairs,
       examples * variants AS generation_calls,
       round((examples * 12.0 + CASE WHEN graph_variants > 0 THEN examples * 40 ELSE 0 END * 0.06::DOUBLE + examples * variants * 1.6::DOUBLE) / 3600, 2) AS total_hours,
       round((examples + CASE WHEN graph_variants > 0 THEN examples * 40 ELSE 0 END + examples * variants) * 1024 / 1048576.0::DOUBLE, 1) AS cache_mb
FROM (SELECT seed, count(DISTINCT example_id) AS examples, count(DISTINCT variant) AS variants,
             count(DISTINCT CASE WHEN variant > '3' THEN variant END) AS graph_variants FROM r GROUP BY 1)"""
    ),
)
def cost_estimates(spark: SparkSession, folder: str) -> DataFrame:
    rows = results(spark, folder)
    counts = rows.groupBy("seed").agg(
        F.count_distinct("example_id").alias("examples"), F.count_distinct("variant").alias("variants"),
        F.count_distinct(F.when(F.col("variant") > "3", F.col("variant"))).alias("graph_variants"),
    )
    return longs(stats.cost_estimate(counts), "classified_pairs")


@query(
    "picked_examples",
    _r(
        """SELECT 'both_low' AS picked_for, min(CASE WHEN a < 50000 AND b < 50000 THEN example_id END) AS example_id FROM w
UNION ALL SELECT 'a_low_b_high', min(CASE WHEN a < 50000 AND b >= 150000 THEN example_id END) FROM w""",
        _MEANS,
        """w AS (SELECT example_id, max(CASE WHEN variant = '1-URGENT' THEN value END) AS a, max(CASE WHEN variant = '5-LOW' THEN value END) AS b
               FROM m GROUP BY 1)""",
    ),
)
def picked_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The first example that shows each pattern across two variants."""
    value = lambda name: F.max(F.when(F.col("variant") == name, F.col("value")))
    wide = _means(spark, folder).groupBy("example_id").agg(value("1-URGENT").alias("a"), value("5-LOW").alias("b"))
    low = F.col("a") < 50000
    return stats.first_matches(wide, {"both_low": low & (F.col("b") < 50000), "a_low_b_high": low & (F.col("b") >= 150000)})


# --- answer metrics on conversations ----------------------------------------------------


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each assistant turn beside the user turn before it."""
    rows = table(spark, folder, "conversations")
    asked = rows.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    said = rows.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("prediction"))
    return said.join(asked, ["conv_id", "turn"])


_T = """t AS (SELECT a.conv_id, a.turn, a.text AS prediction, u.text AS gold FROM conversations a
       JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant')"""


@query(
    "answer_scores",
    O.chain(
        _T,
        f"w AS (SELECT *, {O.answer_words('prediction')} AS p, {O.answer_words('gold')} AS g FROM t)",
        """c AS (SELECT conv_id, turn, sum(least(np, ng)) AS common FROM (
             SELECT conv_id, turn, word, count_if(side = 0) AS np, count_if(side = 1) AS ng FROM (
               SELECT conv_id, turn, unnest(p) AS word, 0 AS side FROM w UNION ALL SELECT conv_id, turn, unnest(g), 1 FROM w) GROUP BY 1, 2, 3)
             GROUP BY 1, 2)""",
        final="""SELECT w.conv_id, w.turn, CAST(prediction = gold AS INTEGER) AS exact_match, CAST(array_to_string(p, ' ') = array_to_string(g, ' ') AS INTEGER) AS normalized_match,
       round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN coalesce(common, 0) = 0 THEN 0.0 ELSE 2.0 * common / (len(p) + len(g)) END, 6) AS token_f1,
       CAST(trim(prediction) = '' AS INTEGER) AS empty_prediction
FROM w LEFT JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn""",
    ),
)
def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.answer_scores(_turns(spark, folder), ["conv_id", "turn"]), "token_f1", places=6)


@query(
    "answer_support",
    O.chain(
        _T,
        f"""w AS (SELECT *, list_distinct({O.answer_words('prediction')}) AS p, list_distinct({O.answer_words('gold')}) AS g,
             list_filter(string_split(replace(prediction, '!', '.'), '.'), lambda s: trim(s, ' ' || chr(10)) <> '') AS sentences FROM t)""",
        f"""x AS (SELECT conv_id, turn, list_transform(sentences, lambda s: list_distinct({O.answer_words('s')})) AS s, g FROM w)""",
        final="""SELECT w.conv_id, w.turn, round(CASE WHEN len(p) = 0 THEN 1.0 ELSE len(list_intersect(p, w.g)) / len(p) END, 6) AS entailment,
       CAST(list_has_any(p, ['not','no','never','cannot','false','incorrect']) AND list_has_any(p, w.g) AS DOUBLE) AS contradiction_cue,
       round(CASE WHEN len(sentences) = 0 THEN 0.0 ELSE
         len(list_filter(x.s, lambda q: CASE WHEN len(q) = 0 THEN false ELSE len(list_intersect(q, x.g)) / len(q) < 0.5 END)) / len(sentences) END, 6) AS unsupported_rate
FROM w JOIN x ON x.conv_id = w.conv_id AND x.turn = w.turn""",
    ),
)
def answer_support(spark: SparkSession, folder: str) -> DataFrame:
    rows = _turns(spark, folder)
    answer, premises = F.col("prediction"), F.array("gold")
    return rows.select(
        "conv_id", "turn", F.round(M.lexical_entailment(answer, premises), 6).alias("entailment"),
        M.contradiction_cue(answer, premises).alias("contradiction_cue"),
        F.round(M.unsupported_rate(M.answer_sentences(answer), premises), 6).alias("unsupported_rate"),
    )


# --- set metrics on order lines ------------------------------------------------------------


_SIZES = """sizes AS (SELECT l_orderkey, sum(p * g) AS hits, sum(p) AS predicted, sum(g) AS gold FROM (
  SELECT l_orderkey, l_suppkey, max(CAST(l_returnflag IN ('A', 'R') AS INTEGER)) AS p, max(CAST(l_linestatus = 'F' AS INTEGER)) AS g
  FROM lineitem GROUP BY 1, 2) GROUP BY 1)"""


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of returned lines against suppliers of finished lines, per order."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", F.col("l_returnflag").isin("A", "R").alias("p"), (F.col("l_linestatus") == "F").alias("g")
    )
    return evaluation.set_sizes(rows, ["l_orderkey"], "l_suppkey", "p", "g")


@query(
    "set_precision_recall",
    O.chain(
        _SIZES,
        final="""SELECT l_orderkey,
       round(CASE WHEN predicted = 0 THEN CASE WHEN gold = 0 THEN 1.0 ELSE 0.0 END ELSE hits / predicted END, 6) AS citation_p,
       round(CASE WHEN gold = 0 THEN 1.0 ELSE hits / gold END, 6) AS citation_r,
       CASE WHEN gold = 0 OR hits = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS completeness,
       round(CASE WHEN predicted = 0 AND gold = 0 THEN 1.0 WHEN predicted = 0 OR gold = 0 THEN 0.0 ELSE hits / predicted END, 6) AS benchmark_p,
       round(CASE WHEN predicted = 0 AND gold = 0 THEN 1.0 WHEN predicted = 0 OR gold = 0 THEN 0.0 ELSE hits / gold END, 6) AS benchmark_r,
       round(CASE WHEN predicted = 0 AND gold = 0 THEN 1.0 WHEN hits = 0 THEN 0.0 ELSE 2.0 * hits / (predicted + gold) END, 6) AS benchmark_f1,
       round(CASE WHEN predicted = 0 THEN 1.0 ELSE hits / predicted END, 6) AS mechanism_p
FROM sizes""",
    ),
)
def set_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sizes(spark, folder)
    sizes = F.col("hits"), F.col("predicted"), F.col("gold")
    cp, cr = M.citation_prf(*sizes)
    bp, br, bf = M.benchmark_prf(*sizes)
    mp, _ = M.mechanism_pr(*sizes)
    out = rows.select(
        "l_orderkey", cp.alias("citation_p"), cr.alias("citation_r"),
        M.completeness(F.col("gold") - F.col("hits"), F.col("gold")).alias("completeness"), bp.alias("benchmark_p"),
        br.alias("benchmark_r"), bf.alias("benchmark_f1"), mp.alias("mechanism_p"),
    )
    return _rounded(out, "citation_p", "citation_r", "benchmark_p", "benchmark_r", "benchmark_f1", "mechanism_p", places=6)


@query(
    "joint_scores",
    O.chain(
        _SIZES,
        final="""SELECT l_orderkey, CASE WHEN o_orderstatus = 'F' AND f1 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS joint_em,
       round(1 / (1 + o_totalprice / 100000) * f1, 6) AS joint_f1
FROM (SELECT l_orderkey, CASE WHEN predicted = 0 AND gold = 0 THEN 1.0 WHEN hits = 0 THEN 0.0 ELSE 2.0 * hits / (predicted + gold) END AS f1 FROM sizes)
JOIN orders ON o_orderkey = l_orderkey""",
    ),
)
def joint_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Answer and supporting facts must both be right."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").cast("double").alias("em"),
        (1 / (1 + F.col("o_totalprice") / 100000)).alias("f1"),
    )
    rows = _sizes(spark, folder).join(orders, "l_orderkey")
    _, _, support = M.benchmark_prf(F.col("hits"), F.col("predicted"), F.col("gold"))
    em, f1 = M.joint(F.col("em"), F.col("f1"), support)
    return rows.select("l_orderkey", em.alias("joint_em"), F.round(f1, 6).alias("joint_f1"))


@query(
    "fact_verification_scores",
    """SELECT o_orderkey, CAST(upper(label) = upper(o_orderstatus) AS DOUBLE) AS label_ok, recovered,
       CAST(label = o_orderstatus AND recovered AS DOUBLE) AS score
FROM orders JOIN (
  SELECT l_orderkey, max(last) AS label, bool_or(complete) AS recovered FROM (
    SELECT l_orderkey, l_linestatus, max(l_linestatus) AS last, bool_and(l_returnflag <> 'N') AS complete FROM lineitem GROUP BY 1, 2) GROUP BY 1
) ON l_orderkey = o_orderkey""",
)
def fact_verification_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Label accuracy and evidence-set recovery; a set is the lines of one status."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linestatus", (F.col("l_returnflag") != "N").alias("found"))
    sets = evaluation.recovered_sets(lines, ["l_orderkey"], "l_linestatus", "found")
    label = lines.groupBy("l_orderkey").agg(F.max("l_linestatus").alias("label"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    rows = orders.join(label, "l_orderkey").join(sets, "l_orderkey")
    rows = rows.withColumn("label_ok", M.label_accuracy(F.col("label"), F.col("o_orderstatus")))
    return rows.select(
        F.col("l_orderkey").alias("o_orderkey"), "label_ok", "recovered",
        M.fever_score(F.col("label_ok"), F.col("o_orderstatus"), F.col("recovered")).alias("score"),
    )


@query(
    "invalid_citations",
    """SELECT a.l_orderkey, count_if(NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_returnflag = 'N'))::BIGINT AS invalid
FROM lineitem a GROUP BY 1""",
)
def invalid_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Cited ids (with repeats) that are not among the known ids: parts of an order that it did not keep."""
    kept = F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("cited"), F.collect_set(kept).alias("known"))
    return longs(rows.select("l_orderkey", M.invalid_citations(F.col("cited"), F.col("known")).alias("invalid")), "invalid")


@query(
    "order_answer_matches",
    O.chain(
        """t AS (SELECT o_orderkey, o_orderpriority AS gold, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority) || '.'
  WHEN 2 THEN '  ' ELSE o_orderstatus END AS prediction FROM orders)""",
        final=f"""SELECT o_orderkey, CAST(prediction = gold AS INTEGER) AS exact_match, CAST(trim(prediction) = '' AS INTEGER) AS empty_prediction,
  CAST(array_to_string({O.answer_words('prediction')}, ' ') = array_to_string({O.answer_words('gold')}, ' ') AS INTEGER) AS normalized_match FROM t""",
    ),
)
def order_answer_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Answers about the priority of orders: right, right but for case and marks, blank, or wrong."""
    key, priority = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    said = F.when(key == 0, priority).when(key == 1, F.concat(F.lower(priority), F.lit("."))).when(key == 2, F.lit("  ")).otherwise(F.col("o_orderstatus"))
    rows = table(spark, folder, "orders").select("o_orderkey", said.alias("prediction"), priority.alias("gold"))
    return evaluation.answer_scores(rows, ["o_orderkey"]).select("o_orderkey", "exact_match", "empty_prediction", "normalized_match")


# --- datasets --------------------------------------------------------------------------------


@query(
    "dataset_issues",
    """WITH x AS (SELECT CAST(d.doc_id AS VARCHAR) AS example_id, source AS question, text AS content, lang AS split, l.doc_id IS NOT NULL AS has_gold
            FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'duplicate_id' AS issue, example_id AS key, count(*) AS n FROM x GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'duplicate_content', min(example_id), count(*) FROM x GROUP BY content HAVING count(*) > 1
UNION ALL SELECT 'missing_gold', example_id, 1 FROM x WHERE NOT has_gold
UNION ALL SELECT 'split_overlap', min(example_id), count(DISTINCT split) FROM x GROUP BY question HAVING count(DISTINCT split) > 1""",
)
def dataset_issues(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.lit(True).alias("has_gold"))
    rows = table(spark, folder, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("example_id"), F.col("source").alias("question"), F.col("text").alias("content"),
        F.col("lang").alias("split"), F.coalesce("has_gold", F.lit(False)).alias("has_gold"),
    )
    return integrity.issues(rows)


@query(
    "dataset_profile",
    """SELECT lang, count(*) AS n, round(avg(sentences), 6) AS mean_documents, count_if(gold > 0 AND present = gold)::BIGINT AS full_coverage,
       count_if(NOT (gold > 0 AND present = gold) AND present > 0)::BIGINT AS partial_coverage,
       count_if(NOT (gold > 0 AND present = gold) AND present = 0)::BIGINT AS no_coverage
FROM (SELECT d.lang, len(regexp_extract_all(text, '[.!?]+')) AS sentences, 2 AS gold, coalesce(l.quality, 0) + coalesce(1 - l.toxic, 0) AS present
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY 1""",
)
def dataset_profile(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    rows = table(spark, folder, "documents").join(labels, "doc_id", "left").select(
        "lang", F.regexp_count("text", F.lit("[.!?]+")).alias("num_documents"), F.lit(2).alias("gold"),
        (F.coalesce("quality", F.lit(0)) + F.coalesce(1 - F.col("toxic"), F.lit(0))).alias("present"),
    )
    return _rounded(integrity.profile(rows, ["lang"]), "mean_documents", places=6)


@query(
    "manifest_examples",
    """WITH m AS (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS position FROM (
  SELECT doc_id AS example_id FROM labels UNION ALL SELECT -1 - item_id FROM benchmark))
SELECT m.example_id, m.position, d.source, d.doc_id IS NULL AS missing FROM m LEFT JOIN documents d ON d.doc_id = m.example_id""",
)
def manifest_examples(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of the labelled documents and of ids that name none, joined to the documents, with the missing ones."""
    from factloom.scale import running_total
    from factloom.sources import readers

    ids = table(spark, folder, "labels").select(F.col("doc_id").alias("example_id")).unionByName(
        table(spark, folder, "benchmark").select((F.lit(-1) - F.col("item_id")).alias("example_id")))
    manifest = running_total(ids.withColumn("all", F.lit(1)), ["all"], "example_id", F.lit(1).cast("bigint"), "position").select("example_id", "position")
    known = table(spark, folder, "documents").select(F.col("doc_id").alias("example_id"), "source")
    found, missing = readers.by_manifest(known, cut_lineage(manifest, "manifest"))
    rows = found.withColumn("missing", F.lit(False)).unionByName(
        missing.withColumns({"source": F.lit(None).cast("string"), "missing": F.lit(True)}))
    return longs(rows, "position")


@query(
    "cache_misses",
    """SELECT sha256(text) AS key, count(*) AS requests, bool_or(doc_id % 2 = 0) AS hit FROM documents GROUP BY 1""",
)
def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Content keys requested, and whether an earlier run had computed them."""
    rows = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    cached = rows.filter(F.pmod("doc_id", F.lit(2)) == 0).select("key").distinct()
    wanted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("requests"))
    misses = wanted.join(cached, "key", "left_anti").withColumn("hit", F.lit(False))
    hits = wanted.join(cached, "key", "left_semi").withColumn("hit", F.lit(True))
    return hits.unionByName(misses)


@query(
    "source_reliability",
    """SELECT d.source, round(avg(l.quality), 6) AS reliability_prior, count(*) AS labels FROM documents d JOIN labels l USING (doc_id) GROUP BY 1""",
)
def source_reliability(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("reliability_prior"), F.count(F.lit(1)).alias("labels"))
