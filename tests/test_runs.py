import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation, packaging, reasoning, selection, stats
from factloom.plans import experiment, pipeline
from factloom.scale import exact_quantiles, running_total
from factloom.sources import builtin, mechanisms, readers, sinks
from factloom.streaming import results as stream


@pytest.fixture(scope="module")
def suite_run(spark):
    suite = mechanisms.build_suite(spark)
    variant = pipeline.Variant("full", "graph", bridges=True)
    reasoned = pipeline.reason(suite.claims, suite.queries, variant, classifier=mechanisms.gold_classifier(suite))
    picked = pipeline.choose(suite.claims, suite.queries, reasoned, variant, selection.Budget())
    return suite, reasoned, picked


def test_mechanism_suite_totals(spark, suite_run):
    suite, reasoned, picked = suite_run
    total = evaluation.activation(suite.queries, reasoned.relations, reasoned.beliefs, reasoned.conflicts, picked)
    names = ["support_edges", "contradiction_edges", "supersession_edges", "duplicate_edges", "bridge_edges", "conflict_sets"]
    sums = total.agg(*[F.sum(n).alias(n) for n in names]).first()
    assert suite.queries.count() == 202
    assert [sums[n] for n in names] == [172, 66, 22, 22, 30, 66]
    assert evaluation.inactive_queries(reasoned.relations, suite.gold_pairs).isEmpty()


def test_beliefs_equal_a_plain_fixed_point(spark, suite_run):
    suite, reasoned, _ = suite_run
    rules = reasoning.PropagationRules()
    weights = {}
    for r in reasoning.message_weights(suite.claims, reasoned.relations, rules).collect():
        weights.setdefault(r.query_id, []).append((r.claim_id, r.sender, r.weight))
    starts = {}
    for r in reasoned.scores.collect():
        starts.setdefault(r.query_id, {})[r.claim_id] = r.initial_belief
    found = {}
    for r in reasoned.beliefs.collect():
        found.setdefault(r.query_id, {})[r.claim_id] = (r.belief, r.iterations)
    assert set(found) == set(starts)
    for query, start in starts.items():
        belief, rounds, moved = dict(start), 0, 1.0
        while moved >= rules.tolerance:
            net = {c: math.log(b / (1 - b)) for c, b in start.items()}
            for to, sender, weight in weights.get(query, []):
                net[to] += weight * 2 * (belief[sender] - 0.5)
            after = {c: rules.damping * belief[c] + (1 - rules.damping) / (1 + math.exp(-net[c])) for c in start}
            moved, belief, rounds = max(abs(after[c] - belief[c]) for c in start), after, rounds + 1
        assert {c: n for c, (_, n) in found[query].items()} == dict.fromkeys(start, rounds)
        assert {c: b for c, (b, _) in found[query].items()} == pytest.approx(belief, abs=1e-9)


def test_mechanism_suite_quality(spark, suite_run):
    suite, reasoned, picked = suite_run
    hop = evaluation.required_claims(picked, suite.required).join(suite.queries, "query_id").filter("category = 'chained'")
    assert hop.agg(F.avg("required_hop_coverage")).first()[0] == 1.0
    edges = evaluation.edge_metrics(reasoned.relations, suite.gold_pairs, suite.queries)
    assert edges.agg(F.min("recall")).first()[0] == 1.0
    conflicts = evaluation.conflict_metrics(reasoned.conflicts, suite.gold_conflicts)
    assert conflicts.agg(F.avg("conflict_set_recall")).first()[0] == 1.0
    assert evaluation.lineage_accuracy(reasoned.relations, suite.lineage).agg(F.avg("duplicate_cluster_accuracy")).first()[0] == 1.0


def test_experiment_runs_resumes_and_survives_bad_lines(spark, tmp_path):
    examples = builtin.synthetic_graph(spark).unionByName(builtin.temporal_conflict(spark))
    plan = experiment.Experiment("demo", str(tmp_path / "run"), ("passage_rag", "full_graph"), (1, 2))
    first = experiment.run(spark, plan, examples)
    assert first.count() == 3 * 2 * 2 and first.filter("failed").isEmpty()
    folder = tmp_path / "run" / "results" / "variant=passage_rag"
    (folder / "part-broken.json").write_text('{"example_id": "x", "seed"\n')
    good, bad = readers.results_log(spark, str(tmp_path / "run" / "results"))
    assert (good.count(), bad.count()) == (12, 1)
    again = experiment.run(spark, plan, examples, resume=True)
    assert again.count() == 12
    metrics = again.filter("variant = 'full_graph' and example_id = 'rescue' and seed = 1").first().metrics
    assert metrics["citation_precision"] > 0 and "token_f1" in metrics
    experiment.write_artifacts(spark, plan, examples, good)
    assert json.loads(spark.read.text(str(tmp_path / "run" / "manifest")).first()[0])["experiment"]["name"] == "demo"
    row = experiment.compare(good, "full_graph", "passage_rag", "token_f1").first()
    assert row.n_paired == 3 and row.ci_low <= row.mean_delta <= row.ci_high
    follower = stream.keep_up(stream.running_counts(stream.follow_results(spark, str(tmp_path / "run" / "results"))), str(tmp_path / "counts"), str(tmp_path / "cp"))
    follower.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "counts")).agg(F.sum("num_examples")).first()[0] >= 12


def test_fairness_and_gold_guards():
    plan = experiment.Experiment("my-tuned", "x", overrides={"a": {"top_k": 9}})
    assert len(experiment.fairness_issues(plan)) == 2
    assert experiment.gold_parameters(["query", "gold_answers"]) == ["gold_answers"]


def test_parse_and_attribution(spark):
    packs = spark.createDataFrame(
        [("q", [("c1", "t", "s")], [(0, "c1", "t", "s", "rejected")])],
        "query_id string, claims array<struct<claim_id:string,text:string,source_id:string>>, "
        "selected array<struct<rank:int,claim_id:string,text:string,source_id:string,status:string>>",
    )
    rows = spark.createDataFrame(
        [("q", '{"answer": " A ", "citations": ["[c1]", "c1"], "uncertainty": ""}'), ("q", '{"answer": "A", "citations": ["zz"]}'), ("q", "nonsense"), ("q", '{"citations": []}')],
        "query_id string, raw string",
    )
    parsed = packaging.parse_answers(rows)
    assert parsed.filter("error is null").orderBy(F.desc(F.size("cited_claim_ids"))).first().cited_claim_ids in (["c1"], ["zz"])
    errors = sorted(r.error for r in packaging.attribution_errors(parsed, packs).collect())
    assert [e.split(": ")[1][:28] for e in errors] == ["answer cites rejected eviden", "answer cites unknown claim i", "malformed structured output", "model output has an empty or"]


def test_prompts_beyond_the_context_fail_before_the_model(spark):
    examples = builtin.temporal_conflict(spark)
    asked = examples.select(F.col("example_id").alias("query_id"), F.col("question").alias("text"))
    found = pipeline.retrieve_own_documents(readers.example_documents(examples), asked)
    packs = pipeline.run_variant(found, pipeline.VARIANTS["claim_only_rag"])
    assert packaging.generate(packs).first().error is None
    small = packaging.Capabilities(context_limit=600)
    assert "exceeds the adapter context limit" in packaging.generate(packs, can=small).first().error
    with pytest.raises(ValueError):
        packaging.capability_warnings(small, stream=True)
    assert len(packaging.capability_warnings(packaging.Capabilities(deterministic=False, seeds=False))) == 2


def test_readers(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in (("b.txt", " second "), ("a.txt", "first"), ("skip.md", "x")):
        (tmp_path / "docs" / name).write_text(text)
    rows = readers.text_folder(spark, str(tmp_path / "docs")).orderBy("document_id").collect()
    assert [(r.document_id, r.source_id, r.text) for r in rows] == [("doc-0", "a", "first"), ("doc-1", "b", "second")]

    fever = tmp_path / "fever.jsonl"
    fever.write_text(json.dumps({"id": 7, "claim": "c", "label": "REFUTES", "evidence": [["P_a", "0", "x"], ["P_b", "1", " "], ["P_a", "2", "y"]]}) + "\n")
    row = readers.fever_jsonl(spark, str(fever)).first()
    assert [d.document_id for d in row.documents] == ["P_a#0#0", "P_a#2#2"]
    assert (row.stance, row.gold_source_ids, row.metadata["num_evidence_skipped_empty"]) == ("refutes", ["P_a"], "1")

    plain = tmp_path / "ex.jsonl"
    plain.write_text('{"id": "1", "claim": "c", "documents": [{"source_id": "s", "text": "t"}], "answer": "a", "label": "supports"}\n')
    row = readers.examples_jsonl(spark, str(plain)).first()
    assert (row.question, row.answers, row.stance, row.split) == ("c", ["a"], "supports", "test")

    hotpot = spark.createDataFrame(
        [("h1", "q", "a", "bridge", "easy", (["T1", "T2"], [["s0", " "], ["s1"]]), (["T1", "T1"], [0, 1]))],
        "id string, question string, answer string, type string, level string, context struct<title:array<string>,sentences:array<array<string>>>, "
        "supporting_facts struct<title:array<string>,sent_id:array<int>>",
    )
    hotpot.write.parquet(str(tmp_path / "hotpot"))
    row = readers.hotpot_parquet(spark, str(tmp_path / "hotpot")).first()
    assert [d.document_id for d in row.documents] == ["T1#0", "T2#0"] and row.gold_source_ids == ["T1"]


def test_cache_computes_only_misses(spark, tmp_path):
    table = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    compute = lambda df: df.select("key", F.length("key").alias("value"))
    path = str(tmp_path / "cache")
    assert sinks.through_cache(table("a", "a", "bb"), path, "key", compute)[1].count() == 2
    rows, misses = sinks.through_cache(table("bb", "ccc"), path, "key", compute)
    assert misses.count() == 1 and {r.key: r.value for r in rows.collect()} == {"bb": 2, "ccc": 3}


def test_quantiles_and_running_totals_under_skew(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else "cold", i, float(rng.randrange(50))) for i in range(500)]
    table = spark.createDataFrame(rows, "k string, id int, v double")
    got = {r.k: (r.a, r.b) for r in exact_quantiles(table, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    want = {r.k: (r.a, r.b) for r in table.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.9)).alias("b")).collect()}
    assert got == want
    placed = running_total(table, ["k"], "id", F.lit(1), "n").filter("k = 'hot'").orderBy("id").collect()
    assert [r.n for r in placed] == list(range(len(placed)))


def test_bootstrap_repeats_its_definition(spark):
    rng = random.Random(9)
    rows = [("m", i, rng.gauss(1.0, 1.0)) for i in range(300)] + [("one", 1, 2.5), ("none", 1, None)]
    table = spark.createDataFrame(rows, "k string, id int, v double")
    found = {r.k: r for r in stats.bootstrap_ci(table.repartition(7), ["k"], "v", "id", samples=200).collect()}
    prime, steps = stats.DRAWS, stats.poisson_steps()
    means = []
    for b in range(200):
        times, total = 0, 0.0
        for _, i, v in rows[:300]:
            digest = hashlib.md5(f"0:{i}".encode()).hexdigest()
            x = (int(digest[:8], 16) % prime + b * (int(digest[8:16], 16) % prime)) % prime
            n = sum(s <= pow(x, 5, prime) for s in steps)
            times, total = times + n, total + n * v
        means.append(total / times)
    means.sort()
    assert found["m"].ci_low == pytest.approx(means[4] + (means[5] - means[4]) * 0.975, abs=1e-9)
    mean = sum(r[2] for r in rows[:300]) / 300
    assert abs(found["m"].ci_high - mean - 1.96 / 300**0.5) < 0.05 and found["m"].n == 300
    assert found["one"].ci_low == found["one"].ci_high == 2.5 and "none" not in found


def test_stratified_sample_fills_up(spark):
    table = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(40)], "id int, s string")
    sample = stats.stratified_sample(table, "s", "id", {"a": 5, "b": 5}, 12, 1)
    assert sample.count() == 12 and sample.filter("s = 'a'").count() == 3 and sample.select("id").distinct().count() == 12


def test_parts_are_injected_and_reranking_reorders(spark):
    documents = spark.createDataFrame(
        [("d1", "The pier is long. " * 3, "s1"), ("d2", "pier pier pier pier pier pier of stone and wood and iron and rope and sand", "s2"), ("d3", "The pier of Keelham", "s3")],
        "document_id string, text string, source_id string",
    )
    asked = spark.createDataFrame([("q", "the pier of Keelham pier")], "query_id string, text string")
    found = pipeline.retrieve_evidence(documents, asked)
    ids = lambda name, parts=None: [s.source_id for s in pipeline.run_variant(found, pipeline.VARIANTS[name], parts=parts).first().selected]
    backwards = pipeline.Components(rerank=lambda hits, queries: hits.withColumn("rank", -F.col("rank")))
    plain = ids("passage_rag")
    assert len(plain) == 3 and ids("reranked_passage_rag", backwards) == plain[::-1]
    assert ids("reranked_passage_rag")[0] == "s3"
    with pytest.raises(ValueError, match="reranker"):
        ids("reranked_passage_rag", pipeline.Components(rerank=None))
    costly = pipeline.Components(count_tokens=lambda text: F.lit(150))
    assert len(ids("passage_rag", costly)) == 1
    one = pipeline.Components(
        chunk=lambda docs, settings: docs.withColumn("passage_id", F.concat(F.lit("p-"), "document_id")).withColumn("start", F.lit(0)),
        retrieve=lambda passages, queries, k: queries.select("query_id").withColumn("passage_id", F.lit("p-d2")).withColumn("score", F.lit(1.0)).withColumn("rank", F.lit(0)),
        extract=lambda hits: hits.limit(0),
    )
    own = pipeline.retrieve_evidence(documents, asked, parts=one)
    assert [r.passage_id for r in own.hits.collect()] == ["p-d2"] and own.claims.isEmpty()
