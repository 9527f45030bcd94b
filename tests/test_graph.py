import math
import os
import random
import time
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom import schemas as S
from factloom.operators import bridges, graph, pairs, reasoning, selection, temporal
from factloom.sources import builtin

CLAIM = "query_id string, claim_id string, text string, source_id string, subject string, predicate string, object string, entities array<string>, negation boolean, valid_from string"


def claims(spark, *rows):
    full = [(*r, *[None] * (10 - len(r))) for r in rows]
    df = spark.createDataFrame(full, CLAIM).withColumn("valid_from", F.to_timestamp("valid_from"))
    for name in ("asserted_at", "observed_at", "published_at"):
        df = df.withColumn(name, F.lit(None).cast("timestamp"))
    for name in ("quantities", "dates"):
        df = df.withColumn(name, F.array().cast("array<string>"))
    return df.withColumn("extraction_confidence", F.lit(0.9))


def relations(spark, *rows):
    return spark.createDataFrame([("q", f"r{i}", a, b, kind, c, "", "") for i, (a, b, kind, c) in enumerate(rows)], S.RELATIONS)


def test_components_on_random_graphs(spark):
    rng = random.Random(3)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [(nodes[i], nodes[i + 1]) for i in range(12)] + [tuple(rng.sample(nodes, 2)) for _ in range(12)]
    head = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            head[a] = head[b] = min(head[a], head[b])
    found = graph.components(relations(spark, *[(a, b, S.SUPPORT, 1.0) for a, b in edges]))
    touched = {x for e in edges for x in e}
    assert {r.claim_id: r.component for r in found.collect()} == {n: head[n] for n in touched}


def test_pruned_candidates_equal_brute_force(spark):
    rng = random.Random(5)
    words = "acme revenue grew fell profit rose market share new plant".split()
    rows = [
        ("q", f"c{i:02d}", " ".join(rng.sample(words, 4)), f"s{i % 3}", rng.choice(["Acme", "", None]), None, None, rng.choice([["Acme"], ["Zeta"], []]), False)
        for i in range(25)
    ]
    table = claims(spark, *rows)
    pruned = {(r.a_id, r.b_id): r.reasons for r in pairs.candidate_pairs(table).collect()}
    every = pairs.candidate_pairs(table, pairs.CandidateRules(brute_force=True)).collect()
    assert len(every) == 25 * 24 // 2
    for r in every:
        a, b = set(r.a_text.split()), set(r.b_text.split())
        want = []
        if set(r.a_names) & set(r.b_names):
            want.append("shared_entities")
        if len(a & b) / len(a | b) >= 0.2:
            want.append("lexical_overlap")
        if r.a_subject_key and r.a_subject_key == r.b_subject_key:
            want.append("subject_predicate")
        assert pruned.get((r.a_id, r.b_id), []) == want


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.6, 0.8, 1.0])
def test_overlap_meetings_lose_no_pair_and_skip_most(spark, threshold):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    often = [1 / (i + 1) for i in range(60)]
    texts = [set(rng.choices(words, often, k=rng.randint(0, 14))) for _ in range(60)]
    texts += [set(words[:5]), set(words[4:9]), set(words[:10]), set(words[:8]), set(words[:8]), set()]
    rows = [(q, f"c{i:02d}", sorted(t)) for q in "pq" for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "query_id string, claim_id string, terms array<string>")
    found = [(r.query_id, r.a_claim_id, r.b_claim_id) for r in pairs.overlap_meetings(table, threshold).collect()]
    sharing, alike = set(), set()
    for q, a, left in rows:
        for p, b, right in rows:
            common = len(set(left) & set(right))
            if p == q and a < b and common:
                sharing.add((q, a, b))
                if common >= threshold * len(set(left) | set(right)) - 1e-12:
                    alike.add((q, a, b))
    assert alike and alike <= set(found) <= sharing and len(found) == len(set(found))
    assert len(found) < len(sharing) * (0.95 if threshold < 0.5 else 0.3)
    assert pairs.overlap_meetings(table.limit(0), threshold).count() == 0


def test_overlap_of_zero_is_refused(spark):
    with pytest.raises(ValueError, match="every pair"):
        pairs.overlap_meetings(spark.createDataFrame([], "query_id string, claim_id string, terms array<string>"), 0.0)


def test_candidates_by_relevance_alone(spark):
    table = claims(spark, ("q", "a", "acme grew", "s"), ("q", "b", "acme fell today", "s"), ("q", "c", "other words", "s"))
    asked = spark.createDataFrame([("q", "acme")], S.QUERIES)
    only = {"shared_entities": False, "lexical_overlap": False, "same_subject": False, "query_relevance": True}
    found = lambda least: {(r.a_id, r.b_id) for r in pairs.candidate_pairs(table, pairs.CandidateRules(**only, min_relevance=least), asked).collect()}
    assert found(0.3) == {("a", "b")} and found(0.4) == set() and found(0.0) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_candidate_budget_prefers_more_signals(spark):
    table = claims(
        spark,
        ("q", "a", "Acme grew fast", "s1", "Acme", None, None, ["Acme"]),
        ("q", "b", "Acme grew slowly", "s2", "Acme", None, None, ["Acme"]),
        ("q", "c", "Acme plant opened today", "s3", None, None, None, ["Acme"]),
    )
    kept = pairs.candidate_pairs(table, pairs.CandidateRules(max_pairs=1))
    assert [(r.a_id, r.b_id) for r in kept.collect()] == [("a", "b")]
    stats = pairs.candidate_stats(table, kept, pairs.candidate_pairs(table)).first()
    assert (stats.possible_pairs, stats.generated_pairs, stats.budget_truncated) == (3, 1, 2)


def test_contradiction_outranks_support_only_in_the_builder(spark):
    scored = spark.createDataFrame(
        [("q", "a", "b", 0.6, 0.6, 0.7, 0.7, 0.0, 0.0), ("q", "a", "c", 0.9, 0.85, 0.9, 0.9, 0.0, 0.0), ("q", "a", "d", 0.6, 0.2, 0.0, 0.0, 0.0, 0.0)],
        "query_id string, a_id string, b_id string, e_ab double, e_ba double, c_ab double, c_ba double, n_ab double, n_ba double",
    )
    edges = {(r.source_claim_id, r.target_claim_id): (r.relation_type, r.relation_confidence) for r in graph.classified_edges(scored).collect()}
    assert edges == {("a", "b"): (S.CONTRADICTION, 0.7), ("a", "c"): (S.DUPLICATE, 0.85), ("a", "d"): (S.SUPPORT, 0.6)}
    decided = {r.b_id: r.relation for r in pairs.decide_relations(scored).collect()}
    assert decided == {"b": "supports", "c": "duplicate", "d": "supports"}


def test_gate_needs_a_shared_entity_or_subject(spark):
    table = claims(
        spark,
        ("q", "a", "the deadline is june", "s1", "x", None, None, []),
        ("q", "b", "the deadline is not june", "s2", "y", None, None, [], True),
    )
    scored = pairs.gated(pairs.lexical_classifier())(pairs.candidate_pairs(table)).first()
    assert (scored.c_ab, scored.n_ab) == (0.0, 1.0)


def test_supersession_needs_subject_predicate_and_time(spark):
    rows = [
        ("q", "old", "t1", "s", "Deadline", "is", "July 10", [], False, "2024-01-01"),
        ("q", "new", "t2", "s", "deadline", "IS", "July 20", [], False, "2024-02-01"),
        ("q", "nopred", "t3", "s", "deadline", None, "July 30", [], False, "2024-03-01"),
        ("q", "notime", "t4", "s", "deadline", "is", "July 31", [], False, None),
    ]
    edges = temporal.supersession_edges(claims(spark, *rows)).collect()
    assert [(e.newer_id, e.older_id, e.confidence) for e in edges] == [("new", "old", 0.9)]


def test_latest_superseding_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", rng.randrange(4), rng.randrange(20)) for i in range(120)]
    table = spark.createDataFrame(rows, "id int, k string, v int, t int")
    got = {r.id: r.superseded_by for r in temporal.latest_superseding(table, ["k"], "v", "t", "id").collect()}
    for i, k, v, t in rows:
        later = [(t2, i2) for i2, k2, v2, t2 in rows if k2 == k and v2 != v and t2 > t]
        assert got[i] == (max(later)[1] if later else None)


def test_duplicate_clusters_are_stars(spark):
    rows = [(i, "Same  text" if i % 2 else "same text") for i in range(50)] + [(99, "alone")]
    found = graph.duplicate_clusters(spark.createDataFrame(rows, "id int, text string"), "id").collect()
    assert len(found) == 50 and {r.head_id for r in found} == {0} and {r.cluster_size for r in found} == {50}
    assert {r.kind for r in found if r.id % 2} == {"normalized"}


def test_lineage_and_validation(spark):
    table = claims(spark, *[("q", c, c, "s") for c in "abcd"])
    edges = relations(spark, ("a", "b", S.SUPERSESSION, 0.9), ("b", "c", S.SUPERSESSION, 0.9), ("b", "d", S.SUPERSESSION, 0.9), ("a", "zz", S.SUPPORT, 1.5))
    lineage = {r.claim_id: r.lineage for r in graph.source_lineage(table, edges.filter("target_claim_id <> 'zz'")).collect()}
    assert lineage["a"] == ["a", "b", "c"] and lineage["d"] == ["d"]
    issues = {(r.issue, r.id) for r in graph.validate(table, edges).collect()}
    assert issues == {("confidence_out_of_range", "r3"), ("dangling_target", "r3")}


def test_lineage_stops_at_cycles(spark):
    rng = random.Random(4)
    queries = {"ring": [1, 2, 0], "self": [0, 0], "tail": [1, 2, 3, 1, 0], "two": [1, 0, 3, 2, 2]} | {f"q{k}": [rng.randrange(12) if rng.random() < 0.9 else None for _ in range(12)] for k in range(20)}
    table = claims(spark, *[(q, f"c{k:02}", "x", "s") for q, to in queries.items() for k in range(len(to))])
    edges = [(q, f"r{k}", f"c{k:02}", f"c{t:02}", S.SUPERSESSION) for q, to in queries.items() for k, t in enumerate(to) if t is not None]
    edges = spark.createDataFrame(edges, "query_id string, relation_id string, source_claim_id string, target_claim_id string, relation_type string")
    found = {(r.query_id, r.claim_id): r.lineage for r in graph.source_lineage(table, edges).collect()}
    for q, to in queries.items():
        for k in range(len(to)):
            want, at = [], k
            while at is not None and at not in want:
                want.append(at)
                at = to[at]
            assert found[q, f"c{k:02}"] == [f"c{x:02}" for x in want]


def test_degree_limit_equals_the_sequential_rule(spark):
    rng = random.Random(7)
    pairs = sorted({(f"q{q}", *sorted(rng.sample([f"n{k:02}" for k in range(15)], 2))) for q in range(12) for _ in range(60)} | {("hub", "a", f"b{k:03}") for k in range(300)} | {("hub", "b001", "b002")})
    found = bridges.limit_degree(spark.createDataFrame(pairs, "query_id string, a_id string, b_id string"), 3)
    degree, want = {}, set()
    for q, a, b in pairs:
        if degree.get((q, a), 0) < 3 and degree.get((q, b), 0) < 3:
            want.add((q, a, b))
            for end in (a, b):
                degree[q, end] = degree.get((q, end), 0) + 1
    assert {tuple(r) for r in found.select("query_id", "a_id", "b_id").collect()} == want


@pytest.mark.parametrize("in_order", [200_000, 40, 0])
def test_degree_limit_does_not_go_round_for_small_queries(spark, monkeypatch, in_order):
    monkeypatch.setattr(bridges, "PAIRS_IN_ORDER", in_order)
    written, cut = [], bridges.cut_lineage
    monkeypatch.setattr(bridges, "cut_lineage", lambda df, name: written.append(name) or cut(df, name))
    rng = random.Random(9)
    # a chain: every pair waits for the one before it
    pairs = {("chain", f"n{k:02}", f"n{k + 1:02}") for k in range(45)} | {("q", *sorted(rng.sample("abcdefghijkl", 2))) for _ in range(30)}
    rows = [(*p, 0.5) for p in sorted(pairs) for _ in range(1 + (p[1] < "d"))]
    found = bridges.limit_degree(spark.createDataFrame(rows, "query_id string, a_id string, b_id string, confidence double"), 1)
    degree, want = set(), Counter()
    for p in sorted(pairs):
        if not degree & {(p[0], p[1]), (p[0], p[2])}:
            degree |= {(p[0], p[1]), (p[0], p[2])}
            want[p] = 1 + (p[1] < "d")
    assert Counter(tuple(r) for r in found.select("query_id", "a_id", "b_id").collect()) == want
    assert in_order < 200_000 or len(written) <= 3


def test_bridges_equal_the_rule_and_meet_in_one_join(spark):
    rng = random.Random(10)
    names = ["Ada", "Bob", "Cid", "Dan", "Eve"]
    rows = []
    for q in ("q", "r"):
        for k in range(14):
            own = rng.sample(names, rng.randrange(1, 4))
            rows.append((q, f"c{k:02}", rng.choice(["same", " same ", f"text {k}", "long " * 30]), "s", None, None, None, own))
    table = claims(spark, *rows)
    goals = {"q": {"Ada", "Eve"}, "r": {"Dan"}}
    asked = spark.createDataFrame([("q", "Who met Ada or Eve?"), ("r", "about Dan")], S.QUERIES)
    blocked = relations(spark, ("c00", "c01", S.SUPPORT, 0.7))
    gone = {(r.query_id, *sorted((r.source_claim_id, r.target_claim_id))) for r in blocked.collect()}
    found = bridges.bridge_candidates(table, blocked, asked)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3
    want = set()
    for q, a, at, *_, an in rows:
        for r, b, bt, *_, bn in rows:
            shared = sorted({*an} & {*bn})
            if q == r and a < b and shared and at.strip() != bt.strip() and {*an} - {*bn} and {*bn} - {*an} and ({*an} | {*bn}) & goals[q] and (q, a, b) not in gone:
                hit = [s for s in shared if s in goals[q]]
                rate = 0.6 + 0.2 * bool(hit) + 0.2 * bool({*an} & goals[q] and {*bn} & goals[q])
                want.add((q, a, b, (hit or shared)[0], tuple(shared), round(rate, 4)))
    assert {(r.query_id, r.a_id, r.b_id, r.bridge_entity, tuple(r.bridge_terms), r.confidence) for r in found.collect()} == want and len(want) > 10


@pytest.mark.parametrize("by_query", [256, 9, 0])
def test_bridges_of_large_queries_meet_by_name(spark, monkeypatch, by_query):
    monkeypatch.setattr(bridges, "CLAIMS_BY_QUERY", by_query)
    rng = random.Random(11)
    names = ["Ada", "Bob", "Cid", "Dan", "Eve"]
    rows = [(q, f"c{k:02}", rng.choice(["same", " same ", None, f"text {k}"]), "s", None, None, None, rng.sample(names, rng.randrange(1, 4))) for q, n in (("q", 20), ("r", 9), ("s", 5)) for k in range(n)]
    rows += rows[3:6]  # a claim that comes twice brings its pairs twice
    asked = spark.createDataFrame([("q", "Who met Ada?"), ("r", "about Dan or Eve"), ("s", "Bob")], S.QUERIES)
    ends = {(f"c{k:02}", f"c{k + d:02}") for k in range(15) for d in (1, 3)}
    blocked = relations(spark, *[(b, a, S.CONTRADICTION, 0.7) for a, b in sorted(ends)])
    gone = {(r.query_id, *sorted((r.source_claim_id, r.target_claim_id))) for r in blocked.collect()}
    goals = {"q": {"Ada"}, "r": {"Dan", "Eve"}, "s": {"Bob"}}
    want = Counter()
    for q, a, at, *_, an in rows:
        for r, b, bt, *_, bn in rows:
            if q == r and a < b and {*an} & {*bn} and at and bt and at.strip() != bt.strip() and {*an} - {*bn} and {*bn} - {*an} and ({*an} | {*bn}) & goals[q]:
                want[q, a, b] += (q, a, b) not in gone
    found = bridges.bridge_candidates(claims(spark, *rows), blocked, asked)
    assert Counter((r.query_id, r.a_id, r.b_id) for r in found.collect()) == +want and gone & {*want} and max(want.values()) > 1


def test_bridges_shuffle_claims_once_and_no_pairs(spark):
    rows = [("q", f"c{k}", f"Ada met Person{k}", "s", None, None, None, ["Ada", f"Person{k}"]) for k in range(6)]
    found = bridges.bridge_candidates(claims(spark, *rows), relations(spark, ("c0", "c1", S.SUPPORT, 0.7)), spark.createDataFrame([("q", "Ada")], S.QUERIES))
    assert found.count() == 14
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "LeftAnti" not in plan and plan.count("ReusedExchange") == 1 and len(shuffles) == 4
    assert all(line.split("hashpartitioning(")[1].startswith("query_id") and "a_id" not in line for line in shuffles)


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def test_degree_limit_leaves_only_its_result(spark, monkeypatch):
    cuts, cut = [], bridges.cut_lineage
    monkeypatch.setattr(bridges, "cut_lineage", lambda df, name: cuts.append(cut(df, name)) or cuts[-1])
    pairs = spark.createDataFrame([(f"q{k % 7}", f"a{k:02}", f"b{k:02}", 0.5) for k in range(60)], "query_id string, a_id string, b_id string, confidence double")
    before, was = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    found = bridges.limit_degree(pairs.repartition(5, "b_id"))
    for _ in range(100):  # the files are deleted without waiting for them
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
    assert found.count() == 60 and [os.path.exists(c.cut_path.removeprefix("file:")) for c in cuts] == [False, True, True]


def test_linear_supersession_answers_equal_the_pairs(spark):
    rng = random.Random(8)
    times = [None, *[datetime(2024, 1, d) for d in range(1, 9)]]
    rows = [("hot" if k % 3 else f"q{k % 5}", f"c{k:03}", rng.choice(["Sun", "sun", "", "moon"]), rng.choice(["is", "has", ""]), rng.choice("abc"), rng.choice(times)) for k in range(250)]
    table = spark.createDataFrame(rows, "query_id string, claim_id string, subject string, predicate string, object string, valid_from timestamp")
    table = table.selectExpr("*", "cast(array() as array<string>) quantities", "cast(array() as array<string>) dates", "cast(null as timestamp) asserted_at", "cast(null as timestamp) observed_at", "cast(null as timestamp) published_at")
    edges = {(r.query_id, r.newer_id, r.older_id) for r in temporal.supersession_edges(table).collect()}
    newest = {(r.query_id, r.newer_id, r.older_id) for r in temporal.superseding(table).collect()}
    assert newest <= edges and {(q, o) for q, _, o in newest} == {(q, o) for q, _, o in edges} and len(newest) == len({(q, o) for q, _, o in edges})
    counts = {r.query_id: r.pairs for r in temporal.supersession_counts(table).collect()}
    assert {q: n for q, n in counts.items() if n} == dict(Counter(q for q, _, _ in edges))
    some = [(q, a[1], b[1]) for q in ("hot", "q0") for a in rows for b in rows if a[0] == b[0] == q and a[1] < b[1]]
    between = {(r.query_id, r.newer_id, r.older_id) for r in temporal.supersession_between(table, spark.createDataFrame(some, "query_id string, a_id string, b_id string")).collect()}
    assert between == {e for e in edges if e[0] in ("hot", "q0")}


def test_bridges_respect_degree_and_evidence(spark):
    rows = [("q", f"c{i}", f"Ada Lovelace met Person{chr(65 + i)} today", "s", None, None, None, ["Ada Lovelace", f"Person{chr(65 + i)}"]) for i in range(7)]
    table = claims(spark, *rows)
    asked = spark.createDataFrame([("q", "Who met Ada Lovelace?")], S.QUERIES)
    blocked = relations(spark, ("c0", "c1", S.SUPPORT, 0.7))
    found = bridges.bridge_candidates(table, blocked, asked)
    assert found.count() == 20 and found.first().confidence == 1.0
    kept = bridges.limit_degree(found).collect()
    degree = {}
    for r in kept:
        for c in (r.a_id, r.b_id):
            degree[c] = degree.get(c, 0) + 1
    assert max(degree.values()) == 4 and {r.bridge_entity for r in kept} == {"Ada Lovelace"}


def test_published_trace(spark):
    asked, table, edges = builtin.reasoning_demo(spark)
    scores = reasoning.initial_scores(table, edges, asked)
    assert {r.claim_id: round(r.initial_belief, 4) for r in scores.collect()} == {"c1": 0.6943, "c2": 0.5743, "c3": 0.5543, "c4": 0.5943}
    beliefs = reasoning.propagate(table, edges, scores)
    rows = {r.claim_id: r for r in beliefs.collect()}
    assert (round(rows["c1"].belief, 4), round(rows["c3"].belief, 4), rows["c1"].iterations) == (0.7325, 0.4617, 15)
    board = reasoning.with_beliefs(scores, beliefs)
    conflicts = reasoning.resolve_conflicts(edges, board)
    assert [(r.outcome, r.preferred_claim_id) for r in conflicts.collect()] == [("preferred", "c1")]
    ctx = selection.context(table, edges, board, asked, conflicts, selection.Objective())
    picked = [r.claim_id for r in selection.select_greedy(ctx, selection.Budget()).collect()]
    assert sorted(picked) == ["c1", "c2", "c3", "c4"]


def test_propagation_reports_unsettled_graphs_and_keeps_the_others(spark):
    asked, table, edges = builtin.reasoning_demo(spark)
    scores = reasoning.initial_scores(table, edges, asked)
    rows = reasoning.propagate(table, edges, scores, reasoning.PropagationRules(max_iterations=2)).collect()
    assert all("did not settle" in r.error and not r.converged for r in rows) and len(rows) == 4
    alone = table.withColumn("query_id", F.lit("other"))
    both = scores.unionByName(scores.withColumn("query_id", F.lit("other")))
    rows = reasoning.propagate(table.unionByName(alone), edges, both, reasoning.PropagationRules(max_iterations=2)).collect()
    assert {(r.query_id, r.converged, r.iterations) for r in rows if r.query_id == "other"} == {("other", True, 1)}


def test_claims_without_a_score_start_at_one_half(spark):
    table = claims(spark, ("q", "a", "x y", "s0"), ("q", "b", "x z", "s1"), ("q", "z", "x w", "s2"))
    edges = relations(spark, ("b", "a", S.SUPPORT, 0.9))
    scores = spark.createDataFrame([("q", "a", 0.6), ("q", "z", 0.99)], "query_id string, claim_id string, initial_belief double")
    found = {r.claim_id: (round(r.belief, 4), r.iterations) for r in reasoning.propagate(table, edges, scores).collect()}
    assert found == {"a": (0.6, 1), "b": (0.5, 1), "z": (0.99, 1)}


@pytest.mark.parametrize("limit", [0, 3, 7, 50])
def test_propagation_equals_plain_rounds(spark, limit):
    rng = random.Random(5)
    table = claims(spark, *[(q, f"c{i}", "x", f"s{i}") for q in "pqr" for i in range(9)])
    kinds = [S.SUPPORT, S.CONTRADICTION]
    edges = [(q, *rng.sample([f"c{i}" for i in range(9)] + ["nobody"], 2), rng.choice(kinds), rng.uniform(0.2, 0.95)) for q in "qr" for _ in range(14)]
    parts = [relations(spark, *[e[1:] for e in edges if e[0] == q]).withColumn("query_id", F.lit(q)) for q in "qr"]
    graph = parts[0].unionByName(parts[1])
    scores = spark.createDataFrame([(q, f"c{i}", rng.uniform(0.1, 0.9)) for q in "pqr" for i in range(8)], "query_id string, claim_id string, initial_belief double")
    rules = reasoning.PropagationRules(max_iterations=limit, duplicate_discount=1.0)
    weights = [tuple(r) for r in reasoning.message_weights(table, graph, rules).select("query_id", "claim_id", "sender", "weight").collect()]
    first = {(r.query_id, r.claim_id): 0.5 for r in table.collect()} | {(r.query_id, r.claim_id): r.initial_belief for r in scores.collect()}
    expected = {}
    for q in "pqr":
        base = {c: math.log(b / (1 - b)) for (p, c), b in first.items() if p == q}
        belief, n, settled = {c: b for (p, c), b in first.items() if p == q}, 0, False
        while n < limit and not settled:
            net = dict.fromkeys(belief, 0.0)
            for p, to, sender, w in weights:
                if p == q and to in net:
                    net[to] += w * (2 * belief[sender] - 1)
            moved = {c: b / 2 + 0.5 / (1 + math.exp(-base[c] - net[c])) for c, b in belief.items()}
            settled = max(abs(moved[c] - belief[c]) for c in belief) < rules.tolerance
            belief, n = moved, n + 1
        expected |= {(q, c): (round(b, 9), n, settled, not settled) for c, b in belief.items()}
    found = reasoning.propagate(table, graph, scores, rules).collect()
    assert {(r.query_id, r.claim_id): (round(r.belief, 9), r.iterations, r.converged, r.error is not None) for r in found} == expected
    assert len(found) == len(expected)


def test_repeated_source_counts_less_than_independent_ones(spark):
    table = claims(spark, ("q", "t", "x y", "s0"), ("q", "a", "x z", "s1"), ("q", "b", "x w", "s1"), ("q", "c", "x v", "s2"))
    asked = spark.createDataFrame([("q", "x")], S.QUERIES)
    same = relations(spark, ("a", "t", S.SUPPORT, 0.9), ("b", "t", S.SUPPORT, 0.9))
    apart = relations(spark, ("a", "t", S.SUPPORT, 0.9), ("c", "t", S.SUPPORT, 0.9))
    belief = lambda e: reasoning.propagate(table, e, reasoning.initial_scores(table, e.limit(0), asked).withColumn("initial_belief", F.lit(0.7))).filter("claim_id = 't'").first().belief
    assert belief(apart) > belief(same)


def test_selection_budgets(spark):
    rows = [("q", f"c{i}", "w" * n, "s", 0.9) for i, n in enumerate([40, 900, 40, 300])]
    table = spark.createDataFrame(rows, "query_id string, claim_id string, text string, source_id string, extraction_confidence double")
    kept = selection.select_prefix(table, [F.asc("claim_id")], selection.Budget(100, 0))
    assert [r.claim_id for r in kept.orderBy("position").collect()] == ["c0"]
    ctx = spark.createDataFrame(
        [("q", f"c{i}", float(-i), n // 4) for i, n in enumerate([40, 900, 40, 300])],
        "query_id string, claim_id string, base double, tokens int",
    )
    picked = selection.select_top(ctx, selection.Budget(100, 0)).orderBy("position").collect()
    assert [r.claim_id for r in picked] == ["c0", "c2", "c3"]
    with pytest.raises(ValueError):
        selection.Budget(10, 20)
