"""Selectors against the objective's definition on random graphs, all graphs in one table."""

import random

from factloom.operators import selection

CONTEXT = (
    "query_id string, claim_id string, source_id string, base double, tokens int, covers array<string>, query_terms int, open boolean, "
    "linked array<string>, supporters array<string>, opponents array<string>, duplicates array<string>, belief double, query_utility double"
)


def board(seed):
    rng, n = random.Random(seed), 9
    ids = [f"c{k}" for k in range(n)]
    edges = [(a, b, rng.choice(["s", "o", "d"])) for a in ids for b in ids if a < b and rng.random() < 0.35]
    near = lambda c, kind: [b if a == c else a for a, b, k in edges if c in (a, b) and k in kind]
    return {
        c: {
            "query_id": str(seed), "claim_id": c, "source_id": f"s{rng.randrange(4)}", "base": round(rng.random() * 2 - 0.4, 2), "tokens": rng.randrange(3, 12),
            "covers": rng.sample(["t0", "t1", "t2", "t3"], rng.randrange(4)), "query_terms": 4, "open": rng.random() < 0.4,
            "linked": near(c, "sod"), "supporters": near(c, "s"), "opponents": near(c, "o"), "duplicates": near(c, "d"), "belief": 0.0, "query_utility": 0.0,
        }
        for c in ids
    }


def gain(rows, goal, claim, before):
    """What the objective says that ``claim`` adds to the claims ``before`` it."""
    own, earlier = rows[claim], [rows[c] for c in before]
    fresh = set(own["covers"]) - {t for c in earlier for t in c["covers"]}
    value = own["base"] + goal.coverage * len(fresh) / 4
    value += goal.coherence * bool(set(own["supporters"]) & set(before))
    value += -goal.lineage if own["source_id"] in {c["source_id"] for c in earlier} else goal.independence
    facing = bool(set(own["opponents"]) & set(before))
    value += goal.uncertainty * facing - goal.redundancy * bool(set(own["duplicates"]) & set(before))
    return round(value - goal.unresolved * (own["open"] and not facing), 9)


def selected(spark, boards, rule, budget, goal):
    rows = [c for rows in boards for c in rows.values()]
    picked = rule(spark.createDataFrame(rows, CONTEXT), selection.Budget(budget, 0), goal)
    found = {}
    for r in picked.orderBy("query_id", "position").collect():
        found.setdefault(int(r["query_id"]), []).append((r["claim_id"], r["contribution"], r["reason"]))
    return found


def test_greedy_takes_the_largest_gain_each_time(spark):
    boards, goal, budget = [board(s) for s in range(60)], selection.Objective(), 30
    found = selected(spark, boards, selection.select_greedy, budget, goal)
    kinds = set()
    for seed, rows in enumerate(boards):
        chosen, grows = [], True
        cost = lambda claims: sum(rows[c]["tokens"] for c in claims)
        for claim, value, reason in [*found.get(seed, []), (None, None, "end")]:
            options = {
                c: gain(rows, goal, c, chosen) for c in rows
                if c not in chosen and set(rows[c]["linked"]) & set(chosen) and cost([*chosen, c]) <= budget
            }
            kinds.add(reason.split(":")[0])
            if reason.startswith("added"):
                assert grows and claim == min(options, key=lambda c: (-options[c], c)) and abs(options[claim] - value) < 1e-6 and value > 0
            elif reason.startswith("first"):
                assert not chosen and value == max(r["base"] for r in rows.values() if r["tokens"] <= budget)
            else:
                assert not grows or not [x for x in options.values() if x > 0]
                grows = False
                if claim:
                    assert any(rows[c]["open"] for c in set(rows[claim]["opponents"]) & set(chosen))
            if claim:
                chosen.append(claim)
        assert cost(chosen) <= budget and len(chosen) == len(set(chosen))
    assert kinds == {"first", "added", "kept", "end"}


def test_a_wide_beam_is_an_exhaustive_search(spark):
    boards, goal, budget = [board(s) for s in range(25)], selection.Objective(beam_width=10**6), 26
    found = selected(spark, boards, selection.select_beam, budget, goal)
    for seed, rows in enumerate(boards):
        cost = lambda claims: sum(rows[c]["tokens"] for c in claims)
        total = lambda path: sum(gain(rows, goal, c, path[:k]) for k, c in enumerate(path))
        level = [(c,) for c in rows if cost([c]) <= budget]
        best = max(map(total, level))
        while level:
            level = [(*p, c) for p in level for c in rows if c not in p and set(rows[c]["linked"]) & set(p) and cost([*p, c]) <= budget]
            longer = max(map(total, level), default=-1e9)
            if longer <= best + 1e-9:
                break
            best = longer
        assert abs(total(tuple(c for c, _, _ in found[seed])) - best) < 1e-6


def test_nothing_fits(spark):
    rows = board(1)
    ctx = spark.createDataFrame(list(rows.values()), CONTEXT)
    for rule in (selection.select_greedy, selection.select_beam):
        picked = rule(ctx, selection.Budget(2, 0))
        assert picked.collect() == []
        assert {r["reason"] for r in selection.explain(ctx, picked, selection.Budget(2, 0)).collect()} == {"rejected: exceeds token budget"}
