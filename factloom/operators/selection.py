"""Choosing a compact evidence set under a token budget.

Greedy and beam selection are rounds over a table of states (claims chosen, terms and sources covered, cost, value),
in which all queries take their next step at once; nothing is gathered per query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom import schemas as S
from factloom.functions import text as T
from factloom.operators import graph as G
from factloom.scale import top_per_key
from factloom.session import cut_lineage

KEY = ["query_id", "claim_id"]


@dataclass(frozen=True)
class Budget:
    total: int = 256
    reserved: int = 64

    def __post_init__(self) -> None:
        if not 0 <= self.reserved <= self.total:
            raise ValueError("reserved output must be between 0 and the total budget")

    @property
    def available(self) -> int:
        return self.total - self.reserved


@dataclass(frozen=True)
class Objective:
    utility: float = 1.0
    belief: float = 1.0
    coverage: float = 0.5
    coherence: float = 0.3
    independence: float = 0.3
    uncertainty: float = 0.2
    redundancy: float = 0.5
    lineage: float = 0.5
    unresolved: float = 0.3
    beam_width: int = 4


def context(
    claims: DataFrame,
    relations: DataFrame,
    board: DataFrame,
    queries: DataFrame,
    conflicts: DataFrame | None,
    objective: Objective,
    count_tokens: Callable[[Column], Column] = T.character_tokens,
) -> DataFrame:
    """One row per claim with everything a selector needs; ``count_tokens`` gives a text's cost."""
    terms = queries.select("query_id", T.token_set(F.col("text")).alias("_q"))
    rows = board.join(terms, "query_id")
    lists = {
        "supporters": G.directed_lookup(relations, S.SUPPORT, incoming=True).withColumnRenamed("ids", "supporters"),
        "opponents": G.neighbors(relations, [S.CONTRADICTION]).withColumnRenamed("neighbors", "opponents"),
        "duplicates": G.neighbors(relations, [S.DUPLICATE]).withColumnRenamed("neighbors", "duplicates"),
        "linked": G.neighbors(relations).withColumnRenamed("neighbors", "linked"),
    }
    for name, table in lists.items():
        rows = rows.join(table, KEY, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    if conflicts is not None:
        open_claims = (
            conflicts.filter(F.col("outcome") == "unresolved")
            .select("query_id", F.explode("claim_ids").alias("claim_id"), F.lit(True).alias("open"))
            .distinct()
        )
        rows = rows.join(open_claims, KEY, "left")
    else:
        rows = rows.withColumn("open", F.lit(None).cast("boolean"))
    base = objective.utility * F.col("query_utility") + objective.belief * F.col("belief")
    return rows.select(
        *KEY,
        "source_id",
        "belief",
        "query_utility",
        base.alias("base"),
        count_tokens(F.col("text")).cast("int").alias("tokens"),
        F.array_intersect(T.token_set(F.col("text")), "_q").alias("covers"),
        F.size("_q").alias("query_terms"),
        *lists,
        F.coalesce("open", F.lit(False)).alias("open"),
    )


#: Gains and values are rounded to so many places before they are compared, so ties are decided by ids everywhere.
PLACES = 9
_STATE = ["query_id", "rank", "chosen", "gains", "covered", "sources", "used", "value"]


def _gain(goal: Objective) -> Column:
    """What a claim (columns of :func:`context`) adds to a state (chosen, covered, sources)."""
    facing = F.arrays_overlap("opponents", "chosen")
    fresh = F.size(F.array_except("covers", "covered")) / F.greatest(F.col("query_terms"), F.lit(1))
    gain = (
        F.col("base")
        + goal.coverage * fresh
        + F.when(F.arrays_overlap("supporters", "chosen"), goal.coherence).otherwise(0.0)
        + F.when(F.array_contains("sources", F.col("source_id")), -goal.lineage).otherwise(goal.independence)
        + F.when(facing, goal.uncertainty).otherwise(0.0)
        - F.when(F.arrays_overlap("duplicates", "chosen"), goal.redundancy).otherwise(0.0)
        - F.when(F.col("open") & ~facing, goal.unresolved).otherwise(0.0)
    )
    return F.round(gain, PLACES)


def _claims(ctx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims a round looks at, and their links (query_id, at, claim_id); each written once, for all rounds."""
    columns = [*KEY, "source_id", "base", "tokens", "covers", "query_terms", "supporters", "opponents", "duplicates", "open"]
    claims = cut_lineage(ctx.select(*columns), "claims")
    return claims, cut_lineage(ctx.select("query_id", F.col("claim_id").alias("at"), F.explode("linked").alias("claim_id")), "links")


def _grown(states: DataFrame, claims: DataFrame, links: DataFrame, available: int, goal: Objective) -> DataFrame:
    """Every state with each claim that touches it, is not in it and still fits, and the claim's gain; as often as it touches it.

    States meet claims over the links of what they hold, so a round's work grows with the neighbours of the states, not with
    the claims of a query.
    """
    met = states.withColumn("at", F.explode("chosen")).join(links, ["query_id", "at"]).drop("at")
    met = met.filter(~F.array_contains("chosen", F.col("claim_id"))).join(claims, KEY)
    return met.filter(F.col("used") + F.col("tokens") <= available).withColumn("gain", _gain(goal))


def _after(value: Column) -> list[Column]:
    """The next state of a grown one, but for its rank."""
    return [
        F.col("query_id"), F.array_append("chosen", F.col("claim_id")).alias("chosen"), F.array_append("gains", F.col("gain")).alias("gains"),
        F.array_union("covered", "covers").alias("covered"), F.array_union("sources", F.array("source_id")).alias("sources"),
        (F.col("used") + F.col("tokens")).alias("used"), F.round(value, PLACES).alias("value"),
    ]


def _empty(claims: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return claims.withColumns(
        {"chosen": none, "gains": F.array().cast("array<double>"), "covered": none, "sources": none, "used": F.lit(0), "value": F.lit(0.0)}
    )


def _rows(states: DataFrame) -> DataFrame:
    """query_id, position, claim_id, contribution of states."""
    pairs = F.arrays_zip("chosen", "gains")
    return states.select("query_id", F.posexplode(pairs).alias("position", "_p")).select(
        "query_id", F.col("_p.chosen").alias("claim_id"), "position", F.round("_p.gains", 6).alias("contribution"))


def select_greedy(ctx: DataFrame, budget: Budget, goal: Objective | None = None) -> DataFrame:
    """Grow a connected set by marginal gain, then keep open counterparts.

    All queries take their next claim in the same round: the claims that touch a query's set are met by a join, and the one
    of the largest gain (ties: smallest id) is one combinable minimum per query. Queries without a positive gain are done.
    The rounds are bounded by the budget, as every claim costs a token.
    """
    goal, available = goal or Objective(), budget.available
    claims, links = _claims(ctx)
    start = _empty(claims.filter(F.col("tokens") <= available)).withColumn("gain", F.round("base", PLACES))
    pick = F.struct((-F.col("gain")).alias("less"), F.col("claim_id"), F.struct(*_after(F.col("value") + F.col("gain"))).alias("state"))

    def best(rows: DataFrame) -> DataFrame:
        chosen = rows.groupBy("query_id").agg(F.min(pick).alias("_b"))
        return chosen.select("_b.state.*").withColumn("rank", F.lit(0)).select(_STATE)

    states = cut_lineage(best(start), "states")
    done = []
    while True:
        more = cut_lineage(best(_grown(states, claims, links, available, goal).filter("gain > 0")), "states")
        if more.isEmpty():
            done.append(states)
            break
        done.append(states.join(more.select("query_id"), "query_id", "left_anti"))
        states = more
    ended = done[0]
    for part in done[1:]:
        ended = ended.unionByName(part)
    ended = cut_lineage(ended, "selected")
    rows = _rows(ended).withColumn("reason", F.when(F.col("position") == 0, "first: largest base value that fits").otherwise("added: gain above zero"))

    # an open question shows both of its sides, as far as they fit
    sides = rows.join(claims.filter("open"), KEY).select("query_id", "position", F.explode("opponents").alias("claim_id"))
    sides = sides.join(ended.select("query_id", "chosen"), "query_id").filter(~F.array_contains("chosen", F.col("claim_id")))
    sides = sides.groupBy(*KEY).agg(F.min("position").alias("position")).join(claims.select(*KEY, "tokens"), KEY)
    listed = sides.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "claim_id", "tokens"))).alias("sides"))
    listed = listed.join(ended.select("query_id", "used", F.size("chosen").alias("first")), "query_id")

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= available
        return F.struct(
            F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.array_append(acc["ids"], x["claim_id"])).otherwise(acc["ids"]).alias("ids"))

    kept = F.aggregate("sides", F.struct("used", F.array().cast("array<string>").alias("ids")), step, lambda acc: acc["ids"])
    kept = listed.select("query_id", "first", F.posexplode(kept).alias("_k", "claim_id"))
    kept = kept.select("query_id", "claim_id", (F.col("first") + F.col("_k")).alias("position"), F.lit(goal.uncertainty).alias("contribution"),
                       F.lit("kept: other side of an open contradiction").alias("reason"))
    return rows.unionByName(kept)


def select_beam(ctx: DataFrame, budget: Budget, goal: Objective | None = None) -> DataFrame:
    """Bounded search over connected extensions by total gain.

    States are rows; in a round all states of all queries grow by one claim over a join with its neighbours, and the best
    ``beam_width`` of a query stay (WindowGroupLimit sends no more per task). Ties go to the smaller sorted ids, then
    to the state that ranked before. A query is done when its best state is no better than the best before.
    """
    goal, available = goal or Objective(), budget.available
    claims, links = _claims(ctx)
    start = _empty(claims.filter(F.col("tokens") <= available)).withColumns({"gain": _gain(goal), "rank": F.lit(0)})
    first = top_per_key(start, ["query_id"], [F.desc("base"), F.asc("claim_id")], goal.beam_width, "_first").drop("rank").withColumnRenamed("_first", "rank")
    states = cut_lineage(first.select(*_after(F.col("value") + F.col("gain")), "rank").select(_STATE), "states")
    top = F.max(F.struct("value", "chosen", F.struct("gains", "used", "covered", "sources").alias("rest"))).alias("_b")
    best = cut_lineage(states.groupBy("query_id").agg(top).select("query_id", "_b.value", "_b.chosen", "_b.rest.gains", F.lit(0).alias("round")), "best")
    bests = best
    for number in range(1, available + 1):  # every claim costs a token
        grown = _grown(states, claims, links, available, goal).dropDuplicates([*KEY, "rank"]).withColumn("total", F.round(F.col("value") + F.col("gain"), PLACES))
        order = [F.desc("total"), F.array_sort(F.array_append("chosen", F.col("claim_id"))), F.asc("rank"), F.desc("base"), F.asc("claim_id")]
        kept = top_per_key(grown, ["query_id"], order, goal.beam_width, "_next")
        kept = cut_lineage(kept.select(*_after(F.col("total")), F.col("_next").alias("rank")).select(_STATE), "states")
        better = kept.filter("rank = 0").join(best.select("query_id", F.col("value").alias("_was")), "query_id").filter(F.col("value") > F.col("_was"))
        best = cut_lineage(better.select("query_id", "value", "chosen", "gains", F.lit(number).alias("round")), "best")
        if best.isEmpty():
            break
        bests = bests.unionByName(best)
        states = kept.join(best.select("query_id"), "query_id", "left_semi").select(_STATE)
    last = bests.groupBy("query_id").agg(F.max_by(F.struct("chosen", "gains"), "round").alias("_b")).select("query_id", "_b.*")
    rows = _rows(last).join(claims.select(*KEY, "base"), KEY)
    return rows.select(*KEY, "position", F.round("base", 6).alias("contribution"), F.lit("on the best path found").alias("reason"))


def select_top(ctx: DataFrame, budget: Budget) -> DataFrame:
    """Highest base value first, skipping what no longer fits.

    Claims cost at least one token, so the first fit is decided within one
    query's sorted claims; the running total is a fold over that list.
    """
    item = F.struct((-F.col("base")).alias("order"), "claim_id", "tokens")
    packed = ctx.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kind = "array<struct<order:double,claim_id:string,tokens:int>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x["tokens"] <= budget.available
        return F.struct(
            F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).cast("int").alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = F.aggregate("_items", start, step, lambda acc: acc["kept"])
    return packed.select("query_id", F.posexplode(kept).alias("position", "_k")).select(
        "query_id",
        "_k.claim_id",
        "position",
        F.round(-F.col("_k.order"), 6).alias("contribution"),
        F.lit("top base value within budget").alias("reason"),
    )


def select_prefix(claims: DataFrame, order: list, budget: Budget, count_tokens: Callable[[Column], Column] = T.prefix_tokens) -> DataFrame:
    """Take claims in order until one no longer fits; the first always stays.

    Every claim costs at least one token, so only the first ``available + 1`` per
    query can matter. They are cut out before the shuffle, which keeps a query
    with millions of claims cheap.
    """
    near = top_per_key(claims, ["query_id"], order, budget.available + 1, "position")
    near = near.withColumn("tokens", count_tokens(F.col("text")).cast("int"))
    w = W.partitionBy("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = near.withColumn("used", F.sum("tokens").over(w))
    return near.filter((F.col("position") == 0) | (F.col("used") <= budget.available))


def select_best(board: DataFrame, n: int) -> DataFrame:
    """The first ``n`` claims by utility, belief and id."""
    order = [F.desc_nulls_last("query_utility"), F.desc_nulls_last("belief"), F.asc("claim_id")]
    return top_per_key(board, ["query_id"], order, n, "position")


def explain(ctx: DataFrame, picked: DataFrame, budget: Budget, rejected: str = "rejected: no positive connected marginal gain") -> DataFrame:
    """A row per candidate claim, selected or not, with its reason.

    Where no claim of a query fits, all are over the budget; else ``rejected`` says why the rest is not there.
    """
    fits = ctx.groupBy("query_id").agg((F.min("tokens") <= budget.available).alias("_any"))
    rows = ctx.join(picked, KEY, "left").join(fits, "query_id")
    over = F.when(~F.col("_any"), F.lit("rejected: exceeds token budget")).otherwise(F.lit(rejected))
    return rows.select(
        *KEY,
        "source_id",
        "belief",
        "query_utility",
        F.round("base", 6).alias("selection_score"),
        F.coalesce("contribution", F.lit(0.0)).alias("contribution"),
        F.col("position").isNotNull().alias("selected"),
        F.coalesce("reason", over).alias("reason"),
        "supporters",
        "opponents",
        "duplicates",
        "tokens",
    )


def weakly_connected(ctx: DataFrame, picked: DataFrame) -> DataFrame:
    """Per query: does every selected claim have a selected neighbour?"""
    chosen = picked.groupBy("query_id").agg(F.collect_set("claim_id").alias("_ids"))
    rows = ctx.join(picked.select(*KEY), KEY, "left_semi").join(chosen, "query_id")
    linked = F.arrays_overlap("linked", F.array_remove("_ids", F.col("claim_id")))
    return rows.groupBy("query_id").agg(
        (F.max(F.size("_ids")) <= 1).alias("_single"), F.bool_and(linked).alias("_all")
    ).select("query_id", (F.col("_single") | F.col("_all")).alias("connected"))


def connected(relations: DataFrame, picked: DataFrame) -> DataFrame:
    """Per query: are the selected claims one component of the induced graph?"""
    parts = G.clusters(picked.select(*KEY), G.induced(relations, picked))
    return parts.groupBy("query_id").agg((F.count_distinct("component") <= 1).alias("connected"))


def term_coverage(ctx: DataFrame, picked: DataFrame) -> DataFrame:
    """Share of the query's terms covered by its selected claims."""
    rows = ctx.join(picked.select(*KEY), KEY, "left_semi")
    return rows.groupBy("query_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("_n"),
        F.max("query_terms").alias("_q"),
    ).select("query_id", F.when(F.col("_q") > 0, F.col("_n") / F.col("_q")).otherwise(F.lit(0.0)).alias("coverage"))
