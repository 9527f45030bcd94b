"""Times of claims and supersession of older values by newer ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.scale import SALTS, salted_copies


def event_time() -> Column:
    return F.coalesce("valid_from", "asserted_at")


def publication_time() -> Column:
    return F.coalesce("observed_at", "published_at")


def effective_time() -> Column:
    return F.coalesce("valid_from", "asserted_at", "observed_at", "published_at")


def fill_asserted(claims: DataFrame) -> DataFrame:
    """Use the publication time where a claim has no assertion time."""
    return claims.withColumn("asserted_at", F.coalesce("asserted_at", "published_at"))


def _timed(claims: DataFrame) -> DataFrame:
    """query_id, subject_key, claim_id, predicate_key, value, time of the claims that can supersede or be superseded."""
    empty = F.array().cast("array<string>")
    return claims.select(
        "query_id",
        T.casefold(F.coalesce("subject", F.lit(""))).alias("subject_key"),
        "claim_id",
        T.casefold(F.coalesce("predicate", F.lit(""))).alias("predicate_key"),
        F.struct(
            T.casefold(F.coalesce("object", F.lit(""))),
            F.coalesce("quantities", empty),
            F.coalesce("dates", empty),
        ).alias("value"),
        effective_time().alias("time"),
    ).filter((F.col("subject_key") != "") & F.col("time").isNotNull())


GROUP = ["query_id", "subject_key", "predicate_key"]


def superseding(claims: DataFrame) -> DataFrame:
    """query_id, older_id, newer_id: for every superseded claim the newest claim of its subject and predicate that replaces it.

    A row per claim at most, from aggregates that combine before the shuffle and a salted lookup; claims without a predicate
    are not confident enough to replace each other.
    """
    found = latest_superseding(_timed(claims).filter("predicate_key <> ''"), GROUP, "value", "time", "claim_id")
    found = found.filter(F.col("superseded_by").isNotNull())
    return found.select("query_id", F.col("claim_id").alias("older_id"), F.col("superseded_by").alias("newer_id"))


def supersession_counts(claims: DataFrame) -> DataFrame:
    """query_id, pairs: how many (newer, older) pairs :func:`supersession_edges` has, without making one.

    Pairs of other times, less those of one value: sums of squares over histograms, which combine before every shuffle.
    """

    def apart(by: list[str]) -> DataFrame:
        """Unordered pairs of one ``by`` with different times."""
        times = _timed(claims).filter("predicate_key <> ''").groupBy(*by, "time").agg(F.count(F.lit(1)).alias("n"))
        n, squares = F.sum("n"), F.sum(F.col("n") * F.col("n"))
        return times.groupBy(*by).agg(((n * n - squares) / 2).cast("bigint").alias("pairs")).groupBy("query_id").agg(F.sum("pairs").alias("pairs"))

    alike = apart([*GROUP, "value"]).withColumnRenamed("pairs", "alike")
    return apart(GROUP).join(alike, "query_id").select("query_id", (F.col("pairs") - F.col("alike")).alias("pairs"))


def supersession_between(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, newer_id, older_id of the ``pairs`` (query_id, a_id, b_id) of which one claim supersedes the other."""
    rows = _timed(claims).filter("predicate_key <> ''").select("query_id", "claim_id", F.struct("subject_key", "predicate_key").alias("group"), "value", "time")
    side = lambda s: rows.select("query_id", F.col("claim_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("group", "value", "time")])
    met = pairs.select("query_id", "a_id", "b_id").join(side("a"), ["query_id", "a_id"]).join(side("b"), ["query_id", "b_id"])
    met = met.filter((F.col("a_group") == F.col("b_group")) & (F.col("a_value") != F.col("b_value")) & (F.col("a_time") != F.col("b_time")))
    first = F.col("a_time") > F.col("b_time")
    return met.select("query_id", F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("newer_id"), F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("older_id")).distinct()


def supersession_edges(claims: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Newer-to-older edges between a query's claims on the same subject.

    All pairs leave this join. :func:`superseding`, :func:`supersession_counts` and :func:`supersession_between` answer
    what most readers need (is it old, by what, how many, does this one replace that one) in linear size.
    """
    rows = _timed(claims)
    newer, older = rows.alias("n"), rows.alias("o")
    joined = newer.join(
        older,
        (F.col("n.query_id") == F.col("o.query_id"))
        & (F.col("n.subject_key") == F.col("o.subject_key"))
        & (F.col("n.time") > F.col("o.time"))
        & (F.col("n.value") != F.col("o.value"))
        # below the confidence of other predicates, pairs meet on the predicate too
        & ((F.col("n.predicate_key") == F.col("o.predicate_key")) if min_confidence > 0.5 else F.lit(True)),
    )
    same_predicate = (F.col("n.predicate_key") != "") & (F.col("n.predicate_key") == F.col("o.predicate_key"))
    confidence = F.when(same_predicate, F.lit(0.9)).otherwise(F.lit(0.5))
    return joined.select(
        F.col("n.query_id").alias("query_id"),
        F.col("n.claim_id").alias("newer_id"),
        F.col("o.claim_id").alias("older_id"),
        confidence.alias("confidence"),
    ).filter(F.col("confidence") >= min_confidence)


def latest_superseding(facts: DataFrame, keys: list[str], value: str, time: str, row_id: str) -> DataFrame:
    """For each fact, the newest later fact of its group with another value.

    Instead of pairing a group's rows, it needs only the newest row of the group
    and the newest row with any other value: two aggregates that combine
    map-side, and one salted lookup, so one huge group stays spread out.
    """
    newest = F.max(F.struct(time, row_id)).alias("newest")
    per_value = facts.filter(F.col(time).isNotNull()).groupBy(*keys, value).agg(newest)
    top = per_value.groupBy(*keys).agg(F.max(F.struct("newest", value)).alias("top"))
    salt = F.pmod(F.xxhash64(value), F.lit(SALTS))
    copies = salted_copies(top, SALTS)
    others = (
        per_value.withColumn("_salt", salt)
        .join(copies, [*keys, "_salt"])
        .filter(F.col(value) != F.col(f"top.{value}"))
        .groupBy(*keys)
        .agg(F.max("newest").alias("other"))
    )
    best = salted_copies(top.join(others, keys, "left"), SALTS)
    rows = facts.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS))).join(best, [*keys, "_salt"])
    candidate = F.when(F.col(value) != F.col(f"top.{value}"), F.col("top.newest")).otherwise(F.col("other"))
    found = F.when(candidate[time] > F.col(time), candidate)
    return rows.select(
        *facts.columns, found[row_id].alias("superseded_by"), found[time].alias("superseded_at")
    )
