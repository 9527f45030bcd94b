"""URL verdicts by rules and, where no rule fits, by trust and distrust that flow over host edges.

Host edges are the absolute links of pages, counted by (host, linked host), and the steps between a host and its parent
domain in both directions, down to two labels. Trust is personalised PageRank along the edges, from hosts with pages that
rules allow; distrust runs against the edges, from hosts with pages that rules block. Seeds weigh their share of
such pages. Steps are repeated until no rank, and no set of hosts reached, changes by more than ``SETTLED`` of it; what is left then changes a
rank by less than six times that. A host is blocked if its distrust is larger than its trust by more than ``APART`` of it.

Defined cases: null urls and urls without ``://`` have an empty host and path; no rule fits them, and as a host that no
trust or distrust reaches they are allowed. Null html has no links. Repeated rows are judged as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_KEYS, bounded
from factloom.scale import within_rows
from factloom.session import cut_lineage, release

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
#: Relative change of a rank that ends the rounds, and relative difference of ranks that counts.
SETTLED, APART = 1e-5, 1e-4
#: Steps between two tables that are written and compared.
STRIDE = 10
FEW_TASKS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host plus path, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight from pages (host, html)."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK)))).alias("dst"))
    links = links.select(F.col("host").alias("src"), F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src <> '' AND src <> dst")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    names = pages.select("host").union(links.select("dst")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    tail = lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    steps = F.when(F.size(labels) > 2, F.sequence(F.lit(1), F.size(labels) - 2)).otherwise(F.array().cast("array<int>"))
    ups = names.select(F.explode(F.transform(steps, lambda k: F.struct(tail(k).alias("src"), tail(k + 1).alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()
    both = ups.union(ups.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1).cast("bigint"))
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, settled: float = SETTLED, damping: float = DAMPING) -> DataFrame:
    """kind, host, rank at the fixed point; seeds (kind, host, seed), edges (kind, src, dst, share).

    A host first reached counts as changed, so chains of any length are followed to their ends. Ranks have at most a row for each
    kind and host; while these are counted to be few, a round runs in ``FEW_TASKS`` tasks and leaves as few shuffle files.
    """
    hosts = edges.select("kind", F.col("dst").alias("host")).union(seeds.select("kind", "host")).distinct()
    few = within_rows(hosts, BROADCAST_KEYS)
    small = lambda rows: rows.coalesce(FEW_TASKS) if few else rows
    edges = small(edges)
    ranks = before = cut_lineage(seeds.select("kind", "host", F.col("seed").alias("rank")), "ranks")
    number = 0
    while True:
        number += 1
        sent = edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
        ranks = small(small(sent.union(start)).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
        if number % STRIDE == 0:
            ranks = cut_lineage(ranks, "ranks")
            was = before.withColumnRenamed("rank", "was")
            moved = ranks.join(was, ["kind", "host"], "left").filter(F.coalesce(F.abs(F.col("rank") - F.col("was")) > settled * F.col("rank"), F.col("rank") > 0))
            still = moved.isEmpty()
            release(before)
            before = ranks
            if still:
                return ranks


def judged(pages: DataFrame, rules=RULES, *, settled: float = SETTLED) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of pages (page_id, url, html)."""
    host, path = split_url(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    marked = named.withColumn("rule", rule).withColumn("ruled", ruled)

    edges = cut_lineage(host_edges(named), "edges")
    share = lambda end: F.col("weight") / F.col("total")
    forward = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("total")), "src").select(F.lit("allow").alias("kind"), "src", "dst", share("src").alias("share"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("weight").alias("total")), "dst").select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), share("dst").alias("share"))
    flows = cut_lineage(forward.union(back), "flows")
    counts = cut_lineage(marked.filter("ruled IS NOT NULL AND host <> ''").groupBy(F.col("ruled").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n")), "seeds")
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counts.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))  # two kinds
    ranks = propagate(flows, seeds, settled=settled)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    hosts = cut_lineage(ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust")), "hosts")
    out = marked.drop("html").join(bounded(hosts), "host", "left")
    known = F.col("distrust") > F.col("trust") * (1 + APART)
    verdict = F.coalesce("ruled", F.when(known, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
