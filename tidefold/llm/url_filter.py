"""URL filters: rules first, then trust and distrust carried over host links.

A url that a rule fits takes the longest rule's verdict. Others take that of
their host, from two personalised PageRanks over host edges: trust starts from
hosts whose pages rules mostly allow and follows links; distrust starts from
hosts whose pages rules mostly block and follows links backwards, to whoever
links there. A host is blocked where its distrust outweighs its trust and
reaches ``MIN_DISTRUST``. Edges are distinct pairs of hosts: absolute links in
the html, and the tie between a host and its parent domain, both ways.

Ranks are BIGINT units and shares round down, so that sums do not depend on the
order of rows, and runs and SQL agree exactly. Both walks go in the same joins
(``_walk`` tells them apart). Links are reduced to distinct pairs before they
are shuffled, and a host with very many links is a skewed side of an ordinary
join, which Spark splits. The plan is cut by a written table every few steps.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null html has no links; of rules of equal length the
first listed wins; a host whose trust equals its distrust is allowed; very long html is
searched whole; repeated rows come out each; an empty table gives no rows; other columns
are not looked at. Links without a scheme are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import ascii_lower, scratch_of

# Verdict, host and path of each rule of the query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
LINK = r"(?i)href\s*=\s*[\"']?\s*[a-z][a-z0-9+.-]*://([^/?#\"'\s<>]+)"
UNITS = 10**15
DAMPING_PCT = 85
STEPS = 8
STEPS_PER_TABLE = 4
# A host with this share of its pages under rules of one verdict is a seed.
SEED_PCT = 50
MIN_DISTRUST = 1000
TRUST, DISTRUST = 0, 1


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def longest_rule(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule[1] + rule[2])):
        _, name, start = rule
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` of links between hosts and of domain ties."""
    hosts = pages.select(url_host(F.col("url")).alias("src"), "html").where(F.col("src") != "")
    links = hosts.select(
        "src", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst")
    ).select("src", ascii_lower(F.col("dst")).alias("dst"))
    # A parent domain has two labels at least.
    ties = (
        hosts.select("src")
        .distinct()
        .select("src", F.regexp_extract("src", r"^[^.]+\.([^.]+\..+)$", 1).alias("dst"))
        .where(F.col("dst") != "")
    )
    return (
        links.union(ties)
        .union(ties.select("dst", "src"))
        .where((F.col("src") != F.col("dst")) & (F.col("dst") != ""))
        .distinct()
    )


def host_seeds(judged: DataFrame) -> DataFrame:
    """``_walk, host, seed`` in units, from pages with ``host`` and ``_ruled``."""
    counts = (
        judged.where(F.col("host") != "")
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(F.col("_ruled") == "allow").alias("allowed"),
            F.count_if(F.col("_ruled") == "block").alias("blocked"),
        )
    )
    of = lambda walk, count: counts.where(
        (F.col(count) > 0) & (F.col(count) * 100 >= F.col("pages") * SEED_PCT)
    ).select(F.lit(walk).alias("_walk"), "host")
    seeds = of(TRUST, "allowed").union(of(DISTRUST, "blocked"))
    totals = seeds.groupBy("_walk").agg(F.count(F.lit(1)).alias("_hosts"))
    return seeds.join(totals, "_walk").select(
        "_walk", "host", F.expr(f"{UNITS} div _hosts").alias("seed")
    )


def propagate(edges: DataFrame, seeds: DataFrame, scratch, steps=STEPS) -> DataFrame:
    """``_walk, host, rank`` after ``steps`` of both walks."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_degree"))
    into = edges.groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("_degree"))
    steps_of = (
        edges.join(out, "src")
        .select(F.lit(TRUST).alias("_walk"), F.col("src").alias("host"), "dst", "_degree")
        .union(
            edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            .join(into, "src")
            .select(F.lit(DISTRUST).alias("_walk"), F.col("src").alias("host"), "dst", "_degree")
        )
    )
    steps_of = scratch.save(steps_of, "walks")
    seeds = scratch.save(seeds, "seeds")
    kept = seeds.select("_walk", "host", F.expr(f"seed * {100 - DAMPING_PCT} div 100").alias("part"))
    ranks = seeds.withColumnRenamed("seed", "rank")
    for step in range(1, steps + 1):
        moved = steps_of.join(ranks, ["_walk", "host"]).select(
            "_walk",
            F.col("dst").alias("host"),
            F.expr(f"rank * {DAMPING_PCT} div (100 * _degree)").alias("part"),
        )
        ranks = moved.union(kept).groupBy("_walk", "host").agg(F.sum("part").alias("rank"))
        if step % STEPS_PER_TABLE == 0:
            ranks = scratch.save(ranks, f"ranks-{step}")
    return ranks


def filter_urls(pages: DataFrame, rules=RULES, scratch=None) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` per row of ``pages``."""
    scratch = scratch or scratch_of(pages)
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = pages.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        longest_rule(host, path, rules, lambda rule: rule[1] + rule[2]).alias("rule"),
        longest_rule(host, path, rules, lambda rule: rule[0]).alias("_ruled"),
    )
    ranks = propagate(host_edges(pages), host_seeds(judged), scratch)
    scores = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("_walk") == TRUST, F.col("rank")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("_walk") == DISTRUST, F.col("rank")).otherwise(0)).alias("distrust"),
    )
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    carried = F.when((distrust > trust) & (distrust >= MIN_DISTRUST), "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("_ruled", carried).alias("verdict"),
        trust.cast("long").alias("trust"),
        distrust.cast("long").alias("distrust"),
    )
