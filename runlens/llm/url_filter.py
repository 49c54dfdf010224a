"""URL filter: rules first, and for the rest trust and distrust along host links.

Hosts most of whose pages are allowed by a rule are trusted seeds, hosts most of whose
pages are blocked are blocked seeds. Trust flows from the trusted seeds along
the links between hosts (personalised PageRank), distrust from the blocked ones
against them: who links to a blocked host is distrusted. A host whose distrust exceeds its
trust is blocked; a host that neither reaches is allowed.

The flow is in whole numbers, so the result doesn't depend on the order of sums.
Links are counted once per pair of hosts, before anything is joined: a host
may have any number of pages and links.

A null url or one without "://" has an empty host and path. Null html has no
links. Page ids pass through, null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.skew import join_summary
from runlens.session import materialize

#: The mass that the seeds share, the share that flows on in percent, and the rounds.
MASS = 10**15
FLOW = 85
ROUNDS = 20
HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Fits a host, its subdomains, and paths that begin with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """`value` of the longest rule that fits, of equal ones the first; else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
    return chosen


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Distinct (source, target) hosts of links that leave their host."""
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    return (
        pages.select(
            host_of(F.col(url_col)).alias("source"),
            F.explode(F.regexp_extract_all(html_col, F.lit(HREF))).alias("link"),
        )
        .where(F.col("link").startswith("//") | F.col("link").contains("://"))
        .select("source", host_of(target).alias("target"))
        .where("source <> target and source <> '' and target <> ''")
        .distinct()
    )


def propagate(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, kind, mass) after ROUNDS rounds; `seeds` is (host, kind) with kind trust or distrust."""
    ways = links.select(F.col("source").alias("from"), F.col("target").alias("to"), F.lit("trust").alias("kind")).union(
        links.select("target", "source", F.lit("distrust"))
    )
    degrees = ways.groupBy("from", "kind").agg(F.count(F.lit(1)).alias("degree"))
    ways = materialize(ways.join(degrees, ["from", "kind"]), "host-links")
    sizes = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    start = materialize(
        seeds.join(F.broadcast(sizes), "kind").select("host", "kind", F.expr(f"{MASS} div n").alias("seed")), "host-seeds"
    )
    mass = start.withColumnRenamed("seed", "mass")
    if ways.isEmpty():  # nothing flows: only the seeds' own share is left
        return start.select("host", "kind", F.expr(f"seed * {100 - FLOW} div 100").alias("mass"))
    for _ in range(ROUNDS):
        moved = mass.join(ways, (F.col("host") == F.col("from")) & (mass["kind"] == ways["kind"])).select(
            F.col("to").alias("host"), ways["kind"], F.expr(f"mass * {FLOW} div 100 div degree").alias("mass")
        )
        stays = start.select("host", "kind", F.expr(f"seed * {100 - FLOW} div 100").alias("mass"))
        mass = materialize(moved.union(stays).groupBy("host", "kind").agg(F.sum("mass").alias("mass")), "host-mass")
    return mass


def judge(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(
        F.col(id_col).alias("id"),
        host.alias("host"),
        path.alias("path"),
        ruled(rules, host, path, lambda r: r.text).alias("rule"),
        ruled(rules, host, path, lambda r: r.verdict).alias("ruled"),
    )
    hosts = rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("ruled") == "allow").cast("long")).alias("allowed"),
        F.sum((F.col("ruled") == "block").cast("long")).alias("blocked"),
    )
    kind = F.when(F.col("allowed") * 2 > F.col("n"), "trust").when(F.col("blocked") * 2 > F.col("n"), "distrust")
    seeds = hosts.where("host <> ''").select("host", kind.alias("kind")).where("kind is not null")
    flows = propagate(host_links(pages, url_col, html_col), seeds)
    scores = flows.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0)).alias("distrust"),
    )
    bad = scores.where("distrust > trust").select(F.col("host").alias("bad_host"))
    judged = hosts.join(bad, F.col("host") == F.col("bad_host"), "left").select(
        "host", "n", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow").alias("by_links")
    )
    # A host may hold a third of all pages: the join spreads such hosts by their count.
    verdict = F.coalesce("ruled", "by_links").alias("verdict")
    return join_summary(rows, judged, "host", "n").select("id", "host", "path", "rule", verdict)
