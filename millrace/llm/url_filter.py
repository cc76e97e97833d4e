"""Operator 9: URL verdicts from rules and from trust over the link graph.

A rule names a host (with its subdomains) and a path's beginning; the longest
rule that fits decides.  Hosts that no rule decides are judged by propagation
over links between hosts: trust flows along links from the hosts of allowed
pages, distrust flows against links from the hosts of blocked pages, both as
personalised PageRank with the seeds weighed by their pages, repeated until the
ranks stay as they are.  A host is blocked
where its distrust is above ``LEAST_DISTRUST`` times the mean and above its
trust.  All of it is DataFrame operations.

Defined results: a null url or one without ``://`` has an empty host and path
and no rule, and is judged as a host of its own without links (allowed); null
html has no links; repeated rows each give a row and count as pages each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, staged

#: Rules up to this number are literals in the plan; more are a table, joined on hosts and beginnings of paths.
LITERAL_RULES = 200
#: Rules up to this number are broadcast.
BROADCAST_RULES = 100_000
DAMPING = 0.85
#: Ranks are settled when a round's changes sum to less than this part of a host's mean rank.
TOLERANCE = 1e-3
#: Times the mean distrust of all hosts.
LEAST_DISTRUST = 1.0
#: Blocked hosts up to this number are broadcast.
BROADCAST_HOSTS = 100_000

_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Links that can leave a host: absolute ones and those without a scheme.
_LINK = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)"""

Rule = tuple[str, str, str]  # verdict, host, beginning of the path


def parse_rule(verdict: str, rule: str) -> Rule:
    """``example.com/en/`` as the host ``example.com`` and paths from ``/en/`` on."""
    if verdict not in ("allow", "block"):
        raise ValueError(verdict)
    host, slash, path = rule.partition("/")
    return verdict, host, slash + path


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``pages`` with host, path, rule and the rule's verdict (null without a rule)."""
    if len(rules) > LITERAL_RULES:
        table = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
        return ruled_by_table(pages, table)
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last that fits is the longest
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("verdict", verdict)


def ruled_by_table(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a table of rules (verdict, host, path) of any size; of equal rules the last verdict in the alphabet counts.

    Each different address looks up its host and the domains above it, cut to the lengths that the paths of their rules have.
    """
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rules = staged(rules.groupBy(F.col("host").alias("domain"), F.col("path").alias("begins")).agg(F.max("verdict").alias("verdict")), "rules")
    rules = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    lengths = rules.select("domain", F.length("begins").alias("length")).distinct()
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = pages.select("host", "path").distinct().withColumn("domain", F.explode(above)).join(lengths, "domain")
    places = places.filter(F.length("path") >= F.col("length")).withColumn("begins", F.substring(F.col("path"), F.lit(1), F.col("length")))
    fits = places.join(rules, ["domain", "begins"]).withColumn("rule", F.concat("domain", "begins"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    best = best.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "best.rule", "best.verdict")
    return pages.join(best, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left").drop("of_host", "of_path")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, with their number."""
    linking = pages.select("host", "html").filter(F.col("html").contains("//") & (F.col("host") != ""))
    links = linking.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    return links.select("src", dst.alias("dst")).filter("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(hosts: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Personalised PageRank: ``hosts`` (host, seed; the seeds sum to 1), ``edges`` (src, dst, n) -> (host, rank).

    What hosts without outgoing edges hold flows back to the seeds.  Without ``rounds`` it goes on until the ranks are
    settled; each round's changes are at most ``DAMPING`` times those before, so that they are.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = staged(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "host-shares")
    sinks = staged(hosts.join(out, hosts["host"] == out["src"], "left_anti").select("host"), "host-sinks")
    ranks = staged(hosts.select("host", "seed", F.col("seed").alias("rank")), "host-ranks")
    least, change, done = TOLERANCE / max(1, hosts.count()), 1.0, 0
    while change > least if rounds is None else done < rounds:
        got = shares.join(ranks, shares["src"] == ranks["host"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        lost = ranks.join(sinks, "host", "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        step = ranks.join(got, ranks["host"] == got["dst"], "left")
        rank = (1 - DAMPING) * F.col("seed") + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.lit(float(lost)) * F.col("seed"))
        moved = staged(step.select("host", "seed", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved")), "host-ranks")
        if rounds is None:
            change = moved.agg(F.sum("moved")).first()[0] or 0.0
        ranks, done = moved.drop("moved"), done + 1
    return ranks.select("host", "rank")


def host_scores(judged: DataFrame) -> DataFrame:
    """(host, trust, distrust), each as times the mean over all hosts, from pages with host, html and the rules' verdict."""
    edges = staged(host_links(judged), "host-links")
    pages = judged.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct().select("host", F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked"))
    hosts = staged(pages.union(linked).groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "hosts")
    totals = hosts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"), F.count("*").alias("n")).first()
    linked_at_all = not edges.isEmpty()

    def spread(column: str, total: int | None, along: DataFrame) -> DataFrame:
        seeds = hosts.select("host", (F.col(column) / F.lit(float(total or 1))).alias("seed"))
        # without an edge every host is a sink, and each round gives the seeds back
        ranks = propagated(seeds, along) if linked_at_all and total else seeds.withColumnRenamed("seed", "rank")
        return ranks.select("host", (F.col("rank") * F.lit(float(totals["n"]))).alias("score"))

    trust = spread("allowed", totals["a"], edges)
    distrust = spread("blocked", totals["b"], edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    return trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host")


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html)."""
    judged = ruled(pages.select("page_id", "url", "html"), rules)
    scores = host_scores(judged)
    blocked = staged(scores.filter((F.col("distrust") > LEAST_DISTRUST) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("bad")), "blocked-hosts")
    bad = F.broadcast(blocked) if blocked.count() <= BROADCAST_HOSTS else blocked
    joined = judged.select("page_id", "host", "path", "rule", "verdict").join(bad, F.col("host") == F.col("bad"), "left")
    method = F.when(F.col("bad").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"))


def parsed_rules(rules: Sequence[tuple[str, str]]) -> list[Rule]:
    return [parse_rule(*r) for r in rules]
