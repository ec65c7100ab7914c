"""Operator 5 [native]: URL filtering by rules, and by trust and distrust propagated over the host graph.

Rules judge what they fit, the longest first.  For the rest, each host gets a verdict: hosts are nodes, links in the
pages' HTML to other hosts are edges.  Trust is personalised PageRank along the links from hosts with allowed pages;
distrust runs against the links from hosts with blocked pages.  A seed's mass is the share of its pages with that
verdict.  Both fade as more hosts link to a seed, so each is divided by what a uniform seed would give the host along
the same links (without the host's own mass, unless rules fit pages of its own).  A host is blocked if its share of
distrust exceeds its share of trust and reaches ``threshold``.

Cases: a url that is null or has no "://" has an empty host and path, fits no rule and is allowed; pages without html
have no links; very long urls and pages are read whole; of rules that fit with equal length the one greater as text
wins, and a host with equal shares of trust and distrust is allowed; repeated rows are judged alike and their links
count twice; a host without links keeps its own mass only; other columns are not read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmill.llm.common import join_hot, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"

#: Into how many parts a hub's edges are dealt.
SALTS = 32


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path as the rules read them."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return pages.withColumn("__rest", rest).withColumn("host", F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), UPPER, LOWER)).withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)).drop("__rest")


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` (with host and path) with the longest fitting rule and its verdict, or nulls; rules are (verdict, host, path)."""
    fitting = [
        F.when(((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path), F.struct(F.lit(len(host + path)).alias("n"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, host, path in rules
    ]
    longest = F.array_max(F.array(*fitting))
    return pages.withColumn("__best", longest).withColumn("rule", F.col("__best.rule")).withColumn("rule_verdict", F.col("__best.verdict")).drop("__best")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links): counted links between different hosts."""
    targets = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    lower = targets.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst and dst <> ''")
    return lower.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def weighted_edges(links: DataFrame, a: str, b: str, salts: int = SALTS, hot_share: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(edges, hubs): the links from ``a`` to ``b`` as (src, dst, weight, salt), weights of a src summing to 1, and (hub) the hot ones.

    A src with more than 1 / ``hot_share`` of all edges is a hub; there are at most ``hot_share``.  A hub's edges are dealt
    to ``salts`` parts by their dst, so a hub that holds a third of all edges comes into no single task.
    """
    totals = links.groupBy(a).agg(F.sum("links").alias("sent"), F.count(F.lit(1)).alias("rows"))
    totals = materialize(totals, "degrees")
    edges = totals.agg(F.sum("rows")).first()[0] or 0
    totals = totals.withColumn("hub", F.col("rows") * hot_share > edges)
    met = join_hot(links, totals, a, "rows", F.concat(F.lit("/"), F.col(b)), hot_share)  # no host holds a slash
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64(b), F.lit(salts))).otherwise(0).cast("int")
    out = met.select(F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("links") / F.col("sent")).alias("weight"), salt.alias("salt"))
    return materialize(out, "edges"), materialize(totals.where("hub").select(F.col(a).alias("hub")), "hubs")


def propagate(seeds: DataFrame, edges: DataFrame, hubs: DataFrame, damping: float, rounds: int, every: int = 4, salts: int = SALTS) -> DataFrame:
    """(host, score) after ``rounds`` of score = (1 - damping) seed + damping * sum of weighted neighbours.

    ``seeds``: (host, mass); ``edges`` and ``hubs``: as ``weighted_edges`` gives them.  A hub's score goes to each of its
    salts, any other host's to salt 0; the hubs are few and broadcast.
    """
    start = seeds.select("host", (F.col("mass") * (1 - damping)).alias("score"))
    score = start
    parts = F.when(F.col("hub").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    for k in range(1, rounds + 1):
        sent = score.join(F.broadcast(hubs), score.host == hubs.hub, "left").select("host", "score", F.explode(parts).alias("part"))
        moved = sent.join(edges, (sent.host == edges.src) & (sent.part == edges.salt)).select(F.col("dst").alias("host"), (F.col("score") * F.col("weight") * damping).alias("score"))
        score = start.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score"))
        if k % every == 0 and k < rounds:
            score = materialize(score, "scores")
    return score


def with_scores(pages: DataFrame, scores: DataFrame, limit: int = 1_000_000, salts: int = 32) -> DataFrame:
    """``pages`` with the scores of their hosts, 0 and not low for hosts without.

    Up to ``limit`` hosts, counted here, are broadcast (some 50 MB).  More meet the pages in a shuffle on host and salt, so
    no host's pages, and not the pages without a host, come into one task.
    """
    scores = materialize(scores, "scores")
    if scores.count() <= limit:
        out = pages.join(F.broadcast(scores), "host", "left")
    else:
        salted = pages.withColumn("__salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
        out = salted.join(scores.withColumn("__salt", F.explode(F.array(*map(F.lit, range(salts))))), ["host", "__salt"], "left").drop("__salt")
    return out.na.fill(0.0, ["trust", "distrust"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = 0.85, rounds: int = 8, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    judged = with_rule(with_host_and_path(pages.select("page_id", "url", "html")), rules)
    share = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0)) / F.count(F.lit(1))
    hosts = materialize(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    links = materialize(host_links(judged), "links")
    seed = lambda c: hosts.where(F.col(c) > 0).select("host", F.col(c).alias("mass"))
    if links.isEmpty():
        spread = [lambda seeds: seeds.select("host", (F.col("mass") * (1 - damping)).alias("score"))] * 2
    else:
        ways = [weighted_edges(links, *ends) for ends in (("src", "dst"), ("dst", "src"))]
        spread = [lambda seeds, way=way: propagate(seeds, *way, damping, rounds) for way in ways]
    nodes = hosts.select("host").union(links.select("src")).union(links.select("dst")).distinct().withColumn("mass", F.lit(1.0))
    scores = hosts.select("host", (F.col("allowed") + F.col("blocked") > 0).alias("ruled"))
    for way, (name, seeds) in zip(spread, (("trust", seed("allowed")), ("distrust", seed("blocked")))):
        scores = scores.join(way(seeds).withColumnRenamed("score", name), "host", "left").join(way(nodes).withColumnRenamed("score", f"all_{name}"), "host", "left").na.fill(0.0)
    part = lambda c: F.when(F.col(c) > 0, F.round(F.try_divide(c, F.col(f"all_{c}") - F.when(F.col("ruled"), 0.0).otherwise(1 - damping)), 9)).otherwise(0.0)
    low = (part("distrust") > part("trust")) & (part("distrust") >= threshold)
    scores = scores.select("host", "trust", "distrust", low.alias("low"))
    out = with_scores(judged.select("page_id", "host", "path", "rule", "rule_verdict"), scores.where("trust > 0 or distrust > 0"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("low"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
