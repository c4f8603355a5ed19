"""URL filters by rules and by trust that spreads over links between hosts.

Rules decide the pages they fit; the longest fitting rule wins. The other pages get the verdict of their host:
personalised PageRank carries trust from hosts with allowed pages along links, and distrust from hosts with blocked
pages against them (who links to bad hosts is suspect). Seeds weigh by the share of a host's pages that rules allow or
block. Both are told as shares of the PageRank that the host has when every host is a seed, so they do not shrink with
the number of a host's links, and a host without links keeps its own share. A host is blocked when its distrust reaches
BLOCK_AT and exceeds its trust.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, settle, table

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: After so many rounds a rank is within DAMPING**ROUNDS = 4 % of its limit.
DAMPING, ROUNDS, BLOCK_AT = 0.85, 20, 0.4
#: Rules are literals of the plan.
MOST_RULES = 2000
#: A tag ends at the next angle bracket of either kind, so that tags without an end cost linear time. White space stands
#: before the attribute: data-href and the like link nowhere.
HREF = r"""(?i)<a\s(?:[^<>]*?\s)?href\s*=\s*["']?([^"'\s>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (struct n, rule, verdict) that fits, or null; of equally long ones the last by name."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n: int, rule: string, verdict: string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts. Relative links stay within a host and carry nothing."""
    src = host_path(F.col("url"))[0]
    links = pages.select(src.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("href"))
    dst = host_path(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href")))[0]
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust (shares from 0 to 1) after ``rounds`` of personalised PageRank; seeds: host, good, bad.

    rank = (1 - damping) * seed + damping * (what links bring), with the seeds and with 1 for every host side by side;
    the share is the one over the other.
    """
    edges = settle(edges)
    if edges.isEmpty():  # nothing flows, every seed keeps its share
        return seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    kinds = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    kinds = kinds.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    out = kinds.groupBy("kind", "a").agg(F.sum("weight").alias("total"))
    flow = settle(kinds.join(settle(out), ["kind", "a"]).select("kind", "a", "b", (F.col("weight") / F.col("total")).alias("part")))
    nodes = flow.select("kind", F.col("a").alias("host")).union(flow.select("kind", F.col("b").alias("host")))
    own = seeds.select(F.lit("trust").alias("kind"), "host", F.col("good").alias("seed")).union(seeds.select(F.lit("distrust"), "host", "bad"))
    own = settle(nodes.select("kind", "host", F.lit(0.0).alias("seed")).union(own).groupBy("kind", "host").agg(F.sum("seed").alias("seed")))
    rank = own.select("kind", "host", F.col("seed").alias("rank"), F.lit(1.0).alias("whole"))
    brings = lambda c: F.sum(F.col(c) * F.col("part"))
    step = lambda seed, got: (1 - damping) * seed + damping * F.coalesce(got, F.lit(0.0))
    for _ in range(rounds):
        got = flow.join(rank.withColumnRenamed("host", "a"), ["kind", "a"]).groupBy("kind", F.col("b").alias("host")).agg(brings("rank").alias("r"), brings("whole").alias("w"))
        moved = own.join(got, ["kind", "host"], "left")
        # written in every round: two written tables join, so that Spark splits the links of a hub
        rank = settle(moved.select("kind", "host", step(F.col("seed"), "r").alias("rank"), step(F.lit(1.0), "w").alias("whole")))
    pick = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank") / F.col("whole")).otherwise(0.0)).alias(kind)
    return rank.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, block_at: float = BLOCK_AT, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    Rules are (verdict, host, path) and fit the host and its subdomains where the path starts so. Pages with an empty
    host (null urls, urls without ``://``) fit no rule and are allowed, as is every host that neither seeds nor links
    reach. Null html has no links; very long html is read whole. Repeated rows are judged alike. Only page_id, url and html are read.
    """
    host, path = host_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    fit = named.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("_ruled"))
    share = lambda v: F.avg((F.coalesce("_ruled", F.lit("")) == v).cast("double"))
    seeds = settle(fit.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")))
    hosts = propagate(seeds, host_edges(pages.select("url", "html")), rounds=rounds)
    bad = hosts.where((F.col("distrust") >= block_at) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("_host"))
    out = fit.join(bad, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", "_host", F.lit("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    host = lambda u: rf"translate(regexp_extract(CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    rounds = "".join(
        f""",
got{k} AS MATERIALIZED (SELECT kind, b AS host, sum(rank * part) AS r, sum(whole * part) AS w FROM flow JOIN rank{k} USING (kind, a) GROUP BY ALL),
rank{k + 1} AS MATERIALIZED (SELECT own.kind, own.host AS a, {1 - DAMPING} * own.seed + {DAMPING} * coalesce(r, 0) AS rank, {1 - DAMPING} + {DAMPING} * coalesce(w, 0) AS whole FROM own LEFT JOIN got{k} USING (kind, host))"""
        for k in range(ROUNDS)
    )
    return rf"""
WITH rules(verdict, h, p) AS (VALUES {rules}),
u AS (SELECT page_id, html, coalesce(url, '') AS url, {host("coalesce(url, '')")} AS host FROM pages),
n AS (SELECT *, regexp_extract(substr(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, length(host) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT page_id, host, path, html, (SELECT max((length(h || p), h || p, verdict)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS fit FROM n),
seeds AS (SELECT host, avg(CASE WHEN fit[3] = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS good, avg(CASE WHEN fit[3] = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS bad FROM f WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^<>]*?\s)?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS href FROM f),
l2 AS (SELECT src, CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END AS href FROM l),
e AS (SELECT src, {host("href")} AS dst, count(*) AS weight FROM l2 GROUP BY ALL HAVING src <> '' AND dst <> '' AND src <> dst),
k AS (SELECT 'trust' AS kind, src AS a, dst AS b, weight FROM e UNION ALL SELECT 'distrust', dst, src, weight FROM e),
flow AS MATERIALIZED (SELECT kind, a, b, weight / sum(weight) OVER (PARTITION BY kind, a) AS part FROM k),
own AS MATERIALIZED (SELECT kind, host, sum(seed) AS seed FROM (
  SELECT 'trust' AS kind, host, good AS seed FROM seeds UNION ALL SELECT 'distrust', host, bad FROM seeds
  UNION ALL SELECT kind, a, 0 FROM flow UNION ALL SELECT kind, b, 0 FROM flow) GROUP BY ALL),
rank0 AS (SELECT kind, host AS a, seed AS rank, 1.0::DOUBLE AS whole FROM own){rounds},
bad AS (SELECT a AS host FROM rank{ROUNDS} GROUP BY a HAVING sum(rank / whole) FILTER (kind = 'distrust') >= {BLOCK_AT} AND sum(rank / whole) FILTER (kind = 'distrust') > sum(rank / whole) FILTER (kind = 'trust'))
SELECT page_id, host, path, fit[2] AS rule, coalesce(fit[3], CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""


SQL = _sql()
