"""URL filters: list rules, and trust and distrust propagated over the link graph of hosts.

A rule names a host and a path prefix; it fits the host, its subdomains and paths that begin with the
prefix; the longest fitting rule decides. Urls that no rule fits are judged by their host: personalised
PageRank spreads trust from hosts of allowed urls along links, and distrust from hosts of blocked urls
against them (who links to a bad host is suspect). A host is blocked if distrust makes up more than
`limit` of both. Hosts that neither reaches are allowed.

Edges are links of a page's html to other hosts, and the tie between a host and the same host without
its first label where both occur. Edges are summed per host pair, so a page with very many links or a hub
host adds no rows beyond its pairs. Each round is one join and one sum; every few rounds the scores are
written to the shared folder, which bounds the plan and survives lost executors.

Defined results: a null url or one without `://` has an empty host and path, no rule, and is
allowed; null html has no links; repeated rows count as so many pages; an empty table gives no rows; columns other than
page_id, url and html are not read. Equal trust and distrust count as trust, up to the order in which the scores
are added. Urls and pages of any length are read by Spark's own functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.sources.storage import cut

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING, ROUNDS, LIMIT = 0.85, 12, 0.5
#: Rounds between two written tables of scores.
CUT_EVERY = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINKS = r"(?i)(?:href|src)\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_length(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, name, prefix = rule
    return ((host == name) | host.endswith("." + name)) & path.startswith(prefix)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as text, or null. The rules are few and become one expression."""
    return F.coalesce(*[F.when(_fits(host, path, r), r[1] + r[2]) for r in _by_length(rules)], F.lit(None).cast("string"))


def listed_verdict(rule: Column, rules=RULES) -> Column:
    return reduce(lambda e, r: e.when(rule == r[1] + r[2], r[0]), rules, F.when(F.lit(False), ""))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, summed, and the ties of subdomains."""
    rows = pages.select(host_of(F.col("url")).alias("src"), "html")
    links = rows.select("src", F.explode(F.regexp_extract_all("html", F.lit(LINKS), 1)).alias("to"))
    links = links.select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("to", r"^(?i)https?:", ""))).alias("dst"))
    links = links.where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = rows.where("src != ''").select(F.col("src").alias("host")).distinct()
    above = hosts.select(F.col("host").alias("low"), F.regexp_replace("host", r"^[^.]*\.", "").alias("up")).where("low != up")
    ties = above.join(hosts.select(F.col("host").alias("up")), "up")
    both = ties.select(F.col("low").alias("src"), F.col("up").alias("dst")).union(ties.select(F.col("up"), F.col("low")))
    return links.union(both.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """kind, host, score after so many rounds. edges and seeds carry `kind`: both rankings run in one plan.

    score = (1 - damping) * seed + damping * sum over edges of score(src) * n / out(src). What reaches a
    host without outgoing edges goes no further.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    shares = cut(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("share")), "shares")
    start = cut(seeds.select("kind", "host", "seed"), "seeds")
    scores = start.select("kind", "host", F.col("seed").alias("score"))
    for i in range(rounds):
        sent = scores.withColumnRenamed("host", "src").join(shares, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        given = start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
        scores = given.union(sent).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (i + 1) % CUT_EVERY == 0 or i + 1 == rounds:
            scores = cut(scores, "scores")
    return scores


def host_verdicts(pages: DataFrame, rules=RULES, limit: float = LIMIT, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust, verdict of every host that trust or distrust reaches."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    listed = pages.select(host.alias("host"), listed_verdict(rule_of(host, path, rules), rules).alias("kind")).where("kind IS NOT NULL AND host != ''")
    counts = listed.groupBy("kind", "host").agg(F.count("*").alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counts.join(totals, "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))
    edges = host_edges(pages)
    forward = edges.select(F.lit("allow").alias("kind"), "src", "dst", "n")
    backward = edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    scores = propagate(forward.union(backward), seeds, rounds)
    both = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "allow", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "block", F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    bad = F.col("distrust") > limit * (F.col("trust") + F.col("distrust"))
    return both.withColumn("verdict", F.when(bad, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules=RULES, limit: float = LIMIT, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    judged = host_verdicts(pages, rules, limit, rounds).where("verdict = 'block'").select(F.col("host").alias("h"), F.col("verdict").alias("v"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    # Only blocked hosts are joined; rows of a hot host are split by the skew join.
    rows = rows.join(judged, (F.col("host") == F.col("h")) & F.col("rule").isNull(), "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce(listed_verdict(F.col("rule"), rules), "v", F.lit("allow")).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _sql(rules=RULES) -> str:
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in _by_length(rules))
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in rules)
    rounds = "".join(
        f""", r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
  SELECT kind, host, {1 - DAMPING} * seed AS score FROM seeds UNION ALL
  SELECT s.kind, s.dst, {DAMPING} * r.score * s.share FROM r{i} r JOIN shares s ON r.kind = s.kind AND r.host = s.src) GROUP BY kind, host)"""
        for i in range(ROUNDS)
    )
    return f"""
WITH cutoff AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cutoff),
ruled AS (SELECT *, CASE {fits} END AS rule FROM parts),
named AS (SELECT *, CASE {verdict} END AS kind FROM ruled),
links AS (SELECT host AS src, translate(regexp_extract(regexp_replace(u, '^(?i)(https?:)?//', ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1)) AS u FROM parts)),
hosts AS (SELECT DISTINCT host FROM parts WHERE host != ''),
ties AS (SELECT a.host AS low, b.host AS up FROM hosts a JOIN hosts b ON b.host = regexp_replace(a.host, '^[^.]*\\.', '') AND a.host != b.host),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM links WHERE src != '' AND dst != '' AND src != dst
  UNION ALL SELECT low, up FROM ties UNION ALL SELECT up, low FROM ties) GROUP BY src, dst),
kinds AS (SELECT 'allow' AS kind, src, dst, n FROM edges UNION ALL SELECT 'block', dst, src, n FROM edges),
shares AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM kinds),
seeds AS MATERIALIZED (SELECT kind, host, count(*) / sum(count(*)) OVER (PARTITION BY kind) AS seed FROM named
  WHERE kind IS NOT NULL AND host != '' GROUP BY kind, host),
r0 AS (SELECT kind, host, seed AS score FROM seeds){rounds},
bad AS (SELECT host FROM r{ROUNDS} GROUP BY host HAVING coalesce(sum(score) FILTER (kind = 'block'), 0)
  > {LIMIT} * (coalesce(sum(score) FILTER (kind = 'allow'), 0) + coalesce(sum(score) FILTER (kind = 'block'), 0)))
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM named
"""


OP3_SQL = _sql()
