"""Verdicts on urls from host rules, and for the rest from the link graph of hosts.

Rules name a host and the beginning of a path; a rule fits its host and all subdomains, and the longest that fits wins.
Hosts that rules allow are trusted seeds and those that they block are distrusted ones, each by its number of pages.
Trust follows links from a host to those it links to (personalised PageRank), distrust follows them backwards, from a
host to those that link to it, both until they settle. Where no rule fits, a host is blocked if its distrust exceeds its trust.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.materialize import discard, materialize

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DAMPING, TOLERANCE = 0.85, 1e-6
#: Where the rank of hosts without links goes; no host has this name.
SINK = "/"
#: So many rules are broadcast at most; more are joined by a shuffle.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host in a link: after // and an optional scheme, up to / ? # or the end of the attribute.
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(name: Column) -> Column:
    """The host and its parent domains, as an array."""
    labels = F.split(name, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, rules``: for each host the rules whose host is its own or a parent domain, longest first."""
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    found = hosts.where("host <> ''").select("host", F.explode(_suffixes(F.col("host"))).alias("rule_host")).join(rules, "rule_host")
    text = F.concat("rule_host", "rule_path")
    return found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length(text).alias("size"), text.alias("rule"), "rule_path", "verdict")), asc=False).alias("rules"))


def _fitting(rules: Column, url_path: Column) -> Column:
    return F.get(F.filter(rules, lambda r: F.startswith(url_path, r["rule_path"])), 0)


def rounds_for(tolerance: float = TOLERANCE, damping: float = DAMPING) -> int:
    """After so many rounds the scores of all hosts together are within ``tolerance`` of their limit, whatever the graph: a round takes that distance times the damping."""
    return math.ceil(math.log(tolerance / 2) / math.log(damping))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: ``host, score`` over ``src, dst, w`` from ``host, weight``; hosts without score are left out.

    Weights are made to sum to 1. What reaches a host without links goes back to the seeds, by way of a sink without name
    that all such hosts link to, and the scores of the hosts sum to 1. Rounds go on until every few of them change less than
    ``tolerance`` in all, ``rounds_for(tolerance)`` at most. No seeds give no scores.
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    start = materialize(seeds.select("host", (F.col("weight") / (total or 1)).alias("seed")), "start")
    if not total or edges.isEmpty():
        return start.select("host", F.col("seed").alias("score"))
    out = edges.join(edges.groupBy("src").agg(F.sum("w").alias("all")), "src").select("src", "dst", (F.col("w") / F.col("all")).alias("share"))
    hosts = edges.select(F.col("dst").alias("src")).unionByName(start.select(F.col("host").alias("src"))).distinct()
    ends = hosts.join(edges.select("src").distinct(), "src", "left_anti").select("src", F.lit(SINK).alias("dst"), F.lit(1.0).alias("share"))
    back = start.select(F.lit(SINK).alias("src"), F.col("host").alias("dst"), F.col("seed").alias("share"))
    out = materialize(out.unionByName(ends).unionByName(back), "shares")
    rank = last = materialize(start.select("host", F.col("seed").alias("score")), "rank")
    most = rounds_for(tolerance, damping)
    for k in range(1, most + 1):
        sent = rank.join(out, rank["host"] == out["src"]).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        rank = sent.unionByName(start.select("host", (F.col("seed") * (1 - damping)).alias("score"))).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 5 == 0 or k == most:
            rank = materialize(rank, "rank")
            other = last.select("host", F.col("score").alias("before"))
            none = F.lit(0.0)
            change, sunk = rank.join(other, "host", "full").agg(F.sum(F.abs(F.coalesce("score", none) - F.coalesce("before", none))), F.sum(F.when(F.col("host") == SINK, F.col("score")))).first()
            discard(last)
            last = rank
            if change < tolerance * (1 - damping):
                break
    found = materialize(rank.where(F.col("host") != SINK).select("host", (F.col("score") / (1 - (sunk or 0.0))).alias("score")), "scores")
    discard(out, start, last)
    return found


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for each row of ``pages``.

    A url that is null or has no ``://`` has no host, so no rule fits and, without links, it is allowed. Links to the
    own host don't count; each page's link to a host counts once. Repeated rows are judged alike and count each.
    """
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    sizes = named.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    known = materialize(host_rules(sizes.select("host"), rules), "host_rules")
    links = named.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("to"))
    links = links.select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> '' AND src <> dst")
    edges = materialize(links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")), "edges")

    # pages of a host by path share its rules; counts by verdict are the seeds
    ruled = named.select("page_id", "host", "path").join(known, "host", "left").select("page_id", "host", "path", _fitting(F.col("rules"), F.col("path")).alias("r"))
    ruled = ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    seeds = materialize(ruled.where("ruled IS NOT NULL").groupBy("host", "ruled").agg(F.count(F.lit(1)).alias("weight")), "seeds")
    trust = propagate(edges, seeds.where("ruled = 'allow'")).withColumnRenamed("score", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = propagate(back, seeds.where("ruled = 'block'")).withColumnRenamed("score", "distrust")
    scores = materialize(trust.join(distrust, "host", "full"), "scores")
    judged = ruled.join(scores, "host", "left")
    own, other = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(other > own, "block").otherwise("allow")).alias("verdict"), own.alias("trust"), other.alias("distrust"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).select("page_id", "host", "path", "rule", "verdict")


def _ranks(name: str, edges: str, verdict: str) -> str:
    """The same scores by a fixed number of rounds, seeds and sink as edges."""
    steps = [f"{name}_s AS MATERIALIZED (SELECT host, weight::DOUBLE / sum(weight) OVER () AS seed FROM seeds WHERE ruled = '{verdict}')",
             f"{name}_o AS MATERIALIZED (SELECT src, dst, w::DOUBLE / sum(w) OVER (PARTITION BY src) AS share FROM {edges} UNION ALL SELECT '{SINK}', host, seed FROM {name}_s "
             f"UNION ALL SELECT host, '{SINK}', 1.0 FROM (SELECT host FROM {name}_s UNION SELECT dst FROM {edges}) WHERE host NOT IN (SELECT src FROM {edges}))",
             f"{name}_0 AS (SELECT host, seed AS score FROM {name}_s)"]
    for k in range(SQL_ROUNDS):
        steps.append(
            f"{name}_{k + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT o.dst AS host, r.score * o.share * {DAMPING} AS score FROM {name}_{k} r JOIN {name}_o o ON o.src = r.host "
            f"UNION ALL SELECT host, seed * (1 - {DAMPING}) FROM {name}_s) GROUP BY host)"
        )
    steps.append(f"{name} AS (SELECT host, score / (1 - coalesce((SELECT score FROM {name}_{SQL_ROUNDS} WHERE host = '{SINK}'), 0)) AS score FROM {name}_{SQL_ROUNDS} WHERE host <> '{SINK}')")
    return ",\n".join(steps)


#: Rounds of the SQL, which can't stop by itself; a host whose two scores differ by less than what is left then may be judged otherwise.
SQL_ROUNDS = 40
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw_host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
n AS (SELECT page_id, translate(raw_host, '{_UPPER}', '{_LOWER}') AS host, path, html FROM p),
rules(h, q, v) AS (VALUES {", ".join(f"('{h}', '{q}', '{v}')" for h, q, v in RULES)}),
fit AS (SELECT n.page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS ruled
        FROM n JOIN rules ON (n.host = h OR ends_with(n.host, '.' || h)) AND starts_with(n.path, q) GROUP BY n.page_id),
ruled AS (SELECT n.page_id, n.host, n.path, fit.rule, fit.ruled FROM n LEFT JOIN fit USING (page_id)),
seeds AS (SELECT host, ruled, count(*) AS weight FROM ruled WHERE ruled IS NOT NULL GROUP BY ALL),
l AS (SELECT DISTINCT page_id, host AS src, translate(dst, '{_UPPER}', '{_LOWER}') AS dst FROM
      (SELECT page_id, host, unnest(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1)) AS dst FROM n)),
e AS (SELECT src, dst, count(*) AS w FROM l WHERE src <> '' AND src <> dst GROUP BY ALL),
b AS (SELECT dst AS src, src AS dst, w FROM e),
{_ranks("t", "e", "allow")},
{_ranks("d", "b", "block")}
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.ruled, CASE WHEN coalesce(d.score, 0) > coalesce(t.score, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN t ON t.host = r.host LEFT JOIN d ON d.host = r.host
"""
