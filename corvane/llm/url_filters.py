"""URL filters: rules by host and path, and trust along the links between hosts where no rule fits.

Rules. A rule is a host and the begin of a path; it fits its host and all hosts below it. Hosts give their last labels, as many as any rule
has, and paths their begins of the lengths that the host's rules have, so finding rules is a matter of equal keys; the longest rule wins,
of equal ones a block.

Links. Absolute links of a page's `href`s count as edges from its host to the link's; links within a host are none. Trust is personalised
PageRank from hosts with allowed pages along the edges, distrust is that from hosts with blocked pages against them, each seeded by the
share of such pages. A host is blocked if distrust is more than a share `threshold` of both together. Ranks are whole numbers, a unit each
`MASS`-th of all, and every contribution is rounded down, so sums don't depend on their order and reruns agree.

Defined cases: a null url, or one without `://`, has an empty host and path, no rule, no links, and is allowed; so is a host of which
nothing is known. A null html has no links. Repeated rows and null identifiers are pages of their own. An empty table gives no rows; without
pages that rules allow (or block) there is no trust (or distrust). Extra columns don't take part, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import Scratch, table

#: (rule, verdict): a host and the begin of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING, ROUNDS, THRESHOLD, MASS = 0.85, 20, 0.5, 10**12
HREF = "(?i)[\\x20\\x09-\\x0D]href[\\x20\\x09-\\x0D]*=[\\x20\\x09-\\x0D]*[\"']?[\\x20\\x09-\\x0D]*([^\"'\\x20\\x09-\\x0D>]+)"
LINK = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Rules as they are written -> rule, rule_host, rule_path, verdict."""
    rows = [(r, _plain_lower(r.partition("/")[0]), "".join(r.partition("/")[1:]), v) for r, v in rules]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, verdict string")


def _plain_lower(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: host, path -> host, path, rule, verdict of each distinct pair that a rule fits."""
    labels = rules.agg(F.max(F.size(F.split("rule_host", "\\.")))).first()[0] or 0
    pairs = urls.filter("host != ''").select("host", "path").distinct()
    parts = F.split("host", "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    begins = rules.select("rule_host", F.length("rule_path").alias("n")).distinct()
    tried = pairs.select("host").distinct().select("host", F.explode(ends).alias("rule_host")).join(begins, "rule_host")
    tried = pairs.join(tried, "host").filter(F.length("path") >= F.col("n")).withColumn("rule_path", F.substr("path", F.lit(1), F.col("n")))
    found = tried.join(rules, ["rule_host", "rule_path"])
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("first"), "rule", "verdict")).alias("best")
    return found.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def host_links(pages: DataFrame) -> DataFrame:
    """pages: host, html -> source, target, links: how many links of a host's pages lead to another host."""
    found = F.filter(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda link: link.rlike(LINK))
    links = pages.filter("host != ''").select(F.col("host").alias("source"), F.explode(found).alias("link"))
    links = links.select("source", _lower(F.regexp_extract("link", LINK, 1)).alias("target")).filter("target != '' AND source != target")
    return links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def propagate(seeds: DataFrame, links: DataFrame, scratch: Scratch, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """seeds: kind (trust or distrust), host, seed (units); links: source, target, links -> kind, host, rank after so many rounds.

    Trust goes from source to target, distrust from target to source. Units that reach a host without such links are lost.
    """
    links = scratch.keep(links, "links")
    if links.isEmpty():
        rounds = min(rounds, 1)  # further ones change nothing
    out = links.groupBy("source").agg(F.sum("links").alias("total"))
    into = links.groupBy("target").agg(F.sum("links").alias("total"))
    share = (F.col("links") / F.col("total")).alias("share")
    forth = links.join(out, "source").select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("next"), share)
    back = links.join(into, "target").select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("next"), share)
    edges = scratch.keep(forth.unionByName(back), "edges")
    again = seeds.select("kind", "host", F.floor((1 - damping) * F.col("seed")).cast("long").alias("rank"))
    ranks, last = seeds.select("kind", "host", F.col("seed").alias("rank")), None
    for _ in range(rounds):
        given = ranks.join(edges, ["kind", "host"]).select("kind", F.col("next").alias("host"), F.floor(damping * F.col("rank") * F.col("share")).cast("long").alias("rank"))
        ranks = scratch.keep(again.unionByName(given).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
        if last is not None:
            scratch.drop(last)
        last = ranks
    return ranks


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", threshold: float = THRESHOLD, **how) -> DataFrame:
    """Each row's identifier, host, path, rule (null where none fits), verdict, and its host's trust and distrust."""
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col(url_column).cast("string")
    own = pages.select(F.col(id_column).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_column).cast("string").alias("html"))
    links = host_links(own)
    rows = scratch.keep(own.drop("html"), "pages")
    matched = scratch.keep(match_rules(rows, rules), "matched")
    judged = rows.join(matched, ["host", "path"], "left")
    by_rule = scratch.keep(judged.filter("rule IS NOT NULL").groupBy("host", "verdict").agg(F.count(F.lit(1)).alias("n")), "seeds")
    totals = {r.verdict: r.n for r in by_rule.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}  # two rows
    total = F.when(F.col("verdict") == "allow", F.lit(totals.get("allow", 1))).otherwise(F.lit(totals.get("block", 1)))
    seeds = by_rule.select(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host", F.floor(F.lit(float(MASS)) * F.col("n") / total).cast("long").alias("seed"))
    ranks = propagate(seeds, links, scratch, **how)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0).cast("long")).alias(kind)
    hosts = ranks.groupBy("host").agg(part("trust"), part("distrust"))
    hosts = hosts.withColumn("judged", F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow"))
    zero = F.lit(0).cast("long")
    return judged.join(hosts, "host", "left").select(
        F.col("page").alias(id_column), "host", "path", "rule", F.coalesce("verdict", "judged", F.lit("allow")).alias("verdict"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust")
    )


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def _sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    lower = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    rules = ", ".join(f"({quoted(r)}, {quoted(r.partition('/')[0])}, {quoted(''.join(r.partition('/')[1:]))}, {quoted(v)})" for r, v in RULES)
    rounds = "".join(
        f"""
ranks{k} AS MATERIALIZED (
  SELECT kind, host, CAST(sum(rank) AS BIGINT) AS rank FROM (
    SELECT kind, host, CAST(floor({1 - DAMPING!r}::DOUBLE * seed) AS BIGINT) AS rank FROM seeds
    UNION ALL SELECT r.kind, e.next, CAST(floor({DAMPING}::DOUBLE * r.rank * e.share) AS BIGINT) FROM ranks{k - 1} r JOIN edges e ON e.kind = r.kind AND e.host = r.host)
  GROUP BY kind, host),"""
        for k in range(1, ROUNDS + 1)
    )
    return f"""
WITH rules(rule, rule_host, rule_path, verdict) AS (VALUES {rules}),
rows AS (
  SELECT page_id, {lower("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
pairs AS (SELECT DISTINCT host, path FROM rows WHERE host <> ''),
matched AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM pairs JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
judged AS (SELECT r.page_id, r.host, r.path, m.rule, m.verdict FROM rows r LEFT JOIN matched m ON r.host = m.host AND r.path = m.path),
seeds AS (
  SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, CAST(floor({float(MASS)!r}::DOUBLE * n / sum(n) OVER (PARTITION BY verdict)) AS BIGINT) AS seed
  FROM (SELECT host, verdict, CAST(count(*) AS DOUBLE) AS n FROM judged WHERE rule IS NOT NULL GROUP BY host, verdict)),
found AS (SELECT host, unnest(regexp_extract_all(html, {quoted(HREF)}, 1)) AS link FROM rows WHERE host <> ''),
links AS (
  SELECT source, target, CAST(count(*) AS DOUBLE) AS links FROM (SELECT host AS source, {lower(f"regexp_extract(link, {quoted(LINK)}, 1)")} AS target FROM found)
  WHERE target <> '' AND source <> target GROUP BY source, target),
edges AS MATERIALIZED (
  SELECT 'trust' AS kind, source AS host, target AS next, links / sum(links) OVER (PARTITION BY source) AS share FROM links
  UNION ALL SELECT 'distrust', target, source, links / sum(links) OVER (PARTITION BY target) FROM links),
ranks0 AS (SELECT kind, host, seed AS rank FROM seeds),{rounds}
hosts AS (
  SELECT host, CAST(coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS BIGINT) AS distrust FROM ranks{ROUNDS} GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN h.distrust > {THRESHOLD} * (h.trust + h.distrust) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(h.trust, 0) AS trust, coalesce(h.distrust, 0) AS distrust
FROM judged j LEFT JOIN hosts h ON j.host = h.host
"""


ORACLE = _sql()
