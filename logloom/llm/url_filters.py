"""URL filters: block and allow rules on hosts with their subdomains and on path beginnings.

Each distinct (host, path) is expanded into host-suffix and path-prefix expressions; these meet the rules by an
equi-join on the first 32 bits of their SHA-256, the full digest confirms, and the longest rule wins.

Defined cases: a null url, or one without "://", has an empty host and path and fits no rule; no fitting rule gives
`allow`; equally long rules: block before allow; a rule given twice counts once; repeated rows keep their number; an
empty table gives no rows; other columns are left out. Up to LISTED rules are broadcast; with more, the expressions that
are rules are found first and meet the urls by a join that splits hot rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, hot_from, join_hot, table, written

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PREFIX_HEX = 8
LISTED = 100_000


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = spark.createDataFrame(rules, "host string, path string, verdict string")
    return rows.select(F.concat("host", "path").alias("rule"), "verdict", F.char_length("path").alias("path_len"))


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages. rules: columns rule, verdict, path_len."""
    # Distinct lengths of rule paths: at most as many as the longest rule path has characters.
    lengths = [r[0] for r in rules.select("path_len").distinct().collect()]
    known = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not lengths:
        return known.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.char_length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    places = known.where("host <> ''").select("host", "path").distinct()
    parts = places.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    asked = parts.select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    asked = asked.select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
    asked = asked.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    digest = F.sha2("rule", 256)
    ruled = rules.select("rule", "verdict", digest.alias("full"), F.substring(digest, 1, PREFIX_HEX).alias("short"))
    if rules.limit(LISTED + 1).count() <= LISTED:
        found = asked.join(F.broadcast(ruled), "short").where("digest = full")
    else:
        # One rule of each digest: the verdict that wins among equals.
        ruled = ruled.groupBy("short", "full", "rule").agg(F.max("verdict").alias("verdict"))
        asked = written(asked)
        times = asked.groupBy("short", "digest").agg(F.count("*").alias("times"))
        hits = written(times.join(ruled, "short").where("digest = full").select("digest", "rule", "verdict", "times"))
        found = join_hot(asked, hits, ["digest"], "times", hot_from(asked.count()))
    order = F.struct(F.char_length("rule"), F.when(F.col("verdict") == "block", 1).otherwise(0), "rule")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("won"))
    fits = known.where("host <> ''").join(best, ["host", "path"], "left").select("page_id", "host", "path", "won.rule", "won.verdict")
    # Rows without a host fit nothing: they stay out of the join, where they would share one key.
    none = F.lit(None).cast("string")
    rest = known.where("host = ''").select("page_id", "host", "path", none.alias("rule"), none.alias("verdict"))
    return fits.unionByName(rest).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


OP8_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('net','/','block'),('example.net','/en/','allow'),('example.com','/de/','block'),('org','/fr/','allow')),
p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT q.page_id, coalesce(q.host, '') AS host, coalesce(q.path, '') AS path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM q LEFT JOIN LATERAL (
  SELECT r.host || r.path AS rule, r.verdict FROM rules r
  WHERE (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)
  ORDER BY length(r.host || r.path) DESC LIMIT 1) b ON true
"""
