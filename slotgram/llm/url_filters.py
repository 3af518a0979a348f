"""URL filters by host-suffix and path-prefix expressions, with DataFrame operations only.

Every url is expanded into the (host suffix, path prefix) expressions that a rule could
have: suffixes at label borders, and prefixes of the lengths that occur among the rules'
paths (a handful of integers, so also prefixes inside a path segment are found).  They are
equi-joined with the rules on the first bytes of a digest; the full digest confirms, and the
longest rule wins (at equal length the longer host, then block, then the lesser text).

Nulls: a null url, or one without ``://``, has an empty host and path and fits no rule.
Urls are judged once per distinct text; repeated rows and null ids keep their rows.  Other
columns are kept; ``host path rule verdict`` are replaced if there.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotgram.llm.common import let, small, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT, PREFIX_HEX = "allow", 8


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in rules], "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule (host and path of the winning rule, else
    null) and verdict (the rule's, else ``default``); ``rules``: verdict, host, path."""
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # at most the longest path's length
    keyed = rules.select("verdict", "host", "path", F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest"))
    keyed = keyed.select(F.substring("digest", 1, PREFIX_HEX).alias("short"), "digest", F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"), F.concat("host", "path").alias("rule"), "verdict").alias("won"))
    urls = pages.select("url").where("url is not null").distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> '' or path <> ''")
    suffixes = let(F.split("host", r"\."), lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x) - i + 1), ".")))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    terms = urls.select("url", suffixes.alias("hosts"), prefixes.alias("paths"))
    terms = terms.select("url", "paths", F.explode("hosts").alias("host")).select("url", "host", F.explode("paths").alias("path"))
    terms = terms.select("url", F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("_digest"))
    hits = terms.join(small(keyed), (F.substring("_digest", 1, PREFIX_HEX) == F.col("short")) & (F.col("_digest") == F.col("digest")))
    best = hits.groupBy(F.col("url").alias("_url")).agg(F.max("won").alias("_won"))
    kept = pages.drop("host", "path", "rule", "verdict").join(best, F.col("url") == F.col("_url"), "left")
    return kept.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "rule": F.col("_won.rule"), "verdict": F.coalesce(F.col("_won.verdict"), F.lit(default))}).drop("_url", "_won")


def query(spark, sf_dir) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM (SELECT p.*, (SELECT max({'n': length(h) + length(q), 'h': length(h), 'b': r.verdict = 'block', 'rule': h || q, 'verdict': r.verdict}) FROM r
  WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, q)) AS f FROM p)
"""
