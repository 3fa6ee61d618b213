"""Operator 9, URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import ascii_lower, table

#: (host, path, verdict). Fixed by the contract of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hex digits of the digest that the join goes by; the whole digest is compared afterwards.
SHORT = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host with A-Z lower-cased, the path up to ? or #; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.expr("substring(url, instr(url, '://') + 3)"))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row of pages.

    Each distinct host and path, the latter cut to the longest rule path, is expanded into one expression
    for each suffix of the host and each path length that the rules have. Expressions meet rules by an
    equi-join on the first SHORT hex digits of their SHA-256; the full digests are compared then. The
    longest rule wins, a block before an allow of that length, then the least text. Without a rule the
    verdict is ``default``. Null and malformed urls have empty host and path and get the default; repeated
    rows are each returned; columns of pages other than page_id and url are ignored.
    """
    host, path = url_parts(F.col("url"))
    pages = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rules = rules.where("rule_host is not null and rule_path is not null and rule_verdict is not null").select(
        F.concat("rule_host", "rule_path").alias("rule"), F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest"), F.length("rule_path").alias("rule_length"), "rule_verdict"
    )
    # A rule set has few path lengths, whatever the number of rules or pages: at most the longest path a rule may have.
    lengths = sorted(r[0] for r in rules.select("rule_length").distinct().collect())
    longest = max(lengths, default=0)
    pages = pages.withColumn("cut", F.substring("path", 1, longest))
    keys = pages.where("host <> ''").select("host", "cut").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)]), lambda n: F.when(F.length("cut") >= n, F.substring(F.col("cut"), F.lit(1), n))), lambda p: p.isNotNull())
    expanded = keys.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    expanded = expanded.select("host", "cut", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    hits = expanded.join(rules.withColumn("short", F.substring("rule_digest", 1, SHORT)), "short").where("digest = rule_digest")
    best = hits.groupBy("host", "cut").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("b"), "rule", "rule_verdict")).alias("best"))
    joined = pages.join(best, ["host", "cut"], "left")
    return joined.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT p.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
"""
