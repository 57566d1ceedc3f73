"""URL rules by hashed host-suffix and path-prefix expressions.

A url's host gives all its label suffixes and its path all prefixes of the lengths that rule paths have. Each
pair of both is an expression; expressions and rules meet in an equi-join on the first bytes of their
SHA-256 digests, the full digests confirm, and the longest rule wins. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.llm.common import free_name, read

#: Hexadecimal digits of a digest that the join runs on.
PREFIX_DIGITS = 8
#: The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Between ``://`` and the first of ``/ ? #``, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host to the first of ``? #``; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The pages' columns, then ``host``, ``path``, ``rule`` (host and path of the rule, or null) and ``verdict``.

    Columns of these names in the input are replaced. ``rules`` has ``host``, ``path`` and ``verdict``; a rule
    fits its host and all subdomains where the url's path starts with its own, the longest (host and path
    together) wins, of equally long ones the first by text, and of equal ones a block. A rule with a null part
    is passed over. Null urls and urls without ``://`` have an empty host and path, and only the default.
    Every input row gives one row.
    """
    helper = free_name(pages, "_length")
    rules = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
             .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
             .select(F.concat("host", "path").alias("rule"), "verdict", F.length("path").alias("n"), F.sha2(_expression(F.col("host"), F.col("path")), 256).alias("rule_digest"))
             .withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_DIGITS)))
    # Lengths of rule paths are few and small numbers: at most as many as the longest rule path has characters.
    lengths = [r[0] for r in rules.select("n").distinct().orderBy("n").collect()]
    named = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).drop("rule", "verdict")
    places = named.select("host", "path").where(F.col("host") != "").distinct()
    labels = F.split("host", r"\.")
    suffixes = places.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")])
    expressions = (suffixes.withColumn("prefix", F.explode(prefixes)).where(F.col("prefix").isNotNull())
                   .withColumn("digest", F.sha2(_expression(F.col("suffix"), F.col("prefix")), 256)))
    found = (expressions.select("host", "path", "digest", F.substring("digest", 1, PREFIX_DIGITS).alias("digest_prefix"))
             .join(rules, F.col("digest_prefix") == F.col("rule_prefix")).where(F.col("digest") == F.col("rule_digest")))
    best = (found.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias(helper), "rule", "verdict")).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))
    judged = named.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return judged.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], "host", "path", "rule", "verdict")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, row_number() OVER () rid, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END r FROM pages),
parts AS (SELECT page_id, rid, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') path FROM rest),
fit AS (SELECT rid, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, h || p) k FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') verdict FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (rid)
"""

QUERIES = {"op9_url_filters": op9_url_filters}
ORACLES = {"op9_url_filters": _SQL}
