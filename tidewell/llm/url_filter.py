"""URL rules by hash prefixes, with DataFrame functions alone.

Each url is expanded into host suffixes x path prefixes, of the sizes (labels of the host,
characters of the path) that some rule has. Every expression, and every rule, has a SHA-256 digest;
the first bytes of the digest are the equi-join key, the full digest confirms, and the longest
confirmed rule decides. Expressions carry their url's digest instead of the url.

Defined results: a null url, or one without "://", has an empty host and path, so no rule fits and
the verdict is the default. Repeated rows each keep their row. Equal rules count once; of two rules
of one length the later verdict in code-point order ("block") wins. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import ascii_lower

PREFIX_BYTES = 4
#: A rule table of up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 100_000
#: Fixed values: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules) + " AS r(host, path, verdict)")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path), 256))


def expressions(host: Column, path: Column, sizes: Column) -> Column:
    """Digests of the host suffixes x path prefixes that have one of the sizes (labels, length); the work doesn't depend on the url's length."""
    labels, n = _labels(host), F.length(path)
    some = F.filter(sizes, lambda z: (z["labels"] <= labels) & (z["length"] <= n))
    return F.transform(some, lambda z: _digest(F.call_function("substring_index", host, F.lit("."), -z["labels"]), F.substring(path, F.lit(1), z["length"])))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    rules = rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", F.concat("host", "path").alias("rule"), _digest(F.col("host"), F.col("path")).alias("digest")
    ).withColumn("prefix", F.substring("digest", 1, PREFIX_BYTES))
    size = F.struct(_labels(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("length"))
    facts = rules.agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_set(size))).alias("sizes")).first()
    sizes = F.from_json(F.lit(facts["sizes"]), "array<struct<labels:int,length:int>>")

    parts = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = parts.withColumn("_url", _digest(F.col("host"), F.col("path")))
    asked = parts.filter(F.col("host") != "").select("_url", F.explode(expressions(F.col("host"), F.col("path"), sizes)).alias("asked"))
    side = rules.select("prefix", "digest", "rule", "verdict")
    side = F.broadcast(side) if facts["n"] <= BROADCAST_RULES else side
    found = (
        asked.withColumn("prefix", F.substring("asked", 1, PREFIX_BYTES)).join(side, "prefix").filter(F.col("asked") == F.col("digest"))
        .groupBy("_url")
        .agg(F.max(F.struct(F.length("rule").alias("length"), "verdict", "rule")).alias("best"))
    )
    return parts.join(found, "_url", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


#: The same result by plain prefix tests of every rule, for DuckDB.
ORACLE_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com','/','allow'), ('example.com','/en/','block'),
  ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(tail, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid FROM cut),
hits AS (
  SELECT p.rid, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
    max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.rid)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict FROM parts p LEFT JOIN hits h USING (rid)
"""
