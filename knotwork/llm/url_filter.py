"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes, confirmed by full digests.

Each URL is expanded into host/path expressions. Only the numbers of host labels and the path lengths that occur in the
rules are expanded, so a URL gives at most (label counts) x (path lengths) rows however long it is. Expressions meet the
rules in an equi-join on 32 bits of their SHA-256; a match counts when the whole digest agrees. The rule that stays is
the longest; of equals, block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import LOWER, UPPER

#: (host, path, verdict), the rules of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rules are sent to all executors up to this many; beyond it the join is left to Spark.
BROADCAST_RULES = 200_000
DEFAULT_VERDICT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; then path up to ? or #.

    Both are empty for null and for urls without ://.
    """
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """pages with host, path, rule and verdict added (replacing columns of these names).

    A rule (host, path) fits its host and all subdomains of it when the url's path starts with the rule's path; the rule
    with the longest host + path wins and, of equally long ones, block. rule is host + path, or null where none fits;
    the verdict is then default. Urls that are null, empty or without :// have empty parts and fit no rule but one with an
    empty host. Rows that repeat stay; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count(F.lit(1)).alias("n")).first()
    digest = lambda h, p: F.unhex(F.sha2(F.concat(h, F.lit("\n"), p).cast("binary"), 256))
    known = rules.select(digest(F.col("host"), F.col("path")).alias("full"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"))
    known = known.withColumn("short", F.substring("full", 1, 4))
    known = F.broadcast(known) if shape["n"] <= broadcast_rules else known
    urls = pages.select(F.col(url_col).alias("url")).distinct().select("url", host.alias("h"), path.alias("p")).filter("h <> ''")
    counts, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    suffixes = F.filter(F.array(*[F.when(F.size(F.split("h", r"\.")) >= k, F.substring_index("h", ".", -k)) for k in counts]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    if counts and lengths:
        expanded = urls.select("url", F.explode(suffixes).alias("hs"), prefixes.alias("ps")).select("url", "hs", F.explode("ps").alias("pp"))
        expanded = expanded.withColumn("full", digest(F.col("hs"), F.col("pp"))).withColumn("short", F.substring("full", 1, 4))
        hits = expanded.alias("e").join(known.alias("k"), F.col("e.short") == F.col("k.short")).filter("e.full = k.full")
        rank = F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict")
        best = hits.groupBy("url").agg(F.max(rank).alias("best")).select(F.col("url").alias("_judged_url"), F.col("best").alias("_judged"))
    else:
        best = spark.createDataFrame([], "_judged_url string, _judged struct<n:int,block:boolean,rule:string,rule_verdict:string>")
    joined = pages.join(best, pages[url_col] == F.col("_judged_url"), "left")
    host, path = url_parts(pages[url_col])
    made = {"host": host, "path": path, "rule": F.col("_judged.rule"), "verdict": F.coalesce(F.col("_judged.rule_verdict"), F.lit(default))}
    return joined.select(*[pages[c] for c in pages.columns if c not in made], *[v.alias(k) for k, v in made.items()])


ORACLE = """
WITH u AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rh, rp, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
  FROM p, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
