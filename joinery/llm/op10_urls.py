"""Query op10: a verdict on every page's url, by rule or by the cascade over the hosts on the block list.

The block list holds each host of the corpus with a label that names a spam, shock or piracy trade; as SQL it is the
regular expression LISTED over distinct hosts.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm.cascade import host_of, path_of, rule_verdict, with_membership
from joinery.runtime import table

NAME = "op10_url_cascade"

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LISTED = r"(^|[.-])(spam|casino|porn|xxx|warez|pills|viagra|malware|phishing|adult|torrent)([.-]|$)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", host_of(pages.url).alias("host"), path_of(pages.url).alias("path"))
    hosts = rows.select(F.col("host").alias("key")).distinct()
    tested = with_membership(rows, F.col("host"), hosts.where(F.col("key").rlike(LISTED)))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), RULES)
    other = F.when(F.col("listed"), "block").otherwise("allow")
    return tested.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"))


SQL = rf"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(decides, h, p) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(decides, length(h || p)) AS decides
    FROM (SELECT DISTINCT page_id, host, path FROM split) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id, host, path
)
SELECT s.page_id, s.host, s.path, f.rule,
    coalesce(f.decides, CASE WHEN regexp_matches(s.host, '{LISTED}') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fit f USING (page_id)
"""
