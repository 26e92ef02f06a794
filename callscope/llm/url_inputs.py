"""Stand-in input of the URL filter query: fetch times and a list history in the schemas it expects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Changes of each listed host and domain.
CHANGES = 6


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time in 2023 or 2024."""
    at = F.timestamp_micros((F.lit(1672531200) + F.col("page_id") * 7919 % 730 * 86400 + F.col("page_id") * 104729 % 86400) * 1_000_000)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated changes to entries of all three kinds, named after the pages' URLs."""
    urls = pages.where("url is not null").select(F.split("url", "#")[0].alias("entry")).distinct().select(F.lit("url").alias("kind"), "entry", F.lit(1).alias("k"))
    hosts = pages.select(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).where("host != ''").distinct()
    steps = F.explode(F.sequence(F.lit(1), F.lit(CHANGES))).alias("k")
    hosts, domains = hosts.select(F.lit("host").alias("kind"), F.col("host").alias("entry"), steps), hosts.select(
        F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("entry")).distinct().select(F.lit("domain").alias("kind"), "entry", steps)
    mark = F.md5(F.concat_ws("|", "kind", "entry", "k"))
    digit = lambda i: F.ascii(F.substr(mark, F.lit(i), F.lit(1)))
    day = (digit(2) * 31 + digit(3) * 17 + F.col("k") * 101) % 730
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), (digit(1) % 3 + 1).cast("int"))
    return urls.union(hosts).union(domains).select("kind", "entry", action.alias("action"), F.timestamp_seconds(F.lit(1672531200) + day * 86400).alias("changed_at"))


#: DuckDB text of the query: the same input, then each capture against every active entry.
ORACLE = """
WITH caps AS (
  SELECT page_id, url, make_timestamp((1672531200 + page_id * 7919 % 730 * 86400 + page_id * 104729 % 86400) * 1000000) AS fetched_at FROM pages
), hosts AS (
  SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS host FROM pages WHERE regexp_extract(url, '://([^/]+)', 1) <> ''
), steps AS (SELECT unnest(range(1, 7)) AS k
), named AS (
  SELECT DISTINCT 'url' AS kind, string_split(url, '#')[1] AS entry, 1::BIGINT AS k FROM pages WHERE url IS NOT NULL
  UNION ALL SELECT 'host', host, k FROM hosts, steps
  UNION ALL SELECT 'domain', entry, k FROM (SELECT DISTINCT regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS entry FROM hosts), steps
), marked AS (
  SELECT *, md5(kind || '|' || entry || '|' || k) AS m FROM named
), changes AS (
  SELECT kind, entry, (['block', 'allow', 'remove'])[ascii(substr(m, 1, 1)) % 3 + 1] AS action,
         make_timestamp((1672531200 + (ascii(substr(m, 2, 1)) * 31 + ascii(substr(m, 3, 1)) * 17 + k * 101) % 730 * 86400) * 1000000) AS changed_at
  FROM marked
), one AS (
  SELECT kind, entry, changed_at, min(action) AS action FROM changes GROUP BY ALL
), spans AS (
  SELECT kind, entry, action, changed_at AS since, lead(changed_at) OVER (PARTITION BY kind, entry ORDER BY changed_at) AS until FROM one
), asked AS (
  SELECT DISTINCT url, fetched_at, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host,
         string_split(url, '#')[1] AS page FROM caps WHERE url IS NOT NULL
), found AS (
  SELECT a.url, a.fetched_at, s.*,
         row_number() OVER (PARTITION BY a.url, a.fetched_at ORDER BY CASE s.kind WHEN 'url' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(s.entry) DESC) AS r
  FROM asked a JOIN spans s ON s.action <> 'remove' AND s.since <= a.fetched_at AND (s.until IS NULL OR a.fetched_at < s.until)
   AND (s.kind = 'url' AND s.entry = a.page OR s.kind = 'host' AND s.entry = a.host
        OR s.kind = 'domain' AND (s.entry = a.host OR ends_with(a.host, '.' || s.entry)))
)
SELECT c.page_id, c.url, c.fetched_at, coalesce(f.action, 'allow') AS verdict, f.kind, f.entry, f.since
FROM caps c LEFT JOIN found f ON f.url = c.url AND f.fetched_at = c.fetched_at AND f.r = 1
"""
