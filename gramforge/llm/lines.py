"""Line deduplication by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages
that contain it over the number of the host's pages; lines whose ratio exceeds
``RATIO`` on a host with at least ``MIN_PAGES`` pages are boilerplate there and
are dropped from its pages.

Lines of an HTML page are its texts between block-level tags and line breaks,
other tags removed, white space (``SPACES``) trimmed, empty lines left out.

Only 128-bit hashes of lines are shuffled for counting; the lines above the
ratio are few (no host can have more than lines-per-page / ratio of them) and
return to the pages as one set per host.

Defined results
---------------
* null url or a url without a host: the host is '' (such pages form one site).
* null or empty html: no lines; the page counts for its host and is returned
  with an empty text.
* a line repeated within a page counts once for the page; all its occurrences
  are dropped or kept together.  ties: a ratio equal to RATIO is kept.
* a host of a single page: its lines repeat nowhere, all are kept.
* very long pages: processed whole.   page ids of any type, nulls too.
* repeated rows: each row is a page.  extra columns, whatever their names:
  ignored.  empty table: empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_upto, cut, named, table_stats

RATIO = 0.5
MIN_PAGES = 2
#: Trimmed from both ends of a line.
SPACES = " \t\v\f\u00a0"
#: Hosts and boilerplate lines up to these numbers are broadcast, so that a host
#: of many pages stays spread; more are shuffled, skewed hosts being split.
BROADCAST_HOSTS = 1_000_000
BROADCAST_KEYS = 1_000_000
_HIDDEN = r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>|<!--.*?-->"
_BREAK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|nav|header|footer|article|section|main|aside|title|body|head|html|blockquote|pre)\b[^>]*>|[\r\n]+"
_TAG = r"<[^>]*>"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def page_lines(html: Column) -> Column:
    """Array of the trimmed, non-empty lines of a page, in order."""
    broken = F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), _BREAK, "\n")
    plain = F.regexp_replace(broken, _TAG, "")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")


def drop_boilerplate(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(id_col, host, text, dropped): remaining lines joined by newlines, and
    how many lines went, of every input row."""
    lined = pages.select(
        named(pages, id_col).alias("_gf_id"),
        host(named(pages, url_col)).alias("_gf_host"),
        F.coalesce(page_lines(named(pages, html_col)), F.array().cast("array<string>")).alias("_gf_lines"),
    )
    digest = lambda x: F.struct(F.xxhash64(F.lit(0), x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))
    totals = lined.groupBy("_gf_host").agg(F.count(F.lit(1)).alias("_gf_pages"))
    seen = (
        lined.select("_gf_host", F.explode(F.array_distinct("_gf_lines")).alias("_gf_line"))
        .select("_gf_host", digest(F.col("_gf_line")).alias("_gf_key"))
        .groupBy("_gf_host", "_gf_key")
        .agg(F.count(F.lit(1)).alias("_gf_n"))
        .filter(F.col("_gf_n") > F.lit(ratio * min_pages))
    )
    bad = cut(
        seen.join(broadcast_upto(cut(totals), BROADCAST_HOSTS), "_gf_host")
        .filter((F.col("_gf_pages") >= min_pages) & (F.col("_gf_n") > F.lit(float(ratio)) * F.col("_gf_pages")))
        .groupBy("_gf_host")
        .agg(F.collect_list("_gf_key").alias("_gf_bad"))
    )
    keys = table_stats(bad, F.sum(F.size("_gf_bad")).alias("n"))["n"] or 0
    joined = lined.join(F.broadcast(bad) if keys <= BROADCAST_KEYS else bad, "_gf_host", "left")
    kept = F.when(F.col("_gf_bad").isNull(), F.col("_gf_lines")).otherwise(
        F.filter("_gf_lines", lambda x: ~F.array_contains(F.col("_gf_bad"), digest(x)))
    )
    return joined.withColumn("_gf_kept", kept).select(
        F.col("_gf_id").alias(id_col),
        F.col("_gf_host").alias("host"),
        F.array_join("_gf_kept", "\n").alias("text"),
        (F.size("_gf_lines") - F.size("_gf_kept")).cast("bigint").alias("dropped"),
    )


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE_SQL = f"""
WITH raw AS (
  SELECT row_number() OVER () AS rid, page_id,
         lower(coalesce(regexp_extract(url, '{_sql(_HOST)}', 1), '')) AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '{_sql(_HIDDEN)}', '', 'g'), '{_sql(_BREAK)}', chr(10), 'g'), '{_sql(_TAG)}', '', 'g') AS plain
  FROM pages
), lined AS (
  SELECT rid, page_id, host,
         coalesce(list_filter(list_transform(string_split(plain, chr(10)), lambda x: trim(x, {" || ".join(f"chr({ord(c)})" for c in SPACES)})), lambda x: x <> ''), []) AS lines
  FROM raw
), totals AS (SELECT host, count(*) AS pages FROM lined GROUP BY host),
seen AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY host, line
), bad AS (
  SELECT host, list(line) AS bad FROM seen JOIN totals USING (host)
  WHERE pages >= {MIN_PAGES} AND n > {RATIO} * pages GROUP BY host
)
SELECT page_id, host,
       array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)), chr(10)) AS text,
       CAST(len(lines) - len(list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x))) AS BIGINT) AS dropped
FROM lined LEFT JOIN bad USING (host)
"""
