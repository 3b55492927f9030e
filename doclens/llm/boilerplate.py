"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import read
from doclens.session import written

# Elements whose content is no text, and elements that start a line of their own.
HIDDEN = "script|style|head|noscript|template"
BLOCKS = "p|div|li|ul|ol|br|h[1-6]|tr|table|nav|article|section|header|footer|aside|main|blockquote|pre|td|th|hr"


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.when(bare != "", bare)


def html_lines(html: Column) -> Column:
    """The visible lines of a page: one per block element, tags removed, white space collapsed."""
    unseen = rf"(?is)<!--.*?-->|<({HIDDEN})(?:\s[^>]*)?>.*?</\1\s*>"
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), unseen, "")
    broken = F.regexp_replace(shown, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n")
    plain = F.regexp_replace(broken, "<[^>]*>", "")
    return text_lines(plain)


def text_lines(text: Column) -> Column:
    """Lines of a text with white space collapsed, empty ones left out."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\n")
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return F.filter(tidy, lambda x: x != "")


def drop_boilerplate(
    pages: DataFrame, ratio: float = 0.3, least: int = 3, key: str = "page_id", host: str = "host", lines: str = "lines"
) -> DataFrame:
    """Pages without the lines that stand on more than ``ratio`` of the pages of their host.

    ``pages`` has ``key``, ``host`` and ``lines`` (array of text). Gives key, host, ``text``
    (the kept lines), ``n_lines``, ``n_dropped``. A line must stand on ``least`` pages of the host at
    least, so hosts of one or two pages lose nothing. A line repeated in a page counts that page once.

    The lines of each page and their hashes are made and written once. What is shuffled for the counts is (host, line hash) with partial sums, so a line on a third of all
    pages is one row per task. The frequent lines come back to their pages as hashes; texts are moved
    once, in the join by page. A hash is 128 bits (two seeds), equal hashes are taken as equal lines.

    A page whose host or key is null loses nothing, and one without a host counts nowhere. Null lines
    are none; an empty page has text ''. Each row counts as a page, repeated ones too, and gives its
    row. Other columns are not read.
    """
    def digest(x: Column) -> Column:
        return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))

    body = F.coalesce(F.col(lines), F.array().cast("array<string>"))
    narrow = pages.select(F.col(key), F.col(host), body.alias("_lines"))
    hashes = F.array_distinct(F.transform("_lines", digest))
    stored = written(narrow.withColumn("_hashes", F.when(F.col(host).isNotNull(), hashes)), "lines")
    narrow, known = stored.select(key, host, "_lines"), stored.filter(F.col(host).isNotNull())
    marks = known.select(key, host, F.explode("_hashes").alias("_line"))
    totals = known.groupBy(host).agg(F.count(F.lit(1)).alias("_pages"))
    counts = marks.groupBy(host, "_line").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    frequent = counts.join(totals, host).filter(F.col("_n") > ratio * F.col("_pages"))
    dropped = marks.join(frequent.select(host, "_line"), [host, "_line"])
    dropped = dropped.groupBy(key, host).agg(F.collect_set("_line").alias("_dropped"))
    joined = narrow.join(dropped, [key, host], "left")
    listed = F.coalesce("_dropped", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    kept = F.filter("_lines", lambda x: ~F.array_contains(listed, digest(x)))
    return joined.select(
        key, host, F.array_join(kept, "\n").alias("text"),
        F.size("_lines").alias("n_lines"), (F.size("_lines") - F.size(kept)).alias("n_dropped"),
    )


def query(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages", "page_id", "url", "html")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    return drop_boilerplate(parsed)


def _sql() -> str:
    shown = r"regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gis')"
    for name in HIDDEN.split("|"):
        shown = rf"regexp_replace({shown}, '<{name}(?:\s[^>]*)?>.*?</{name}\s*>', '', 'gis')"
    broken = rf"regexp_replace({shown}, '</?(?:{BLOCKS})(?:\s[^>]*)?/?>', chr(10), 'gi')"
    plain = f"regexp_replace({broken}, '<[^>]*>', '', 'g')"
    host = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
    return rf"""
WITH parsed AS (
  SELECT page_id, nullif(regexp_replace(regexp_replace({host}, '^.*@', ''), ':[0-9]*$', ''), '') AS host,
    list_filter(list_transform(string_split({plain}, chr(10)),
      lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM pages),
flat AS (SELECT page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parsed),
totals AS (SELECT host, count(*) AS pages FROM parsed WHERE host IS NOT NULL GROUP BY host),
frequent AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT page_id) AS n FROM flat GROUP BY host, line)
  JOIN totals USING (host) WHERE n >= 3 AND n > 0.3 * pages),
kept AS (SELECT f.page_id, string_agg(f.line, chr(10) ORDER BY f.pos) AS text, count(*) AS n
  FROM flat f LEFT JOIN frequent q ON f.host = q.host AND f.line = q.line WHERE q.line IS NULL GROUP BY f.page_id)
SELECT p.page_id, p.host, coalesce(k.text, '') AS text, len(p.lines)::INTEGER AS n_lines,
  (len(p.lines) - coalesce(k.n, 0))::INTEGER AS n_dropped FROM parsed p LEFT JOIN kept k USING (page_id)
"""


SQL = _sql()
