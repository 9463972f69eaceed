"""Line deduplication by site-relative frequency.

Pages are grouped by host. A line's boilerplate ratio is the number of the host's pages
that hold it over the number of the host's pages; lines on at least MIN_PAGES pages whose
ratio exceeds RATIO are dropped from every page of that host.

Native: DataFrame functions only. Lines are counted by their 128-bit MD5 digest, once a
page, with partial sums before the shuffle; a line that a third of all pages hold is
spread over SALTS tasks when pages look it up, and only positions move, not the pages.

Edge cases: a null or unparsable url has host '' (a site of its own); null or empty html has
no lines. Lines are compared without surrounding white space, blank ones are left out. A
line twice on one page counts once, and both copies stay or go. Rows that repeat a
page_id are pages of their own. On hosts with fewer than MIN_PAGES pages nothing is
dropped. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.buffers import durable

RATIO = 0.2
MIN_PAGES = 3
SALTS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)"
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|article|section|header|footer|nav|title|head|body|html|main|aside|blockquote|pre)\b[^>]*>"
TAGS = r"<[^>]*>"
BLANKS = " \t\r\f\x0b"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def lines_of(html: Column) -> Column:
    """The visible lines of a page, in order."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def line_id(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(lines: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line_id, pages of the lines to drop. lines: host, lines (one row a page)."""
    held = lines.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", line_id(F.col("line")).alias("line_id")).agg(F.count(F.lit(1)).alias("pages"))
    totals = lines.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return held.where(F.col("pages") >= min_pages).join(totals, "host").where(F.col("pages") / F.col("host_pages") > ratio).select("host", "line_id", "pages")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (the lines that stay) of every page."""
    lines = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), lines_of(F.col("html").cast("string")).alias("lines"))
    lines = durable(lines.withColumn("row", F.monotonically_increasing_id()), "page-lines")
    dropped = boilerplate(lines, ratio, min_pages).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("pages")
    placed = lines.select("row", "host", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.posexplode("lines").alias("pos", "line"))
    placed = placed.select("row", "host", "salt", "pos", line_id(F.col("line")).alias("line_id"))
    hits = placed.join(dropped, ["host", "salt", "line_id"], "left_semi").groupBy("row").agg(F.collect_list("pos").alias("out"))
    whole = lines.join(hits, "row", "left").withColumn("out", F.coalesce("out", F.array().cast("array<int>")))
    kept = F.filter("lines", lambda _, i: ~F.array_contains("out", i))
    return whole.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size("out").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS row, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
  list_filter(list_transform(str_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', chr(10), 'g'),
    '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))), lambda x: x <> '') AS lines FROM pages),
totals AS (SELECT host, count(*) AS n FROM p GROUP BY host),
l AS (SELECT row, host, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM p),
bad AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT row) AS c FROM l GROUP BY host, line) JOIN totals USING (host) WHERE c >= {MIN_PAGES} AND c / n > {RATIO}),
m AS (SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad USING (host, line)),
s AS (SELECT row, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text FROM m GROUP BY row)
SELECT page_id, host, len(lines) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(text, '') AS text FROM p LEFT JOIN s USING (row)
"""
