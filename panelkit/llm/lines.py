"""Line dedup by site-relative frequency.

Pages are grouped by host. A line that stands on more than ``max_ratio`` of its
host's pages, and on more than one of them, is boilerplate of that host and is
dropped from them; the same line elsewhere stays.

A page counts once for a line however often it repeats there. Pages are counted
per (host, 64-bit hash of the line) first, plain partial aggregates of small
rows; only occurrences of hashes over the ratio are counted again by the line
itself, so equal hashes of different lines do no harm. A host has at most
(lines per page) / max_ratio boilerplate lines. While all of them together stay
within a checked size they go to every task and the pages are not moved; beyond
it they are joined to the host's pages, spread over salts because one host may
hold a third of them.

Only DataFrame functions are used. Defined results: null html has no lines; a
null or unreadable url belongs to the host ''; pages are rows, so repeated rows
count and repeat; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import BROADCAST_LIMIT_BYTES, maybe_broadcast, text_or_empty, written

MAX_RATIO = 0.3
SALTS = 32

#: fixed patterns, shared with the DuckDB form
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK = (r"(?i)</?(?:address|article|aside|blockquote|body|br|div|dl|dd|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|"
         r"section|table|tbody|td|th|thead|title|tr|ul)(?:[ \t\r\n][^>]*)?/?>")
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(url), HOST, 1))


def lines_of(html: Column) -> Column:
    """Text lines of a page: block tags break lines, other tags vanish."""
    shown = F.regexp_replace(text_or_empty(html), HIDDEN, "\n")
    plain = F.regexp_replace(F.regexp_replace(shown, BLOCK, "\n"), TAG, "")
    parts = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.filter(parts, lambda x: x != "")


def _over(counts: DataFrame, totals: DataFrame, max_ratio: float) -> DataFrame:
    return (counts.filter("pages > 1").join(maybe_broadcast(totals, 64), "host")
            .filter(F.col("pages") > F.col("host_pages") * max_ratio))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """(host, line, pages, host_pages) of the lines over the ratio; ``pages`` has host and lines."""
    totals = written(pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).filter("host_pages > 1"), "hosts")
    hashes = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))
    counts = pages.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("pages"))
    likely = written(_over(counts, totals, max_ratio).select("host", "h"), "likely_lines")
    lines = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).withColumn("h", F.xxhash64("line"))
    exact = (lines.join(maybe_broadcast(likely, 64), ["host", "h"], "left_semi")
             .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")))
    return _over(exact, totals, max_ratio)


def line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               max_ratio: float = MAX_RATIO) -> DataFrame:
    """page_id, host, n_lines, n_removed, kept_text per page."""
    cut = written(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                               lines_of(F.col(html_col)).alias("lines")), "lines")
    drop = written(boilerplate(cut, max_ratio).groupBy("host").agg(F.collect_list("line").alias("dropped")), "boilerplate")
    size = F.aggregate("dropped", F.lit(64).cast("long"), lambda n, x: n + F.length(x) * 4 + 32)
    n_bytes = drop.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if n_bytes <= BROADCAST_LIMIT_BYTES:
        joined = cut.join(F.broadcast(drop), "host", "left")
    else:
        drop = drop.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = cut.withColumn("salt", F.pmod(F.xxhash64("page_id", "lines"), F.lit(SALTS)).cast("int"))
        joined = salted.join(drop, ["host", "salt"], "left")
    # the page's own boilerplate first (a hashed intersection), so that each line is held against a few
    kept = F.when(F.col("own").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("own", x)))
    return joined.withColumn("own", F.array_intersect("lines", "dropped")).withColumn("kept", kept).select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("kept_text"))


SQL = f"""
    WITH cut AS (
        SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
               list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
                   coalesce(html, ''), '{HIDDEN}', chr(10), 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)),
                   lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> '') AS lines
        FROM pages),
    numbered AS (SELECT *, row_number() OVER () AS row_no FROM cut),
    totals AS (SELECT host, count(*) AS host_pages FROM cut GROUP BY host),
    counts AS (SELECT host, line, count(DISTINCT row_no) AS pages FROM (SELECT host, row_no, unnest(lines) AS line FROM numbered) GROUP BY host, line),
    dropped AS (SELECT host, list(line) AS gone FROM counts JOIN totals USING (host) WHERE pages > 1 AND pages > host_pages * {MAX_RATIO} GROUP BY host)
    SELECT page_id, numbered.host AS host, len(lines) AS n_lines,
           len(list_filter(lines, lambda x: list_contains(coalesce(gone, []), x))) AS n_removed,
           array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)), chr(10)) AS kept_text
    FROM numbered LEFT JOIN dropped ON numbered.host = dropped.host
"""
