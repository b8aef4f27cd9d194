"""Line deduplication by site-relative frequency.

A page's lines are its visible text: scripts, styles and comments go, block tags end lines, other tags go, white space is
collapsed, empty lines go. For each host, the pages that contain a line (each page once) are divided by the host's
pages; a line on two pages or more and above `ratio` is boilerplate and is dropped from all the host's pages. A ratio of
`ratio` exactly isn't above it.

Lines are counted by host and line, a line of more than SPELLED characters by its SHA-256, with map-side partial sums, so a
line on every page of a large host costs a row for each task. The lines are made once and kept in the shared folder. A
host's boilerplate has at most (lines per page) / ratio entries of bounded length, whatever the host's size; it is joined
to the pages as one array, so pages are never exploded and regrouped, and repeated page_ids don't meet. It is broadcast
if all hosts' entries together are few, else joined by a shuffle.

A null url is the host '' and null html has no lines. Repeated rows are pages of their own. Further columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import cut, small

RATIO = 0.3
SPELLED = 64
#: Up to this many hosts and boilerplate lines, of at most 4 * SPELLED bytes or a digest each, are broadcast.
BROADCAST_ENTRIES = 100_000
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|nav|tr|table|td|th|h[1-6]|article|section|header|footer|title|head|body|html|blockquote|pre|form|aside|main)\b[^>]*>"
TAG = r"<[^>]*>"
SPACE = r"[\t\x0B\f\r ]+"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAG, "")
    text = F.regexp_replace(F.regexp_replace(text, SPACE, " "), r" ?\n ?", "\n")
    return F.array_remove(F.split(F.trim(text), "\n"), "")


def line_key(line: Column) -> Column:
    """The line, or, of a long one, its digest, which is longer than any line that stands for itself."""
    return F.when(F.length(line) <= SPELLED, line).otherwise(F.concat(F.lit("sha256:"), F.sha2(line.cast("binary"), 256)))


def boilerplate(lines: DataFrame, ratio: float = RATIO) -> DataFrame:
    """host, host_pages and `bad`, the sorted keys of its boilerplate lines, from (host, lines), one row for each page."""
    hosts = lines.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    seen = lines.select("host", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    bad = counts.join(hosts, "host").where(F.col("n") > ratio * F.col("host_pages"))
    return hosts.join(bad.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("bad")), "host", "left")


def line_dedup(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """page_id, host, host_pages, n_lines, n_dropped, kept_sha256 (of the kept lines, each ended by a line feed) and text, the kept lines."""
    lines = cut(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")), "lines")
    found = cut(boilerplate(lines.select("host", "lines"), ratio), "boilerplate")
    joined = lines.join(small(found, BROADCAST_ENTRIES, F.greatest(F.size("bad"), F.lit(0))), "host")
    joined = joined.withColumn("_kept", F.when(F.size("bad") > 0, F.filter("lines", lambda x: ~F.array_contains("bad", line_key(x)))).otherwise(F.col("lines")))
    text = F.concat(F.array_join("_kept", "\n"), F.when(F.size("_kept") > 0, "\n").otherwise(""))
    return joined.select(
        "page_id", "host", "host_pages", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"), text.alias("text"),
    )
