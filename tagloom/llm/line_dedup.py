"""Line deduplication by site-relative frequency, in DataFrame functions only.

A page's lines are its visible text cut at block-level tags and line feeds, trimmed, the
empty ones left out. For every host, the pages that contain a line are divided by the
host's pages; lines on more than one page and above ``max_ratio`` are boilerplate and are dropped
from its pages.

Only 64-bit hashes of lines are counted, summed up before the shuffle, so a host or line
with a third of all pages is no hot key. A host has at most (its mean number of lines on
a page) / max_ratio boilerplate lines. Their hashes come to the pages by a join on the
host in which the largest hosts are broadcast, at most 2**20 hashes in all (see joins.look_up).

Defined cases. Null html has no lines. Pages with no host in their url (or no url) keep
all lines. Repeated rows count as pages of their own. Null ids stay null. Input
columns named like a result column are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.joins import look_up
from tagloom.llm.store import materialise

MAX_RATIO = 0.3
#: Patterns of what is invisible, of tags that end a line, and of other tags.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern, to in ((HIDDEN, "\n"), (BLOCKS, "\n"), (TAGS, "")):
        text = F.regexp_replace(text, pattern, to)
    return F.filter(F.transform(F.split(text, r"\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda x: x != "")


def drop_boilerplate(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_ratio: float = MAX_RATIO) -> DataFrame:
    """(id, host, host_pages, n_lines, n_dropped, text) of every page; text is the lines that stay."""
    pages = materialise(df.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines")), "lines")
    sites = pages.where("host is not null").groupBy("host").agg(F.count("*").alias("host_pages"))
    seen = pages.where("host is not null").select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    often = seen.groupBy("host", "line").agg(F.count("*").alias("pages")).where("pages > 1").join(sites, "host").where(F.col("pages") > F.col("host_pages") * max_ratio)
    known = sites.join(often.groupBy("host").agg(F.collect_list("line").alias("common")), "host", "left")
    known = materialise(known, "sites")
    met = look_up(pages, known, "host", pages.count(), "1 + coalesce(size(common), 0)")
    stay = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.expr("filter(lines, x -> not array_contains(common, xxhash64(x)))"))
    met = met.withColumn("stay", stay)
    return met.select(F.col("page_id").alias(id_col), "host", "host_pages", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"), F.array_join("stay", "\n").alias("text"))
