"""Web pages: visible text, links, and bundles of a page with those it links to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.kernels import page_text

#: An anchor's address in double quotes, single quotes or none.
HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]+"|'[^']+'|[^\s"'>]+)"""
#: Links that lead to no content (fixed values).
NOT_CONTENT = r"(?i)(mailto:|privacy|terms)"


def text(html: Column, most: int = 2000) -> Column:
    return F.substring(page_text(html), 1, most)


def links(pages: DataFrame) -> DataFrame:
    """page_id, link_no, href of each link with an address, in order."""
    found = F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: F.when(x.rlike("^[\"']"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    return pages.select("page_id", F.posexplode(found).alias("link_no", "href"))


def bundles(pages: DataFrame, links: DataFrame, most: int = 5000) -> DataFrame:
    """A page's text followed by the texts of the pages it links to, cut; links are (page_id, link_no, target_id).

    Only what fits is gathered: running lengths in the order of links tell which texts begin within the limit, so a hub page's list is no longer than `most`.
    """
    own = pages.select("page_id", F.substring("text", 1, most).alias("text"))
    linked = links.join(own.select(F.col("page_id").alias("target_id"), F.col("text").alias("linked")), "target_id")
    begins = F.sum(F.length("linked") + 1).over(Window.partitionBy("page_id").orderBy("link_no").rowsBetween(Window.unboundedPreceding, -1))
    linked = linked.withColumn("_at", F.coalesce(begins, F.lit(0))).where(F.col("_at") < most)
    joined = linked.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("link_no", "linked"))), lambda x: x["linked"]), "\n").alias("more"))
    return own.join(joined, "page_id", "left").select("page_id", F.substring(F.concat_ws("\n", "text", "more"), 1, most).alias("bundle"))
