"""Site crawling: the frontier, its order and what the pages on it hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.urls import normalize
from sluice.functions.arrow import dealt
from sluice.operators.analyze import analysis, links_column, listed
from sluice.plans.config import DEFAULTS
from sluice.sources.pages import Pages, pages_from

PRIORITY = {"root": 0, "nav": 1, "footer": 1, "content": 1, "sitemap": 2}


def frontier(root_url: str, pages: DataFrame | Pages, sitemap: DataFrame | None = None, most: int = DEFAULTS["crawl_pages"]) -> DataFrame:
    """url, source, priority, ord of the pages to visit: the root, its links, then the sitemap's; the first to name a
    page labels it. At most ``most``. Without a table of the sitemap's places, pages of the web ask for it."""
    source = pages_from(pages)
    spark = source.spark
    root = normalize(root_url, root_url) or root_url
    own = source.one(root_url).select("html")
    if root != root_url:
        own = own.unionByName(source.one(root).select("html")).limit(1)
    found = listed(own, links_column(F.col("html"), F.lit(root_url))).select("url", "source", F.lit(1).alias("priority"), "ord")
    sitemap = source.sitemap(root_url) if sitemap is None else sitemap
    out = spark.createDataFrame([(root, "root", 0, 0)], "url string, source string, priority int, ord int").unionByName(found)
    out = out.unionByName(sitemap.select("url", F.lit("sitemap").alias("source"), F.lit(2).alias("priority"), F.col("ord").cast("int").alias("ord")))
    first = out.groupBy("url").agg(F.min_by(F.struct("source", "priority", "ord"), F.struct("priority", "ord")).alias("x"))
    return first.select("url", "x.*").orderBy("priority", "ord").limit(most)


def crawl(root_url: str, pages: DataFrame | Pages, sitemap: DataFrame | None = None, most: int = DEFAULTS["crawl_pages"]) -> DataFrame:
    """url, title, page_type, has_data, items, confidence, source of the frontier's pages: those with repeated data
    first, the root last among equals, then the most confident."""
    source = pages_from(pages)
    # At most ``most`` rows: which pages to read is settled before any is.
    rows = [tuple(r) for r in frontier(root_url, source, sitemap, most).select("url", "source").collect()]
    visits = source.spark.createDataFrame(rows, "url string, source string")
    got = dealt(source.get(F.broadcast(visits)).where("html IS NOT NULL").select("url", "html"), "url").dropDuplicates(["url"])
    found = got.join(F.broadcast(visits), "url").withColumn("a", analysis(F.col("html"), F.col("url")))
    best = F.try_element_at("a.blocks", F.lit(1))
    rows = found.select(
        "url", F.col("a.title").alias("title"), F.col("a.page_type").alias("page_type"), F.coalesce(best["confidence"] >= DEFAULTS["confidence_threshold"], F.lit(False)).alias("has_data"),
        F.coalesce(best["count"], F.lit(0)).alias("items"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"), "source",
    )
    return rows.orderBy(F.desc("has_data"), F.col("source") == "root", F.desc("confidence"), "url")


def summary(crawled: DataFrame, discovered: int | Column) -> DataFrame:
    """One row: pages, data_pages, skipped."""
    discovered = discovered if isinstance(discovered, Column) else F.lit(discovered)
    return crawled.agg(F.count("*").alias("pages"), F.count_if("has_data").alias("data_pages"), F.greatest(discovered - F.count("*"), F.lit(0)).alias("skipped"))
