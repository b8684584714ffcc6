"""Sitemaps: the places that url elements name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCATIONS = "//*[local-name()='url']/*[local-name()='loc']/text()"


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """url, ord of each location, from columns root and xml; white space around it is cut."""
    found = F.posexplode(F.xpath("xml", F.lit(LOCATIONS)))
    return sitemaps.select("root", found.alias("ord", "url")).select("root", "ord", F.trim("url").alias("url")).where("url <> ''")
