"""Pages that follow one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.dom import first, parse_cached
from sluice.functions.urls import parse_url, resolve
from sluice.plans.config import Pagination
from sluice.sources.pages import Pages, Stored, pages_from


def next_url(html: str | None, pagination: Pagination | None, url: str, fetched: int) -> str | None:
    """The page after ``fetched`` pages, or none."""
    if pagination is None or fetched >= pagination.max_pages:
        return None
    if pagination.strategy == "next-link":
        node = first(parse_cached(html or ""), pagination.next_selector) if pagination.next_selector else None
        return resolve(node.get("href"), url) if node is not None and node.get("href") else None
    if pagination.strategy in ("page-param", "offset-param") and pagination.param:
        start, step = (1, 1) if pagination.strategy == "page-param" else (0, 20)
        start = start if pagination.start is None else pagination.start
        step = step if pagination.increment is None else pagination.increment
        found = parse_url(url)
        return found.with_param(pagination.param, str(start + fetched * step)) if found else None
    return None


def numbered_urls(pagination: Pagination | None, start_url: str) -> list[str] | None:
    """All page URLs where they follow from numbers alone; None where only a page names the next one."""
    if pagination is None or pagination.strategy == "next-link":
        return None
    out = [start_url]
    while (found := next_url(None, pagination, out[-1], len(out))) and found not in out:
        out.append(found)
    return out


def chain(pages: DataFrame | Pages, start_url: str, pagination: Pagination | None) -> DataFrame:
    """url, html, page_no of a start page and those that follow it, up to the first that is missing or failed; one page
    without pagination. Stored pages that follow from numbers are one join; links are followed one page at a time."""
    source = pages_from(pages)
    numbered = numbered_urls(pagination, start_url)
    if numbered is not None and isinstance(source, Stored):
        wanted = source.pages.sparkSession.createDataFrame(list(enumerate(numbered)), "page_no int, u string")
        found = source.pages.join(F.broadcast(wanted), F.col("url") == F.col("u")).select("url", "html", "page_no").dropDuplicates(["page_no"])
        have = {r["page_no"] for r in found.select("page_no").collect()}  # at most max_pages
        return found.where(F.col("page_no") < next(k for k in range(len(numbered) + 1) if k not in have))
    url, parts = start_url, []
    seen: set[str] = set()
    while url and url not in seen:
        seen.add(url)
        now = source.one(url)
        row = now.select("html").first()
        if row is None or row["html"] is None:
            break
        parts.append(now.select("url", "html", F.lit(len(parts)).alias("page_no")))
        url = next_url(row["html"], pagination, url, len(parts)) if pagination else None
    if not parts:
        return source.one(start_url).where("html IS NOT NULL").select("url", "html", F.lit(0).alias("page_no"))
    return reduce(DataFrame.unionByName, parts)
