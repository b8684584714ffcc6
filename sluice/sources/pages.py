"""Where pages come from: a stored table, or the web, each page fetched once and kept."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.urls import parse_url
from sluice.plans.config import DEFAULTS
from sluice.sources import sitemap, web
from sluice.sources.session import ship

#: Where a site's map may be, in order (fixed values).
SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml")


class Pages:
    """Pages by URL: ``get`` gives rows of url, html (null if it failed), error."""

    def get(self, urls: DataFrame) -> DataFrame:
        raise NotImplementedError

    def one(self, url: str) -> DataFrame:
        return self.get(self.spark.createDataFrame([(url,)], "url string"))

    def robots(self, url: str) -> str | None:
        """The site's robots.txt, if the source has one."""
        return None

    def sitemap(self, url: str) -> DataFrame:
        """url, ord of the places that the site's map names: the first map that names any."""
        return self.spark.createDataFrame([], "url string, ord int")

    def errors(self) -> list[tuple[str, str]]:
        """URL and error of the fetches that failed so far, at most 100."""
        return []


class Stored(Pages):
    """A table with url and html."""

    def __init__(self, pages: DataFrame):
        self.pages, self.spark = pages, pages.sparkSession

    def get(self, urls: DataFrame) -> DataFrame:
        return self.pages.join(urls.select("url").distinct(), "url", "left_semi").select("url", "html", F.lit(None).cast("string").alias("error"))

    def one(self, url: str) -> DataFrame:
        return self.pages.where(F.col("url") == url).limit(1).select("url", "html", F.lit(None).cast("string").alias("error"))


def fetched(urls: DataFrame, mode: str = "static", interval_ms: float = DEFAULTS["rate_limit_ms"]) -> DataFrame:
    """Fetch a column of URLs: one task reads a domain's, one after another with a pause. A failed page is a row with its error."""
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.col("url"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = web.RateLimiter(interval_ms)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                row = web.fetch_row(url, mode, limiter)
                yield pa.RecordBatch.from_pylist([row], web.ARROW_SCHEMA)

    return urls.select("url").distinct().repartition(host).sortWithinPartitions("url").mapInArrow(fetch, web.SCHEMA)


class Live(Pages):
    """The web. What is fetched is written to a folder that driver and executors share and read from there: a page is
    asked for once however often its rows are used, and lost executors ask for nothing again."""

    def __init__(self, spark: SparkSession, folder: str, mode: str = "static", interval_ms: float = DEFAULTS["rate_limit_ms"]):
        ship(spark)
        self.spark, self.mode, self.interval = spark, mode, interval_ms
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        self.fetches: dict[str, list[str]] = {}

    def _kept(self, part: str) -> DataFrame:
        # Named one by one: Spark takes two reads of one folder for the same, though it has more files by then.
        places = self.fetches.get(part)
        return self.spark.read.schema(web.SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], web.SCHEMA)

    def get(self, urls: DataFrame, part: str = "pages", mode: str | None = None) -> DataFrame:
        wanted = urls.select("url").distinct()
        new = wanted.join(self._kept(part).select("url"), "url", "left_anti")
        places = self.fetches.setdefault(part, [])
        place = f"{self.path}/{part}/{len(places)}"
        fetched(new, mode or self.mode, self.interval).write.parquet(place)
        places.append(place)
        return self._kept(part).join(wanted, "url", "left_semi").select("url", "html", "error")

    def _text(self, url: str) -> str | None:
        row = self.get(self.spark.createDataFrame([(url,)], "url string"), "files", "static").first()
        return row["html"] if row else None

    def robots(self, url: str) -> str | None:
        found = parse_url(url)
        return self._text(f"{found.origin}/robots.txt") if found else None

    def sitemap(self, url: str) -> DataFrame:
        found = parse_url(url)
        for place in SITEMAPS if found else ():
            text = self._text(f"{found.origin}{place}")
            if text and "<" in text:
                maps = self.spark.createDataFrame([(url, text)], "root string, xml string")
                places = sitemap.sitemap_urls(maps).select("url", "ord")
                if places.limit(1).count():
                    return places
        return super().sitemap(url)

    def errors(self) -> list[tuple[str, str]]:
        return [(r["url"], r["error"]) for r in self._kept("pages").where("error IS NOT NULL").select("url", "error").limit(100).collect()]

    def failed(self) -> int:
        return self._kept("pages").where("error IS NOT NULL").count()


def pages_from(pages: DataFrame | Pages) -> Pages:
    return pages if isinstance(pages, Pages) else Stored(pages)
