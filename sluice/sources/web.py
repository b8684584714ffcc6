"""Pages from the web as a data source: ``spark.read.format("webpage").option("urls", '["https://..."]')``.

URLs of one domain are one partition, read one after another with a pause; a failed request is tried again with
growing pauses. ``register`` makes the format known to a session.
"""

from __future__ import annotations

import json
import math
import random
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.functions.urls import parse_url
from sluice.plans.config import DEFAULTS

SCHEMA = "url string, final_url string, html string, status int, fetch_mode string, fetch_time_ms double, fetched_at timestamp, error string"
AGENT = "sluice/0.1"


class NetworkError(RuntimeError):
    error_class = "NetworkError"


class FetchTimeout(NetworkError):
    error_class = "TimeoutError"


class RobotsBlocked(RuntimeError):
    error_class = "RobotsBlockedError"


def backoff(attempt: int, base_ms: float = 1000, most_ms: float = 30_000) -> float:
    """Milliseconds to wait after a failed attempt, with jitter from half to all of it."""
    return min(base_ms * 2**attempt, most_ms) * random.uniform(0.5, 1.0)


def retried(action: Callable[[], object], retries: int = DEFAULTS["max_retries"], sleep: Callable[[float], None] = time.sleep):
    for attempt in range(retries + 1):
        try:
            return action()
        except Exception:
            if attempt == retries:
                raise
            sleep(backoff(attempt) / 1000)


class RateLimiter:
    """At least an interval between two requests to one domain; domains unused for an hour are forgotten."""

    def __init__(self, interval_ms: float = DEFAULTS["rate_limit_ms"], clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval_ms / 1000, clock, sleep, {}

    def wait(self, url: str) -> None:
        found = parse_url(url)
        domain = found.host if found and found.host else url
        now = self.clock()
        self.last = {d: t for d, t in self.last.items() if now - t < DEFAULTS["rate_limiter_ttl_ms"] / 1000}
        left = self.interval - (now - self.last[domain]) if domain in self.last else 0
        if left > 0:
            self.sleep(left)
        self.last[domain] = self.clock()


def fetch_static(url: str, timeout_ms: int = DEFAULTS["timeout_ms"], agent: str = AGENT, most_bytes: int = DEFAULTS["max_response_bytes"]) -> dict:
    from urllib.error import HTTPError, URLError
    from urllib.request import Request, urlopen

    begun = time.monotonic()
    request = Request(url, headers={"User-Agent": agent, "Accept": "text/html,application/xhtml+xml,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9"})
    try:
        with urlopen(request, timeout=timeout_ms / 1000) as r:
            raw = r.read(most_bytes + 1)
            if len(raw) > most_bytes:
                raise NetworkError(f"response of {url} is larger than {most_bytes} bytes")
            html = raw.decode(r.headers.get_content_charset() or "utf-8", "replace")
            return {"final_url": r.url, "html": html, "status": r.status, "fetch_mode": "static", "fetch_time_ms": (time.monotonic() - begun) * 1000}
    except HTTPError as e:
        raise NetworkError(f"HTTP {e.code} from {url}") from e
    except TimeoutError as e:
        raise FetchTimeout(f"{url} took more than {timeout_ms} ms") from e
    except URLError as e:
        raise NetworkError(f"{url}: {e.reason}") from e


#: Roots whose text a rendered page is waited for (fixed values).
APP_ROOTS = ("#root > *", "#app > *", "#__next > *", "#__nuxt > *")


#: Milliseconds after which a response with data no longer counts as one that content may still come of (fixed value).
PENDING_MS = 800


def settled(lengths: list[int], least: int, since_data_ms: float = math.inf) -> bool:
    """Whether the last three text lengths are within 5 % and long enough, and no data came just before."""
    last = lengths[-3:]
    return since_data_ms >= PENDING_MS and len(last) == 3 and min(last) >= least and (max(last) - min(last)) <= 0.05 * max(last)


def rendered_available() -> bool:
    import importlib.util

    return importlib.util.find_spec("playwright") is not None


def fetch_rendered(url: str, timeout_ms: int = DEFAULTS["timeout_ms"], agent: str = AGENT, wait_for: str | None = None, least: int = 500, most_wait_ms: int = 8000) -> dict:
    if not rendered_available():
        raise NetworkError("rendered pages need the playwright package and a browser")
    from playwright.sync_api import sync_playwright

    begun = time.monotonic()
    with sync_playwright() as p:
        browser = p.chromium.launch()
        try:
            page = browser.new_page(user_agent=agent, viewport={"width": 1280, "height": 900})
            data_at = [-math.inf]
            page.on("response", lambda r: data_at.__setitem__(0, time.monotonic()) if "json" in (r.headers.get("content-type") or "") else None)
            page.goto(url, wait_until="networkidle", timeout=timeout_ms)
            try:
                page.wait_for_selector(wait_for or ", ".join(APP_ROOTS), timeout=10_000 if wait_for else 5000)
            except Exception:
                pass  # pages without such an element go on
            lengths: list[int] = []
            while (time.monotonic() - begun) * 1000 < most_wait_ms and not settled(lengths, least, (time.monotonic() - data_at[0]) * 1000):
                lengths.append(page.evaluate("document.body ? document.body.innerText.length : 0"))
                page.wait_for_timeout(300)
            return {"final_url": page.url, "html": page.content(), "status": 200, "fetch_mode": "rendered", "fetch_time_ms": (time.monotonic() - begun) * 1000}
        finally:
            browser.close()


def usable_fields(html: str, document: object) -> bool:
    """Whether the static page gives fields worth having: three, one of them neither title nor url."""
    from sluice.functions import mining

    found = mining.repeated_blocks(document)
    names = [f["name"] for f in mining.infer_fields(document, found[0])] if found else []
    return len(names) >= 3 and bool(set(names) - {"title", "url"})


def fetch(
    url: str, mode: str = "static", static: Callable[..., dict] = fetch_static, rendered: Callable[..., dict] = fetch_rendered, accept: Callable[[str, object], bool] | None = None
) -> dict:
    """Static, rendered, or static first and rendered where the page seems to need it: by its signals, too little text, or
    because the caller (``accept``, else its fields) won't have it. A failed rendering leaves the static page."""
    if mode == "rendered":
        return rendered(url)
    found = retried(lambda: static(url))
    if mode == "static":
        return found
    from sluice.functions import mining
    from sluice.functions.dom import parse

    html = found["html"]
    document = parse(html)
    usable = accept or usable_fields
    signals = mining.rendering_features(html, document)
    if mining.rendering_score(signals) >= DEFAULTS["rendering_score_threshold"] or signals["body_length"] < DEFAULTS["min_body_text_length"] or not usable(html, document):
        try:
            return rendered(found["final_url"])
        except Exception:
            return found
    return found


ARROW_SCHEMA = pa.schema([
    ("url", pa.string()), ("final_url", pa.string()), ("html", pa.string()), ("status", pa.int32()), ("fetch_mode", pa.string()), ("fetch_time_ms", pa.float64()),
    ("fetched_at", pa.timestamp("us", tz="UTC")), ("error", pa.string()),
])


def fetch_row(url: str, mode: str, limiter: RateLimiter) -> dict:
    """A page as a row of SCHEMA; a failed one has its error instead of html."""
    limiter.wait(url)
    row = {"url": url, "fetch_mode": mode, "fetched_at": datetime.now(timezone.utc), "error": None}
    try:
        return row | fetch(url, mode)
    except Exception as e:  # a failed page is a row, as a failed phase is
        return row | {"error": f"{getattr(e, 'error_class', type(e).__name__)}: {e}"}


class _Domain(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.mode = options.get("mode", "static")
        self.interval = float(options.get("ratelimitms", options.get("rateLimitMs", DEFAULTS["rate_limit_ms"])))

    def partitions(self) -> list[InputPartition]:
        by_domain: dict[str, list[str]] = defaultdict(list)
        for url in self.urls:
            found = parse_url(url)
            by_domain[found.host if found and found.host else url].append(url)
        return [_Domain(urls) for urls in by_domain.values()] or [_Domain([])]

    def read(self, partition: _Domain) -> Iterator[tuple]:
        limiter = RateLimiter(self.interval)
        for url in partition.urls:
            row = fetch_row(url, self.mode, limiter)
            yield tuple(row.get(name) for name in ARROW_SCHEMA.names)


class WebPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webpage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)
