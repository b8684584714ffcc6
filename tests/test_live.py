"""Runs, crawls and schedules against a web server of the test's own."""

import json
import logging
import threading
from collections import Counter
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sluice import log, wizard
from sluice.operators import analyze, crawl, paginate
from sluice.plans import run as runs
from sluice.plans.config import ConfigError, Pagination, config_of
from sluice.plans.schedule import Lock
from sluice.sources import web
from sluice.sources.catalog import Catalog
from sluice.sources.pages import Live, Stored

CARD = '<div class="product-card"><h3><a href="/item/{k}">Thing number {k}</a></h3><span class="price">${k}.50</span><img src="/{k}.png"><p class="desc">This thing is the one with the number {k} of all.</p></div>'


def listing(page: int, last: int = 3) -> str:
    cards = "".join(CARD.format(k=page * 10 + k) for k in range(4))
    return f'<title>List {page}</title><nav><a href="/list/1">Things</a><a href="/secret/x">Secret</a></nav><div class="products">{cards}</div>' + (f'<a rel="next" href="/list/{page + 1}">next</a>' if page < last else "")


@pytest.fixture
def site():
    asked: Counter = Counter()
    pages = {f"/list/{k}": listing(k) for k in (1, 2)} | {f"/item/{p * 10 + k}": f"<body><p class=maker>Maker {p * 10 + k}</p></body>" for p in (1, 2) for k in range(4)}
    pages |= {"/": listing(0), "/robots.txt": "User-agent: *\nDisallow: /secret/", "/sitemap.xml": "<urlset><url><loc>http://HOST/list/2</loc></url><url><loc>http://HOST/gone</loc></url></urlset>"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            body = pages.get(self.path, "").replace("HOST", self.headers["Host"]).encode()
            self.send_response(200 if body else 404)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


@pytest.fixture
def live(spark, tmp_path):
    return lambda: Live(spark, str(tmp_path / "pages"), interval_ms=0)


def config(url: str, **more) -> dict:
    return {
        "name": "things", "url": url, "listSelector": "div.product-card", "pagination": {"strategy": "next-link", "nextSelector": "a[rel=next]", "maxPages": 5},
        "fields": [{"name": "title", "selector": "h3", "required": True}, {"name": "url", "selector": "a", "attribute": "href", "type": "url"}, {"name": "price", "selector": ".price", "type": "price"}],
    } | more


def test_run_over_the_web(spark, site, live, tmp_path):
    base, asked = site
    c = Catalog(spark, str(tmp_path / "c"))
    detail = {"detailPage": {"fields": [{"name": "maker", "selector": "p.maker"}]}}
    source = c.add_source(config(f"{base}/list/1", **detail))
    found = runs.run(c, source, live())
    rows = found.records.orderBy("page_no", "item_idx").collect()
    # Page 3 is missing: two pages of four items, the error is told, and the run completes.
    assert len(rows) == 8, (found, asked)
    assert rows[0]["maker"] == "Maker 10" and rows[7]["maker"] == "Maker 23" and rows[4]["page_no"] == 1
    assert [e[0] for e in found.errors] == ["fetch"] and "/list/3" in found.errors[0][1] and c.latest("runs", source)["status"] == "completed"
    once = {p: n for p, n in asked.items() if p != "/list/3"}
    assert set(once.values()) == {1} and "/robots.txt" in once
    assert c.latest("snapshots", source)["content_hash"] and c.latest("runs", source)["pages"] == 2

    blocked = runs.run(c, c.add_source(config(f"{base}/secret/x")), live())
    assert blocked.errors and c.table("runs").where("error_class = 'RobotsBlockedError'").count() == 1 and asked["/secret/x"] == 0
    ignoring = runs.run(c, c.add_source(config(f"{base}/secret/x", robotsPolicy="ignore")), live())
    assert asked["/secret/x"] >= 1 and ignoring.health["degraded"] and any(r.startswith("High error rate") for r in ignoring.health["reasons"])


def test_crawl_over_the_web(spark, site, live):
    base, asked = site
    rows = crawl.crawl(f"{base}/", live(), most=10).collect()
    assert [(r["url"][len(base):], r["source"], r["has_data"], r["items"]) for r in rows] == [("/list/1", "nav", True, 4), ("/list/2", "sitemap", True, 4), ("/", "root", True, 4)]
    assert asked["/"] == asked["/list/1"] == asked["/list/2"] == 1


def test_scheduler(spark, site, live, tmp_path):
    base, _ = site
    c = Catalog(spark, str(tmp_path / "c"))
    source = c.add_source(config(f"{base}/list/2", pagination=None))
    c.set_schedule(source, "0 9 * * *")
    lock = Lock(str(tmp_path / "lock"))
    scheduler = runs.Scheduler(c, lambda _: live(), lock, lambda: datetime(2024, 1, 1, 9, 0, 30))
    assert len(scheduler.tick()) == 1 and c.get("schedules", source)["next_run_at"] == datetime(2024, 1, 2, 9)
    assert lock.acquire() and scheduler.tick() == []
    lock.release()
    c.disable_schedule(source)
    assert scheduler.tick() == []
    scheduler.start().stop()


def test_stored_pages_by_number(spark):
    pages = spark.createDataFrame([(f"https://s.com/?page={k}", "x") for k in (1, 2, 3, 5)], "url string, html string")
    found = paginate.chain(pages, "https://s.com/?page=1", Pagination("page-param", param="page", max_pages=9))
    assert sorted((r["page_no"], r["url"][-1]) for r in found.collect()) == [(0, "1"), (1, "2"), (2, "3")]
    assert Stored(pages).get(pages.limit(2)).count() == 2 and paginate.chain(pages, "https://s.com/none", None).count() == 0


def test_automatic_mode():
    static = lambda html: lambda url: {"html": html, "final_url": url}
    rendered = lambda url: {"html": "rendered", "final_url": url}
    full = listing(1) + "<p>" + "word " * 100
    assert web.fetch("u", "auto", static(full), rendered)["html"] == full
    assert web.fetch("u", "auto", static(full), rendered, accept=lambda h, d: False)["html"] == "rendered"
    assert web.fetch("u", "auto", static("<p>few"), rendered)["html"] == "rendered"
    assert web.fetch("u", "auto", static("<p>" + "word " * 100), rendered)["html"] == "rendered"  # no fields

    def broken(url):
        raise web.NetworkError("no browser")

    assert web.fetch("u", "auto", static("<p>few"), broken)["html"] == "<p>few"


def test_wizard(spark):
    page = spark.createDataFrame([("https://s.com/", listing(1))], "url string, html string")
    found = analyze.analyze(page).first()["analysis"].asDict(True)
    said: list[str] = []
    answers = iter(["title,nope", "title,price", "", "x", "3", "maybe", "daily"])
    made = wizard.converse("https://s.com/", found, lambda _: next(answers), said.append)
    assert [f.name for f in made.fields] == ["title", "price"] and made.name == "List 1" and made.pagination.max_pages == 3 and made.schedule == "0 9 * * *"
    assert any("no field nope" in s for s in said) and config_of(made.to_json()) == made
    with pytest.raises(ConfigError):
        wizard.converse("https://s.com/", found | {"blocks": []}, lambda _: "", said.append)


def test_log(tmp_path):
    path = tmp_path / "log"
    out = log.setup("warning", str(path))
    logging.getLogger("sluice").warning("slow", extra={"source": "a"})
    out.info("not said")
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    assert len(lines) == 1 and lines[0]["msg"] == "slow" and lines[0]["source"] == "a" and lines[0]["level"] == "warning"
    log.setup()


def test_each_page_function_runs_once(spark, tmp_path):
    spark.createDataFrame([(1, "https://s.com/", listing(1))], "page_no int, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    for make in (analyze.blocks, analyze.fields, analyze.links, analyze.sections, analyze.page_types):
        plan = make(pages)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, (make.__name__, plan)
    assert analyze.blocks(pages).count() >= 1
