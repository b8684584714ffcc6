from datetime import datetime

from pyspark.sql import functions as F

from sluice.operators import analyze, crawl
from sluice.plans import run as runs
from sluice.plans.schedule import Cron, Lock, valid
from sluice.sources import catalog, export, robots, sitemap, web
from sluice.streaming import watch
from tests.test_dom import LISTING
from tests.test_extract import CONFIG


def test_run_and_diff(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "c"))
    source = c.add_source(CONFIG)
    pages = spark.createDataFrame([("https://s.com/", LISTING)], "url string, html string")
    first = runs.run(c, source, pages)
    assert first.errors == () and c.latest("runs", source)["status"] == "completed" and c.get("diffs", first.diff_id)["summary"] == "5 added"
    second = runs.run(c, source, pages.withColumn("html", F.replace("html", F.lit("$29.99"), F.lit("$1.00"))))
    assert c.get("diffs", second.diff_id)["summary"] == "1 changed"
    assert c.page(source, limit=2, offset=1).count() == 2 and c.report().count() == 1
    assert runs.run(c, source, pages, robots_txt="User-agent: *\nDisallow: /").errors and c.latest("runs", source)["error_class"] == "RobotsBlockedError"
    c.set_schedule(source, "0 9 * * *")
    assert len(runs.run_due(c, datetime(2024, 1, 1, 9), lambda config: pages)) == 1
    assert runs.run(c, source, pages, dry=True).records.count() == 5
    records = c.records(source, first.snapshot_id)
    assert export.csv_text(records.orderBy("item_idx")).splitlines()[0] == "title,url,price,number,none,page_no,item_idx"
    assert '"_id"' in export.json_text(records) and export.csv_text(records.limit(0)) == ""
    c.delete_source(source)
    assert c.sources().count() == 0 and c.table("runs").count() == 0 and not (tmp_path / "c" / "records" / f"source_id={source}").exists()
    c.compact("runs")
    assert c.table("runs").count() == 0


def test_robots(spark):
    txt = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /a/b\nDisallow: /a*\n"
    assert [robots.allowed(txt, f"https://e.com{p}") for p in ("/", "/a/b/c", "/a/x", "/ab")] == [True, True, False, False]
    assert not robots.allowed(txt, "https://e.com/", "other") and robots.allowed(None, "https://e.com/")
    pages = spark.createDataFrame([("https://e.com/a/x",), ("https://f.com/a",)], "url string")
    rules = spark.createDataFrame([("https://e.com", txt)], "origin string, robots_txt string")
    assert sorted(r["robots_allowed"] for r in robots.with_robots(pages, rules).collect()) == [False, True]


def test_analysis_and_crawl(spark):
    nav = '<nav><a href="/list">List</a><a href="/about/">About</a><a href="/x.pdf">P</a><a href="https://o.com/">o</a></nav>'
    pages = spark.createDataFrame([("https://s.com/", nav), ("https://s.com/list", LISTING), ("https://s.com/about", "<p>x</p>")], "url string, html string")
    maps = spark.createDataFrame([("https://s.com", "<urlset xmlns='u'><url><loc> https://s.com/more </loc></url></urlset>")], "root string, xml string")
    front = crawl.frontier("https://s.com/", pages, sitemap.sitemap_urls(maps))
    assert [(r["url"], r["source"]) for r in front.collect()] == [("https://s.com/", "root"), ("https://s.com/list", "nav"), ("https://s.com/about", "nav"), ("https://s.com/more", "sitemap")]
    found = crawl.crawl("https://s.com/", pages).collect()
    assert found[0]["url"] == "https://s.com/list" and found[0]["has_data"] and found[0]["items"] == 5 and found[-1]["url"] == "https://s.com/"
    assert analyze.analyze(pages).count() == 3
    assert analyze.blocks(pages).count() == 1 and analyze.fields(pages).where("url LIKE '%list'").count() >= 5
    need = {r["url"]: r for r in analyze.needs_rendering(pages).collect()}
    assert need["https://s.com/"]["render"] and need["https://s.com/"]["score"] == 0.0


def test_sections(spark):
    links = "".join(f'<a href="/shop/{n}">{n}</a>' for n in ("shoes", "hats", "bags"))
    pages = spark.createDataFrame([("https://s.com/shop", f"<nav>{links}<a href='/shop'>self</a></nav>"), ("https://s.com/none", "<p>x</p>")], "url string, html string")
    rows = analyze.sections(pages).collect()
    assert len(rows) == 1 and rows[0]["strategy"] == "child-path" and rows[0]["score"] == 24.0 and [s["label"] for s in rows[0]["sections"]] == ["shoes", "hats", "bags"]


def test_cron_and_lock(tmp_path):
    assert Cron("*/15 9-17 * * mon-fri").matches(datetime(2024, 3, 18, 9, 45)) and not Cron("0 9 * * 1").matches(datetime(2024, 3, 19, 9))
    assert Cron("daily").after(datetime(2024, 1, 1, 9)) == datetime(2024, 1, 2, 9) and not valid("61 * * * *") and valid("weekly")
    lock, other = Lock(str(tmp_path / "l")), Lock(str(tmp_path / "l"))
    assert lock.acquire() and not other.acquire()
    lock.release()
    assert other.acquire()
    open(tmp_path / "l", "w").write("999999999")
    assert lock.acquire()


def test_web_parts():
    waits: list[float] = []
    attempts = iter([1, 1, 0])

    def act():
        if next(attempts):
            raise web.NetworkError("no")
        return "ok"

    assert web.retried(act, 3, waits.append) == "ok" and len(waits) == 2 and 0.5 <= waits[0] <= 1.0 <= waits[1] <= 2.0
    clock = iter([0.0, 0.0, 0.4, 1.0])
    slept: list[float] = []
    limiter = web.RateLimiter(1000, lambda: next(clock), slept.append)
    limiter.wait("https://e.com/a")
    limiter.wait("https://e.com/b")
    assert abs(slept[0] - 0.6) < 1e-9 and web.settled([100, 600, 610, 605], 500) and not web.settled([600, 900, 610], 500) and not web.settled([600, 600, 600], 500, 300)


def test_stream(spark, tmp_path):
    from sluice.plans.config import config_of

    source = str(tmp_path / "in")
    pages = lambda html: spark.createDataFrame([("https://s.com/", html, 0)], "url string, html string, page_no int")
    for html in (LISTING, LISTING.replace("$29.99", "$1.00")):
        pages(html).write.mode("append").parquet(source)
        stream = spark.readStream.schema("url string, html string, page_no int").parquet(source)
        watch.watch(stream, config_of(CONFIG), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "out" / "changes"))
    assert {(r["batch"], r["change_type"]): r["count"] for r in changes.groupBy("batch", "change_type").count().collect()} == {(0, "added"): 5, (1, "changed"): 1}
    assert spark.read.parquet(str(tmp_path / "out" / "state-1")).count() == 5


def test_stateful_changes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, price in enumerate(("1", "1", "2")):
        spark.createDataFrame([("a", datetime(2024, 1, 1 + k), price)], "_id string, _extractedAt timestamp, price string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("_id string, _extractedAt timestamp, price string").parquet(source)
        watch.field_changes(stream, "price").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["before"], r["after"]) for r in spark.read.parquet(out).collect() if r["before"]) == [("1", "2")]
