"""Queries over pages made of the driver's tables, one list page a nation and one page a customer, and their SQL.

The pages hold what the stored ones lack: cards, pagination, JSON-LD, OpenGraph, scripts. What the engine finds on
them must be what the tables say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import mining
from sluice.functions.arrow import dealt, once, per_row
from sluice.functions.dom import first, parse_cached
from sluice.operators import analyze, crawl, extract, paginate
from sluice.plans import run as runs
from sluice.plans.config import Pagination, config_of
from sluice.plans.queries import NOW, query, table
from sluice.sources.catalog import Catalog
from sluice.sources.session import new_path

SITE = "https://shop.org"
CONFIG = {
    "name": "customers", "url": f"{SITE}/nation/0", "listSelector": "div.customer-card", "pagination": {"strategy": "next-link", "nextSelector": "a[rel=next]", "maxPages": 10},
    "fields": [
        {"name": "title", "selector": "h4", "fallbackSelectors": ["h3"], "required": True}, {"name": "url", "selector": "h3 a", "attribute": "href", "type": "url"}, {"name": "image", "selector": "img", "attribute": "src", "type": "image"},
        {"name": "price", "selector": ".price", "type": "price"}, {"name": "day", "selector": "time", "type": "date"}, {"name": "stock", "selector": ".stock", "type": "boolean"}, {"name": "pieces", "selector": ".qty", "type": "number"},
        {"name": "segment", "selector": ".desc", "transform": [{"type": "regex", "pattern": "segment ([A-Z]+)", "group": 1}, {"type": "lowercase"}]},
    ],
}
_CENTS = "(abs(round(c_acctbal * 100)))::BIGINT"


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def shop(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """n_nationkey, n_name, url, html of the list pages."""
    key, c = F.col("c_custkey"), F.col
    cents = F.abs(F.round(c("c_acctbal") * 100)).cast("bigint") + (F.when(key % 7 == 0, 1).otherwise(0) if changed else 0)
    card = _text(
        '<div class="customer-card"><h3><a href="/customer/', key, '">', c("c_name"), '</a></h3><img src="/img/', key, '.png"><span class="price">$', cents, ".25</span><time>2024-03-", F.lpad((key % 28 + 1).cast("string"), 2, "0"),
        '</time><em class="stock">', F.when(key % 2 == 0, "In Stock").otherwise("sold out"), '</em><b class="qty">', key % 50, ' pcs</b><p class="desc">A customer of the segment ', c("c_mktsegment"), " among all those of the shop</p></div>",
    )
    customer = table(spark, sf_dir, "customer")
    customer = customer.where(key % 11 != 0) if changed else customer
    nation = table(spark, sf_dir, "nation")
    made = customer.select(c("c_nationkey").alias("k"), F.struct(key, card.alias("card")).alias("x"))
    # Nations without customers have an empty card each, which no list collects; so the few nations are what is broadcast,
    # and the pages stay where they were put together, spread over all cores: a page grows with the customers.
    made = made.unionByName(nation.select(c("n_nationkey").alias("k"), F.lit(None).cast(made.schema["x"].dataType).alias("x")))
    cards = dealt(made, "k").groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["card"]), "").alias("cards"))
    regions = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r"))
    tabs = regions.select(F.array_join(F.transform("r", lambda r: F.concat(F.lit('<li><a href="/region/'), r["r_regionkey"].cast("string"), F.lit('">'), r["r_name"], F.lit("</a></li>"))), "").alias("tabs"))
    rows = cards.join(F.broadcast(nation), c("n_nationkey") == c("k")).crossJoin(F.broadcast(tabs))  # one row
    n = c("n_nationkey")
    html = _text(
        "<html><head><title>", c("n_name"), ' customers</title><meta property="og:title" content="', c("n_name"), '"><meta name="twitter:card" content="summary"><script type="application/ld+json">{"@type":"ItemList","name":"', c("n_name"),
        '","offers":{"price":"code-', n, '"}}</script></head><body><nav><ul class="tabs">', c("tabs"), '</ul></nav><main><div class="customers">', c("cards"), '</div></main><ul class="pager"><li><a href="/nation/', n,
        '?page=1">1</a><a href="/nation/', n, '?page=2">2</a><a rel="next" href="/nation/', n + 1, '">next</a></li></ul><footer><a href="/about">About us</a></footer></body></html>',
    )
    return rows.select("n_nationkey", "n_name", _text(f"{SITE}/nation/", n).alias("url"), html.alias("html"))


_COUNTS = "SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL"
_URL = "'https://shop.org/nation/' || n_nationkey AS url"


@query(f"""SELECT {_URL}, 1 AS rank, 'div.customers > div.customer-card' AS selector, 'div.customers' AS parent_selector, n::INT AS count, 1.0::DOUBLE AS confidence FROM ({_COUNTS}) WHERE n >= 3
    UNION ALL SELECT {_URL}, CASE WHEN n >= 3 THEN 2 ELSE 1 END, 'ul.tabs > li', 'ul.tabs', 5, 0.65 FROM ({_COUNTS})""")
def shop_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.blocks(shop(spark, sf_dir)).select("url", "rank", "selector", "parent_selector", "count", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH f(name, rank, selector, inferred_type, confidence) AS (VALUES ('title', 1, 'div.customer-card > h3', 'string', 1.0::DOUBLE), ('url', 2, 'a', 'url', 1.0), ('image', 3, 'div.customer-card > img', 'image', 1.0),
    ('price', 4, 'span.price', 'price', 0.9), ('date', 5, 'div.customer-card > time', 'date', 0.9), ('description', 6, 'p.desc', 'string', 0.9)),
    s AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    v AS (SELECT c_nationkey AS n_nationkey, 'title' AS name, c_name AS v, nth FROM s WHERE n >= 3 AND nth <= 5 UNION ALL SELECT c_nationkey, 'url', '/customer/' || c_custkey, nth FROM s WHERE n >= 3 AND nth <= 5
    UNION ALL SELECT c_nationkey, 'image', '/img/' || c_custkey || '.png', nth FROM s WHERE n >= 3 AND nth <= 5)
    SELECT {_URL}, f.*, (SELECT string_agg(v, '|' ORDER BY nth) FROM v WHERE v.name = f.name AND v.n_nationkey = c.n_nationkey) AS samples FROM ({_COUNTS}) c, f WHERE n >= 3""")
def shop_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze.fields(shop(spark, sf_dir)).where("selector LIKE 'div.customer%' OR selector IN ('a', 'span.price', 'p.desc')")
    samples = F.when(F.col("name").isin("title", "url", "image"), F.array_join("sample_values", "|"))
    return found.select("url", "name", "rank", "selector", "inferred_type", F.round("confidence", 6).alias("confidence"), samples.alias("samples"))


@query(f"SELECT n_nationkey, 'good' AS quality FROM ({_COUNTS}) WHERE n >= 3")
def shop_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(shop(spark, sf_dir), analyze.fields_column(F.col("html"), F.col("url")), "f", "n_nationkey")
    return rows.select("n_nationkey", analyze.field_quality(F.col("f")).alias("quality")).where("quality = 'good'")


@query(f"""SELECT n_nationkey, 'list' AS page_type, round(least(1, CASE WHEN greatest(n, 5) >= 5 AND (n >= 5 OR n < 3) THEN 0.4 ELSE 0 END + 0.55), 6) AS confidence FROM ({_COUNTS})""")
def shop_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.page_types(shop(spark, sf_dir)).select("n_nationkey", "page_type", F.round("type_confidence", 6).alias("confidence"))


@query(f"""SELECT {_URL}, 1 AS rank, 'next-link' AS strategy, 'a[rel="next"]' AS selector, '/nation/' || (n_nationkey + 1) AS url_pattern, 0.95::DOUBLE AS confidence FROM nation
    UNION ALL SELECT {_URL}, 2, 'page-param', 'ul.pager a', 'page={{{{page}}}}', 0.85 FROM nation""")
def shop_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.hints(shop(spark, sf_dir))


@query(f"""SELECT 'https://shop.org/nation/' || c_nationkey AS url, 'h3 > a' AS selector, 0.95::DOUBLE AS confidence, string_agg('https://shop.org/customer/' || c_custkey, '|' ORDER BY c_custkey) AS samples
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE nth <= 5 AND n >= 3 GROUP BY c_nationkey""")
def shop_detail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze.detail_links(shop(spark, sf_dir)).where("selector LIKE 'h3%'")
    return found.select("url", "selector", F.round("confidence", 6).alias("confidence"), F.array_join("sample_urls", "|").alias("samples"))


@query("SELECT n_nationkey, n_name AS title, 'summary' AS card, 2 AS n, n_name || ' customers' AS page_title FROM nation")
def shop_open_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shop(spark, sf_dir).select("n_nationkey", analyze.head_column(F.col("html"), F.col("url")).alias("h")).select("n_nationkey", "h.*")
    return rows.select("n_nationkey", F.col("og")["title"].alias("title"), F.col("og")["card"].alias("card"), F.size("og").alias("n"), "page_title")


@query("SELECT n_nationkey, 'title' AS name, n_name AS value, 'string' AS type, 'ItemList.name' AS source FROM nation UNION ALL SELECT n_nationkey, 'price', 'code-' || n_nationkey, 'price', 'ItemList.offers.price' FROM nation")
def shop_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.listed(shop(spark, sf_dir), analyze.ld_column(F.col("html"), F.col("url")), "n_nationkey").select("n_nationkey", "name", "value", "type", "source")


@query(f"""SELECT 'https://shop.org/nation/' || c_nationkey AS page_url, 'https://shop.org/customer/' || c_custkey AS url, 'content' AS source, (5 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::INT AS ord FROM customer
    UNION ALL SELECT 'https://shop.org/nation/' || n_nationkey, 'https://shop.org/region/' || r_regionkey, 'nav', r_regionkey::INT FROM nation, region
    UNION ALL SELECT 'https://shop.org/nation/' || n_nationkey, 'https://shop.org/about', 'footer', 5 FROM nation""")
def shop_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.links(shop(spark, sf_dir)).select("page_url", "url", "source", "ord")


_TABS = "(SELECT string_agg(r_name, '|' ORDER BY r_regionkey) FROM region)"


@query(f"""SELECT {_URL}, 'nav-context' AS strategy, 15.0::DOUBLE AS score, {_TABS} AS labels FROM nation UNION ALL SELECT 'https://shop.org/region', 'child-path', 30.0, {_TABS}
    UNION ALL SELECT 'https://shop.org/list', 'query-param:r', 13.0, {_TABS} UNION ALL SELECT 'https://shop.org/', 'nav-context', 15.0, {_TABS}""")
def shop_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r"))

    def links(before: str, holder: str) -> Column:
        made = F.transform("r", lambda r: F.concat(F.lit(f'<a href="{before}'), r["r_regionkey"].cast("string"), F.lit('">'), r["r_name"], F.lit("</a>")))
        return F.concat(F.lit(f"<{holder}>"), F.array_join(made, ""), F.lit(f"</{holder}>"))

    pages = [("/region", links("/region/", "nav")), ("/list", links("/list?r=", "div")), ("/", links("/r", "nav"))]
    others = regions.select(F.explode(F.array(*(F.struct(F.lit(f"{SITE}{u}").alias("url"), h.alias("html")) for u, h in pages))).alias("p")).select("p.url", "p.html")
    found = analyze.sections(shop(spark, sf_dir).select("url", "html").unionByName(others))
    return found.select("url", "strategy", "score", F.array_join(F.transform("sections", lambda s: s["label"]), "|").alias("labels"))


_RECORDS = f"""SELECT c_custkey, c_nationkey, substr(sha256(c_name), 1, 16) AS _id, c_name AS title, 'https://shop.org/customer/' || c_custkey AS url, 'https://shop.org/img/' || c_custkey || '.png' AS image, ({_CENTS} || '.25')::DOUBLE AS amount,
    '$' AS currency, '2024-03-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00.000Z' AS day, c_custkey % 2 = 0 AS stock, (c_custkey % 50)::DOUBLE AS pieces, lower(c_mktsegment) AS segment, 0.95::DOUBLE AS confidence FROM customer"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("_id", "title", "url", "image", F.col("price.amount").alias("amount"), F.col("price.currency").alias("currency"), "day", "stock", "pieces", "segment", F.round("_confidence", 6).alias("confidence"))


@query(f"SELECT * EXCLUDE (c_custkey, c_nationkey) FROM ({_RECORDS})")
def shop_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(extract.extract(shop(spark, sf_dir).withColumn("page_no", F.col("n_nationkey")), config_of(CONFIG), now=F.expr(NOW)))


@query("SELECT c_nationkey AS page_no, c_name AS title, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS item_idx FROM customer WHERE c_nationkey < 10")
def shop_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = config_of(CONFIG)
    found = extract.extract(paginate.chain(shop(spark, sf_dir), config.url, config.pagination), config, now=F.expr(NOW))
    return found.select(F.col("page_no").cast("long").alias("page_no"), "title", F.col("item_idx").cast("long").alias("item_idx"))


@query("SELECT n_nationkey::BIGINT AS page_no, 'https://shop.org/list?page=' || (n_nationkey + 1) AS url FROM nation WHERE n_nationkey < 12")
def shop_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shop(spark, sf_dir).select(_text(f"{SITE}/list?page=", F.col("n_nationkey") + 1).alias("url"), "html")
    return paginate.chain(pages, f"{SITE}/list?page=1", Pagination("page-param", param="page", max_pages=12)).select(F.col("page_no").cast("long").alias("page_no"), "url")


@query("""SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Better ' || c_name ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS maker FROM customer""")
def shop_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = config_of(CONFIG | {"detailPage": {"fields": [{"name": "maker", "selector": "p.maker"}, {"name": "title", "selector": "h1"}]}})
    key = F.col("c_custkey")
    details = table(spark, sf_dir, "customer").where(key % 2 == 0).select(_text(f"{SITE}/customer/", key).alias("url"), _text("<h1>Better ", F.col("c_name"), '</h1><p class="maker"> ', F.col("c_mktsegment"), "</p>").alias("html"))
    found = extract.records(shop(spark, sf_dir).withColumn("page_no", F.col("n_nationkey")), config, F.expr(NOW))
    return extract.with_details(found, details, config).select("title", "maker")


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The list pages with a root that links to the first ten, and the places of its sitemap."""
    pages = shop(spark, sf_dir).select("url", "html")
    menu = table(spark, sf_dir, "nation").where("n_nationkey < 10").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    made = F.transform("n", lambda n: F.concat(F.lit('<li><a href="/nation/'), n["n_nationkey"].cast("string"), F.lit('">'), n["n_name"], F.lit("</a></li>")))
    root = menu.select(F.lit(f"{SITE}/").alias("url"), F.concat(F.lit('<title>Shop</title><nav><ul class="menu">'), F.array_join(made, ""), F.lit("</ul></nav>")).alias("html"))
    places = table(spark, sf_dir, "nation").select(_text(f"{SITE}/nation/", F.col("n_nationkey")).alias("url"), (F.col("n_nationkey") * 2).alias("ord"))
    return pages.unionByName(root), places


_VISITS = """SELECT 'https://shop.org/' AS url, 'root' AS source, 0 AS priority UNION ALL
    SELECT 'https://shop.org/nation/' || n_nationkey, CASE WHEN n_nationkey < 10 THEN 'nav' ELSE 'sitemap' END, CASE WHEN n_nationkey < 10 THEN 1 ELSE 2 END FROM nation"""


@query(f"SELECT * FROM ({_VISITS}) WHERE url = 'https://shop.org/' OR regexp_extract(url, '[0-9]+$')::INT < 19")
def shop_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.frontier(f"{SITE}/", *_site(spark, sf_dir)).select("url", "source", "priority")


_CRAWLED = f"""SELECT {_URL}, n_name || ' customers' AS title, 'list' AS page_type, true AS has_data, CASE WHEN n >= 3 THEN n ELSE 5 END::INT AS items, CASE WHEN n >= 3 THEN 1.0 ELSE 0.65 END::DOUBLE AS confidence,
    CASE WHEN n_nationkey < 10 THEN 'nav' ELSE 'sitemap' END AS source FROM ({_COUNTS}) UNION ALL SELECT 'https://shop.org/', 'Shop', 'list', true, 10, 0.7, 'root'"""


@query(_CRAWLED)
def shop_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl(f"{SITE}/", *_site(spark, sf_dir), most=40).withColumn("confidence", F.round("confidence", 6))


@query("SELECT 20::BIGINT AS pages, 20::BIGINT AS data_pages, 6::BIGINT AS skipped")
def shop_crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, places = _site(spark, sf_dir)
    return crawl.summary(crawl.crawl(f"{SITE}/", pages, places), pages.count()).select("pages", "data_pages", F.col("skipped").cast("long").alias("skipped"))


@query("""SELECT count(*) AS records_total, count(*) FILTER (c_custkey % 7 = 0) AS changed, (SELECT count(*) FROM customer WHERE c_nationkey < 10 AND c_custkey % 11 = 0) AS removed, 0::BIGINT AS added,
    concat_ws(', ', count(*) FILTER (c_custkey % 7 = 0) || ' changed', (SELECT count(*) FROM customer WHERE c_nationkey < 10 AND c_custkey % 11 = 0) || ' removed') AS summary, 'completed' AS status, 10::BIGINT AS pages
    FROM customer WHERE c_nationkey < 10 AND c_custkey % 11 <> 0""")
def shop_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Catalog(spark, new_path(spark, "shop"))
    source = found.add_source(CONFIG)
    runs.run(found, source, shop(spark, sf_dir))
    done = runs.run(found, source, shop(spark, sf_dir, changed=True))
    last = found.table("runs").where(F.col("id") == done.run_id).select("records_total", F.col("records_changed").alias("changed"), F.col("records_removed").alias("removed"), F.col("records_added").alias("added"), "status", F.col("pages").cast("long").alias("pages"), F.col("id").alias("run_id"))
    return last.join(found.table("diffs").select("run_id", "summary"), "run_id").drop("run_id")


_WAYS = (
    '<div id="root"></div><script src="a.js"></script><script src="b.js"></script><script src="c.js"></script><script src="d.js"></script>', '<p>x</p><script src="/_next/a.js"></script><script>var __NEXT_DATA__ = 1</script>',
    '<p data-v-1>x</p><noscript>Please enable JavaScript</noscript>', "<p>plain</p>",
)


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.8 ELSE 0 END::DOUBLE AS score, CASE n_nationkey % 4 WHEN 0 THEN 'empty-body-with-scripts,spa-marker:#root'
    WHEN 1 THEN '__NEXT_DATA__-hydration,js-bundle-chunks' WHEN 2 THEN 'vue-data-v,noscript-javascript-required' ELSE '' END AS reasons, false AS usable, true AS render FROM nation""")
def shop_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    html = F.element_at(F.array(*(F.lit(f"<html><body>{w}</body></html>") for w in _WAYS)), (k % 4 + 1).cast("int"))
    found = analyze.needs_rendering(table(spark, sf_dir, "nation").select("n_nationkey", F.lit(SITE).alias("url"), html.alias("html")))
    return found.select("n_nationkey", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"), "usable", "render")


def _shape(html: str) -> dict:
    card = first(parse_cached(html), "div.customer-card")
    return {"shape": mining.tag_shape(card), "depth": mining.depth_of(card), "print": mining.fingerprint(card)} if card else {"shape": None, "depth": None, "print": None}


@query(f"""SELECT n_nationkey, 'div>h3>a+img+span+time+em+b+p' AS shape, 2 AS depth, 'div>h3>a+img+span+time+em+b+p|7|1110' AS print FROM ({_COUNTS}) WHERE n > 0""")
def shop_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(shop(spark, sf_dir), per_row(_shape, "struct<shape: string, depth: int, print: string>")(F.col("html")), "s", "n_nationkey")
    return rows.select("n_nationkey", "s.*").where("shape IS NOT NULL")


@query("SELECT c_name AS title FROM customer WHERE c_nationkey = 0 ORDER BY c_custkey LIMIT 10")
def shop_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = config_of(CONFIG)
    first_page = shop(spark, sf_dir).where("n_nationkey = 0").withColumn("page_no", F.lit(0))
    return extract.preview(extract.records(first_page, config, F.expr(NOW))).select("title")
