"""Queries over small tables whose rows are odd, against what their SQL gives."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from sluice.functions import arrow, dom, mining, text
from sluice.plans import queries


def _pages(spark, folder, *rows):
    spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_links_of_pages_that_share_a_url(spark, tmp_path):
    page = "<html><body><nav><ul><li><a href=\"/{}\">x</a></li><li><a href=\"/b\">y</a></li></ul></nav></body></html>"
    found = queries.queries()["page_links"](spark, _pages(spark, tmp_path, ("https://s.org/1", page.format("a")), ("https://s.org/1", page.format("c")))).collect()
    assert sorted(r["url"] for r in found) == ["https://s.org/a", "https://s.org/b", "https://s.org/c"]


def test_headings_keep_references_that_are_cut(spark, tmp_path):
    said = ["a &lt;b&gt; &amp;&amp", "&amp;lt; &copy; &am", "&quot;x&quot;&"]
    found = queries.queries()["page_records"](spark, _pages(spark, tmp_path, *((f"https://s.org/{k}", f"<article><h1>{h}</h1><p>x</p></article>") for k, h in enumerate(said)))).orderBy("page_id").collect()
    assert [r["heading"] for r in found] == ["a <b> &&amp", "&lt; &copy; &am", '"x"&']


def _page(n):
    return '<div class="customers">' + "".join(f'<div class="card"><h3><a href="/c/{k}">Name {k}</a></h3><b class="qty">{k} pcs</b><p class="desc">What is said of it, at some length</p></div>' for k in range(n)) + "</div>"


def _peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_large_page_takes_little_more_than_its_text():
    html = _page(4000)
    assert _peak(lambda: mining.repeated_blocks(dom.parse(html))) < 5 * len(html)
    # Links and items are given one by one.
    page = dom.parse(f"<main>{html}</main>")
    assert _peak(lambda: sum(1 for _ in mining.crawl_links(page, "https://s.org/"))) < 2 * len(html)
    assert dom.parse_cached("x" * (dom.KEPT_PAGE + 1)) is not dom.parse_cached("x" * (dom.KEPT_PAGE + 1))


def test_results_of_a_page_become_arrow_piece_by_piece():
    kind = pa.list_(pa.struct([("url", pa.string()), ("og", pa.map_(pa.string(), pa.string()))]))
    got = list(arrow.made(iter([({"url": f"{k}", "og": {"a": "b"} if k else None} for k in range(3000)), None, []]), kind))
    assert sum(map(len, got)) == 3 and [None if x is None else len(x) for a in got for x in a.to_pylist()] == [3000, None, 0]
    assert got[0][0].as_py()[:2] == [{"url": "0", "og": None}, {"url": "1", "og": [("a", "b")]}]


def test_shop_pages_are_dealt_out_and_parsed_once(spark):
    for name in ("shop_field_quality", "shop_open_graph", "shop_shapes", "shop_json_ld"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "REPARTITION_BY_NUM" in plan, name


def test_numbers_as_scripts_print_them_take_few_patterns(spark):
    assert str(text.js_number(F.col("v"))).count("regexp") <= 2
    values = {98765432.1: "98765432.1", -1234567890.125: "-1234567890.125", 123456789012345680.0: "123456789012345680", 9.99e20: "999000000000000000000", 1.5e21: "1.5e+21", 0.00099: "0.00099", 1.2345678901234e-6: "0.0000012345678901234", -2e-9: "-2e-9", float("inf"): "Infinity"}
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(text.js_number(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in rows] == list(values.values())
