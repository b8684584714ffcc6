import json

from sluice import mcp
from sluice.sources import sql
from sluice.sources.catalog import Catalog
from tests.test_dom import LISTING
from tests.test_extract import CONFIG


def test_sql_functions(spark):
    sql.register(spark)
    spark.createDataFrame([("https://s.com/a/", LISTING), ("https://s.com/b", None)], "url string, html string").createOrReplaceTempView("pages_sql")
    row = spark.sql("""SELECT html_select(html, 'h3') AS a, size(html_select_all(html, 'span.price')) AS n, html_attr(html, 'h3 a', 'href') AS h, resolve_url('../x', url) AS r FROM pages_sql ORDER BY url""").collect()
    assert tuple(row[0]) == ("Product number 1", 5, "/products/item-1", "https://s.com/x") and tuple(row[1])[:3] == (None, 0, None)
    items = spark.sql("""SELECT i FROM pages_sql LATERAL VIEW explode(extract_items(html, 'div.product-card', '{"title": "h3", "link": "a@href"}')) t AS i""").collect()
    assert len(items) == 5 and items[1]["i"] == {"title": "Product number 2", "link": "/products/item-2"}


def test_tools(spark, tmp_path):
    pages = spark.createDataFrame([("https://s.com/", LISTING)], "url string, html string")
    tools = mcp.Tools(Catalog(spark, str(tmp_path)), lambda urls: pages)

    def call(name, **arguments):
        result = mcp.answer(tools, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})["result"]
        return result if result.get("isError") else json.loads(result["content"][0]["text"])

    assert len(mcp.answer(tools, {"id": 1, "method": "tools/list"})["result"]["tools"]) == 6 and mcp.answer(tools, {"method": "x"}) is None
    assert call("analyze_page", url="https://s.com/")[0]["analysis"]["page_type"] == "list"
    source = call("create_source", config=CONFIG)["source_id"]
    assert len(call("preview_extraction", source_id=source)["records"]) == 5
    assert call("run_extraction", source_id=source)["diff"]["summary"] == "5 added" and len(call("list_sources")) == 1
    assert call("create_source", config={"name": "x"})["isError"]
