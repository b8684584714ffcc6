from datetime import datetime

from pyspark.sql import functions as F

from sluice.functions import text
from sluice.operators import diff, extract, paginate
from sluice.plans.config import ConfigError, Pagination, config_of
from tests.test_dom import LISTING

CONFIG = {
    "name": "shop", "url": "https://s.com/", "listSelector": "div.product-card",
    "fields": [
        {"name": "title", "selector": "h4", "fallbackSelectors": ["h3"], "required": True}, {"name": "url", "selector": "a", "attribute": "href", "type": "url", "required": True},
        {"name": "price", "selector": ".price", "type": "price"}, {"name": "number", "selector": "h3", "transform": [{"type": "regex", "pattern": "\\d+"}, {"type": "parseNumber"}]}, {"name": "none", "selector": ".none"},
    ],
}
def now():
    return F.lit(datetime(2024, 3, 20, 12)).cast("timestamp")



def one(spark, values, function):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(function(F.col("v")).alias("r")).collect()
    return [r["r"] for r in rows]


def test_numbers(spark):
    cases = {"42": 42.0, "19.99": 19.99, "1,234.56": 1234.56, "1.234,56": 1234.56, "1.234.567,89": 1234567.89, "$19.99": 19.99, "hello": None, "": None, "1.234": 1234.0, "19,99": 1999.0, "1.2.3": 1.2, "10-20": 10.0, "-5": -5.0, "-": None}
    assert one(spark, list(cases), text.parse_number) == list(cases.values())


def test_prices_and_booleans(spark):
    cases = {"$29.99": (29.99, "$"), "€49.00": (49.0, "€"), "29.99": (29.99, None), "free": None, "1,000 USD": (1000.0, None), "usd 5": (5.0, "usd")}
    assert [tuple(r) if r else None for r in one(spark, list(cases), text.parse_price)] == list(cases.values())
    assert one(spark, ["Yes", "In Stock", "no", "out of stock"], text.parse_boolean) == [True, True, False, False]


def test_dates(spark):
    cases = {
        "2024-03-15T10:00:00Z": "2024-03-15T00:00:00.000Z", "03/15/2024": "2024-03-15T00:00:00.000Z", "March 15, 2024": "2024-03-15T00:00:00.000Z", "15 March 2024": "2024-03-15T00:00:00.000Z",
        "2 days ago": "2024-03-18T12:00:00.000Z", "hello world": None, "15/03/2024": None,
    }
    assert one(spark, list(cases), lambda c: text.parse_date(c, now())) == list(cases.values())


def test_other_dates(spark):
    cases = {
        "2024": "2024-01-01T00:00:00.000Z", "2024-03": "2024-03-01T00:00:00.000Z", " 2024/3/15 ": "2024-03-15T00:00:00.000Z", "2024/03/15 10:30": "2024-03-15T10:30:00.000Z", "3-15-2024, 1:05:09 PM": "2024-03-15T13:05:09.000Z",
        "3/15/24": "2024-03-15T00:00:00.000Z", "3/15/70 12:00 am": "1970-03-15T00:00:00.000Z", "15-Mar-2024": "2024-03-15T00:00:00.000Z", "march-15-2024 23:59:59 GMT": "2024-03-15T23:59:59.000Z", "Sept 2024": "2024-09-01T00:00:00.000Z",
        "2024 Mar 15": "2024-03-15T00:00:00.000Z", "31-Feb-2024": None, "15-Foo-2024": None, "2024/13/01": None, "2024/03/15 25:00": None, "2024/03/15 13:00 pm": None, "12345": None, "": None,
    }
    assert one(spark, list(cases), lambda c: text.parse_date(c, now())) == list(cases.values())


def test_text(spark):
    assert one(spark, [" \t a  b\n"], text.trim) == ["a  b"]
    assert one(spark, [" a  b\n\tc "], text.collapse_whitespace) == ["a b c"]
    assert one(spark, ["<b>x</b> "], text.strip_html) == ["x"]
    assert one(spark, ["ab1"], lambda c: text.replace(c, "([a-z])", "$1$$$&")) == ["a$ab$b1"]
    assert one(spark, ["hello world"], lambda c: text.truncate(c, 8)) == ["hello..."]
    assert one(spark, ["A"], lambda c: text.record_id([c, F.lit("/a")])) == ["4b36882561175abb"]


def test_records(spark):
    pages = spark.createDataFrame([("https://s.com/", LISTING, 0), ("https://s.com/x", None, 1), ("https://s.com/y", "", 2)], "url string, html string, page_no int")
    config = config_of(CONFIG)
    rows = extract.extract(pages, config, now=now()).orderBy("item_idx").collect()
    assert len(rows) == 5 and rows[0]["title"] == "Product number 1" and rows[0]["url"] == "https://s.com/products/item-1"
    assert tuple(rows[1]["price"]) == (29.99, "$") and rows[2]["number"] == 3.0 and rows[0]["none"] is None
    assert abs(rows[0]["_confidence"] - 0.9) < 1e-9  # an empty optional field and a fallback
    health = extract.health(extract.records(pages, config, now()), config).first()
    # Price values are objects to the uniformity rule, all alike.
    assert [r.split('"')[1] for r in health["reasons"]] == ["price"] and health["required_field_coverage"] == {"title": 1.0, "url": 1.0} and abs(health["overall_confidence"] - 0.63) < 1e-9
    assert extract.health(extract.records(pages.limit(0), config, now()), config).first()["reasons"][0].startswith("Only 0 items")


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "https://s.com/", LISTING)], "page_no int, url string, html string").write.parquet(str(tmp_path / "p"))
    found = extract.raw_records(spark.read.parquet(str(tmp_path / "p")), config_of(CONFIG)).where("page_no < 10")
    assert "LessThan(page_no,10)" in found._jdf.queryExecution().toString()


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([("A", "/a", 0, 1), ("A", "/a", 0, 0), ("B", "/b", 1, 0)], "title string, url string, page_no int, item_idx int")
    assert sorted((r["title"], r["item_idx"]) for r in extract.deduplicate(rows, ["title", "url"], ["page_no", "item_idx"]).collect()) == [("A", 0), ("B", 0)]
    assert extract.deduplicate(rows, [], ["page_no", "item_idx"]).count() == 2


def test_diff(spark):
    schema = "_id string, title string, price string"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    before = make(("1", "A", "$10"), ("2", "B", "$20"))
    after = make(("1", "A", "$15"), ("3", "C", None))
    found = {r["record_id"]: r for r in diff.diff(before, after).collect()}
    assert {k: r["change_type"] for k, r in found.items()} == {"1": "changed", "2": "removed", "3": "added"}
    assert found["1"]["changed_fields"] == ["price"] and found["1"]["before"]["price"] == "$10" and found["1"]["after"]["price"] == "$15"
    assert diff.counts(diff.diff(before, after)).first()["summary"] == "1 added, 1 changed, 1 removed"
    assert diff.counts(diff.diff(before, before)).first()["summary"] == "No changes detected"


def test_pagination(spark):
    pages = spark.createDataFrame([(f"https://s.com/?page={k}", f"<a rel=next href='/?page={k + 1}'>n</a>") for k in range(1, 5)], "url string, html string")
    next_link = Pagination("next-link", next_selector="a[rel=next]", max_pages=3)
    assert [r["url"][-1] for r in paginate.chain(pages, "https://s.com/?page=1", next_link).orderBy("page_no").collect()] == ["1", "2", "3"]
    assert paginate.next_url("", Pagination("page-param", param="page"), "https://s.com/?page=1", 1) == "https://s.com/?page=2"
    assert paginate.next_url("", Pagination("offset-param", param="o"), "https://s.com/", 2) == "https://s.com/?o=40"
    assert paginate.chain(pages, "https://s.com/?page=1", None).count() == 1


def test_config_errors():
    for change in ({"listSelector": ""}, {"fields": []}, {"url": "nope"}, {"fields": [{"name": "a", "selector": "b", "type": "c"}]}):
        try:
            config_of(CONFIG | change)
            raise AssertionError(change)
        except ConfigError:
            pass
    assert config_of(config_of(CONFIG).to_json()) == config_of(CONFIG)


def test_numbers_as_scripts_print_them(spark):
    values = {0.0: "0", -0.5: "-0.5", 12.0: "12", 12345678.5: "12345678.5", -12345678.25: "-12345678.25", 1e7: "10000000", 1.5e20: "150000000000000000000", 1e21: "1e+21", 1e22: "1e+22", 0.00012: "0.00012", 1e-6: "0.000001", 1.5e-7: "1.5e-7", 123.456: "123.456"}
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(text.js_text(F.col("v"), "double").alias("r")).collect()
    assert [r["r"] for r in rows] == list(values.values())
    assert spark.createDataFrame([(None,)], "v double").select(text.js_text(F.col("v"), "double").alias("r")).first()["r"] == ""


def test_groups_of_a_pattern(spark):
    pattern = r"(\d+)(px)?(em)*"
    assert one(spark, ["a12px", "12", "px", None, "3em"], lambda c: text.regex(c, pattern, 2)) == ["px", None, None, None, None]
    assert one(spark, ["a12px", "none"], lambda c: text.regex(c, pattern)) == ["12px", None]
    assert one(spark, ["x=", "x", "x=1"], lambda c: text.regex(c, "x(?:=(.*))?", 1)) == ["", None, "1"]


def test_content_hash(spark):
    rows = [("a", 1, 0), ("b", 2, 1), ("b", 2, 2)]
    make = lambda rows, n: spark.createDataFrame(rows, "title string, n int, item_idx int").repartition(n)
    digest = lambda df: extract.content_hash(df, ["item_idx"]).first()["content_hash"]
    assert digest(make(rows, 1)) == digest(make(rows[::-1], 3)) != digest(make([("b", 1, 0), *rows[1:]], 1))
    assert digest(make(rows, 1)) != digest(make([("b", 2, 0), ("a", 1, 1), rows[2]], 1)) and len(digest(make(rows, 1).limit(0))) == 64
