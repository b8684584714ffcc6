"""Queries of scalar functions over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import mining, names, text
from sluice.functions.arrow import per_row
from sluice.functions.urls import normalize
from sluice.plans.columns import apply, resolve_url
from sluice.plans.config import Transform
from sluice.plans.queries import query, table


def _chain(c, *steps: dict):
    for step in steps:
        c = apply(Transform(**step), c, F.lit("https://e.org/"), None)
    return c


@query("""SELECT p_partkey, lower(p_name) AS lowered, p_name || ' ' || p_type AS stripped, nullif(regexp_extract(p_type, '^([A-Z]+) ([A-Z]+)', 2), '') AS second, CASE WHEN p_size % 2 = 0 THEN NULL ELSE '!' END AS mark,
    regexp_replace(p_name, '([aeiou])', '\\1$', 'g') AS replaced, 'part: ' || p_name AS prefixed FROM part""")
def fn_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    rows = table(spark, sf_dir, "part").withColumns({"html": F.concat(F.lit(" <b class='x'>"), name, F.lit("</b> <i>"), "p_type", F.lit("</i>\t")), "said": F.concat(name, F.when(F.col("p_size") % 2 == 0, "").otherwise("!"))})
    return rows.select(
        "p_partkey", _chain(F.concat(F.lit("  "), name), {"op": "trim"}, {"op": "lowercase"}).alias("lowered"), _chain(F.col("html"), {"op": "stripHtml"}, {"op": "collapseWhitespace"}).alias("stripped"),
        _chain(F.col("p_type"), {"op": "regex", "pattern": "^([A-Z]+) ([A-Z]+)", "group": 2}).alias("second"), _chain(F.col("said"), {"op": "regex", "pattern": "[a-z](!)?$", "group": 1}).alias("mark"),
        _chain(name, {"op": "replace", "search": "([aeiou])", "replacement": "$1$$"}).alias("replaced"), _chain(name, {"op": "prefix", "value": "part: "}).alias("prefixed"),
    )


@query("""SELECT l_orderkey, l_linenumber, (l_orderkey * 10000000) || '.5' AS large, '0.' || rtrim(lpad((l_quantity::BIGINT)::VARCHAR, 5, '0'), '0') AS small, l_orderkey::VARCHAR AS whole,
    rtrim(rtrim((l_quantity::BIGINT * 2 + 1) / 2 || '', '0'), '.') AS half FROM lineitem""")
def fn_js_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    double = lambda c: text.js_text(c.cast("double"), "double")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", double(F.col("l_orderkey") * 10_000_000 + F.lit(0.5)).alias("large"), double(F.col("l_quantity").cast("bigint") / F.lit(100_000)).alias("small"), double(F.col("l_orderkey")).alias("whole"),
        double(F.col("l_quantity").cast("bigint") + F.lit(0.5)).alias("half"),
    )


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'https://e.org/a/x' || p_partkey WHEN 1 THEN 'https://e.org/a/b/c?q=' || p_partkey WHEN 2 THEN NULL WHEN 3 THEN 'https://cdn.org/' || p_partkey ELSE 'https://e.org/p%20q/' || p_partkey END AS resolved,
    'https://e.org' || CASE p_size % 3 WHEN 0 THEN '/d' || p_partkey WHEN 1 THEN '/d' || p_partkey ELSE '/d/e' || p_partkey || '?x=1' END AS normal FROM part""")
def fn_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    link = F.when(size % 5 == 0, F.concat(F.lit(" ../x"), key)).when(size % 5 == 1, F.concat(F.lit("?q="), key)).when(size % 5 == 2, "javascript:void(0)").when(size % 5 == 3, F.concat(F.lit("//cdn.org/"), key)).otherwise(F.concat(F.lit("/p q/./"), key))
    raw = F.when(size % 3 == 0, F.concat(F.lit("/d"), key, F.lit("/index.html"))).when(size % 3 == 1, F.concat(F.lit("/d"), key, F.lit("/#top"))).otherwise(F.concat(F.lit("/d/e"), key, F.lit("?x=1#y")))
    rows = table(spark, sf_dir, "part").withColumns({"link": link, "raw": raw, "base": F.lit("https://e.org/a/b/c")})
    return rows.select("p_partkey", resolve_url(F.col("link"), F.col("base")).alias("resolved"), per_row(normalize, "string")(F.col("raw"), F.col("base")).alias("normal"))


@query("""SELECT p_partkey, floor(p_retailprice / 7 * 100 + 0.5) / 100 AS rounded, greatest(0, least(1, p_size / 25 - 0.5)) AS clamped, p_size % 4 <> 0 AS useful, p_size % 3 = 2 AS meaningful FROM part""")
def fn_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    url = F.when(size % 8 == 0, F.concat(F.lit("https://e.org/i/"), key, F.lit(".PNG"))).when(size % 8 == 4, F.concat(F.lit("https://e.org/login?next="), key)).otherwise(F.concat(F.lit("https://e.org/part/"), key))
    name = F.when(size % 3 == 0, F.concat(F.lit("col-"), key)).when(size % 3 == 1, F.concat(F.lit("css-abc"), key, F.lit("xyz"))).otherwise(F.concat(F.lit("product_"), key))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.round2(F.col("p_retailprice") / 7).alias("rounded"), text.clamp(size / F.lit(25) - F.lit(0.5), 0.0, 1.0).alias("clamped"), per_row(mining.useful, "boolean")(url).alias("useful"),
        per_row(names.meaningful, "boolean")(name).alias("meaningful"),
    )


@query("SELECT count(*) AS n, count(*) AS n_ids, 12 AS shortest, 12 AS longest, true AS hex FROM nation")
def fn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(text.new_id().alias("id"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.min(F.length("id")).alias("shortest"), F.max(F.length("id")).alias("longest"), F.bool_and(F.col("id").rlike("^[0-9a-f]+$")).alias("hex"))


@query("""SELECT o_orderkey, strftime(CASE o_orderkey % 8 WHEN 0 THEN date_trunc('day', o_orderdate) + INTERVAL 13 HOUR + INTERVAL 5 MINUTE WHEN 1 THEN date_trunc('year', o_orderdate) WHEN 2 THEN date_trunc('month', o_orderdate) WHEN 3 THEN date_trunc('month', o_orderdate)
    WHEN 4 THEN NULL ELSE date_trunc('day', o_orderdate) END, '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM orders""")
def fn_parse_other_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 8
    forms = {0: "yyyy/M/d '1:05 PM'", 1: "yyyy", 2: "yyyy-MM", 3: "MMM yyyy", 5: "d-MMM-yyyy", 6: "M-d-yyyy", 7: "MMM-dd-yyyy"}
    said = F.when(kind == 4, "31-Feb-1995")
    for k, form in forms.items():
        said = said.when(kind == k, F.date_format("o_orderdate", form))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_date(said).alias("iso"))
