"""Page analysis as DataFrame operators: one Arrow function a page, everything after it native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import mining
from sluice.functions.arrow import per_row, spread
from sluice.functions.dom import Node, parse_cached
from sluice.plans.config import DEFAULTS

BLOCK = "struct<selector: string, parent_selector: string, count: int, sample_html: string, confidence: double, fingerprint: string>"
FIELD = "struct<name: string, selector: string, fallback_selectors: array<string>, sample_values: array<string>, inferred_type: string, confidence: double, inference_source: string>"
HINT = "struct<strategy: string, selector: string, url_pattern: string, confidence: double>"
DETAIL = "struct<selector: string, sample_urls: array<string>, confidence: double>"
RENDERING = (
    "struct<body_length: int, html_length: int, scripts: int, root: string, vue: boolean, next_meta: boolean, next_data: boolean, nuxt: boolean, gatsby: boolean, chunks: boolean, noscript: boolean, empty: boolean, spa: boolean, low_text: boolean>"
)
ANALYSIS = (
    f"struct<title: string, page_type: string, type_confidence: double, blocks: array<{BLOCK}>, fields: array<{FIELD}>, og: map<string,string>, "
    f"pagination: array<{HINT}>, detail_links: array<{DETAIL}>, rendering: {RENDERING}>"
)
LINKS = "array<struct<url: string, source: string, ord: int>>"
SECTIONS = "array<struct<label: string, url: string, path: string, search: string, depth: int, in_nav: boolean, ord: int>>"


def _of_page(function: Callable[[str, str], object], schema: str) -> Callable[[Column, Column], Column]:
    return per_row(lambda html, url: function(html or "", url or ""), schema)


def _typed(html: str, url: str) -> dict:
    document = parse_cached(html)
    return mining.page_type(document, url, mining.repeated_blocks(document))


def _fields(html: str, _: str) -> list[dict]:
    document = parse_cached(html)
    found = mining.repeated_blocks(document)
    return mining.infer_fields(document, found[0]) if found else []


def _details(html: str, url: str) -> list[dict]:
    document = parse_cached(html)
    found = mining.repeated_blocks(document)
    return mining.detail_hints(document, found[0], url) if found else []


def _head(document: Node, url: str) -> dict:
    return {"page_title": mining.page_title(document, url), "og": mining.open_graph(document)}


def _ld(html: str, _: str) -> list[dict]:
    return [dict(zip(("name", "value", "type", "source"), x)) for x in mining.ld_fields(parse_cached(html))]


analysis = _of_page(mining.analyse, ANALYSIS)
#: Parts of the analysis by themselves, for queries that need no more.
blocks_column = _of_page(lambda h, _: mining.repeated_blocks(parse_cached(h)), f"array<{BLOCK}>")
fields_column = _of_page(_fields, f"array<{FIELD}>")
type_column = _of_page(_typed, "struct<page_type: string, type_confidence: double>")
details_column = _of_page(_details, f"array<{DETAIL}>")
pagination_column = _of_page(lambda h, u: mining.pagination_hints(parse_cached(h), u), f"array<{HINT}>")
rendering_column = _of_page(lambda h, _: mining.rendering_features(h, parse_cached(h)), RENDERING)
title_column = _of_page(lambda h, u: mining.page_title(parse_cached(h), u), "string")
open_graph_column = _of_page(lambda h, _: mining.open_graph(parse_cached(h)), "map<string,string>")
#: The title and what OpenGraph says, of one parse.
head_column = _of_page(lambda h, u: _head(parse_cached(h), u), "struct<page_title: string, og: map<string,string>>")
ld_column = _of_page(_ld, "array<struct<name: string, value: string, type: string, source: string>>")
links_column = _of_page(lambda h, u: mining.crawl_links(parse_cached(h), u), LINKS)
sections_column = _of_page(lambda h, u: mining.section_links(parse_cached(h), u), SECTIONS)


def analyze(pages: DataFrame) -> DataFrame:
    """pages' columns other than html, and analysis: title, type, blocks, fields, hints, rendering signals."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c != "html"]
    return spread(pages).select(*rest, analysis(F.col("html"), F.col("url")).alias("analysis"))


def listed(rows: DataFrame, array: Column, *keep: str) -> DataFrame:
    """One row an element, ranked from 1: the kept columns, rank, and the element's. The array is exploded with its
    empty ones: a plain explode would have Spark put a filter on its size below, which runs the function twice."""
    found = rows.select(*keep, F.posexplode_outer(array).alias("rank", "x")).where("rank IS NOT NULL")
    return found.select(*keep, (F.col("rank") + 1).alias("rank"), "x.*")


def blocks(pages: DataFrame) -> DataFrame:
    """Repeated blocks of pages, ranked: url, rank, and the block's columns."""
    return listed(spread(pages.select("url", "html")), blocks_column(F.col("html"), F.col("url")), "url")


def rank_blocks(found: DataFrame, most: int = DEFAULTS["max_repeated_blocks"]) -> DataFrame:
    """Blocks of each page by 10 * confidence + log2(count), at most ``most``."""
    from pyspark.sql import Window

    score = F.col("confidence") * 10 + F.log2("count")
    w = Window.partitionBy("url").orderBy(score.desc(), "selector")
    return found.where(F.col("confidence") >= DEFAULTS["block_confidence_threshold"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def fields(pages: DataFrame) -> DataFrame:
    """Proposed fields of pages' best blocks, ranked: url, rank, and the field's columns."""
    return listed(spread(pages.select("url", "html")), fields_column(F.col("html"), F.col("url")), "url")


def hints(pages: DataFrame) -> DataFrame:
    """Signs of further pages, ranked: url, rank, and the hint's columns."""
    return listed(spread(pages.select("url", "html")), pagination_column(F.col("html"), F.col("url")), "url")


def detail_links(pages: DataFrame) -> DataFrame:
    """Selectors of links to detail pages, ranked: url, rank, and the selector's columns."""
    return listed(spread(pages.select("url", "html")), details_column(F.col("html"), F.col("url")), "url")


def page_types(pages: DataFrame) -> DataFrame:
    """pages' columns other than html, page_type, type_confidence."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c != "html"]
    found = spread(pages).select(*rest, type_column(F.col("html"), F.col("url")).alias("_t"))
    return found.select(*rest, "_t.page_type", "_t.type_confidence")


def links(pages: DataFrame) -> DataFrame:
    """A crawler's links of pages: page_url, rank, url, source, ord."""
    return listed(spread(pages.select(F.col("url").alias("page_url"), "html")), links_column(F.col("html"), F.col("page_url")), "page_url")


def rendering_need(r: str = "rendering") -> tuple[Column, Column]:
    """Score from 0 to 1 and reasons, natively from the signals."""
    c = lambda name: F.col(f"{r}.{name}")
    total = F.lit(0.0)
    reasons = []
    for weight, name, why in mining.SIGNALS:
        total = total + F.when(c(name), weight).otherwise(0.0)
        reasons.append(F.when(c(name), F.concat(F.lit(why), c("root")) if name == "spa" else F.lit(why)))
    return F.least(total, F.lit(1.0)), F.array_compact(F.array(*reasons))


def needs_rendering(pages: DataFrame) -> DataFrame:
    """pages' columns other than html, score, reasons, usable (enough text), has_fields, render: what an automatic fetch decides."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c != "html"]
    made = spread(pages).select(*rest, rendering_column(F.col("html"), F.col("url")).alias("rendering"), fields_column(F.col("html"), F.col("url")).alias("_fields"))
    score, reasons = rendering_need()
    usable = F.col("rendering.body_length") >= DEFAULTS["min_body_text_length"]
    names = F.transform("_fields", lambda f: f["name"])
    has_fields = (F.size(names) >= 3) & F.exists(names, lambda n: ~n.isin("title", "url"))
    return made.select(*rest, score.alias("score"), reasons.alias("reasons"), usable.alias("usable"), has_fields.alias("has_fields"), ((score >= DEFAULTS["rendering_score_threshold"]) | ~usable | ~has_fields).alias("render"))


def field_quality(found: Column) -> Column:
    """none, poor, weak, fair or good, by how many fields there are and how sure they are."""
    n = F.size(found)
    sure = F.aggregate(found, F.lit(0.0), lambda a, f: a + f["confidence"]) / F.when(n > 0, n)
    return F.when(n == 0, "none").when(n < 2, "poor").when(n < 3, "weak").when(sure < 0.6, "fair").otherwise("good")


def link_sections(pages: DataFrame) -> DataFrame:
    """url, base (its path), base_depth, l: labelled links of every page, without links to the page itself."""
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    base = F.regexp_replace(path, "/$", "")
    base = F.when(base == "", "/").otherwise(base)
    rows = spread(pages.select("url", "html")).select("url", base.alias("base"), sections_column(F.col("html"), F.col("url")).alias("l"))
    depth = F.when(F.col("base") == "/", 0).otherwise(F.size(F.split("base", "/")) - 1)
    return rows.select("url", "base", depth.alias("base_depth"), F.filter("l", lambda x: (x["path"] != F.col("base")) | (x["search"] != "")).alias("l"))


def _pairs(links: Column) -> Column:
    return F.transform(links, lambda x: F.struct(x["label"].alias("label"), x["url"].alias("url")))


def _way(rank: int, strategy: Column, score: Column, links: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), F.lit(-rank).alias("way"), strategy.alias("strategy"), _pairs(links).alias("links"))


def sections(pages: DataFrame) -> DataFrame:
    """Per page: strategy, score, sections (label, url), has_sections: the best of four ways to see a page's sections.

    A page's links are one array, found in one parse; the ways are array functions over it, so nothing is shuffled.
    """
    rows = link_sections(pages)
    base, depth = F.col("base"), F.col("base_depth")
    nav_links = F.transform(
        F.filter("l", lambda x: x["in_nav"]),
        lambda x: F.struct(x["ord"].alias("ord"), x["label"].alias("label"), x["url"].alias("url"), F.coalesce(F.nullif(F.regexp_replace(x["path"], "/[^/]*$", ""), F.lit("")), F.lit("/")).alias("prefix")),
    )
    params = F.flatten(F.transform(
        F.filter("l", lambda x: (x["path"] == base) & (x["search"] != "")),
        lambda x: F.transform(F.split(F.substring(x["search"], 2, 1 << 20), "&"), lambda kv: F.struct(F.substring_index(kv, "=", 1).alias("k"), F.substring(kv, F.instr(kv, "=") + 1, F.length(kv)).alias("v"), x["ord"].alias("ord"), x["label"].alias("label"), x["url"].alias("url"))),
    ))
    rows = rows.select(
        "url", "base", F.filter("l", lambda x: (base != "/") & (x["depth"] == depth + 1) & x["path"].startswith(F.concat(base, F.lit("/")))).alias("below"), nav_links.alias("nav"), params.alias("params"),
        F.size(F.filter("l", lambda x: (x["path"] == base) & (x["search"] != ""))).alias("same"), F.filter("l", lambda x: (base == "/") & x["in_nav"] & (x["depth"] == 1)).alias("tops"),
    )
    keys = lambda array, name: F.array_distinct(F.transform(array, lambda x: x[name]))
    groups = F.transform(keys("nav", "prefix"), lambda p: F.struct(p.alias("prefix"), F.filter("nav", lambda x: x["prefix"] == p).alias("links")))
    by_key = F.transform(keys("params", "k"), lambda k: F.struct(k.alias("k"), F.filter("params", lambda x: x["k"] == k).alias("links")))
    segment = lambda x: F.split(x["path"], "/")[1]
    firsts = F.transform(F.array_distinct(F.transform("tops", segment)), lambda s: F.filter("tops", lambda x: segment(x) == s)[0])
    rows = rows.select("url", "base", "below", "same", groups.alias("groups"), by_key.alias("keys"), firsts.alias("tops"))

    most = F.array_max(F.transform("groups", lambda g: F.size(g["links"])))
    under = lambda g: (base != "/") & ((g["prefix"] == base) | g["prefix"].startswith(F.concat(base, F.lit("/"))))
    near = lambda g: under(g) & (F.size(g["links"]) >= most - 1)
    ranked = F.transform(
        F.filter("groups", lambda g: F.size(g["links"]) >= 2),
        lambda g: F.struct(near(g).cast("int").alias("near"), F.when(near(g), 0).otherwise(F.size(g["links"])).alias("n"), (-g["links"][0]["ord"]).alias("at"), g["prefix"].alias("prefix"), g["links"].alias("links")),
    )
    told = F.transform("keys", lambda g: F.struct(F.size(keys(g["links"], "v")).alias("values"), (-g["links"][0]["ord"]).alias("at"), g["k"].alias("k"), F.size(keys(g["links"], "ord")).alias("n"), g["links"].alias("links")))
    total = F.aggregate("groups", F.lit(0), lambda a, g: a + F.size(g["links"]))
    rows = rows.select("url", "base", "below", "same", "tops", F.array_max(ranked).alias("context"), total.alias("total"), F.array_max(told).alias("param"))

    n = F.size("below")
    context, param = F.col("context"), F.col("param")
    bonus = F.when((base != "/") & context["prefix"].startswith(base), 8).otherwise(0)
    ways = F.array_compact(F.array(
        F.when(n >= 2, _way(0, F.lit("child-path"), n * 3 + F.size(F.filter("below", lambda x: x["in_nav"])) / n * 10 + 5, F.col("below"))),
        F.when((F.col("total") >= 3) & context.isNotNull(), _way(1, F.lit("nav-context"), F.size(context["links"]) * 2 + 5 + bonus, context["links"])),
        F.when((F.col("same") >= 3) & (param["values"] >= 3), _way(2, F.concat(F.lit("query-param:"), param["k"]), param["n"] * 2 + 3, param["links"])),
        F.when(F.size("tops") >= 3, _way(3, F.lit("top-level-nav"), F.size("tops") * 1.5 + 1, F.col("tops"))),
    ))
    won = listed(rows, F.slice(F.sort_array(ways, False), 1, 1), "url")
    unique = F.array_distinct("links")
    return won.select("url", "strategy", "score", unique.alias("sections"), (F.size(unique) >= 2).alias("has_sections"))
