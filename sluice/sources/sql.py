"""Functions for plain SQL over pages: ``register(spark)``, then e.g.

    SELECT url, html_select(html, 'h1') AS heading FROM pages
    SELECT url, i.* FROM pages LATERAL VIEW explode(extract_items(html, 'li.item', '{"title": "h3", "link": "a@href"}')) t AS i
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import SparkSession

from sluice.functions.arrow import row_udf
from sluice.functions.dom import SelectorError, first, js_trim, parse_cached, select
from sluice.functions.urls import normalize, resolve
from sluice.sources.session import ship


def _texts(html: str | None, selector: str) -> list[str]:
    try:
        return [js_trim(n.text()) for n in select(parse_cached(html or ""), selector)]
    except SelectorError:
        return []


def _attribute(html: str | None, selector: str, name: str) -> str | None:
    try:
        node = first(parse_cached(html or ""), selector)
    except SelectorError:
        return None
    return node.get(name) if node is not None else None


@lru_cache(maxsize=256)
def _places(spec: str) -> dict[str, tuple[str, str | None]]:
    """Field to selector and attribute, from JSON with "selector" or "selector@attribute"."""
    return {k: (v.partition("@")[0].strip(), v.partition("@")[2].strip() or None) for k, v in json.loads(spec).items()}


def _items(html: str | None, selector: str, spec: str) -> list[dict[str, str | None]]:
    out = []
    try:
        for node in (n for n in select(parse_cached(html or ""), selector) if n.is_tag):
            row = {}
            for name, (place, attribute) in _places(spec).items():
                found = first(node, place) if place else node
                row[name] = None if found is None else (found.get(attribute) if attribute else js_trim(found.text())) or None
            out.append(row)
    except (SelectorError, ValueError):
        return []
    return out


def register(spark: SparkSession) -> None:
    """html_select, html_select_all, html_attr, extract_items, resolve_url, normalize_url."""
    ship(spark)
    spark.udf.register("html_select", row_udf(lambda h, s: next(iter(_texts(h, s)), None), "string"))
    spark.udf.register("html_select_all", row_udf(_texts, "array<string>"))
    spark.udf.register("html_attr", row_udf(_attribute, "string"))
    spark.udf.register("extract_items", row_udf(_items, "array<map<string,string>>"))
    spark.udf.register("resolve_url", row_udf(resolve, "string"))
    spark.udf.register("normalize_url", row_udf(normalize, "string"))
