"""Pages to records: list items, fields, types, confidence, ids, de-duplication and health.

The only step in Python is the one that needs the DOM: an Arrow function that turns a page into an array of raw
items. Everything behind it is native, and because the function is an expression over ``html`` rather than a map
over rows, filters on other columns still reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.functions.arrow import per_row, spread
from sluice.functions.dom import Node, SelectorError, each, js_trim, parse_cached
from sluice.functions.dom import first as first_match
from sluice.plans.columns import normalised
from sluice.plans.config import DEFAULTS, ExtractionConfig, Field


def field_value(item: Node, field: Field) -> tuple[str | None, bool]:
    """Text or attribute of the first selector that gives any, and whether that was a fallback."""
    for k, selector in enumerate((field.selector, *field.fallbacks)):
        try:
            node = first_match(item, selector)
        except SelectorError:
            continue
        if node is None:
            continue
        value = (node.get(field.attribute) or node.get("data-src")) if field.attribute else js_trim(node.text())
        if value:
            return value, k > 0
    return None, False


def each_item(html: str | None, list_selector: str, fields: tuple[Field, ...]) -> Iterator[dict]:
    try:
        nodes = each(parse_cached(html or ""), list_selector)
    except SelectorError:
        return
    for node in nodes:
        if not node.is_tag:
            continue
        values, fallbacks, missing = [], 0, []
        for f in fields:
            if f.from_detail:
                values.append(None)
                continue
            value, fell_back = field_value(node, f)
            values.append(value)
            fallbacks += fell_back
            if value is None and f.required:
                missing.append(f.name)
        yield {"raw": values, "fallback_count": fallbacks, "missing_required": missing}


def raw_items(html: str | None, list_selector: str, fields: tuple[Field, ...]) -> list[dict]:
    return list(each_item(html, list_selector, fields))


ITEMS = "array<struct<raw: array<string>, fallback_count: int, missing_required: array<string>>>"


def items_column(html: Column, list_selector: str, fields: tuple[Field, ...]) -> Column:
    return per_row(lambda h: each_item(h, list_selector, fields), ITEMS)(html)


def raw_records(pages: DataFrame, config: ExtractionConfig, order: str = "page_no") -> DataFrame:
    """One row for each list item: _sourceUrl, page order, item_idx, raw texts by field, fallback_count, missing_required."""
    # Exploded with the empty ones: a plain explode has Spark filter on the array's size first, which runs the function twice.
    found = spread(pages.select("url", "html", order)).select("url", order, F.posexplode_outer(items_column(F.col("html"), config.list_selector, config.fields)).alias("item_idx", "item")).where("item_idx IS NOT NULL")
    return found.select(
        F.col("url").alias("_sourceUrl"), order, "item_idx", *(F.col("item.raw")[k].alias(f.name) for k, f in enumerate(config.fields)), F.col("item.fallback_count").alias("fallback_count"), F.col("item.missing_required").alias("missing_required")
    )


def empty(c: Column, field: Field) -> Column:
    """Null or the empty text."""
    return c.isNull() | (c == "") if field.data_type.simpleString() == "string" else c.isNull()


def confidence(config: ExtractionConfig, fallback_count: Column) -> Column:
    """1, less for every empty field (more if it is required) and for every fallback."""
    score = F.lit(1.0) - fallback_count * 0.05
    for f in config.fields:
        score = score - F.when(empty(F.col(f"`{f.name}`"), f), 0.3 if f.required else 0.05).otherwise(0.0)
    return text.clamp(score, 0.0, 1.0)


def key_texts(fields: list[Field]) -> list[Column]:
    return [text.js_text(F.col(f"`{f.name}`"), f.data_type.simpleString()) for f in fields]


def records(pages: DataFrame, config: ExtractionConfig, now: Column | None = None, order: str = "page_no") -> DataFrame:
    """Typed records in extraction order: meta columns, fields, and the order columns."""
    raw = raw_records(pages, config, order)
    now = F.current_timestamp() if now is None else now
    # Each value is computed once, then scored.
    typed = raw.select("_sourceUrl", order, "item_idx", "fallback_count", *(normalised(f, F.col(f"`{f.name}`"), F.col("_sourceUrl"), now).alias(f.name) for f in config.fields))
    keys = [f for f in config.fields if f.required] or list(config.fields)
    return typed.select(
        text.record_id(key_texts(keys)).alias("_id"), F.col("_sourceUrl"), now.alias("_extractedAt"), confidence(config, F.col("fallback_count")).alias("_confidence"),
        *(F.col(f"`{f.name}`") for f in config.fields), order, "item_idx",
    )


def with_details(found: DataFrame, details: DataFrame, config: ExtractionConfig, now: Column | None = None) -> DataFrame:
    """Left join with stored detail pages on the record's url; detail fields take the place of equal names. Rows
    without a page stay as they are."""
    if config.detail is None or "url" not in found.columns:
        return found
    fields = config.detail.fields
    item = items_column(F.col("html"), "body", fields)[0]
    own = spread(details.select("url", "html")).select(F.col("url").alias("_detail_url"), item.alias("item")).where("item IS NOT NULL")
    own = own.select("_detail_url", *(normalised(f, F.col("item.raw")[k], F.col("_detail_url"), now).alias(f"_detail_{f.name}") for k, f in enumerate(fields)))
    joined = found.join(own, found["url"] == own["_detail_url"], "left")
    names = {f.name for f in fields}
    met = F.col("_detail_url").isNotNull()
    kept = [F.when(met, F.col(f"`_detail_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in found.columns]
    new = [F.col(f"`_detail_{f.name}`").alias(f.name) for f in fields if f.name not in found.columns]
    return joined.select(*kept, *new)


def deduplicate(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row in ``order`` of every key; without keys, of equal rows (fields that don't begin with _)."""
    kinds = dict(found.dtypes)
    columns = keys or [c for c in found.columns if not c.startswith("_") and c not in order]
    texts = [text.js_text(F.col(f"`{c}`"), kinds[c]) for c in columns]
    key = F.concat_ws("|", *texts) if keys else F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"}), 256)
    # A minimum by order with map-side combine instead of a window: a key shared by very many rows is no single task's work.
    rest = F.struct(*(F.col(f"`{c}`") for c in found.columns))
    least = found.select(key.alias("_key"), F.struct(*order).alias("_order"), rest.alias("_row")).groupBy("_key").agg(F.min_by("_row", "_order").alias("_row"))
    return least.select("_row.*")


@dataclass(frozen=True)
class Health:
    overall_confidence: float
    item_count_in_range: bool
    required_field_coverage: dict[str, float]
    degraded: bool
    reasons: list[str]


def health(found: DataFrame, config: ExtractionConfig, errors: int | Column = 0) -> DataFrame:
    """One row: overall_confidence, item_count_in_range, required_field_coverage, degraded, reasons. One aggregation."""
    aggregates = [F.count("*").alias("n"), F.avg("_confidence").alias("mean")]
    for k, f in enumerate(config.fields):
        c = F.col(f"`{f.name}`")
        filled = ~empty(c, f)
        aggregates.append(F.count_if(filled).alias(f"filled_{k}"))
        words = text.js_text(c, f.data_type.simpleString())
        aggregates += [F.min(F.when(filled, words)).alias(f"low_{k}"), F.max(F.when(filled, words)).alias(f"high_{k}")]
    row = found.agg(*aggregates)
    n, errors = F.col("n"), errors if isinstance(errors, Column) else F.lit(errors)
    reasons, coverage = [F.when(n < 3, F.format_string("Only %d items extracted, expected at least 3", n))], []
    for k, f in enumerate(config.fields):
        if f.required:
            share = F.when(n > 0, F.col(f"filled_{k}") / n).otherwise(0.0)
            coverage += [F.lit(f.name), share]
            reasons.append(F.when(share < DEFAULTS["required_field_coverage"], F.format_string(f'Required field "{f.name}" only present in %d%% of items', F.floor(share * 100 + 0.5))))
    for k, f in enumerate(config.fields):
        if f.type != "boolean":
            same = (F.col(f"filled_{k}") >= 3) & (F.col(f"low_{k}") == F.col(f"high_{k}"))
            reasons.append(F.when(same, F.lit(f'Field "{f.name}" has identical value across all items — selector may be wrong')))
    reasons.append(F.when(errors > n * DEFAULTS["error_rate"], F.format_string("High error rate: %d errors for %d items", errors.cast("long"), n)))
    listed = F.array_compact(F.array(*reasons))
    bad = F.size(listed) > 0
    mean = F.coalesce("mean", F.lit(0.0))
    cover = F.create_map(*coverage) if coverage else F.expr("map_from_arrays(array(), array())").cast("map<string,double>")
    return row.select(
        text.clamp(F.when(bad, mean * DEFAULTS["degraded_multiplier"]).otherwise(mean), 0.0, 1.0).alias("overall_confidence"), (n >= 3).alias("item_count_in_range"),
        cover.alias("required_field_coverage"), bad.alias("degraded"), listed.alias("reasons"),
    )


def content_hash(found: DataFrame, order: list[str], skip: tuple[str, ...] = ("_extractedAt",)) -> DataFrame:
    """One row, content_hash: SHA-256 over the records' number and the sums of their own hashes (JSON with their place in
    ``order``), so the order counts, but no task holds more than sums: partitions add up their own records first."""
    columns = order + [c for c in found.columns if c not in skip and c not in order]
    each = found.select(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    sums = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string"), F.lit("0")) for k in range(4)]
    return each.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("content_hash"))


def snapshot_hash(found: DataFrame) -> DataFrame:
    """Like ``content_hash``, whatever the order: by _id, without _extractedAt and _confidence."""
    return content_hash(found.withColumn("_by", F.col("_id")), ["_by"], ("_extractedAt", "_confidence"))


def preview(found: DataFrame, limit: int = 10, order: tuple[str, ...] = ("page_no", "item_idx")) -> DataFrame:
    """The first records, at most 50."""
    return found.orderBy(*order).limit(max(1, min(limit, 50)))


def extract(pages: DataFrame, config: ExtractionConfig, details: DataFrame | None = None, now: Column | None = None, order: str = "page_no") -> DataFrame:
    """Records of a config over stored pages: extracted, typed, enriched, first of equal keys."""
    found = records(pages, config, now, order)
    if details is not None:
        found = with_details(found, details, config, now)
    return deduplicate(found, config.required, [order, "item_idx"])


def first_per(found: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by ``order``; for metadata tables whose groups are small."""
    return found.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")
