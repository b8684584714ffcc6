"""Fields compiled to columns: transform chains and typed normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.functions.arrow import per_row
from sluice.functions.urls import resolve
from sluice.plans.config import Field, Transform


def resolve_url(link: Column, base: Column) -> Column:
    """Absolute URL. Browser rules need more than the built-in URL functions know, so this is an Arrow function."""
    return per_row(lambda to, on: None if to is None else resolve(to, on), "string")(link, base)


def apply(step: Transform, c: Column, base: Column, now: Column | None) -> Column:
    match step.op:
        case "trim":
            return text.trim(c)
        case "lowercase":
            return F.lower(c)
        case "collapseWhitespace":
            return text.collapse_whitespace(c)
        case "stripHtml":
            return text.strip_html(c)
        case "regex":
            return text.regex(c, step.pattern, step.group)
        case "replace":
            return text.replace(c, step.search, step.replacement)
        case "prefix":
            return F.concat(F.lit(step.value), c)
        case "parseNumber":
            return text.parse_number(c)
        case "parsePrice":
            return text.parse_price(c)
        case "parseDate":
            return text.parse_date(c, now)
        case "parseBoolean":
            return text.parse_boolean(c)
        case "resolveUrl":
            return resolve_url(c, base)
    raise ValueError(step.op)


def normalised(field: Field, raw: Column, base: Column, now: Column | None = None) -> Column:
    """The typed value of a field's raw text. A chain of transforms stands in for the type's own rule."""
    if field.steps:
        c = raw
        for step in field.steps:
            c = apply(step, c, base, now)
        return c
    match field.type:
        case "url" | "image":
            return resolve_url(raw, base)
        case "number":
            return text.parse_number(raw)
        case "price":
            return text.parse_price(raw)
        case "date":
            return text.parse_date(raw, now)
        case "boolean":
            return text.parse_boolean(raw)
    return text.collapse_whitespace(raw)
