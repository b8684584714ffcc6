"""From a page's analysis to a config that can be run."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from sluice.plans.config import ConfigError, ExtractionConfig, Field, Pagination

#: Attributes that hold the value of a type (fixed values).
ATTRIBUTES = {"url": "href", "image": "src"}


def field_of(found: Mapping[str, Any]) -> Field:
    """A suggested field as a field; sure titles and links are required."""
    return Field(
        name=found["name"], selector=found["selector"], type=found["inferred_type"], attribute=ATTRIBUTES.get(found["inferred_type"]), fallbacks=tuple(found["fallback_selectors"] or ()),
        required=found["confidence"] > 0.8 and found["name"] in ("title", "url"),
    )


def propose(name: str, url: str, analysis: Mapping[str, Any], picked: Iterable[str] | None = None, max_pages: int = 10) -> ExtractionConfig:
    """The best block's config: its selector, the suggested fields (or those picked), and the surest pagination."""
    if not analysis["blocks"]:
        raise ConfigError(f"{url} has no repeated items")
    names = None if picked is None else set(picked)
    fields = tuple(field_of(f) for f in analysis["fields"] if names is None or f["name"] in names)
    hint = next((h for h in analysis["pagination"] or () if h["strategy"] in ("next-link", "page-param")), None)
    pagination = None
    if hint and hint["strategy"] == "next-link":
        pagination = Pagination("next-link", next_selector=hint["selector"], max_pages=max_pages)
    elif hint:
        pagination = Pagination("page-param", param=hint["url_pattern"].partition("=")[0], max_pages=max_pages)
    return ExtractionConfig(name=name, url=url, list_selector=analysis["blocks"][0]["selector"], fields=fields, pagination=pagination)
