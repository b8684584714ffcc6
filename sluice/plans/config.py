"""Extraction configs: what to take from a page, declared as data."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

FIELD_TYPES = ("string", "number", "boolean", "url", "date", "image", "price", "html")
TRANSFORMS = ("trim", "lowercase", "collapseWhitespace", "stripHtml", "regex", "replace", "prefix", "parseNumber", "parsePrice", "parseDate", "resolveUrl", "parseBoolean")
STRATEGIES = ("next-link", "page-param", "offset-param", "infinite-scroll")
FETCH_MODES = ("static", "rendered", "auto")
#: Defaults and limits (fixed values).
DEFAULTS: dict[str, Any] = {
    "fetch_mode": "static", "rate_limit_ms": 1000, "timeout_ms": 30_000, "max_retries": 3, "robots_policy": "respect", "max_pages": 10, "server_port": 3847, "server_host": "127.0.0.1",
    "log_level": "info", "confidence_threshold": 0.3, "min_repeated_blocks": 3, "sample_size": 5, "field_match_threshold": 0.6, "rendering_score_threshold": 0.4,
    "min_body_text_length": 300, "max_repeated_blocks": 10, "block_confidence_threshold": 0.2, "required_field_coverage": 0.8, "error_rate": 0.3, "degraded_multiplier": 0.7,
    "max_response_bytes": 10 * 1024 * 1024, "rate_limiter_ttl_ms": 3_600_000, "crawl_pages": 20,
}
PRICE = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("currency", T.StringType())])
META = ("_id", "_sourceUrl", "_extractedAt", "_confidence")


class ConfigError(ValueError):
    """A config that can't be run."""


@dataclass(frozen=True)
class Transform:
    """One step of a field's chain."""

    op: str
    pattern: str | None = None
    group: int = 0
    search: str | None = None
    replacement: str = ""
    value: str = ""

    def __post_init__(self):
        if self.op not in TRANSFORMS:
            raise ConfigError(f"unknown transform {self.op!r}")
        if self.op == "regex" and not self.pattern or self.op == "replace" and self.search is None:
            raise ConfigError(f"transform {self.op} lacks its pattern")

    @property
    def result(self) -> str:
        """Field type of what the step gives."""
        return {"parseNumber": "number", "parsePrice": "price", "parseBoolean": "boolean"}.get(self.op, "string")


@dataclass(frozen=True)
class Field:
    name: str
    selector: str
    type: str = "string"
    attribute: str | None = None
    fallbacks: tuple[str, ...] = ()
    transforms: tuple[Transform, ...] = ()
    required: bool = False
    from_detail: bool = False

    def __post_init__(self):
        if not self.name or not self.selector:
            raise ConfigError("a field needs a name and a selector")
        if self.type not in FIELD_TYPES:
            raise ConfigError(f"unknown type {self.type!r} of field {self.name}")

    @property
    def steps(self) -> tuple[Transform, ...]:
        """The chain as far as it runs: it ends once a value isn't text."""
        out = []
        for step in self.transforms:
            out.append(step)
            if step.result != "string":
                break
        return tuple(out)

    @property
    def data_type(self) -> T.DataType:
        kind = self.steps[-1].result if self.steps else self.type
        return {"number": T.DoubleType(), "boolean": T.BooleanType(), "price": PRICE}.get(kind, T.StringType())


@dataclass(frozen=True)
class Pagination:
    strategy: str
    next_selector: str | None = None
    param: str | None = None
    start: int | None = None
    increment: int | None = None
    max_pages: int = DEFAULTS["max_pages"]

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ConfigError(f"unknown pagination strategy {self.strategy!r}")


@dataclass(frozen=True)
class DetailPage:
    fields: tuple[Field, ...]
    link_selector: str | None = None
    link_attribute: str = "href"
    fetch_mode: str = "static"
    rate_limit_ms: int | None = None


@dataclass(frozen=True)
class ExtractionConfig:
    name: str
    url: str
    list_selector: str
    fields: tuple[Field, ...]
    fetch_mode: str = "static"
    pagination: Pagination | None = None
    detail: DetailPage | None = None
    schedule: str | None = None
    version: int = 1
    robots: str = DEFAULTS["robots_policy"]
    rate_limit_ms: int = DEFAULTS["rate_limit_ms"]
    extra: Mapping[str, Any] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        from sluice.functions.urls import parse_url

        if not self.list_selector or not self.fields:
            raise ConfigError("a config needs a list selector and fields")
        if self.fetch_mode not in FETCH_MODES:
            raise ConfigError(f"unknown fetch mode {self.fetch_mode!r}")
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ConfigError("two fields have one name")
        if parse_url(self.url) is None:
            raise ConfigError(f"not a URL: {self.url!r}")

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    @property
    def schema(self) -> T.StructType:
        """Meta columns, then a column for every field."""
        meta = [T.StructField("_id", T.StringType()), T.StructField("_sourceUrl", T.StringType()), T.StructField("_extractedAt", T.TimestampType()), T.StructField("_confidence", T.DoubleType())]
        return T.StructType(meta + [T.StructField(f.name, f.data_type) for f in self.fields])

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=list)


def _field(raw: Mapping[str, Any]) -> Field:
    steps = []
    for t in raw.get("transform") or raw.get("transforms") or ():
        t = dict(t)
        steps.append(Transform(op=t.get("type") or t.get("op"), pattern=t.get("pattern"), group=int(t.get("group") or 0), search=t.get("search"), replacement=t.get("replacement") or "", value=t.get("value") or ""))
    return Field(
        name=raw["name"], selector=raw["selector"], type=raw.get("type") or "string", attribute=raw.get("attribute"),
        fallbacks=tuple(raw.get("fallbackSelectors") or raw.get("fallbacks") or ()), transforms=tuple(steps),
        required=bool(raw.get("required")), from_detail=bool(raw.get("fromDetailPage") or raw.get("from_detail")),
    )


def config_of(raw: Mapping[str, Any] | str) -> ExtractionConfig:
    """A config from its JSON form; keys in camel case or as the classes name them."""
    raw = json.loads(raw) if isinstance(raw, str) else raw
    missing = [k for k in ("name", "url") if not raw.get(k)]
    if missing or not (raw.get("listSelector") or raw.get("list_selector")):
        raise ConfigError(f"missing: {', '.join(missing + ([] if raw.get('listSelector') or raw.get('list_selector') else ['listSelector']))}")
    pages, detail = raw.get("pagination"), raw.get("detailPage") or raw.get("detail")
    return ExtractionConfig(
        name=raw["name"], url=raw["url"], list_selector=raw.get("listSelector") or raw.get("list_selector"), fields=tuple(_field(f) for f in raw.get("fields") or ()),
        fetch_mode=raw.get("fetchMode") or raw.get("fetch_mode") or "static",
        pagination=Pagination(
            strategy=pages["strategy"], next_selector=pages.get("nextSelector") or pages.get("next_selector"), param=pages.get("paramName") or pages.get("param"),
            start=pages.get("startValue", pages.get("start")), increment=pages.get("increment"), max_pages=int(pages.get("maxPages") or pages.get("max_pages") or DEFAULTS["max_pages"]),
        ) if pages else None,
        detail=DetailPage(fields=tuple(_field(f) for f in detail.get("fields") or ()), link_selector=detail.get("linkSelector") or detail.get("link_selector"), link_attribute=detail.get("linkAttribute") or detail.get("link_attribute") or "href") if detail else None,
        schedule=raw.get("schedule"), version=int(raw.get("version") or 1), robots=raw.get("robotsPolicy") or raw.get("robots") or DEFAULTS["robots_policy"],
        rate_limit_ms=int(raw.get("rateLimitMs") or raw.get("rate_limit_ms") or DEFAULTS["rate_limit_ms"]),
    )
