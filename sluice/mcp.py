"""The engine's tools for a model client: JSON-RPC 2.0, one message a line, on standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from sluice.operators import analyze, crawl
from sluice.plans import run as runs
from sluice.plans.config import ConfigError, config_of
from sluice.sources import export
from sluice.sources.catalog import Catalog
from sluice.sources.pages import Pages, pages_from

VERSION = "2024-11-05"


class Tools:
    """pages_of gives the stored pages, or the web in a fetch mode."""

    def __init__(self, catalog: Catalog, pages_of: Callable[[str], DataFrame | Pages]):
        self.catalog, self.pages_of = catalog, pages_of

    def analyze_page(self, url: str) -> Any:
        return [r.asDict(True) for r in analyze.analyze(pages_from(self.pages_of("auto")).one(url).where("html IS NOT NULL")).collect()]

    def crawl_site(self, url: str, max_pages: int = 20) -> Any:
        return [r.asDict(True) for r in crawl.crawl(url, self.pages_of("static"), most=max_pages).collect()]

    def create_source(self, config: dict) -> Any:
        return {"source_id": self.catalog.add_source(config_of(config))}

    def list_sources(self) -> Any:
        return [r.asDict(True) for r in self.catalog.report().collect()]

    def preview_extraction(self, source_id: str = "", config: dict | None = None, limit: int = 10) -> Any:
        found = config_of(config) if config else self.catalog.active_config(source_id)
        result = runs.run(self.catalog, source_id, self.pages_of(found.fetch_mode), dry=True, config=found)
        shown = result.records.orderBy("page_no", "item_idx").limit(max(1, min(limit, 50)))
        return {"records": [json.loads(r["value"]) for r in export.json_lines(shown).collect()], "health": result.health}

    def run_extraction(self, source_id: str) -> Any:
        config = self.catalog.active_config(source_id)
        result = runs.run(self.catalog, source_id, self.pages_of(config.fetch_mode), trigger="mcp")
        return {"run_id": result.run_id, "snapshot_id": result.snapshot_id, "diff": self.catalog.get("diffs", result.diff_id) if result.diff_id else None, "health": result.health, "errors": result.errors}


#: Arguments of each tool: name, JSON type, needed.
ARGUMENTS: dict[str, list[tuple[str, str, bool]]] = {
    "analyze_page": [("url", "string", True)], "crawl_site": [("url", "string", True), ("max_pages", "integer", False)], "create_source": [("config", "object", True)], "list_sources": [],
    "preview_extraction": [("source_id", "string", False), ("config", "object", False), ("limit", "integer", False)], "run_extraction": [("source_id", "string", True)],
}


def described() -> list[dict]:
    return [
        {"name": name, "description": name.replace("_", " "), "inputSchema": {"type": "object", "properties": {a: {"type": t} for a, t, _ in args}, "required": [a for a, _, need in args if need]}}
        for name, args in ARGUMENTS.items()
    ]


def answer(tools: Tools, message: dict) -> dict | None:
    """The reply to one message; none to a notification."""
    method, params, key = message.get("method"), message.get("params") or {}, message.get("id")
    if key is None:
        return None
    reply = lambda **x: {"jsonrpc": "2.0", "id": key} | x
    if method == "initialize":
        return reply(result={"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "sluice", "version": "0.1.0"}})
    if method == "tools/list":
        return reply(result={"tools": described()})
    if method == "tools/call" and params.get("name") in ARGUMENTS:
        try:
            found = getattr(tools, params["name"])(**(params.get("arguments") or {}))
            return reply(result={"content": [{"type": "text", "text": json.dumps(found, default=str)}]})
        except (ConfigError, KeyError, TypeError, AttributeError) as e:
            return reply(result={"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True})
    return reply(error={"code": -32601, "message": f"no method {method}"})


def main() -> None:
    from sluice import cli

    spark = cli.session()
    tools = Tools(Catalog(spark, cli.data_dir()), lambda mode: cli.pages_of(spark, None, mode))
    for line in sys.stdin:
        try:
            message = json.loads(line)
        except ValueError:
            continue
        found = answer(tools, message)
        if found is not None:
            print(json.dumps(found), flush=True)


if __name__ == "__main__":
    main()
