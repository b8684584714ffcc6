"""Command line: ``python -m sluice.cli COMMAND``. Pages come from a Parquet table (--pages) or from the web."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import log, wizard
from sluice.functions.urls import parse_url
from sluice.operators import analyze, crawl
from sluice.plans import run as runs
from sluice.plans.config import DEFAULTS, ConfigError, ExtractionConfig, config_of
from sluice.plans.schedule import PRESETS, Cron, Lock, valid
from sluice.sources import export, web
from sluice.sources.catalog import Catalog
from sluice.sources.pages import Live, Pages, Stored
from sluice.sources.robots import allowed
from sluice.sources.session import ship


def session() -> SparkSession:
    spark = SparkSession.builder.appName("sluice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def data_dir() -> str:
    """$SLUICE_DATA, or a folder under the user's data directory."""
    return os.environ.get("SLUICE_DATA") or os.path.join(os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share"), "sluice")


def pages_of(spark: SparkSession, stored: str | None, mode: str = "static", interval_ms: float = DEFAULTS["rate_limit_ms"]) -> Pages:
    """The stored pages, or the web, whose pages are kept in the data folder."""
    if stored:
        return Stored(spark.read.parquet(stored))
    return Live(spark, f"file://{os.path.abspath(data_dir())}/pages" if spark.sparkContext.master.startswith("local") else f"{data_dir()}/pages", mode, interval_ms)


def live_url(url: str) -> str:
    found = parse_url(url)
    if found is None or not found.host:
        raise ConfigError(f"not a URL: {url!r}")
    return url


def head(url: str, timeout: float = 5) -> str:
    """What a site answers to a HEAD request."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, method="HEAD", headers={"User-Agent": web.AGENT}), timeout=timeout) as r:
            return str(r.status)
    except HTTPError as e:
        return str(e.code)
    except Exception as e:
        return f"{type(e).__name__}: {e}"


def cells(rows: list, columns: list[str], most: int = 20, width: int = 40) -> str:
    """A plain table of at most ``most`` rows and cells of ``width`` characters."""
    cut = lambda v: (t := "" if v is None else str(v))[: width - 3] + "..." if len(str(v or "")) > width else "" if v is None else str(v)
    body = [[cut(r[c]) for c in columns] for r in rows[:most]]
    sizes = [max(len(c), *(len(b[k]) for b in body)) if body else len(c) for k, c in enumerate(columns)]
    line = lambda xs: "  ".join(x.ljust(n) for x, n in zip(xs, sizes)).rstrip()
    return "\n".join([line(columns), line(["-" * n for n in sizes]), *map(line, body)])


def changes_text(changes: DataFrame, most: int = 10) -> str:
    """Up to ``most`` changes of each kind, labelled by title, name or id."""
    out = []
    for kind, sign in (("added", "+"), ("changed", "~"), ("removed", "-")):
        found = changes.where(F.col("change_type") == kind)
        n, rows = found.count(), found.limit(most).collect()
        if n:
            out.append(f"{kind}: {n}")
        for r in rows:
            fields = r["after"] or r["before"] or {}
            label = fields.get("title") or fields.get("name") or r["record_id"]
            out.append(f"  {sign} {label}" + "".join(f"\n      {c}: {(r['before'] or {}).get(c)} -> {(r['after'] or {}).get(c)}" for c in r["changed_fields"] or []))
        if n > most:
            out.append(f"  ... and {n - most} more")
    return "\n".join(out) or "No changes detected"


def serve(catalog: Catalog, host: str, port: int, pages_of: Callable[[ExtractionConfig], DataFrame | Pages]) -> None:
    """The REST routes, on a plain HTTP server, and the schedules beside it."""
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    begun = datetime.now(timezone.utc)

    def answer(method: str, path: list[str], asked: dict) -> tuple[int, object]:
        rows = lambda df: [r.asDict(True) for r in df.collect()]
        if path == ["health"]:
            return 200, {"status": "ok", "uptime": (datetime.now(timezone.utc) - begun).total_seconds()}
        if path == ["sources"]:
            return 200, rows(catalog.sources())
        if len(path) < 2 or path[0] != "sources" or catalog.get("sources", path[1]) is None:
            return 404, {"error": "not found"}
        source, rest = path[1], path[2:]
        if not rest:
            return 200, {"source": catalog.get("sources", source), "latest_run": catalog.latest("runs", source), "schedule": catalog.get("schedules", source)}
        if rest == ["data"]:
            limit, offset = int(asked.get("limit", ["100"])[0]), int(asked.get("offset", ["0"])[0])
            snapshot = catalog.snapshot_of_run(asked["run"][0]) if "run" in asked else catalog.latest("snapshots", source)
            if snapshot is None:
                return 404, {"error": "no data"}
            found = catalog.page(source, snapshot["id"], limit, offset)
            return 200, {"records": [json.loads(r["value"]) for r in export.json_lines(found).collect()], "meta": {"total": snapshot["record_count"], "limit": limit, "offset": offset}}
        if rest[0] in ("runs", "diffs"):
            if len(rest) == 1:
                return 200, rows(catalog.recent(rest[0], source))
            found = catalog.get(rest[0], rest[1])
            if found and rest[0] == "diffs":
                found["changes"] = rows(catalog.changes(source, rest[1]))
            return (200, found) if found else (404, {"error": "not found"})
        if rest == ["extract"] and method == "POST":
            import threading

            threading.Thread(target=lambda: runs.run(catalog, source, pages_of(catalog.active_config(source)), trigger="api"), daemon=True).start()
            return 202, {"status": "accepted"}
        return 404, {"error": "not found"}

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            parts = urlsplit(self.path)
            code, body = answer(self.command, [p for p in parts.path.split("/") if p], parse_qs(parts.query))
            raw = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _do

        def log_message(self, *_: object) -> None:
            pass

    scheduler = runs.Scheduler(catalog, pages_of, Lock(os.path.join(data_dir(), "run.lock"))).start()
    try:
        HTTPServer((host, port), Handler).serve_forever()
    finally:
        scheduler.stop()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluice")
    p.add_argument("--pages", help="Parquet table of url and html, instead of the web")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **options: dict) -> None:
        c = commands.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for o, kw in options.items():
            c.add_argument(f"--{o}", **kw)

    add("init", config={"default": None}, url={"default": None})
    add("configs", "source", deactivate={"action": "store_true"})
    add("scan", "url", mode={"default": "auto"})
    add("crawl", "url", limit={"type": int, "default": DEFAULTS["crawl_pages"]})
    add("sections", "url")
    add("sources", status={"default": None}, show={"default": None})
    add("preview", "source", limit={"type": int, "default": 10}, config={"default": None})
    add("extract", "source")
    add("diff", "source")
    add("schedule", "source", cron={"default": None}, disable={"action": "store_true"})
    add("export", "source", format={"default": "json"}, run={"default": None}, output={"default": None})
    add("serve", host={"default": DEFAULTS["server_host"]}, port={"type": int, "default": DEFAULTS["server_port"]})
    add("tick")
    add("doctor")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    catalog = Catalog(spark, data_dir())
    log.setup()
    web_pages = lambda mode="static", interval=DEFAULTS["rate_limit_ms"]: pages_of(spark, args.pages, mode, interval)
    of_config = lambda c: web_pages(c.fetch_mode, c.rate_limit_ms)
    try:
        return command(args, spark, catalog, web_pages, of_config)
    except (ConfigError, KeyError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def command(args: argparse.Namespace, spark: SparkSession, catalog: Catalog, web_pages: Callable[..., Pages], of_config: Callable[[ExtractionConfig], Pages]) -> int:
    say = print
    match args.command:
        case "init":
            if args.config:
                with open(args.config, encoding="utf-8") as f:
                    config = config_of(f.read())
            else:
                url = live_url(args.url or input("URL: ").strip())
                found = analyze.analyze(web_pages("auto").one(url).where("html IS NOT NULL")).first()
                if found is None:
                    raise ConfigError(f"{url} can't be read")
                config = wizard.converse(url, found["analysis"].asDict(True), input, say)
            source = catalog.add_source(config)
            if config.schedule:
                catalog.set_schedule(source, PRESETS.get(config.schedule, config.schedule))
            say(source)
        case "configs":
            if args.deactivate:
                catalog.deactivate_configs(args.source)
            rows = catalog.configs(args.source).collect()
            say(cells(rows, ["id", "version", "is_active", "created_at"]))
        case "scan":
            source = web_pages(args.mode)
            found = analyze.analyze(source.one(live_url(args.url)).where("html IS NOT NULL")).withColumn("robots_allowed", F.lit(allowed(source.robots(args.url), args.url)))
            say(json.dumps([r.asDict(True) for r in found.collect()], indent=2, default=str))
        case "crawl":
            rows = crawl.crawl(live_url(args.url), web_pages(), most=args.limit).collect()
            say(cells(rows, ["url", "title", "page_type", "has_data", "items", "confidence"]))
        case "sections":
            found = analyze.sections(web_pages().one(live_url(args.url)).where("html IS NOT NULL"))
            say(json.dumps([r.asDict(True) for r in found.collect()], indent=2))
        case "sources":
            if args.show:
                say(json.dumps({"source": catalog.get("sources", args.show), "runs": [r.asDict() for r in catalog.recent("runs", args.show, 5).collect()]}, indent=2, default=str))
            else:
                rows = catalog.report() if args.status is None else catalog.sources(args.status)
                say(cells(rows.collect(), rows.columns))
        case "preview":
            config = config_of(args.config) if args.config else catalog.active_config(args.source)
            found = runs.run(catalog, args.source, of_config(config), dry=True, config=config)
            shown = found.records.orderBy("page_no", "item_idx").limit(args.limit)
            say(cells(shown.collect(), shown.columns))
            say(json.dumps(found.health))
        case "extract":
            config = catalog.active_config(args.source)
            found = runs.run(catalog, args.source, of_config(config))
            say(json.dumps({"run": found.run_id, "snapshot": found.snapshot_id, "health": found.health, "errors": found.errors}, default=str))
            if found.diff_id:
                say(changes_text(catalog.changes(args.source, found.diff_id)))
            return 1 if found.errors else 0
        case "diff":
            last = catalog.latest("diffs", args.source)
            say(changes_text(catalog.changes(args.source, last["id"])) if last else "No changes detected")
        case "schedule":
            if args.disable:
                catalog.disable_schedule(args.source)
                return 0
            if not args.cron or not valid(args.cron):
                raise ConfigError(f"not a cron expression: {args.cron}")
            catalog.set_schedule(args.source, PRESETS.get(args.cron, args.cron), args.cron if args.cron in PRESETS else None)
            say(Cron(args.cron).after(datetime.now()).isoformat())
        case "export":
            snapshot = catalog.snapshot_of_run(args.run) if args.run else catalog.latest("snapshots", args.source)
            found = catalog.records(args.source, snapshot["id"]).orderBy("page_no", "item_idx").drop("page_no", "item_idx")
            if args.output:
                (export.write_csv if args.format == "csv" else export.write_json)(found, args.output)
            else:
                for line in export.csv_lines(found) if args.format == "csv" else export.array_lines(found):
                    say(line)
        case "serve":
            serve(catalog, args.host, args.port, of_config)
        case "tick":
            # For an outer cron: runs what is due this minute, one run at a time.
            with Lock(os.path.join(data_dir(), "run.lock")):
                done = runs.run_due(catalog, datetime.now().replace(second=0, microsecond=0), of_config)
                say(f"{len(done)} runs")
        case "doctor":
            say(json.dumps({"spark": spark.version, "data": data_dir(), "writable": os.access(os.path.dirname(data_dir()) or ".", os.W_OK), "sources": catalog.sources().count(), "rendered": web.rendered_available(), "heads": {r["url"]: head(r["url"]) for r in catalog.sources("active").limit(50).collect()}}, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
