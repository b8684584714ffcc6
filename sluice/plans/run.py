"""A run: pages to records to snapshot to differences, with everything logged."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.diff import diff
from sluice.operators.extract import deduplicate, health, records, with_details
from sluice.operators.paginate import chain
from sluice.plans.config import ExtractionConfig
from sluice.plans.schedule import Cron, Lock
from sluice.sources.catalog import Catalog
from sluice.sources.pages import Pages, pages_from
from sluice.sources.robots import allowed
from sluice.sources.web import RobotsBlocked

log = logging.getLogger("sluice")
ORDER = ["page_no", "item_idx"]


@dataclass
class Result:
    run_id: str | None
    records: DataFrame | None
    health: dict
    snapshot_id: str | None = None
    diff_id: str | None = None
    errors: tuple[tuple[str, str], ...] = ()


def run(
    catalog: Catalog, source_id: str, pages: DataFrame | Pages, details: DataFrame | None = None, robots_txt: str | None = None, trigger: str = "manual", dry: bool = False,
    config: ExtractionConfig | None = None,
) -> Result:
    """Extract a source from stored pages or the web. Unless dry, it is logged, kept as a snapshot and compared with the
    last one. A page that fails ends the pages, not the run: it is an error of the result and counts in its health."""
    config = config or catalog.active_config(source_id)
    if config is None:
        raise KeyError(f"source {source_id} has no config")
    previous = None if dry else catalog.latest("snapshots", source_id)
    run_id = None if dry else catalog.begin_run(source_id, trigger)
    source = pages_from(pages)
    phase = "pipeline"
    try:
        if config.robots == "respect":
            rules = source.robots(config.url) if robots_txt is None else robots_txt
            if not allowed(rules, config.url):
                raise RobotsBlocked(f"robots.txt forbids {config.url}")
        phase = "extract"
        now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")
        found = records(chain(source, config.url, config.pagination), config, now)
        if config.detail is not None and "url" in found.columns:
            own = details if details is not None else source.get(found.select("url").where("url IS NOT NULL"))
            found = with_details(found, own.where("html IS NOT NULL"), config, now)
        found = deduplicate(found, config.required, ORDER)
        if dry:
            errors = source.errors()
            return Result(None, found, health(found, config, len(errors)).first().asDict(True), errors=tuple(("fetch", f"{u}: {e}") for u, e in errors))
        phase = "persist"
        snapshot = catalog.add_snapshot(source_id, run_id, found, ORDER)
        kept = catalog.records(source_id, snapshot)
        errors = source.errors()
        score = health(kept, config, len(errors)).first().asDict(True)
        phase = "diff"
        changes = diff(catalog.records(source_id, previous["id"]) if previous else kept.limit(0), kept, ORDER)
        diff_id = catalog.add_diff(source_id, run_id, previous["id"] if previous else None, snapshot, changes)
        d = catalog.get("diffs", diff_id)
        pages_read = kept.select("page_no").distinct().count()
        catalog.update(
            "runs", run_id, status="completed", ended_at=datetime.now(timezone.utc).replace(tzinfo=None), pages=pages_read, records_total=catalog.get("snapshots", snapshot)["record_count"], records_added=d["added"],
            records_changed=d["changed"], records_removed=d["removed"],
        )
        log.info("run completed", extra={"source": source_id, "run": run_id, "errors": len(errors)})
        return Result(run_id, kept, score, snapshot, diff_id, tuple(("fetch", f"{u}: {e}") for u, e in errors))
    except Exception as e:
        if dry:
            raise
        kind = getattr(e, "error_class", type(e).__name__)
        log.error("run failed", extra={"source": source_id, "run": run_id, "phase": phase, "error": str(e)[:500]})
        catalog.update("runs", run_id, status="failed", ended_at=datetime.now(timezone.utc).replace(tzinfo=None), error_class=kind, error=str(e)[:2000])
        return Result(run_id, None, {"overall_confidence": 0.0, "degraded": True, "reasons": [str(e)]}, errors=((phase, str(e)),))


def run_due(catalog: Catalog, at: datetime, pages_of: Callable[[ExtractionConfig], DataFrame | Pages]) -> list[Result]:
    """Run every enabled schedule of an active source that is due at a time, one after another."""
    out = []
    for s in catalog.due_schedules().collect():
        if Cron(s["cron"]).matches(at):
            config = catalog.active_config(s["source_id"])
            out.append(run(catalog, s["source_id"], pages_of(config), trigger="scheduled"))
            catalog.update("schedules", s["source_id"], last_run_at=at, next_run_at=Cron(s["cron"]).after(at))
    return out


class Scheduler:
    """Runs what is due, minute by minute, beside a server. Schedules are read anew each minute, so changes count at
    once; the lock keeps it to one run at a time, other processes included."""

    def __init__(self, catalog: Catalog, pages_of: Callable[[ExtractionConfig], DataFrame | Pages], lock: Lock, clock: Callable[[], datetime] = datetime.now):
        self.catalog, self.pages_of, self.lock, self.clock = catalog, pages_of, lock, clock
        self.stopped = threading.Event()
        self.thread = threading.Thread(target=self._loop, daemon=True)

    def tick(self) -> list[Result]:
        """Run what is due this minute; nothing while another run holds the lock."""
        if not self.lock.acquire():
            return []
        try:
            return run_due(self.catalog, self.clock().replace(second=0, microsecond=0), self.pages_of)
        finally:
            self.lock.release()

    def _loop(self) -> None:
        while not self.stopped.wait(60 - self.clock().second):
            try:
                self.tick()
            except Exception as e:  # a failed minute doesn't end the others
                log.error("tick failed", extra={"error": str(e)[:500]})

    def start(self) -> Scheduler:
        self.thread.start()
        return self

    def stop(self) -> None:
        self.stopped.set()
