"""Sources, configs, runs, snapshots, diffs and schedules as Parquet tables under one folder.

Metadata is append-only: a change is a new row, and the last row of a key counts. Records of a snapshot are a
Parquet folder of their own, so a snapshot is read without the others.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sluice.operators import diff as diffs
from sluice.operators.extract import content_hash
from sluice.plans.config import ExtractionConfig, config_of

TABLES = {
    "sources": "id string, name string, url string, description string, status string, created_at timestamp, updated_at timestamp",
    "configs": "id string, source_id string, version int, is_active boolean, config string, created_at timestamp",
    "runs": "id string, source_id string, config_id string, status string, trigger string, started_at timestamp, ended_at timestamp, pages int, records_total long, records_added long, records_changed long, records_removed long, error_class string, error string, created_at timestamp",
    "snapshots": "id string, source_id string, run_id string, record_count long, content_hash string, created_at timestamp",
    "diffs": "id string, source_id string, run_id string, before_id string, after_id string, added long, changed long, removed long, summary string, created_at timestamp",
    "schedules": "source_id string, cron string, preset string, enabled boolean, last_run_at timestamp, next_run_at timestamp, created_at timestamp",
}
KEYS = {"schedules": "source_id"}


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def new_id() -> str:
    return uuid.uuid4().hex[:12]


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _schema(self, name: str) -> str:
        return f"{TABLES[name]}, deleted boolean, seq long"

    def table(self, name: str) -> DataFrame:
        """The last row of every key that isn't deleted."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(self._schema(name)).parquet(f"{self.path}/{name}")
        last = rows.groupBy(KEYS.get(name, "id")).agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")
        return last.where("NOT deleted").drop("deleted", "seq")

    def _put(self, name: str, row: dict[str, Any]) -> dict[str, Any]:
        fields = [f.split()[0] for f in TABLES[name].split(", ")]
        values = tuple(row.get(f) for f in fields) + (False, time.time_ns())
        self.spark.createDataFrame([values], self._schema(name)).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
        return row

    def load(self, name: str, rows: DataFrame, deleted: bool = False) -> None:
        """Put many rows at once; columns that rows lacks are null."""
        fields = [f.split() for f in TABLES[name].split(", ")]
        own = [F.col(f).cast(t).alias(f) if f in rows.columns else F.lit(None).cast(t).alias(f) for f, t in fields]
        rows.select(*own, F.lit(deleted).alias("deleted"), F.lit(time.time_ns()).alias("seq")).write.mode("append").parquet(f"{self.path}/{name}")

    def compact(self, name: str) -> None:
        """One file of the rows that count, instead of one a change. Not while others write."""
        kept = f"{self.path}/.{name}-{new_id()}"
        self.table(name).select("*", F.lit(False).alias("deleted"), F.lit(time.time_ns()).alias("seq")).coalesce(1).write.parquet(kept)
        self._delete(name)
        jvm = self.spark.sparkContext._jvm
        old, new = jvm.org.apache.hadoop.fs.Path(kept), jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(old, new)

    def _delete(self, part: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def get(self, name: str, key: str) -> dict[str, Any] | None:
        found = self.table(name).where(F.col(KEYS.get(name, "id")) == key).first()
        return found.asDict() if found else None

    def update(self, name: str, key: str, **changes: Any) -> dict[str, Any]:
        row = self.get(name, key)
        if row is None:
            raise KeyError(f"no {key} in {name}")
        return self._put(name, row | changes | ({"updated_at": _now()} if name == "sources" else {}))

    # Sources and configs.

    def add_source(self, config: ExtractionConfig | dict, description: str | None = None) -> str:
        config = config if isinstance(config, ExtractionConfig) else config_of(config)
        row = self._put("sources", {"id": new_id(), "name": config.name, "url": config.url, "description": description, "status": "active", "created_at": _now(), "updated_at": _now()})
        self.add_config(row["id"], config)
        return row["id"]

    def add_config(self, source_id: str, config: ExtractionConfig) -> str:
        last = self.table("configs").where(F.col("source_id") == source_id).agg(F.max("version")).first()[0] or 0
        return self._put("configs", {"id": new_id(), "source_id": source_id, "version": last + 1, "is_active": True, "config": config.to_json(), "created_at": _now()})["id"]

    def active_config(self, source_id: str) -> ExtractionConfig | None:
        found = self.table("configs").where((F.col("source_id") == source_id) & F.col("is_active")).orderBy(F.desc("version")).first()
        return config_of(found["config"]) if found else None

    def configs(self, source_id: str) -> DataFrame:
        """A source's configs, the newest version first."""
        return self.table("configs").where(F.col("source_id") == source_id).orderBy(F.desc("version"))

    def deactivate_configs(self, source_id: str) -> None:
        rows = self.table("configs").where((F.col("source_id") == source_id) & F.col("is_active"))
        if rows.limit(1).count():
            self.load("configs", rows.withColumn("is_active", F.lit(False)))

    def active_configs(self) -> DataFrame:
        """source_id, config, version: of every source the newest active config."""
        found = self.table("configs").where("is_active").groupBy("source_id").agg(F.max_by(F.struct("id", "version", "config"), "version").alias("x"))
        return found.select("source_id", "x.*")

    def sources(self, status: str | None = None) -> DataFrame:
        found = self.table("sources")
        return (found.where(F.col("status") == status) if status else found).orderBy(F.desc("created_at"))

    def delete_source(self, source_id: str) -> None:
        """The source and all that belongs to it, records and changes too."""
        for name in TABLES:
            column = "id" if name == "sources" else "source_id"
            rows = self.table(name).where(F.col(column) == source_id)
            if rows.limit(1).count():
                self.load(name, rows, deleted=True)
        for part in ("records", "changes"):
            self._delete(f"{part}/source_id={source_id}")

    # Runs.

    def begin_run(self, source_id: str, trigger: str = "manual") -> str:
        return self._put("runs", {"id": new_id(), "source_id": source_id, "status": "running", "trigger": trigger, "started_at": _now(), "created_at": _now()})["id"]

    def recent(self, name: str, source_id: str, limit: int = 20) -> DataFrame:
        return self.table(name).where(F.col("source_id") == source_id).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)

    def latest_of_all(self, name: str) -> DataFrame:
        """The newest row of every source: a maximum with map-side combine."""
        found = self.table(name)
        return found.groupBy("source_id").agg(F.max_by(F.struct(*(c for c in found.columns if c != "source_id")), F.struct("created_at", "id")).alias("x")).select("source_id", "x.*")

    def latest(self, name: str, source_id: str) -> dict[str, Any] | None:
        found = self.recent(name, source_id, 1).first()
        return found.asDict() if found else None

    # Snapshots and diffs.

    def add_snapshot(self, source_id: str, run_id: str, records: DataFrame, order: list[str] | None = None) -> str:
        """Write records; their number and content hash (in ``order``) are read from what was written, so that a
        source that changes or costs requests is asked once."""
        key = new_id()
        records.write.parquet(f"{self.path}/records/source_id={source_id}/snapshot_id={key}")
        kept = self.records(source_id, key)
        digest = content_hash(kept, order).first()["content_hash"] if order else None
        self._put("snapshots", {"id": key, "source_id": source_id, "run_id": run_id, "record_count": kept.count(), "content_hash": digest, "created_at": _now()})
        return key

    def records(self, source_id: str, snapshot_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records/source_id={source_id}/snapshot_id={snapshot_id}")

    def snapshot_of_run(self, run_id: str) -> dict[str, Any] | None:
        found = self.table("snapshots").where(F.col("run_id") == run_id).first()
        return found.asDict() if found else None

    def page(self, source_id: str, snapshot_id: str | None = None, limit: int = 100, offset: int = 0, order: tuple[str, ...] = ("page_no", "item_idx")) -> DataFrame:
        """A slice of a snapshot's records, the latest by default."""
        snapshot_id = snapshot_id or (self.latest("snapshots", source_id) or {}).get("id")
        if snapshot_id is None:
            raise KeyError(f"source {source_id} has no snapshot")
        return self.records(source_id, snapshot_id).orderBy(*order).offset(offset).limit(limit)

    def add_diff(self, source_id: str, run_id: str, before_id: str | None, after_id: str, changes: DataFrame) -> str:
        key = new_id()
        changes.write.parquet(f"{self.path}/changes/source_id={source_id}/diff_id={key}")
        row = diffs.counts(self.changes(source_id, key)).first()
        self._put("diffs", {"id": key, "source_id": source_id, "run_id": run_id, "before_id": before_id, "after_id": after_id, "added": row["added"], "changed": row["changed"], "removed": row["removed"], "summary": row["summary"], "created_at": _now()})
        return key

    def changes(self, source_id: str, diff_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/changes/source_id={source_id}/diff_id={diff_id}")

    # Schedules.

    def set_schedule(self, source_id: str, cron: str, preset: str | None = None) -> None:
        """A source has one schedule; setting it enables it."""
        old = self.get("schedules", source_id) or {}
        self._put("schedules", {"last_run_at": None, "created_at": _now()} | old | {"source_id": source_id, "cron": cron, "preset": preset, "enabled": True})

    def disable_schedule(self, source_id: str) -> None:
        self.update("schedules", source_id, enabled=False)

    def due_schedules(self) -> DataFrame:
        """Enabled schedules of active sources."""
        return self.table("schedules").where("enabled").join(self.sources("active").select(F.col("id").alias("source_id")), "source_id")

    def report(self) -> DataFrame:
        """Sources with their latest run, snapshot and schedule: left joins to one row each."""
        def last(name: str, *columns: str) -> DataFrame:
            t = self.table(name)
            by = t.groupBy("source_id").agg(F.max_by(F.struct(*columns), F.struct("created_at", "id")).alias("x"))
            return by.select(F.col("source_id").alias("id"), *(F.col(f"x.{c}").alias(f"{name[:-1]}_{c}") for c in columns))

        out = self.table("sources")
        for t in (last("runs", "id", "status", "started_at"), last("snapshots", "id", "record_count"), self.table("schedules").select(F.col("source_id").alias("id"), "cron", "enabled")):
            out = out.join(t, "id", "left")
        return out.orderBy(F.desc("created_at"))


def row_json(row: Row | dict) -> str:
    return json.dumps(row.asDict(True) if isinstance(row, Row) else row, default=str)
