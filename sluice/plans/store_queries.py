"""Queries over a catalog that is filled from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.queries import query, table
from sluice.sources import export
from sluice.sources.catalog import Catalog
from sluice.sources.session import new_path

_BEGUN = "TIMESTAMP '2024-01-01 00:00:00'"
#: The catalog's tables as SQL sees them.
_VIEWS = f"""WITH sources AS (SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_nationkey % 5 = 0 THEN 'paused' ELSE 'active' END AS status FROM customer),
    runs AS (SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS source_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at FROM orders),
    snapshots AS (SELECT 's' || o_orderkey AS id, o_custkey::VARCHAR AS source_id, o_orderkey::VARCHAR AS run_id, o_orderkey % 100 AS record_count, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F'),
    configs AS (SELECT c_custkey || '-' || v AS id, c_custkey::VARCHAR AS source_id, v AS version, (c_custkey + v) % 3 <> 0 AS is_active FROM customer, (VALUES (1), (2)) t(v)),
    schedules AS (SELECT c_custkey::VARCHAR AS source_id, '0 9 * * *' AS cron, c_custkey % 2 = 0 AS enabled FROM customer WHERE c_custkey % 3 = 0) """


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    found = Catalog(spark, new_path(spark, "catalog"))
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key, at = F.col("c_custkey"), F.expr(_BEGUN)
    found.load("sources", customer.select(key.alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("https://e.org/"), key).alias("url"), F.when(F.col("c_nationkey") % 5 == 0, "paused").otherwise("active").alias("status"), at.alias("created_at")))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    found.load("runs", orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("created_at")))
    kept = orders.where("o_orderstatus = 'F'")
    found.load("snapshots", kept.select(F.concat(F.lit("s"), "o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 100).alias("record_count"), F.col("o_orderdate").alias("created_at")))
    versions = customer.select(key, F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))
    found.load("configs", versions.select(F.concat_ws("-", key, "v").alias("id"), key.alias("source_id"), F.col("v").alias("version"), ((key + F.col("v")) % 3 != 0).alias("is_active")))
    found.load("schedules", customer.where(key % 3 == 0).select(key.alias("source_id"), F.lit("0 9 * * *").alias("cron"), (key % 2 == 0).alias("enabled")))
    return found


_NEWEST = "(PARTITION BY source_id ORDER BY created_at DESC, id DESC)"


@query(f"""{_VIEWS} SELECT s.id, s.name, s.status, r.id AS run_id, r.status AS run_status, p.id AS snapshot_id, coalesce(p.record_count, -1) AS record_count, h.cron, coalesce(h.enabled, false) AS enabled FROM sources s
    LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER {_NEWEST} = 1) r ON r.source_id = s.id
    LEFT JOIN (SELECT * FROM snapshots QUALIFY row_number() OVER {_NEWEST} = 1) p ON p.source_id = s.id LEFT JOIN schedules h ON h.source_id = s.id""")
def catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).report().select("id", "name", "status", "run_id", "run_status", "snapshot_id", F.coalesce("snapshot_record_count", F.lit(-1)).alias("record_count"), "cron", F.coalesce("enabled", F.lit(False)).alias("enabled"))


@query(f"{_VIEWS} SELECT source_id, id, status FROM runs QUALIFY row_number() OVER {_NEWEST} = 1")
def catalog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).latest_of_all("runs").select("source_id", "id", "status")


@query(f"{_VIEWS} SELECT id, status FROM runs WHERE source_id = (SELECT min(source_id) FROM runs) ORDER BY created_at DESC, id DESC LIMIT 20")
def catalog_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog(spark, sf_dir)
    source = found.table("runs").agg(F.min("source_id")).first()[0]
    return found.recent("runs", source).select("id", "status")


@query(f"""{_VIEWS} SELECT 'active source' AS kind, id FROM sources WHERE status = 'active' UNION ALL
    SELECT 'due schedule', source_id FROM schedules WHERE enabled AND source_id IN (SELECT id FROM sources WHERE status = 'active') UNION ALL
    SELECT 'active config', id FROM (SELECT * FROM configs WHERE is_active QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY version DESC) = 1)""")
def catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog(spark, sf_dir)
    parts = [("active source", found.sources("active").select("id")), ("due schedule", found.due_schedules().select(F.col("source_id").alias("id"))), ("active config", found.active_configs().select("id"))]
    a, b, c = (df.select(F.lit(kind).alias("kind"), "id") for kind, df in parts)
    return a.unionByName(b).unionByName(c)


@query(f"{_VIEWS} SELECT p.id, p.record_count FROM runs r JOIN snapshots p ON p.run_id = r.id WHERE r.id = (SELECT min(run_id) FROM snapshots)")
def catalog_run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog(spark, sf_dir)
    run = found.table("snapshots").agg(F.min("run_id")).first()[0]
    row = found.snapshot_of_run(run)
    return spark.createDataFrame([(row["id"], row["record_count"])], "id string, record_count long")


@query(f"""{_VIEWS}, gone AS (SELECT min(source_id) AS id FROM snapshots) SELECT 'sources' AS name, count(*) AS n FROM sources WHERE id <> (SELECT id FROM gone)
    UNION ALL SELECT 'runs', count(*) FROM runs WHERE source_id <> (SELECT id FROM gone) UNION ALL SELECT 'snapshots', count(*) FROM snapshots WHERE source_id <> (SELECT id FROM gone)
    UNION ALL SELECT 'configs', count(*) FROM configs WHERE source_id <> (SELECT id FROM gone) UNION ALL SELECT 'schedules', count(*) FROM schedules WHERE source_id <> (SELECT id FROM gone)""")
def catalog_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog(spark, sf_dir)
    found.delete_source(found.table("snapshots").agg(F.min("source_id")).first()[0])
    names = ("sources", "runs", "snapshots", "configs", "schedules")
    return spark.createDataFrame([(n, found.table(n).count()) for n in names], "name string, n long")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 50")
def catalog_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Catalog(spark, new_path(spark, "catalog"))
    found.add_snapshot("a", "r", table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    return found.page("a", limit=100, offset=50, order=("c_custkey",))


@query("""SELECT n_nationkey || ',' || n_name || ',"' || replace('a "quoted", b', '"', '""') || '",' || n_regionkey AS value FROM nation UNION ALL SELECT 'n_nationkey,n_name,note,n_regionkey'""")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit('a "quoted", b').alias("note"), "n_regionkey", F.lit("x").alias("_meta"))
    export.write_csv(rows.coalesce(1), path)
    return spark.read.text(path)


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS none FROM nation")
def export_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    export.write_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")), path)
    return spark.read.schema("n_nationkey int, n_name string, none string").json(path)


@query("SELECT n_nationkey AS a, n_name AS b, NULL::VARCHAR AS c FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def export_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b"))
    return export.all_records([one, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("c"))])
