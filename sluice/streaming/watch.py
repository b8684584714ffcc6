"""Streams of pages: each micro-batch becomes records, updates the current ones, and appends its differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.diff import diff
from sluice.operators.extract import extract
from sluice.plans.config import ExtractionConfig


def record_stream(pages: DataFrame, config: ExtractionConfig) -> DataFrame:
    """Records of a stream of pages (url, html, page_no), without de-duplication across batches."""
    from sluice.operators.extract import records

    return records(pages, config)


def watch(pages: DataFrame, config: ExtractionConfig, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the newest records of every page under ``path/state-<n>`` and changes under ``path/changes``.

    A batch is written under its number, so a repeated batch writes the same again.
    """
    spark = pages.sparkSession

    def update(batch: DataFrame, number: int) -> None:
        found = extract(batch, config).drop("page_no", "item_idx")
        last = f"{path}/state-{number - 1}"
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(last)
        known = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        before = spark.read.parquet(last) if known else found.limit(0)
        renewed = batch.select(F.col("url").alias("_sourceUrl")).distinct()
        old = before.join(renewed, "_sourceUrl", "left_semi")
        diff(old, found).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        kept = before.join(renewed, "_sourceUrl", "left_anti").select(*found.columns)
        kept.unionByName(found).write.mode("overwrite").parquet(f"{path}/state-{number}")

    writer = pages.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def field_changes(records: DataFrame, field: str) -> DataFrame:
    """Changes of one field's value by record id on a stream: state holds the last value."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for batch in batches:
            for value in batch.sort_values("_extractedAt")["value"]:
                if state.exists and value != last or not state.exists and last is None:
                    out.append((key[0], last, value))
                last = value
                state.update((last,))
        yield pd.DataFrame(out, columns=["_id", "before", "after"])

    rows = records.select("_id", "_extractedAt", F.col(f"`{field}`").cast("string").alias("value"))
    return rows.groupBy("_id").applyInPandasWithState(step, "_id string, before string, after string", "last string", "append", GroupStateTimeout.NoTimeout)
