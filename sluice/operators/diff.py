"""Differences between snapshots: a full outer join on the record id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _json(c: Column, kind: str) -> Column:
    return F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if kind.startswith(("struct", "map", "array")) else c.cast("string")


def last_of_each(found: DataFrame, order: list[str] | None) -> DataFrame:
    """The last row of each _id, in ``order`` if there is one."""
    if not order:
        return found
    rest = F.struct(*(F.col(f"`{c}`") for c in found.columns))
    return found.groupBy("_id").agg(F.max_by(rest, F.struct(*order)).alias("_row")).select("_row.*")


def diff(before: DataFrame, after: DataFrame, order: list[str] | None = None) -> DataFrame:
    """change_type (added, changed, removed), record_id, before, after (maps of texts), changed_fields.

    Fields that begin with _ don't count; null and missing are the same; fields are the later snapshot's, so one
    that only the earlier has changes nothing.
    """
    order = order or []
    before, after = last_of_each(before, order), last_of_each(after, order)
    kinds_a, kinds_b = dict(after.dtypes), dict(before.dtypes)
    fields = [c for c in after.columns if not c.startswith("_") and c not in order]
    old = [c for c in before.columns if not c.startswith("_") and c not in order]

    def texts(names: list[str], kinds: dict[str, str]) -> Column:
        if not names:
            return F.lit(None).cast("map<string,string>")
        pairs = [x for c in names for x in (F.lit(c), _json(F.col(f"`{c}`"), kinds[c]))]
        return F.create_map(*pairs)

    a = after.select(F.col("_id").alias("record_id"), texts(fields, kinds_a).alias("after"))
    b = before.select(F.col("_id").alias("_bid"), texts(old, kinds_b).alias("before"))
    both = b.join(a, b["_bid"] == a["record_id"], "full")
    changed = F.array_compact(F.array(*(F.when(~F.try_element_at(F.col("before"), F.lit(c)).eqNullSafe(F.col("after")[c]), F.lit(c)) for c in fields))) if fields else F.array().cast("array<string>")
    kind = F.when(F.col("_bid").isNull(), "added").when(F.col("record_id").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return both.select(kind.alias("change_type"), F.coalesce("record_id", "_bid").alias("record_id"), "before", "after", F.when(kind == "changed", changed).alias("changed_fields")).where("change_type IS NOT NULL")


def added(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before.select("_id"), "_id", "left_anti")


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after.select("_id"), "_id", "left_anti")


def counts(changes: DataFrame) -> DataFrame:
    """One row: added, changed, removed, summary."""
    row = changes.agg(*(F.count_if(F.col("change_type") == k).alias(k) for k in ("added", "changed", "removed")))
    said = F.concat_ws(", ", *(F.when(F.col(k) > 0, F.format_string(f"%d {k}", F.col(k))) for k in ("added", "changed", "removed")))
    return row.withColumn("summary", F.when(said == "", "No changes detected").otherwise(said))
