"""Records to JSON and CSV."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def json_lines(found: DataFrame) -> DataFrame:
    """One row a record: value, its JSON with all fields."""
    return found.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in found.columns)), KEEP_NULLS).alias("value"))


def write_json(found: DataFrame, path: str) -> None:
    """A JSON object a line, all fields and nulls kept."""
    found.write.option("ignoreNullFields", "false").json(path)


def json_text(found: DataFrame, pretty: bool = True) -> str:
    """A JSON array of the records; what a caller can print, so meant for slices."""
    import json

    rows = [json.loads(r["value"]) for r in json_lines(found).collect()]
    return json.dumps(rows, indent=2 if pretty else None, ensure_ascii=False, separators=None if pretty else (",", ":"))


def csv_ready(found: DataFrame, meta: bool = False) -> DataFrame:
    """The columns of a CSV export: no meta fields unless asked for, nested values as JSON."""
    columns = [c for c in found.columns if meta or not c.startswith("_")]
    kinds = dict(found.dtypes)
    return found.select(*(F.to_json(f"`{c}`", KEEP_NULLS).alias(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(f"`{c}`") for c in columns))


def write_csv(found: DataFrame, path: str, meta: bool = False) -> None:
    csv_ready(found, meta).write.option("header", True).option("nullValue", "").option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


def _csv_value(v: object) -> object:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else int(v) if isinstance(v, float) and v == int(v) else v


def csv_lines(found: DataFrame, meta: bool = False) -> Iterator[str]:
    """Lines of CSV, none without records; rows come to the driver a partition at a time."""
    import csv
    import io

    ready = csv_ready(found, meta)
    for k, r in enumerate(ready.toLocalIterator()):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        if k == 0:
            writer.writerow(ready.columns)
        writer.writerow([_csv_value(v) for v in r])
        yield out.getvalue()[:-1]


def csv_text(found: DataFrame, meta: bool = False) -> str:
    """CSV of the records, empty without any; meant for slices."""
    return "".join(f"{line}\n" for line in csv_lines(found, meta))


def array_lines(found: DataFrame) -> Iterator[str]:
    """Lines of a JSON array of the records; rows come to the driver a partition at a time."""
    yield "["
    before = None
    for r in json_lines(found).toLocalIterator():
        if before is not None:
            yield f"{before},"
        before = f"  {r['value']}"
    if before is not None:
        yield before
    yield "]"


def all_records(parts: list[DataFrame]) -> DataFrame:
    """Records of several snapshots under the union of their fields, first seen first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
