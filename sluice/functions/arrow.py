"""Python functions of a row's values as columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Values, or elements of one array, that are Python objects at once, and bytes of arrays that are sent together, but for the last.
PIECE, SENT = 1024, 1 << 20


def _plain(value: object, kind: pa.DataType) -> object:
    """The value with maps as the pairs that Arrow takes."""
    if value is None:
        return None
    if pa.types.is_map(kind):
        return [(k, _plain(v, kind.item_type)) for k, v in value.items()]
    if pa.types.is_list(kind):
        return [_plain(v, kind.value_type) for v in value]
    if pa.types.is_struct(kind):
        return {f.name: _plain(value.get(f.name), f.type) for f in kind}
    return value


def one_array(value: object, kind: pa.DataType) -> pa.Array:
    """An Arrow array of one array. Its elements, which may come of a generator, are turned piece by piece: as Python
    objects they would take many times their size."""
    if value is None:
        return pa.nulls(1, kind)
    elements, pieces = iter(value), []
    while piece := [_plain(v, kind.value_type) for v in islice(elements, PIECE)]:
        pieces.append(pa.array(piece, kind.value_type))
    inside = pa.concat_arrays(pieces) if pieces else pa.array([], kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(inside)], pa.int32()), inside, type=kind)


def made(values: Iterator[object], kind: pa.DataType) -> Iterator[pa.Array]:
    """The values as Arrow arrays of bounded size, but for what one value takes."""
    if not pa.types.is_list(kind):
        while piece := list(islice(values, PIECE)):
            yield pa.array([_plain(v, kind) for v in piece], kind)
        return
    pieces, size = [], 0
    for value in values:
        pieces.append(one_array(value, kind))
        size += pieces[-1].nbytes
        if size > SENT:
            yield pa.concat_arrays(pieces)
            pieces, size = [], 0
    if pieces:
        yield pa.concat_arrays(pieces)


def row_udf(function: Callable[..., object], schema: str) -> Callable[..., Column]:
    """``function`` of each row's values as a user-defined function. A struct's rows are dicts; an array may be a generator.

    One row's values are Python objects at a time and what it gives is Arrow at once, so large pages take memory one by
    one, not a batch of them with all their results.
    """
    kind = to_arrow_type(_parse_datatype_string(schema))

    def columns(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            given = (batch,) if isinstance(batch, pa.Array) else batch
            yield from made((function(*(c[k].as_py() for c in given)) for k in range(len(given[0]))), kind)

    return F.arrow_udf(columns, schema)


def per_row(function: Callable[..., object], schema: str) -> Callable[..., Column]:
    """Like ``row_udf``, but made when it is used: it needs no session before."""
    return lambda *columns: row_udf(function, schema)(*columns)


def spread(pages: DataFrame) -> DataFrame:
    """pages over all cores where the scan is too small to be cut into as many pieces (one file, one row group).
    Only then are rows moved: a table beyond one scan piece a core stays where it is, and so do rows that were dealt out."""
    spark = pages.sparkSession
    n = spark.sparkContext.defaultParallelism
    plan = pages._jdf.queryExecution().optimizedPlan()
    if plan.containsPattern(spark._jvm.org.apache.spark.sql.catalyst.trees.TreePattern.REPARTITION_OPERATION()):
        return pages
    size = int(str(plan.stats().sizeInBytes()))
    piece = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return pages.repartition(n) if n > 1 and size < n * piece else pages


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows by the columns in many more parts than there are cores, which Spark doesn't join again: for few groups whose
    size grows with the input. However the groups fall, a core that has none takes the next."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def once(rows: DataFrame, column: Column, name: str, *keep: str) -> DataFrame:
    """The kept columns and a function's, as a generated one: Spark takes no filter on it below, where the function would
    run a second time."""
    return rows.select(*keep, F.explode_outer(F.array(column)).alias(name))
