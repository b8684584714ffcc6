"""Packing into sequences of fixed length: cutting stock by column generation.

Documents are cut at multiples of the sequence length; a document's last piece is shorter. Pieces are
rounded up to units and counted by length (a histogram of at most ``length / unit`` rows, whatever the
corpus). The linear program over patterns (which lengths share a sequence) starts from one pattern a
length; a knapsack dynamic program over the dual prices finds the pattern worth most, until none is worth
more than a sequence. Patterns are rounded down, what is left goes by first fit decreasing, and the pieces,
ranked within their length, take the patterns' places.

A null text is an empty one (its end id alone is packed). Null and repeated doc_ids are kept as rows of
their own. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut
from sluice.llm.tokens import KEEP, encoder


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts of items of size 1..len(values) within ``capacity``, worth most."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    n = len(values)
    for c in range(1, capacity + 1):
        k = min(c, n)
        worth = best[c - k : c][::-1] + values[:k]
        i = int(np.argmax(worth))
        if worth[i] > best[c - 1] + 1e-12:
            best[c], last[c] = worth[i], i + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(n, dtype=np.int64), capacity
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def solve(demand: np.ndarray, capacity: int, gap: float = 1e-4, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their (fractional) uses covering ``demand``; demand[i] counts pieces of size i + 1."""
    sizes = np.flatnonzero(demand)
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // (sizes + 1)).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand[sizes]
    for step in range(most):
        dual = inverse.sum(axis=0)
        values = np.zeros(capacity)
        values[sizes] = np.maximum(dual, 0)
        worth, counts = price(values, capacity)
        if worth <= 1 + gap:  # then the bound is within the gap too
            break
        column = counts[sizes].astype(float)
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        basis[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, row)
        inverse[leave] = row
        if step % 100 == 99:  # a Newton step takes the rounding errors out again
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", basis, inverse))
        x = np.maximum(inverse @ demand[sizes], 0)
    out = []
    for j in range(m):
        counts = np.zeros(len(demand), dtype=np.int64)
        counts[sizes] = basis[:, j].round().astype(np.int64)
        out.append((counts, float(x[j])))
    return out


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole uses of patterns that place exactly ``demand``."""
    left = demand.astype(np.int64).copy()
    uses = []
    for counts, x in sorted(solve(left.astype(float), capacity), key=lambda p: -p[1]):
        fit = np.flatnonzero(counts)
        n = min(int(x + 1e-9), int((left[fit] // counts[fit]).min()))
        if n:
            uses.append((counts, n))
            left -= n * counts
    extra: dict[bytes, int] = {}
    rest: list[tuple[int, np.ndarray]] = []  # what each open sequence still holds
    for i in range(len(left) - 1, -1, -1):
        for _ in range(int(left[i])):
            at = next((k for k, (room, _) in enumerate(rest) if room >= i + 1), None)
            if at is None:
                rest.append((capacity, np.zeros(len(left), dtype=np.int64)))
                at = len(rest) - 1
            room, counts = rest[at]
            counts[i] += 1
            rest[at] = (room - i - 1, counts)
    for _, counts in rest:
        extra[counts.tobytes()] = extra.get(counts.tobytes(), 0) + 1
    return uses + [(np.frombuffer(k, dtype=np.int64), n) for k, n in extra.items()]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, keep: int = KEEP) -> DataFrame:
    """Every document's pieces: doc_id, start, length, ids_crc32, doc_tokens."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keep)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(enc.encode(text.as_py()).astype("<u4"), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(found: DataFrame, length: int, unit: int = 16) -> DataFrame:
    """Give every piece a sequence_id and an offset in that sequence.

    The driver sees the histogram and one row for each partition and length that meet. Ranks come from a
    range shuffle by (length, doc_id), which splits a length that many pieces share, plus prefix sums.
    """
    spark = found.sparkSession
    capacity = length // unit
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = found.columns
    sized = found.withColumn("units", F.ceil(F.col("length") / unit).cast("int"))
    ordered = sized.repartitionByRange(n, "units", "doc_id", "start", "ids_crc32").sortWithinPartitions("units", "doc_id", "start", "ids_crc32")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column(batch.num_columns - 1).to_numpy()
            first = np.concatenate([[True], units[1:] != units[:-1]])
            begins = np.flatnonzero(first)
            run = np.arange(len(units)) - np.repeat(begins, np.diff(np.append(begins, len(units))))
            local = run + seen[units]
            seen += np.bincount(units, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(units), part, np.int32)), pa.array(local)], [*own, "units", "part", "local"])

    schema = ", ".join(f"{c} long" for c in own) + ", units int, part int, local long"
    ranked = cut(ordered.mapInArrow(rank, schema), "ranked")
    met = sorted(tuple(r) for r in ranked.groupBy("units", "part").count().collect())
    demand, base = np.zeros(capacity, dtype=np.int64), {}
    for units, part, count in met:
        base[units, part] = int(demand[units - 1])
        demand[units - 1] += count
    # Places of each length in pattern order: (pieces before, sequences before, pieces of it in a sequence, its first slot).
    places: dict[int, list[tuple[int, int, int, int]]] = {u + 1: [] for u in np.flatnonzero(demand)}
    before, sequences = np.zeros(capacity, dtype=np.int64), 0
    for counts, uses in plan(demand, capacity):
        slot = 0
        for i in np.flatnonzero(counts)[::-1]:
            places[int(i) + 1].append((int(before[i]), sequences, int(counts[i]), slot))
            before[i] += uses * counts[i]
            slot += int(counts[i])
        sequences += uses
    tables = {u: np.array(p, dtype=np.int64).reshape(-1, 4) for u, p in places.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, parts, local = (batch.column(len(own) + k).to_numpy() for k in range(3))
            sequence, slot = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
            for u in np.unique(units):
                at = np.flatnonzero(units == u)
                ranks = local[at] + np.array([base[int(u), int(p)] for p in parts[at]], dtype=np.int64)
                table = tables[int(u)]
                row = table[np.searchsorted(table[:, 0], ranks, side="right") - 1]
                sequence[at] = row[:, 1] + (ranks - row[:, 0]) // row[:, 2]
                slot[at] = row[:, 3] + (ranks - row[:, 0]) % row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(sequence), pa.array(slot)], [*own, "sequence_id", "slot"])

    placed = ranked.mapInArrow(place, ", ".join(f"{c} long" for c in own) + ", sequence_id long, slot long")
    # At most `length` pieces share a sequence.
    before_it = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before_it), F.lit(0))).drop("slot")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, keep: int = KEEP) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(cut(pieces(docs, tokenizer, end_id, length, keep), "pieces"), length)
