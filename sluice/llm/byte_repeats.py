"""Substring dedup over UTF-8 bytes: prefix-free parsing and suffix order.

Tiles (``passages``) find where 400-byte strings may recur and settle the insides of repeated passages. The
tiles at their edges go, with the bytes that their windows reach, to shards by anchor; equal strings have equal
anchors, so they meet. A shard is parsed into phrases, the suffixes of its dictionary and its parse are sorted
and combined, and neighbours in that order that share 400 bytes recur. An anchor with more than ``TILE`` such
tiles (a passage that very many documents share) would be one task's work. Its windows are counted by hash
instead, with map-side combine, which is exact as well: first in steps of ``STEP`` windows at equal distances
from the anchor, which are dropped unless the bytes that all of a step's windows hold recur, and settled if
all bytes that they reach recur; only the rest is counted window by window.

A null text is empty. Rows with null or equal ids are documents of their own, so equal rows repeat each
other. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import NO_ID, cut, keyed, release
from sluice.llm.parsing import suffix_order
from sluice.llm.passages import BYTES, Rolling, as_bytes, by_document, candidates, codes_of_bytes, covered, half_tiles_of, unsettled

WIDTH, GRAM = 400, 32
TILE = 2048
STEP = 16
#: Bytes that are parsed together.
SHARD = 1_000_000
EDGES = "kid long, kh long, anchor long, start long, n int, settled boolean, hot boolean, core long, seg long, windows array<long>, segment binary"


def steps_of(rolling: Rolling, grams: np.ndarray, anchor: int, start: int, n: int, width: int, gram: int) -> list[tuple[int, int, int, int, list[int]]]:
    """A tile's windows in steps: first window, number, hash of the bytes that every window of the step holds, hash of
    all bytes (and how many windows there are), hashes of the windows."""
    last = start + n - 1
    place = last + int(np.argmin(grams[last : last + width - gram + 1]))  # the tile's least gram
    hashes = rolling.of(np.arange(start, last + 1), np.arange(start, last + 1) + width).view(np.int64)
    out, end = [], last + 1
    while end > start:
        # Windows that begin `distance` before the least gram, for STEP distances.
        step = (place - end + 1) // STEP
        begin = max(start, place - STEP * step - STEP + 1)
        inner = place - STEP * step
        core, seg = rolling.of(np.array([inner, begin]), np.array([inner - STEP + 1 + width, end - 1 + width]))
        seg = (int(seg) * 31 + (end - begin) * 2654435761 + (place - begin) * 40503) & (1 << 64) - 1
        core = (int(core) + step * 0x9E3779B97F4A7C15 + (anchor & (1 << 64) - 1)) & (1 << 64) - 1
        signed = [x - (1 << 64) if x >= 1 << 63 else x for x in (core, seg)]
        out.append((begin, end - begin, *signed, hashes[begin - start : end - start].tolist()))
        end = begin
    return out


def edges_of(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """The bytes of each tile in ``parts``; of a hot anchor's tiles, their steps instead."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    names = ["kid", "kh", "anchor", "start", "n", "settled", "hot", "core", "seg", "windows", "segment"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kid, kh, text, parts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw, rolling, grams, out = as_bytes(text), None, None, []
                for p in parts:
                    if not p["hot"]:
                        out.append((kid, kh, p["anchor"], p["start"], p["n"], p["recurs"], False, None, None, None, raw[p["start"] : p["start"] + p["n"] + width - 1]))
                        continue
                    if rolling is None:
                        rolling = Rolling(BYTES[np.frombuffer(raw, np.uint8)])
                        grams = rolling.all(gram)
                    out += [(kid, kh, p["anchor"], at, n, p["recurs"], True, core, seg, hashes, None) for at, n, core, seg, hashes in steps_of(rolling, grams, p["anchor"], p["start"], p["n"], width, gram)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.mapInArrow(make, EDGES)


def hot_ranges(edges: DataFrame) -> DataFrame:
    """kid, kh, start, n: recurring windows of unsettled tiles whose anchors are hot, by counting."""
    steps = edges.where("hot").select("kid", "kh", "start", "n", "settled", "core", "seg", "windows")
    cores = cut(steps.groupBy("core").count().where("count > 1").select("core"), "cores")
    live = cut(steps.join(cores, "core"), "steps")
    release(cores)
    whole = cut(live.groupBy("seg").agg(F.count("*").alias("times"), F.min(F.struct("kid", "kh", "start")).alias("rep")).where("times > 1"), "segs")
    first = F.coalesce(F.struct("kid", "kh", "start") == F.col("rep"), F.lit(False))
    marked = cut(live.join(whole, "seg", "left").select("kid", "kh", "start", "n", "settled", "core", "windows", F.col("times").isNotNull().alias("recurs"), first.alias("first")), "marked")
    release(live, whole)
    open_ = marked.where("NOT recurs AND NOT settled")
    near = marked.where("(recurs AND first) OR (settled AND NOT recurs)").join(open_.select("core").distinct(), "core", "left_semi")
    each = open_.withColumn("own", F.lit(True)).unionByName(near.withColumn("own", F.lit(False)))
    each = cut(each.select("kid", "kh", "start", "own", F.posexplode("windows").alias("at", "window")), "windows")
    again = cut(each.groupBy("window").count().where("count > 1").select("window"), "again")
    counted = each.where("own").join(again, "window").select("kid", "kh", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"))
    return marked.where("recurs AND NOT settled").select("kid", "kh", "start", "n").unionByName(counted)


def recurring(segments: list[bytes], counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Of the first ``counts`` windows of each segment, those that another window of the segments equals."""
    order, shift = suffix_order(segments, width)
    total = int(sum(map(len, segments)))
    first = np.zeros(total, bool)
    for s, n in zip(shift, counts):
        first[s : s + n] = True
    order = order[first[order]]
    window = Rolling(BYTES[np.frombuffer(b"".join(segments), np.uint8)]).of(order, order + width)
    same = window[1:] == window[:-1]
    again = np.zeros(total, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return [np.flatnonzero(again[s : s + n]) for s, n in zip(shift, counts)]


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of runs of consecutive numbers."""
    begin = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1])) if len(at) else np.zeros(0, np.int64)
    return at[begin], np.diff(np.append(begin, len(at)))


def shard_ranges(edges: DataFrame, width: int) -> DataFrame:
    """kid, kh, start, n: recurring windows of unsettled tiles whose anchors aren't hot."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.where("NOT hot").select("anchor", "kid", "kh", "start", "n", "settled", "segment").repartition(n, "anchor").sortWithinPartitions("anchor")
    names = ["kid", "kh", "start", "n"]

    def parse(held: list[tuple]) -> pa.RecordBatch:
        found = recurring([h[6] for h in held], np.array([h[4] for h in held]), width)
        rows = [(h[1], h[2], h[3] + int(a), int(n)) for h, at in zip(held, found) if not h[5] for a, n in zip(*runs(at))]
        a, b, c, d = zip(*rows) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int32())], names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if size > SHARD and row[0] != held[-1][0]:
                    yield parse(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield parse(held)

    return dealt.mapInArrow(stream, "kid long, kh long, start long, n int")


def remove(rows: DataFrame, width: int) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("text", "parts")]
    frame = rows.select("text", "parts", *rest)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, spans = [], [], [], []
            for text, parts in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = as_bytes(text.as_py())
                sizes.append(len(raw))
                if not parts:
                    kept.append(raw)
                    gone.append(0)
                    spans.append([])
                    continue
                out = covered(len(raw), np.array([p["start"] for p in parts]), np.array([p["n"] for p in parts]), width)
                kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
                gone.append(int(out.sum()))
                spans.append([{"start": int(a), "length": int(n)} for a, n in zip(*runs(np.flatnonzero(out)))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                [*batch.schema.names[2:], "kept", "n_bytes", "n_removed", "spans"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in frame.dtypes[2:]) + ", kept binary, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>"
    return frame.mapInArrow(make, schema)


def without_byte_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, tile: int = TILE) -> DataFrame:
    """Per document: doc_id, kept (the bytes left), n_bytes, n_removed, spans (removed runs)."""
    found = candidates(keyed(docs), codes_of_bytes, gram, width, half_tiles_of)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"kid": F.coalesce("doc_id", F.lit(NO_ID)), "kh": F.xxhash64(F.coalesce("text", F.lit("")))})
    open_ = unsettled(found)
    hot = cut(open_.groupBy("anchor").count().where(F.col("count") > tile).select("anchor", F.lit(True).alias("hot")), "hot")
    open_ = open_.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    parts = by_document(open_, "start", "n", "anchor", "recurs", "hot")
    edges = cut(edges_of(texts.select("kid", "kh", "text").join(parts, ["kid", "kh"]), width, gram), "edges")
    ranges = found.where("recurs").select("kid", "kh", "start", "n").unionByName(shard_ranges(edges, width)).unionByName(hot_ranges(edges))
    left = texts.join(by_document(ranges, "start", "n"), ["kid", "kh"], "left").select("doc_id", "text", "parts")
    return remove(left, width)


def byte_repeat_digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = without_byte_repeats(docs, width, gram)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
