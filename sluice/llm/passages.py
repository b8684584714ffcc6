"""Recurring windows of a corpus, found by content-defined tiles.

A window is ``width`` consecutive units (words or bytes) of one document. Every window has a least gram (by
hash, of ``gram`` units; the leftmost of equals); consecutive windows with the same one form a tile, whose anchor
is that hash.
Equal windows have equal anchors wherever they stand, so only tiles whose anchor recurs can hold a recurring
window; there are about 2 / (width - gram) tiles a unit. A tile whose whole segment recurs recurs in all its
windows. What remains, tiles at the edges of repeated passages, is looked into window by window.

All counts are hash aggregations with map-side combine and all joins equi-joins on hashes, so a passage that a
third of all documents share is no single task's work. Hashes have 64 bits; segments are told apart by two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.caches import kept
from sluice.llm.common import cut, release

MULTIPLIER = 0x9E3779B97F4A7C15
#: Windows of a text that are tiled at a time.
CHUNK = 1 << 20
BYTES = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)

_powers = {MULTIPLIER: np.ones(1, np.uint64), pow(MULTIPLIER, -1, 1 << 64): np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.multiply.accumulate(grown)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretch of a sequence of codes, alike wherever the stretch stands."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(MULTIPLIER, n), dtype=np.uint64)])
        self.back = powers(pow(MULTIPLIER, -1, 1 << 64), n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.back[:n])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + n])


def tiles_of(codes: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each tile: its first window, its number of windows, its anchor and the hash of its segment."""
    out = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64, np.uint64)]
    for at in range(0, len(codes) - width + 1, CHUNK):
        rolling = Rolling(codes[at : at + CHUNK + width - 1])
        grams = rolling.all(gram)
        anchors = least(grams, width - gram + 1)
        # A window that begins with its least gram is the last with that one, even if an equal gram follows.
        begin = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (grams[: len(anchors) - 1] == anchors[:-1])]))
        end = np.append(begin[1:], len(anchors))
        found = (begin + at, end - begin, anchors[begin], rolling.of(begin, end - 1 + width) + (end - begin).astype(np.uint64) * np.uint64(MULTIPLIER))
        for o, f in zip(out, found):
            o.append(f)
    return tuple(np.concatenate(o) for o in out)


def half_tiles_of(codes: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``tiles_of``, each tile cut in two by which side of its least gram has more of the window. Windows of a half hold the
    same stretch of about half a window beside the gram, whose hash is the half's anchor: it seldom recurs by chance."""
    out, room = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64, np.uint64)], width - gram
    before = room // 2
    for at in range(0, len(codes) - width + 1, CHUNK):
        rolling = Rolling(codes[at : at + CHUNK + width - 1])
        grams = rolling.all(gram)
        least_ = least(grams, room + 1)
        begin = np.flatnonzero(np.concatenate([[True], (least_[1:] != least_[:-1]) | (grams[: len(least_) - 1] == least_[:-1])]))
        end = np.append(begin[1:], len(least_))
        # Where the least gram stands: a lesser one came in at the end of the first window, or the last begins with it.
        place = np.where(np.append(False, least_[begin[1:]] < least_[begin[1:] - 1]), begin + room, np.where(grams[end - 1] == least_[begin], end - 1, -1))
        rest = np.flatnonzero(place < 0)
        for k in range(0, len(rest), 1024):
            some = rest[k : k + 1024]
            place[some] = end[some] - 1 + np.argmax(grams[(end[some] - 1)[:, None] + np.arange(room + 1)] == least_[begin[some]][:, None], axis=1)
        middle = np.clip(place - before + 1, begin, end)
        left, right = np.flatnonzero(middle > begin), np.flatnonzero(middle < end)
        first, after = np.concatenate([begin[left], middle[right]]), np.concatenate([middle[left], end[right]])
        a, b = np.concatenate([place[left] - before, place[right]]), np.concatenate([place[left] + gram, place[right] + width - before + 1])
        found = (first + at, after - first, rolling.of(a, b), rolling.of(first, after - 1 + width) + (after - first).astype(np.uint64) * np.uint64(MULTIPLIER))
        for o, f in zip(out, found):
            o.append(f)
    return tuple(np.concatenate(o) for o in out)


class _Codes(dict):
    """Word to its hash; keeps the first ``keep`` words."""

    def __init__(self, keep: int = 300_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < self.keep:
            self[word] = found
        return found


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(kept("word codes", _Codes).__getitem__, words), np.uint64, len(words))


def codes_of_words(text: str | None) -> np.ndarray:
    return word_codes(as_bytes(text).split())


def codes_of_bytes(text: str | None) -> np.ndarray:
    return BYTES[np.frombuffer(as_bytes(text), np.uint8)]


def candidates(docs: DataFrame, codes: Callable[[str | None], np.ndarray], gram: int, width: int, tiling: Callable = tiles_of) -> DataFrame:
    """Tiles with a recurring anchor: kid, kh, start, n (windows), anchor, recurs (the whole segment does), and
    first (no tile with this segment comes before it). docs are ``keyed``."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kid", "kh", "start", "n", "anchor", "seg"]
        for batch in batches:
            kid, kh = (batch.column(k).to_numpy() for k in (0, 1))
            parts, held = [], 0
            for i, text in enumerate(batch.column(2)):
                found = tiling(codes(text.as_py()), gram, width)
                parts.append((np.full(len(found[0]), i), *found))
                held += len(found[0])
                if held > 50_000 or i == batch.num_rows - 1:
                    row, start, n, anchor, seg = (np.concatenate(p) for p in zip(*parts))
                    yield pa.RecordBatch.from_arrays([pa.array(kid[row]), pa.array(kh[row]), pa.array(start), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64))], names)
                    parts, held = [], 0

    tiles = cut(docs.select("kid", "kh", "text").mapInArrow(tile, "kid long, kh long, start long, n int, anchor long, seg long"), "tiles")
    # Written first: a join of two shuffles can split a key that very many rows share, one after an aggregation can't.
    again = cut(tiles.groupBy("anchor").count().where("count > 1").select("anchor"), "again")
    found = cut(tiles.join(again, "anchor"), "anchored")
    release(tiles, again)
    # Segments are the same if their hashes and their anchors' are: chance alone would need both to meet.
    whole = cut(found.groupBy("anchor", "seg").agg(F.count("*").alias("times"), F.min(F.struct("kid", "kh", "start")).alias("rep")).where("times > 1"), "whole")
    marked = found.join(whole, ["anchor", "seg"], "left").select(
        "kid", "kh", "start", "n", "anchor", F.col("times").isNotNull().alias("recurs"), F.coalesce(F.struct("kid", "kh", "start") == F.col("rep"), F.lit(False)).alias("first")
    )
    out = cut(marked, "candidates")
    release(found, whole)
    return out


def unsettled(found: DataFrame) -> DataFrame:
    """Of ``candidates``: those whose segment doesn't recur, and, where their anchors have such tiles, one of every
    segment that does."""
    open_ = found.where("NOT recurs")
    near = found.where("first").join(open_.select("anchor").distinct(), "anchor", "left_semi")
    return open_.unionByName(near)


def by_document(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """One row for each document: its different (start, ...) structs. A document's own length bounds them."""
    return rows.groupBy("kid", "kh").agg(F.collect_set(F.struct(*columns)).alias("parts"))


def covered(n: int, starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Units under any of the windows starts .. starts + counts - 1."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts - 1 + width, n), -1)
    return np.cumsum(edge)[:n] > 0
