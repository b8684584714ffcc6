"""Substring dedup over words: recurring passages, Aho-Corasick automata, every occurrence.

Recurring 35-word windows are confirmed by counting (``passages``). Documents then meet the confirmed windows
that they may hold in shards; each shard compiles the anchor phrases of its confirmed windows into an
Aho-Corasick automaton and streams its documents' whole texts through it. Around every phrase found, the windows
that hold it are compared with the shard's confirmed windows, and the words under those that match are removed.

A null or empty text has no words. Rows with null or equal ids are documents of their own, so equal rows repeat
each other. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import NO_ID, cut, keyed, packed
from sluice.llm.passages import Rolling, as_bytes, by_document, candidates, codes_of_words, covered, least, unsettled, word_codes

WIDTH, GRAM = 35, 8
#: Bytes of text that share one automaton.
SHARD = 4_000_000


def windows_of(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """kid, kh, at, window (hash), settled: of every window of the tiles in ``parts``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kid, kh, text, parts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rolling = Rolling(codes_of_words(text))
                n = np.array([p["n"] for p in parts])
                at = np.repeat(np.array([p["start"] for p in parts]) - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hashes = rolling.of(at, at + width).view(np.int64)
                settled = np.repeat(np.array([p["recurs"] for p in parts], bool), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kid)), pa.array(np.full(len(at), kh)), pa.array(at), pa.array(hashes), pa.array(settled)], ["kid", "kh", "at", "window", "settled"])

    return rows.mapInArrow(make, "kid long, kh long, at long, window long, settled boolean")


class Shard:
    """Confirmed windows and anchor phrases of some documents."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram
        self.automaton, self.windows = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), []

    def learn(self, words: list[str], rolling: Rolling, starts: np.ndarray, counts: np.ndarray) -> None:
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        self.windows.append(rolling.of(at, at + self.width))
        grams = rolling.all(self.gram)
        anchors = np.unique(least(grams, self.width - self.gram + 1)[at])
        order = np.argsort(grams, kind="stable")
        for j in order[np.searchsorted(grams[order], anchors)]:
            self.automaton.add_word(f" {' '.join(words[j : j + self.gram])} ")

    def compile(self) -> None:
        self.automaton.make_automaton()
        self.windows = np.unique(np.concatenate(self.windows))

    def locate(self, words: list[str], rolling: Rolling) -> np.ndarray:
        """Starts of all confirmed windows in a text."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        found = np.fromiter((e for e, _ in self.automaton.iter(f" {' '.join(words)} ")), np.int64)
        gram = np.unique(np.searchsorted(ends, found)) - self.gram + 1
        n = len(words) - self.width + 1
        edge = np.zeros(len(words) + 2, np.int64)
        np.add.at(edge, np.maximum(gram - (self.width - self.gram), 0), 1)
        np.add.at(edge, gram + 1, -1)
        at = np.flatnonzero(np.cumsum(edge)[:n] > 0)
        hashes = rolling.of(at, at + self.width)
        place = np.minimum(np.searchsorted(self.windows, hashes), len(self.windows) - 1)
        return at[self.windows[place] == hashes]


def remove(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """Stream documents with the windows confirmed for them (``parts``, null if none) through shard automata.
    rows: own (a struct with text), parts."""

    def shard(part: pa.RecordBatch) -> pa.RecordBatch:
        found, shard = [], Shard(width, gram)
        for text, parts in zip(part.column(0).field("text").to_pylist(), part.column(1).to_pylist()):
            words = as_bytes(text).split()
            if not parts:
                found.append((None, None, b" ".join(words).decode("utf-8", "surrogatepass"), len(words)))
                continue
            rolling, plain = Rolling(word_codes(words)), [w.decode("utf-8", "surrogatepass") for w in words]
            shard.learn(plain, rolling, np.array([p["start"] for p in parts]), np.array([p["n"] for p in parts]))
            found.append((plain, rolling, None, len(words)))
        if shard.windows:
            shard.compile()
        kept, sizes, removed = [], [], []
        for words, rolling, whole, n in found:
            gone = 0
            if words is not None:
                at = shard.locate(words, rolling)
                out = covered(n, at, np.ones(len(at), np.int64), width)
                gone = int(out.sum())
                whole = " ".join([words[i] for i in np.flatnonzero(~out)])
            kept.append(whole)
            sizes.append(n)
            removed.append(gone)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], ["own", "kept", "n_words", "n_removed"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = size = 0
            for row, text in enumerate(batch.column(0).field("text")):
                size += len(text.as_py() or "")
                if size > SHARD or row == batch.num_rows - 1:
                    yield shard(batch.slice(begin, row + 1 - begin))
                    begin, size = row + 1, 0

    return rows.mapInArrow(stream, T.StructType([rows.schema["own"], T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """own (a struct of docs' columns), kept (the words left, joined by one space), n_words, n_removed."""
    found = candidates(keyed(docs), codes_of_words, gram, width)
    texts = docs.select(packed(docs).alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("kid"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("kh"))
    open_ = texts.select("kid", "kh", "own.text").join(by_document(unsettled(found), "start", "n", "recurs"), ["kid", "kh"])
    windows = cut(windows_of(open_, width, gram), "windows")
    confirmed = cut(windows.groupBy("window").count().where("count > 1").select("window"), "confirmed")
    hits = windows.where("NOT settled").join(confirmed, "window").select("kid", "kh", F.col("at").alias("start"), F.lit(1).alias("n"))
    ranges = by_document(found.where("recurs").select("kid", "kh", "start", "n").unionByName(hits), "start", "n")
    return remove(texts.join(ranges, ["kid", "kh"], "left").select("own", "parts"), width, gram)


def word_repeat_digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return without_repeats(slim, width, gram).select("own.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
