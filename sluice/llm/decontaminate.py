"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers, units after a number, and names (capitalised words
that don't begin a sentence) become typed placeholders, whose words are slots. Five-word windows of the
resulting templates are hash-joined with the items' windows. A document is a leak of an item if at least
``SIMILARITY`` of the item's windows occur in a copy whose slots are consistent: one word of the item always
stands for one word of the document and the other way round. So verbatim copies match (every slot keeps its
word), and so do questions with other numbers or names. A document may hold several copies and stray windows; one
consistent copy is enough.

A window without a literal word says little, so it counts only where its slots keep their words.

Items' different texts come to the driver in blocks of about ``BLOCK`` bytes (a stated query set against all rows),
and each block's windows go to the executors as a hash table; documents are read once a block, never shuffled.

A null or empty text, and an item without words, match nothing. An item of fewer than five words is one window,
found only verbatim: "42" leaks from texts that hold 42, not from all that hold a number. Null and repeated
doc_ids are rows of their own; repeated items give repeated pairs. An empty table on
either side gives no pairs. Columns other than doc_id, text, item_id are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.caches import kept
from sluice.llm.common import packed

WIDTH = 5
SIMILARITY = 0.8
BLOCK = 8_000_000
STRIPPED = ".,;:!?\"'()[]{}<>*_#&%$-–—…«»“”‘’"
NUMBER = re.compile(r"[+\-]?[$€£¥]?\d[\d.,:/]*(?:st|nd|rd|th|[a-zµ°%]{1,3})?", re.I)
UNITS = frozenset(
    "% kg g mg lb lbs oz t ton tons km m cm mm nm mi mile miles ft foot feet inch inches in yd yards l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents pound pounds usd eur gbp hz khz mhz w kw v a k c f percent degrees degree kmh mph".split()
)
LITERAL, NUMERAL, UNIT, CAPITAL = range(4)
#: Template codes of the placeholders.
CODES = {NUMERAL: 0x51AB7C1D9E3F0261, UNIT: 0x2F8D16E4B09A7C35, CAPITAL: 0x6E0C93A5D147F82B}
MIX = np.uint64(0x9E3779B97F4A7C15)


def kind_of(word: str) -> tuple[str, int, bool]:
    """The stripped lower-case word, what it can be, and whether it ends a sentence."""
    bare = word.strip(STRIPPED)
    ends = word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":", "…")
    if not bare:
        return word, LITERAL, ends
    if NUMBER.fullmatch(bare):
        return bare.lower(), NUMERAL, ends
    if bare.lower() in UNITS:
        return bare.lower(), UNIT, ends
    if len(bare) > 1 and bare[0].isupper():
        return bare.lower(), CAPITAL, ends
    return bare.lower(), LITERAL, ends


class _Kinds(dict):
    """Word to a number; the words' codes, kinds and sentence ends by number."""

    def __init__(self, keep: int = 200_000):
        super().__init__()
        self.keep, self.rows = keep, []
        self.codes, self.kinds, self.ends = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool)

    def __missing__(self, word: bytes) -> int:
        bare, kind, ends = kind_of(word.decode("utf-8", "surrogatepass"))
        self.rows.append((word, xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")), kind, ends))
        self[word] = found = len(self)
        return found

    def templates(self, texts: list[str | None]) -> list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """Words, template codes, whether each word is a slot, and the words' own codes, of every text."""
        lists = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        get = self.__getitem__
        numbers = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in lists]
        if self.rows:
            _, codes, kinds, ends = zip(*self.rows)
            self.codes, self.kinds, self.ends = (np.concatenate([old, np.array(new, old.dtype)]) for old, new in ((self.codes, codes), (self.kinds, kinds), (self.ends, ends)))
        out = []
        for ws, n in zip(lists, numbers):
            own, kinds, ends = self.codes[n], self.kinds[n], self.ends[n]
            codes = own.copy()
            begins = np.concatenate([[True], ends[:-1]])[: len(n)]
            after_number = np.concatenate([[False], kinds[:-1] == NUMERAL])[: len(n)]
            slot = np.zeros(len(n), bool)
            for kind, at in ((NUMERAL, kinds == NUMERAL), (UNIT, (kinds == UNIT) & after_number), (CAPITAL, (kinds == CAPITAL) & ~begins)):
                codes[at] = CODES[kind]
                slot |= at
            out.append((ws, codes, slot, own))
        extra = len(self) - self.keep
        if extra > 0:
            for row in self.rows[len(self.rows) - extra :]:
                del self[row[0]]
            self.codes, self.kinds, self.ends = self.codes[: self.keep], self.kinds[: self.keep], self.ends[: self.keep]
        self.rows = []
        return out


def window_codes(codes: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(codes) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * MIX + codes[i : i + n]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = []
        tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for (item_id, _), (words, codes, slot, plain) in zip(items, _Kinds().templates([t for _, t in items])):
            if not words:
                continue
            width = min(WIDTH, len(words))
            # Of a short item the words themselves, not their template.
            found = window_codes(codes if width == WIDTH else plain, width)
            tables.setdefault(width, []).append((found, np.full(len(found), len(self.items)), np.arange(len(found))))
            self.items.append((item_id, [w.decode("utf-8", "surrogatepass").strip(STRIPPED).lower() for w in words], slot if width == WIDTH else slot & False, width, len(found)))
        self.tables = {}
        for width, parts in tables.items():
            code, item, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(code, kind="stable")
            self.tables[width] = (code[order], item[order], place[order])
        self.kinds = _Kinds()

    def match(self, texts: list[str | None], similarity: float = SIMILARITY) -> list[list[tuple[int | None, float, int]]]:
        """For each text: the items it leaks, the share of their windows, and how many slots have other words."""
        out = []
        for words, codes, _, plain in self.kinds.templates(texts):
            leaks = []
            for width, (code, item, place) in self.tables.items():
                found = window_codes(codes if width == WIDTH else plain, width)
                low = np.searchsorted(code, found)
                hits = np.flatnonzero((low < len(code)) & (code[np.minimum(low, len(code) - 1)] == found))
                if not len(hits):
                    continue
                low, high = low[hits], np.searchsorted(code, found[hits], side="right")
                counts = high - low
                row = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                at = np.repeat(hits, counts)
                # Distinct windows of an item that occur are counted first; few items have enough.
                key = np.unique(item[row] * (1 << 32) + place[row])
                which, n = np.unique(key >> 32, return_counts=True)
                for i, share in zip(which, n / np.array([self.items[i][4] for i in which])):
                    if share >= similarity:
                        own = item[row] == i
                        copy = self._copy(self.items[i], words, at[own], place[row][own], similarity)
                        if copy is not None:
                            leaks.append((self.items[i][0], *copy))
            out.append(leaks)
        return out

    def _copy(self, item: tuple, words: list[bytes], at: np.ndarray, place: np.ndarray, similarity: float) -> tuple[float, int] | None:
        """The share of the item's windows in a copy with consistent slots and how many of these have other words, or
        None if no copy has enough. Every shift between item and document may be a copy's, those with most windows
        first; the windows of other shifts (words were put in or left out) belong to it if they are consistent with it,
        the nearest first. What has all its windows consistent wherever they are first read is a copy as well."""
        off = at - place
        shifts, n = np.unique(off, return_counts=True)
        shifts = shifts[np.argsort(-n, kind="stable")]
        for shift in shifts:
            order = np.lexsort((place, off, np.abs(off - shift)))
            cuts = np.flatnonzero(np.diff(off[order], prepend=off[order[0]] - 1))
            found = self._read(item, words, [list(zip(place[k].tolist(), at[k].tolist())) for k in np.split(order, cuts[1:])], similarity)
            if found is not None:
                return found
        order = np.lexsort((at, off != shifts[0], place))
        first = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
        return self._read(item, words, [list(zip(place[first].tolist(), at[first].tolist()))], similarity)

    def _read(self, item: tuple, words: list[bytes], runs: list[list[tuple[int, int]]], similarity: float) -> tuple[float, int] | None:
        """The copy that begins with the first run of (place, at). Later runs add the places that have none yet, if all
        of these are consistent; else they lie outside it."""
        _, own, own_slot, width, total = item
        to: dict[str, str] = {}
        back: dict[str, str] = {}
        changed: set[int] = set()
        filled: set[int] = set()

        def consistent(run: list[tuple[int, int]], to: dict[str, str], back: dict[str, str], changed: set[int]) -> bool:
            for p, q in run:
                verbatim = own_slot[p : p + width].all()
                for j in range(width):
                    if own_slot[p + j]:
                        a, b = own[p + j], words[q + j].decode("utf-8", "surrogatepass").strip(STRIPPED).lower()
                        if verbatim and a != b or to.setdefault(a, b) != b or back.setdefault(b, a) != a:
                            return False
                        if a != b:
                            changed.add(p + j)
            return True

        for k, run in enumerate(runs):
            run = [x for x in run if x[0] not in filled]
            tried = dict(to), dict(back), set(changed)
            if run and consistent(run, *tried):
                to, back, changed = tried
                filled.update(p for p, _ in run)
            elif k == 0:
                return None
        share = len(filled) / total
        return (share, len(changed)) if share >= similarity else None


def matcher(name: str, items: list[tuple[int | None, str | None]]) -> Matcher:
    """The worker's matcher of a block."""
    return kept(("matcher", name), lambda: Matcher(items))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, text, key: equal for equal texts."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.xxhash64("text").alias("key")).where("text IS NOT NULL")


def blocks(items: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items' different texts (key, text), about ``block`` bytes at a time."""
    texts = items.groupBy("key").agg(F.first("text").alias("text"))
    n = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block)
    for k in range(n):
        yield [tuple(r) for r in texts.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k).sort("key").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Pairs: doc_id, item_id, similarity (share of the item's windows), changed_slots."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, key long, similarity double, changed_slots long"
    items = items_of(benchmark)
    out = spark.createDataFrame([], schema)
    for part in blocks(items, block):
        shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def match(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            m = matcher(name, shared.value)
            for batch in batches:
                found = m.match(batch.column(1).to_pylist(), similarity)
                pairs = [(d, *x) for d, xs in zip(batch.column(0).to_pylist(), found) for x in xs]
                a, b, c, d = zip(*pairs) if pairs else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64()), pa.array(d, pa.int64())], ["doc_id", "key", "similarity", "changed_slots"])

        out = out.union(rows.mapInArrow(match, schema))
    return out.join(items.select("item_id", "key"), "key").select("doc_id", "item_id", "similarity", "changed_slots")


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    spark = docs.sparkSession
    rows = docs.select(packed(docs).alias("own"))
    for part in blocks(items_of(benchmark), block):
        shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            m = matcher(name, shared.value)
            for batch in batches:
                clean = [not x for x in m.match(batch.column(0).field("text").to_pylist(), similarity)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        rows = rows.mapInArrow(keep, rows.schema)
    return rows.select("own.*")
