"""SimHash near-duplicates by BK-trees.

Two fingerprints within ``radius`` bits agree on at least one choice of blocks: bits are cut into m blocks, and
m - radius blocks are sure to be equal. So every fingerprint joins a shard for each choice, and a BK-tree of
each shard finds the links. More fingerprints make more and longer choices, which keeps shards small. A shard
beyond ``TILE`` fingerprints (a group of near copies) is cut into tiles: the tree of one tile is searched by
another, for each pair of tiles, in tasks of bounded size. A task gives at most one link for each fingerprint of
its shard, to the smallest it can be reached from, so groups never become all their pairs.

Shard trees aren't broadcast: together they hold every fingerprint, which has no bound, so queries and trees
meet by a shuffle on the shard.

A null or empty text has fingerprint zero, linked like any other. component_id is the smallest doc_id that isn't
null. Null and repeated doc_ids are rows of their own. An empty table gives no rows. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bktree import Forest, join_labels
from sluice.llm.common import NO_ID, components, cut, packed

TILE = 4096
#: Mean fingerprints in a shard beyond which choices get longer.
SHARD = 1000
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
PLACES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> bytes:
    """8 bytes, the highest first: a bit is set if over half of the shingles' XXH64 have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_digest
    counts = np.zeros(2048, np.int64)
    last = min(width, len(words)) - 1
    for k in range(0, n, 1 << 16):
        pairs = zip(begins[k : min(n, k + (1 << 16))].tolist(), ends[last + k : last + min(n, k + (1 << 16))].tolist())
        raw = b"".join([digest(joined[a:b], seed) for a, b in pairs])
        counts += np.bincount((np.frombuffer(raw, np.uint8).reshape(-1, 8) + PLACES).ravel(), minlength=2048)
    ones = np.einsum("pv,vb->pb", counts.reshape(8, 256), BITS).ravel()
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """docs' columns other than text, and fp: the fingerprint as a signed 64-bit integer."""
    rest = [c for c in docs.columns if c != "text"]
    frame = docs.select("text", *rest)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(t.as_py(), width) for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], [*batch.schema.names[1:], "fp"])

    return frame.mapInArrow(make, ", ".join(f"`{n}` {t}" for n, t in frame.dtypes[1:]) + ", fp long")


def choices(n: int, radius: int) -> list[int]:
    """Masks of the block choices for n fingerprints, as signed 64-bit integers."""
    for m in range(radius + 1, 65):
        kept = m - radius
        if kept * (64 // m) >= 40 or n / 2 ** (64 * kept / m) <= SHARD:
            break
    edges = [64 * k // m for k in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, kept)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in masks]


def shards(values: DataFrame, key: list[str], tile: int = TILE, weight: str | None = None, most: int = 1) -> DataFrame:
    """Rows (key columns, fp, ...) with tile numbers: own, and lo <= hi of each pair of tiles that must meet.
    Shards of at most ``tile`` rows, and ``most`` of the sum of ``weight``, have the one pair (0, 0)."""
    tiles = F.ceil(F.count("*") / tile)
    if weight:
        tiles = F.greatest(tiles, F.ceil(F.sum(weight) / most))
    large = values.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(tiles.cast("int").alias("tiles")).where("tiles > 1")
    large = cut(large, "large")
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    both = values.join(large, on, "left").drop(*(f"_{k}" for k in key)).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    both = both.withColumn("own", F.pmod(F.xxhash64(F.lit(1), *values.columns), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return both.withColumn("other", other).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "tiles")


def grouped(batches: Iterator[pa.RecordBatch], keys: int, least: int = 1 << 15) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups (rows alike in the first ``keys`` columns, which the input is sorted by), at least
    ``least`` rows at a time, after a column that numbers the groups."""
    held: list[list[np.ndarray]] = []
    size = 0

    def numbered(columns: list[np.ndarray]) -> list[np.ndarray]:
        new = np.zeros(len(columns[0]), bool)
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        return [np.cumsum(new), *columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size < least:
            continue
        columns = numbered([np.concatenate(c) for c in zip(*held)])
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last:
            yield [c[:last] for c in columns]
            held, size = [[c[last:] for c in columns[1:]]], len(columns[0]) - last
    if held:
        yield numbered([np.concatenate(c) for c in zip(*held)])


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` that connect what chains of links within the radius connect."""
    masks = choices(fps.count(), radius)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))).alias("x"))
    tiled = shards(keyed.select("x.c", "x.k", "fp"), ["c", "k"], tile).select("c", "k", "lo", "hi", "own", "fp")
    dealt = tiled.repartition(n, "c", "k", "lo", "hi").sortWithinPartitions("c", "k", "lo", "hi", "own", "fp")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _, _, lo, hi, own, fp in grouped(batches, 4):
            values, label = fp.astype(np.int64).view(np.uint64), np.arange(len(fp))
            tree = np.flatnonzero(own == lo)
            forest = Forest(values[tree], group[tree])
            asking = np.flatnonzero(own == hi)
            for q, v, _ in forest.search(values[asking], group[asking], radius):
                label = join_labels(label, asking[q], tree[v])
            linked = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], ["a", "b"])

    return dealt.mapInArrow(find, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    made = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width), "fingerprints")
    each = cut(made.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(each.select("fp"), radius))
    rooted = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "roots")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicate groups by shingle similarity, for filtering a corpus.

WIDTH, SIMILARITY = 5, 0.8
#: Least shingles (under different hashes) of a text; two texts at the similarity share any of them with its chance.
LEAST = 7
#: Shingles that are compared together, and of a tile.
PORTION = 1 << 22
#: Bits beyond which texts aren't compared. At a similarity of 0.8 fingerprints differ in 10 bits, give or take 3; of 4
#: against 5 shingles one pair in a million lies beyond the radius, of more shingles fewer.
RADIUS = 28
ODD = np.random.default_rng(11).integers(1 << 62, size=LEAST, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the different shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last, digest = min(width, len(words)) - 1, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(begins, ends[last:].tolist())), np.uint64))


def sketch(text: str | None) -> tuple[int, list[int]]:
    """Fingerprint of the set of shingles, and its least ones under each hash."""
    hashes = shingles(text)
    if not len(hashes):
        return 0, [0] * LEAST
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((raw + PLACES).ravel(), minlength=2048)
    ones = np.einsum("pv,vb->pb", counts.reshape(8, 256), BITS).ravel()
    fp = np.packbits(2 * ones > len(hashes)).view(">i8")[0]
    return int(fp), [int((hashes * m).min().view(np.int64)) for m in ODD]


def similar_links(values: np.ndarray, group: np.ndarray, tree: np.ndarray, asking: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links to the smallest text of each part that similar pairs within the radius connect. Texts have ``sizes`` of the
    ``hashes`` of shingles each, one after the other. A pair links by its Jaccard similarity only, and every pair of the
    radius is tested unless its texts are connected already, so a pair that fails hides no other."""
    forest, label = Forest(values[tree], group[tree]), np.arange(len(values))
    ids = np.unique(hashes, return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first, last = np.searchsorted(group, group), np.searchsorted(group, group, side="right")
    mark = np.zeros(len(ids) + 1, bool)
    for q, v, _ in forest.search(values[asking], group[asking], radius):
        a, b = asking[q], tree[v]
        # Sets of too different sizes can't be similar.
        open_ = (label[a] != label[b]) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]))
        a, b = a[open_], b[open_]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            one = a[low]
            own = ids[begins[one] : ends[one]]
            mark[own] = True
            step = max(1, PORTION // max(1, int(sizes[b[low:high]].max())))
            for k in range(low, high, step):
                others = b[k : min(high, k + step)]
                others = others[label[others] != label[one]]
                if not len(others):
                    continue
                n = sizes[others]
                until = np.cumsum(n)
                place = np.repeat(begins[others] - (until - n), n) + np.arange(until[-1])
                hits = np.concatenate([[0], np.cumsum(mark[ids[place]])])
                both = hits[until] - hits[until - n]
                near = others[both >= similarity * (len(own) + n - both)]
                if len(near):
                    here = label[first[one] : last[one]]
                    joined = np.append(label[near], label[one])
                    here[np.isin(here, joined)] = joined.min()
            mark[own] = False
    linked = np.flatnonzero(label != np.arange(len(values)))
    return linked, label[linked]


def shared_choices(distinct: DataFrame) -> DataFrame:
    """(key, fp, k): a k for each two least shingles of a text that another text shares."""
    choices_ = [(i, j) for i in range(LEAST) for j in range(i)]
    keyed_ = distinct.select("key", "fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.lit(j), F.col("least")[i], F.col("least")[j]) for i, j in choices_))).alias("k"))
    shared = cut(keyed_.groupBy("k").count().where("count > 1").select("k"), "shared")
    return keyed_.join(shared, "k")


def candidate_links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) of ``key`` that connect all that may be near-duplicates: texts sharing two least shingles whose
    fingerprints a BK-tree of the shard finds within the radius. Two similar texts are in one part, but not all of a
    part is similar."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiled = shards(shared_choices(distinct), ["k"], tile).select("k", "lo", "hi", "own", "fp", "key")
    dealt = tiled.repartition(n, "k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "own", "fp")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _, lo, hi, own, fp, key in grouped(batches, 3):
            values, label = fp.astype(np.int64).view(np.uint64), np.arange(len(fp))
            tree, asking = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            forest = Forest(values[tree], group[tree])
            for q, v, _ in forest.search(values[asking], group[asking], RADIUS):
                label = join_labels(label, asking[q], tree[v])
            linked = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(key[linked]), pa.array(key[label[linked]])], ["a", "b"])

    return dealt.mapInArrow(find, "a long, b long").where("a <> b").distinct()


def similar_pairs(distinct: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Links (a, b) of ``key`` that connect what chains of similar texts connect. Each part of the candidates meets as a
    whole, a part beyond ``tile`` texts by the least shingles again, and its texts (key, text) are compared there."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = components(candidate_links(distinct, tile))
    members = cut(distinct.join(parts, distinct["key"] == parts["node"]).select("key", "fp", "least", "root"), "members")
    large = members.groupBy("root").count().where(F.col("count") > tile).select("root")
    small = members.join(large, "root", "left_anti").select("key", "fp", F.xxhash64("root").alias("k"))
    places = small.unionByName(shared_choices(members.join(large, "root", "left_semi")).select("key", "fp", "k"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "size", "hashes"])

    sets = texts.join(members.select("key"), "key", "left_semi").dropDuplicates(["key"]).select("key", "text").mapInArrow(make, "key long, size long, hashes binary")
    placed = cut(places.join(sets, "key").select("k", "fp", "key", "size", "hashes"), "sets")
    numbered = shards(placed.select("k", "fp", "key", "size", "hashes"), ["k"], tile, "size", PORTION)
    dealt = numbered.select("k", "lo", "hi", "own", "fp", "key", "hashes").repartition(n, "k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "own", "fp")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _, lo, hi, own, fp, key, raw in grouped(batches, 3, 1 << 11):
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
            tree, asking = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            a, b = similar_links(fp.astype(np.int64).view(np.uint64), group, tree, asking, np.frombuffer(b"".join(raw), np.uint64), sizes, similarity, RADIUS)
            yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b])], ["a", "b"])

    return dealt.mapInArrow(find, "a long, b long").where("a <> b").distinct()


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """The documents without all but one of each group of near-duplicates: texts linked by shingle sets (five
    lower-cased words) whose Jaccard similarity is at least ``similarity``. The smallest doc_id stays, a null one only
    if the group has no other.

    Texts without words are one group. Equal rows are copies. A pair links only by its whole texts, in
    ``similar_pairs``.
    """
    rows = docs.select(packed(docs).alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_kid"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, least = zip(*(sketch(t.as_py()) for t in batch.column(2))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(least, pa.list_(pa.int64()))], ["kid", "key", "fp", "least"])

    # ``key`` stands for a text.
    made = cut(rows.select("_kid", "_key", "own.text").mapInArrow(make, "kid long, key long, fp long, least array<long>"), "sketches")
    distinct = made.groupBy("key").agg(F.first("fp").alias("fp"), F.first("least").alias("least"))
    texts = rows.select(F.col("_key").alias("key"), "own.text")
    roots = components(similar_pairs(distinct, texts, similarity, tile))
    # Real ids come before null ones.
    low = made.groupBy("key").agg(F.min(F.struct((F.col("kid") == NO_ID).alias("none"), "kid")).alias("low")).select("key", "low.*")
    grouped_ = low.join(roots, low["key"] == roots["node"], "left").select("key", "none", "kid", F.coalesce("root", "key").alias("root"))
    stay = grouped_.groupBy("root").agg(F.min(F.struct("none", "kid", "key")).alias("x")).select(F.col("x.kid").alias("_kid"), F.col("x.key").alias("_key"))
    stay = cut(stay, "stay")
    return rows.join(stay, ["_kid", "_key"], "left_semi").dropDuplicates(["_kid", "_key"]).select("own.*")
