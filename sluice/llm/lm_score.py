"""Whole-document log probabilities: corpus counts and a recurrent model over them.

Counts of every word of every training document are made once (partitions add up their own first). The
``WORDS`` most frequent words are the recurrent model's; all others belong to one of ``RARE`` classes by their last
bytes, in which a word's probability is its share, (count + 1) / (tokens + words + 1) of the class. A table of the
``HEAD`` most frequent words' counts goes to the executors; words beyond it meet their counts by a join on the word.

The recurrent model learns from all training documents, whole: each round from its turn of them by hash, a third where
there are three rounds (more where that holds less than ``LEAST`` tokens: small corpora are read in every round). Executors train: a
round's documents are dealt to trainers of about ``PORTION`` tokens, every trainer goes through its own from the common weights, and
their mean, each counted by its tokens, is the next round's start. Means are taken in a tree, ``FAN`` at a time, so neither a task
nor the driver ever holds more than that many weights.

A null or empty text is its end alone. Null and repeated doc_ids are rows of their own (a null id's text for
the held-out rule is empty). Without training documents every count is 0. An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import recurrent_lm as lm
from sluice.llm.caches import kept
from sluice.llm.common import cut, held_out, keyed, release

WORDS, RARE = 2047, 16
HEAD = 200_000
#: A round reads one in so many training documents, by turns (rounds together all of them); tokens of a round at least, and
#: of one trainer in a round.
EVERY, LEAST, PORTION = 3, 600_000, 2_400_000
#: Learning rates of the rounds.
RATES = (0.01, 0.01, 0.005)
FAN = 32
#: Bytes of text that are read and scored together.
SCORED = 8_000_000


#: Classes of words of one byte, and of longer ones by their last two.
_ENDS = np.array([zlib.crc32(bytes([a])) % RARE for a in range(256)]), np.array([zlib.crc32(bytes([a, b])) % RARE for a in range(256) for b in range(256)])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, A-Z lower-cased, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words, sizes = lists.flatten().cast(pa.binary()), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    real = pc.binary_length(words).to_numpy() > 0  # before, between and after white space there may be nothing
    if not real.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        words = words.filter(pa.array(real))
    return words, sizes


def rare_classes(words: pa.Array) -> np.ndarray:
    """Of each word (not empty) by its last bytes."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, ends, data = words.buffers()
    ends, data = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(data, np.uint8)
    last = data[ends[1:] - 1].astype(np.int64)
    return np.where(np.diff(ends) == 1, _ENDS[0][last], _ENDS[1][data[np.maximum(ends[1:] - 2, 0)].astype(np.int64) * 256 + last])


def pieces(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of about ``SCORED`` bytes of the column text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    part = np.cumsum(sizes, dtype=np.int64) // (most or SCORED)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, rare (its class), c: over all texts. A task holds the words of about ``SCORED`` bytes before it passes them on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = words_of(piece.column("text"))[0].value_counts()
                words = found.field("values")
                yield pa.RecordBatch.from_arrays([words, pa.array(rare_classes(words), pa.int32()), found.field("counts")], ["word", "rare", "c"])

    return docs.select("text").mapInArrow(count, "word binary, rare int, c long").groupBy("word").agg(F.first("rare").alias("rare"), F.sum("c").alias("c"))


class Scorer:
    """What the executors need: head counts, the model, and totals."""

    def __init__(self, head: list[tuple[bytes, int, int]], ends: int, tokens: int, distinct: int, rare_tokens: np.ndarray, rare_words: np.ndarray):
        self.words = pa.array([w for w, _, _ in head], pa.binary())
        self.counts = np.array([c for _, _, c in head], np.int64)
        rare = np.array([k for _, k, _ in head], np.int64)
        self.ends, self.tokens, self.distinct = ends, tokens, distinct
        top = len(self.words[:WORDS])
        self.shape = lm.Shape(self.counts[:top], ends, RARE)
        self.ids = np.concatenate([np.arange(top), self.shape.end + 1 + rare[top:]])
        self.base = np.log10((self.counts + 1) / (tokens + distinct + 1))
        self.base_end = float(np.log10((ends + 1) / (tokens + distinct + 1)))
        # Rare words by class: all training words but the frequent ones.
        self.rare_total = rare_tokens + rare_words + 1.0 - np.bincount(rare[:top], self.counts[:top] + 1.0, RARE)
        self.rare_score = np.zeros(len(self.words))
        self.rare_score[top:] = np.log10((self.counts[top:] + 1) / self.rare_total[rare[top:]])
        self.weights: lm.Weights = {}

    def read(self, texts: pa.Array) -> Read:
        """Texts' target ids and what their words are. Each different word is looked up once."""
        words, sizes = words_of(texts)
        coded = words.dictionary_encode()
        of, word = coded.indices.to_numpy(), coded.dictionary
        place = pc.fill_null(pc.index_in(word, self.words), -1).to_numpy().astype(np.int64)
        rare = rare_classes(word)
        target = self.shape.end + 1 + rare
        target[place >= 0] = self.ids[place[place >= 0]]
        owner, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes + 1)
        ids = np.full(int(ends[-1]) if len(ends) else 0, self.shape.end, np.uint16)
        ids[np.arange(len(of)) + owner] = target[of]
        return Read(ids, ends, word, rare, place, of, owner)


class Read:
    """Texts as a scorer reads them: target ids, where each text's end in them, the different words with their classes and
    places in the head (-1: beyond it), and of each word of the texts which one it is and whose."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, word: pa.Array, rare: np.ndarray, place: np.ndarray, of: np.ndarray, owner: np.ndarray):
        self.ids, self.ends, self.word, self.rare, self.place, self.of, self.owner = ids, ends, word, rare, place, of, owner

    def each(self) -> list[np.ndarray]:
        return np.split(self.ids, self.ends[:-1]) if len(self.ends) else []

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By text, of a value of each different word."""
        return np.bincount(self.owner, values[self.of], len(self.ends))

    def far(self) -> pa.Array:
        """By text, the words beyond the head: word, n, rare."""
        beyond, some = self.place[self.of] < 0, max(1, len(self.word))
        pairs, n = np.unique(self.owner[beyond] * some + self.of[beyond], return_counts=True)
        offsets = np.append(0, np.cumsum(np.bincount(pairs // some, minlength=len(self.ends))))
        word = pairs % some
        found = pa.StructArray.from_arrays([self.word.take(pa.array(word)), pa.array(n, pa.int64()), pa.array(self.rare[word], pa.int32())], ["word", "n", "rare"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)


def frequent(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int, int]]:
    """The most frequent words, at most ``most``: those from a count on, which a histogram of counts (16 bins for each
    doubling) gives. No task or driver sorts or holds more words than that."""
    size = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted(((r["bin"], r["count"]) for r in counts.groupBy(size.alias("bin")).count().collect()), reverse=True)
    least, n = None, 0
    for b, count in bins:
        if n + count > most:
            break
        least, n = b, n + count
    if least is None:
        return []
    found = counts.where(size >= least).select("word", "rare", "c").toArrow()
    return sorted(zip(*(found.column(k).to_pylist() for k in range(3))), key=lambda w: (-w[2], w[0]))


def corpus(docs: DataFrame, least: int = LEAST, every: int = EVERY, portion: int = PORTION) -> tuple[Scorer, DataFrame]:
    """The scorer, fitted to training documents ``docs``, and their counts."""
    counts = cut(word_counts(docs), "counts")
    ends = docs.count()
    by_rare = {r["rare"]: (r["n"], r["c"]) for r in counts.groupBy("rare").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    rare_words, rare_tokens = (np.array([float(by_rare.get(k, (0, 0))[j]) for k in range(RARE)]) for j in (0, 1))
    head = frequent(counts)
    tokens, distinct = int(rare_tokens.sum()) + ends, int(rare_words.sum()) + (ends > 0)
    found = Scorer(head, ends, tokens, distinct, rare_tokens, rare_words)
    found.weights = trained(docs, found, least, every, portion)
    return found, counts


def trained(docs: DataFrame, scorer: Scorer, least: int, every: int, portion: int) -> lm.Weights:
    """The recurrent model's weights after all rounds."""
    weights = scorer.shape.start()
    if not scorer.tokens:
        return weights
    buckets, rounds = 1 << 20, len(RATES)
    # Rounds take turns, so each document is in one of them at least: a round's share is never less than its turn.
    share = min(buckets, max(-(-buckets // min(every, rounds)), int(buckets * least / scorer.tokens) + 1))
    trainers = max(1, round(scorer.tokens * share / buckets / portion))
    context = docs.sparkSession.sparkContext
    tables, key = context.broadcast(scorer), ("lm training", uuid.uuid4().hex)
    dice = F.xxhash64("doc_id", "text", F.lit("lm"))
    chosen = cut(_targets(docs.select("text", dice.alias("dice")), tables, key), "training")
    dealt = chosen.withColumn("trainer", F.pmod(F.xxhash64("dice"), F.lit(trainers)))
    for number, rate in enumerate(RATES):
        start = context.broadcast(lm.flat(weights))

        schema = "part long, weights binary, tokens long"
        turn = dealt.where(F.pmod(F.pmod("dice", F.lit(buckets)) - F.lit(number * buckets // rounds), F.lit(buckets)) < share)
        found, parts = turn.groupBy("trainer").applyInArrow(_learner(scorer.shape, start, number, rate), schema), trainers
        while parts > FAN:
            found = found.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(_mean, schema)
            parts = -(-parts // FAN)
        rows = sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])  # at most FAN
        if rows:
            weights = lm.shaped(lm.mean([(bytes(w), n) for _, w, n in rows])[0], weights)
        start.destroy()
    release(chosen)
    return weights


def _targets(docs: DataFrame, tables: Broadcast, key: object) -> DataFrame:
    """dice, ids: what the recurrent model reads of each text, two bytes an id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept(key, lambda: tables.value)
        for batch in batches:
            for piece in pieces(batch):
                found = m.read(piece.column("text"))
                ids = pa.array([t.tobytes() for t in found.each()], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("dice"), ids], ["dice", "ids"])

    return docs.mapInArrow(make, "dice long, ids binary")


def _learner(shape: lm.Shape, start: Broadcast, number: int, rate: float) -> Callable[[pa.Table], pa.Table]:
    """One round of a trainer: its documents once, from the common weights."""

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("dice", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(t.as_buffer(), "<u2") for t in group.column("ids")]
        after = lm.train(shape, ids, 1, 5 + number, rate, lm.shaped(start.value, shape.start()))
        return pa.table({"part": group.column("trainer")[:1], "weights": pa.array([lm.flat(after)], pa.binary()), "tokens": pa.array([sum(map(len, ids))], pa.int64())})

    return learn


def _mean(group: pa.Table) -> pa.Table:
    raw, tokens = lm.mean(list(zip(group.column("weights").to_pylist(), group.column("tokens").to_pylist())))
    return pa.table({"part": group.column("part")[:1], "weights": pa.array([raw], pa.binary()), "tokens": pa.array([tokens], pa.int64())})


def scored(docs: DataFrame, model: Scorer) -> DataFrame:
    """Per row: doc_id, kid, kh, n_tokens, and over the words of the head: n_known, base, score; ``far``: the others and their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = zlib.crc32(b"".join(model.weights[k].tobytes() for k in sorted(model.weights))) ^ model.tokens

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept(("lm", key), lambda: shared.value)
        for batch in batches:
            for part in pieces(batch):
                found = m.read(part.column("text"))
                near = found.place >= 0
                base, rare = np.zeros(len(near)), np.zeros(len(near))
                base[near], rare[near] = m.base[found.place[near]], m.rare_score[found.place[near]]
                known = found.sums(near).astype(np.int64) + (m.ends > 0)
                total = lm.score(m.weights, m.shape, found.each()) + found.sums(rare)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in ("doc_id", "kid", "kh")), pa.array(np.diff(found.ends, prepend=0)), pa.array(known), pa.array(found.sums(base) + m.base_end), pa.array(total), found.far()],
                    ["doc_id", "kid", "kh", "n_tokens", "n_known", "base", "score", "far"],
                )

    return docs.mapInArrow(make, "doc_id long, kid long, kh long, n_tokens long, n_known long, base double, score double, far array<struct<word: binary, n: long, rare: int>>")


def lm_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, least: int = LEAST, every: int = EVERY, portion: int = PORTION) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = keyed(docs)
    model, counts = corpus(rows.where(~held_out(modulus, remainder)).select("doc_id", "text"), least, every, portion)
    each = cut(scored(rows, model), "scored")
    far = each.select("kid", "kh", F.explode("far").alias("f")).select("kid", "kh", "f.*")
    totals = F.element_at(F.array(*(F.lit(float(t)) for t in model.rare_total)), F.col("rare") + 1)
    c = F.coalesce("c", F.lit(0))
    met = far.join(counts.select("word", "c"), "word", "left").select(
        "kid", "kh", F.when(c > 0, F.col("n")).otherwise(0).alias("n"),
        (F.col("n") * F.log10((c + 1) / F.lit(float(model.tokens + model.distinct + 1)))).alias("b"),
        (F.col("n") * F.log10((c + 1) / totals)).alias("s"),
    )
    # Rows with the same id and text share a key: each adds the same, so sums are divided by their number.
    copies = each.groupBy("kid", "kh").agg(F.count("*").alias("copies"))
    sums = met.groupBy("kid", "kh").agg(F.sum("n").alias("far_n"), F.sum("b").alias("far_b"), F.sum("s").alias("far_s")).join(copies, ["kid", "kh"])
    sums = sums.select("kid", "kh", (F.col("far_n") / F.col("copies")).cast("long").alias("far_n"), (F.col("far_b") / F.col("copies")).alias("far_b"), (F.col("far_s") / F.col("copies")).alias("far_s"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return each.drop("far").join(sums, ["kid", "kh"], "left").select(
        "doc_id", held_out(modulus, remainder).alias("held_out"), "n_tokens", (F.col("n_known") + zero("far_n")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("far_b")).alias("base_score"), (F.col("score") + zero("far_s")).alias("score"),
    )
