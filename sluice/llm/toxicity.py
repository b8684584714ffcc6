"""Toxicity by a bidirectional gated recurrent network over word and character inputs, in numpy.

A word's input joins an embedding of the word and the mean of embeddings of its character n-grams (both
hashed), so new words and inflected stems have inputs too. Two gated recurrent networks read a window of
words from either side, attention pools their states, and a logistic unit gives the window's log odds. A text
is cut into overlapping windows, all of them are scored, and the highest counts. Training first takes every
window of a text for an example of the text's label, then only the window scored highest.

The network is fitted on a bounded sample of labelled rows, ``SAMPLE`` of either label, chosen by a hash of
doc_id among rows that ``held_out`` doesn't name; its weights (under 2 MB) go to the executors. Labels, lang,
source and doc_id are never inputs of a score.

A null or empty text has one window without words, and a score. Null and repeated doc_ids are rows of
their own; a null doc_id or a null label is never learnt from. Where labels have one class or none, every
score is that class's share, or 0. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.caches import kept
from sluice.llm.common import held_out, packed

#: Labelled rows of each class to learn from at most, and bytes of a text that still teaches.
SAMPLE, LONGEST = 2000, 100_000
WINDOW, STRIDE = 48, 36
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 8
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
#: Texts are cut into examples of training up to this many windows an epoch.
BATCH = 256
STRIPPED = b".,;:!?\"'()[]{}*_-<>"

Weights = dict[str, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word in the word table; rows of all n-grams (3 to 5 bytes) in the character table, and where each word's begin."""
    word = np.array([zlib.crc32(w.strip(STRIPPED)) for w in words], dtype=np.int64) % WORD_ROWS
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.int64)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(words)), sizes)
    left = ends[of] - np.arange(len(raw))  # bytes to the word's end
    rows, owner, value = [], [], raw * 1
    for n in range(2, 6):
        value = value[:-1] * 1000003 % (1 << 40) + raw[n - 1 :]
        if n >= 3:
            at = np.flatnonzero(left[: len(value)] >= n)
            rows.append((value[at] * (0x9E3779B1 + 2 * n) >> 7) % CHAR_ROWS)
            owner.append(of[at])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return word, rows[order], np.searchsorted(owner[order], np.arange(len(words)))


def inputs(p: Weights, words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
    word, rows, begins = features(words)
    counts = np.diff(np.append(begins, len(rows)))
    grams = np.add.reduceat(p["chars"][rows], begins, axis=0) / counts[:, None]
    return np.hstack([p["words"][word], grams]).astype(np.float32)


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words, laid end to end: begin and end of every window's words, and each text's first window."""
    counts = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = (np.cumsum(sizes) - sizes)[text] + (np.arange(len(text)) - first[text]) * STRIDE
    return begin, np.minimum(begin + WINDOW, np.cumsum(sizes)[text]), first


def start_weights(seed: int = 7) -> Weights:
    r = np.random.default_rng(seed)
    e, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"words": r.normal(0, 0.3, (WORD_ROWS, WORD_DIM)), "chars": r.normal(0, 0.6, (CHAR_ROWS, CHAR_DIM))}
    for d in "fb":
        p |= {"x" + d: r.normal(0, e**-0.5, (e, 3 * h)), "u" + d: r.normal(0, h**-0.5, (h, 3 * h)), "c" + d: np.zeros(3 * h)}
    p |= {"wa": r.normal(0, 0.3, (2 * h, h)), "ba": np.zeros(h), "va": r.normal(0, 0.3, h), "wo": r.normal(0, 0.3, 2 * h), "bo": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _read(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one network over (time, batch, 3 * hidden) input parts."""
    h = np.zeros((gates.shape[1], HIDDEN), np.float32)
    out = np.empty((gates.shape[0], gates.shape[1], HIDDEN), np.float32)
    for t in range(len(gates)):
        hu = h @ u
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
        h = h + m * ((1 - z) * (n - h))
        out[t] = h
    return out


def forward(p: Weights, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Log odds of windows: x (time, batch, inputs), mask (time, batch) 1 where there is a word."""
    states = []
    for d in "fb":
        xs, ms = (x, mask) if d == "f" else (x[::-1], mask[::-1])
        steps: list | None = None if keep is None else []
        s = _read(xs @ p["x" + d] + p["c" + d], p["u" + d], ms, steps)
        states.append(s if d == "f" else s[::-1])
        if keep is not None:
            keep[d] = steps
    s = np.concatenate(states, axis=2)
    a = np.tanh(s @ p["wa"] + p["ba"])
    e = np.where(mask > 0, a @ p["va"], np.float32(-1e9))
    w = np.exp(e - e.max(axis=0)) * mask
    w = w / np.maximum(w.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", w, s)
    if keep is not None:
        keep |= {"s": s, "a": a, "w": w, "pooled": pooled}
    return pooled @ p["wo"] + p["bo"][0]


def backward(p: Weights, x: np.ndarray, mask: np.ndarray, keep: dict, d_out: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Gradients of the dense weights and of x, given those of the log odds."""
    g = {"wo": keep["pooled"].T @ d_out, "bo": d_out.sum(keepdims=True)}
    d_pool = d_out[:, None] * p["wo"]
    s, a, w = keep["s"], keep["a"], keep["w"]
    d_w = np.einsum("bh,tbh->tb", d_pool, s)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    g["va"] = np.einsum("tb,tbk->k", d_e, a)
    d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
    g["wa"], g["ba"] = np.einsum("tbh,tbk->hk", s, d_a), d_a.sum(axis=(0, 1))
    d_s = w[:, :, None] * d_pool + d_a @ p["wa"].T
    d_x = np.zeros_like(x)
    for d in "fb":
        ds, xs, ms = (d_s[:, :, :HIDDEN], x, mask) if d == "f" else (d_s[::-1, :, HIDDEN:], x[::-1], mask[::-1])
        dh, du = np.zeros(ds.shape[1:], np.float32), np.zeros_like(p["u" + d])
        dg = np.empty((len(ds), ds.shape[1], 3 * HIDDEN), np.float32)
        for t in range(len(ds) - 1, -1, -1):
            h, z, r, n, hu = keep[d][t]
            dh = dh + ds[t]
            cell = dh * ms[t][:, None]
            dn = cell * (1 - z) * (1 - n * n)
            dz = cell * (h - n) * z * (1 - z)
            dr = dn * hu * r * (1 - r)
            dg[t] = np.concatenate([dz, dr, dn], axis=1)
            dhu = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ dhu
            dh = dh - cell * (1 - z) + dhu @ p["u" + d].T
        g["u" + d], g["x" + d], g["c" + d] = du, np.einsum("tbe,tbk->ek", xs, dg), dg.sum(axis=(0, 1))
        back = dg @ p["x" + d].T
        d_x += back if d == "f" else back[::-1]
    return g, d_x


class Examples:
    """Texts as indices into the inputs of their different words."""

    def __init__(self, texts: list[str | None]):
        known: dict[bytes, int] = {}
        lists = [words_of(t) for t in texts]
        self.index = np.concatenate([*(np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int32, len(ws)) for ws in lists), np.zeros(1, np.int32)])
        self.sizes = np.array([len(ws) for ws in lists], dtype=np.int64)
        self.begin, self.end, self.first = windows_of(self.sizes)
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.append(self.first, len(self.begin))))
        del lists
        words, parts = list(known) or [b""], []
        for k in range(0, len(words), 20_000):
            parts.append(features(words[k : k + 20_000]))
        known.clear()
        shift = np.cumsum([0] + [len(p[1]) for p in parts])
        self.word = np.concatenate([p[0] for p in parts]).astype(np.int32)
        self.rows = np.concatenate([p[1] for p in parts]).astype(np.int32)
        self.begins = np.concatenate([p[2] + s for p, s in zip(parts, shift)])
        self.counts = np.diff(np.append(self.begins, len(self.rows)))

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.begin[chosen] + np.arange(WINDOW)[:, None]
        mask = at < self.end[chosen]
        return self.index[np.where(mask, at, 0)], mask.astype(np.float32)


def lean(data: Examples, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much more texts of label 1 have each row of the two tables than others do: log odds of text counts, less where few texts have it."""
    counts = [np.zeros((2, WORD_ROWS)), np.zeros((2, CHAR_ROWS))]
    at = 0
    for size, label in zip(data.sizes, labels):
        words = np.unique(data.index[at : at + size])
        at += size
        n = data.counts[words]
        spans = np.repeat(data.begins[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for table, rows in zip(counts, (data.word[words], data.rows[spans])):
            table[int(label), np.unique(rows)] += 1
    zeros, ones = len(labels) - labels.sum(), labels.sum()
    return tuple((np.log((t[1] + 1) / (ones + 2)) - np.log((t[0] + 1) / (zeros + 2))) * (t.sum(axis=0) / (t.sum(axis=0) + 6.0)) for t in counts)


def train(texts: list[str | None], labels: np.ndarray, seed: int = 7, epochs: int = 6) -> Weights:
    p = start_weights(seed)
    data, rng = Examples(texts), np.random.default_rng(seed)
    # The first dimension of either table starts with what the labels say about single words and n-grams.
    p["words"][:, 0], p["chars"][:, 0] = lean(data, labels)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k not in ("words", "chars")}
    squares = {k: np.full(len(p[k]), 1e-3, np.float32) for k in ("words", "chars")}
    step = 0
    for epoch in range(epochs):
        if epoch == 0:
            chosen = np.arange(len(data.begin))
        else:
            odds = odds_of(p, data)
            top = np.lexsort((rng.random(len(odds)), -odds, data.text))[data.first]
            other = data.first + (rng.random(len(data.first)) * np.diff(np.append(data.first, len(odds)))).astype(np.int64)
            chosen = np.concatenate([top, other[labels == 0]])
        chosen = rng.permutation(chosen)
        for k in range(0, len(chosen), BATCH):
            part = chosen[k : k + BATCH]
            index, mask = data.take(part)
            used, inverse = np.unique(index, return_inverse=True)
            spans = np.concatenate([np.arange(data.begins[i], data.begins[i] + data.counts[i]) for i in used])
            rows, counts = data.rows[spans], data.counts[used]
            begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
            vectors = np.hstack([p["words"][data.word[used]], np.add.reduceat(p["chars"][rows], begins, axis=0) / counts[:, None]]).astype(np.float32)
            inverse = inverse.reshape(index.shape)
            x = vectors[inverse]
            keep: dict = {}
            odds = forward(p, x, mask, keep)
            y = labels[data.text[part]]
            d_out = ((_sigmoid(odds) - y) / len(part)).astype(np.float32)
            g, d_x = backward(p, x, mask, keep, d_out)
            step += 1
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p[name] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            flat, d_flat = inverse.ravel(), d_x.reshape(-1, d_x.shape[2]) * mask.ravel()[:, None]
            d_used = np.stack([np.bincount(flat, d_flat[:, c], len(used)) for c in range(d_flat.shape[1])], axis=1)
            per_gram = np.repeat(d_used[:, WORD_DIM:] / counts[:, None], counts, axis=0)
            for name, at, grad in (("words", data.word[used], d_used[:, :WORD_DIM]), ("chars", rows, per_gram)):
                ids, back = np.unique(at, return_inverse=True)
                total = np.stack([np.bincount(back, grad[:, c], len(ids)) for c in range(grad.shape[1])], axis=1)
                squares[name][ids] += (total**2).mean(axis=1)
                p[name][ids] -= (0.1 * total / np.sqrt(squares[name][ids])[:, None]).astype(np.float32)
    return p


def odds_of(p: Weights, data: Examples, batch: int = 1024) -> np.ndarray:
    vectors, step = np.empty((len(data.word), WORD_DIM + CHAR_DIM), np.float32), 50_000
    for k in range(0, len(vectors), step):
        word, begins, counts = data.word[k : k + step], data.begins[k : k + step], data.counts[k : k + step]
        rows = data.rows[begins[0] : begins[-1] + counts[-1]]
        vectors[k : k + step, :WORD_DIM] = p["words"][word]
        vectors[k : k + step, WORD_DIM:] = np.add.reduceat(p["chars"][rows], begins - begins[0], axis=0) / counts[:, None]
    out = np.empty(len(data.begin), np.float32)
    for k in range(0, len(out), batch):
        index, mask = data.take(np.arange(k, min(k + batch, len(out))))
        out[k : k + batch] = forward(p, vectors[index], mask)
    return out


class Scorer:
    """Scores texts; keeps the inputs of the first ``keep`` different words it meets."""

    def __init__(self, p: Weights, keep: int = 200_000):
        self.p, self.keep, self.known = p, keep, _Numbered()
        self.vectors = np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)

    def score(self, texts: list[str | None], batch: int = 1024) -> np.ndarray:
        out, at, size = [], 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size > 2_000_000 or k == len(texts) - 1:
                out.append(self._score(texts[at : k + 1], batch))
                at, size = k + 1, 0
        return np.concatenate(out) if out else np.zeros(0)

    def _score(self, texts: list[str | None], batch: int) -> np.ndarray:
        lists = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in lists], dtype=np.int64)
        get = self.known.__getitem__
        index = np.concatenate([*(np.fromiter(map(get, ws), np.int64, len(ws)) for ws in lists), [0]])
        new, self.known.new = self.known.new, []
        vectors = np.concatenate([self.vectors, inputs(self.p, new)])
        begin, end, first = windows_of(sizes)
        odds = np.empty(len(begin), np.float32)
        table = vectors if len(vectors) else np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
        for k in range(0, len(begin), batch):
            at = begin[k : k + batch] + np.arange(WINDOW)[:, None]
            mask = at < end[k : k + batch]
            odds[k : k + batch] = forward(self.p, table[index[np.where(mask, at, 0)]], mask.astype(np.float32))
        extra = len(self.known) - self.keep
        if extra > 0:
            for w in new[len(new) - extra :]:
                del self.known[w]
        self.vectors = vectors[: self.keep]
        return _sigmoid(np.maximum.reduceat(odds.astype(np.float64), first))


class _Numbered(dict):
    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        self.new.append(word)
        return found


def scorer(p: Weights) -> Scorer:
    """The worker's scorer of a network."""
    return kept(("toxicity", zlib.crc32(b"".join(p[k].tobytes() for k in sorted(p)))), lambda: Scorer(p))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Weights | float:
    """The network, or a constant score where the sample has one class at most. Labelled texts beyond ``LONGEST`` bytes
    don't teach, so what the driver holds is bounded; they are scored whole like all others."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    spread = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = spread[0].union(spread[1])  # at most 2 * sample ids: bounded, so broadcast
    found = (
        docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
        .orderBy("doc_id").collect()
    )
    y = np.array([r["toxic"] for r in found], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.0
    return train([r["text"] for r in found], y)


def score(docs: DataFrame, model: Weights | float) -> DataFrame:
    """own (a struct of docs' columns) and toxic_score, the score of every row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(packed(docs).alias("own"))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(0).field("text").to_pylist()
            found = np.full(len(texts), model) if isinstance(model, float) else scorer(model).score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["own", "toxic_score"])

    return rows.mapInArrow(scores, T.StructType([rows.schema["own"], T.StructField("toxic_score", T.DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    return score(docs, fit(docs, labels, sample)).where(F.col("toxic_score") < threshold).select("own.*")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, sample))
    found = found.select("own.doc_id", "toxic_score")
    return found.select("doc_id", held_out(4, 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))
