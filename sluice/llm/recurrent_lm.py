"""A gated recurrent language model in numpy, with a class-factored softmax.

Its words are the most frequent ones, an end, and classes of all other words. The probability of the next word is
that of its class times that of the word in its class; frequent words' classes hold about equal shares of the
tokens, and both factors are softmaxes of the state. A word outside the frequent ones is one of its class by its
count in the whole training corpus, which the caller adds.

Training is truncated backpropagation: parallel streams of documents are read in windows, gradients stay within
a window and the state is carried into the next; it starts anew with each document. Scoring carries the state
through a document's windows to its end, however long it is.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, EMBED = 24, 16
STREAMS, STEPS = 64, 32
MOST_STREAMS, UPDATES = 512, 200
WINDOW = 64
#: States whose probabilities are worked out together, so that they stay in a processor's cache.
ROWS = 8192
#: The same in training, whose class probabilities pass through more steps.
PART = 2048
#: The largest logit that needs no shift to stay within exp's range.
MILD = 80.0
LN10 = float(np.log(10))

Weights = dict[str, np.ndarray]


class Shape:
    """Ids: 0 .. words-1 frequent words, then the end, then rare classes, then the begin (input only)."""

    def __init__(self, counts: np.ndarray, ends: int, rare: int, classes: int = 32):
        self.words, self.rare = len(counts), rare
        self.end, self.begin = self.words, self.words + 1 + rare
        # Frequent words and the end, most frequent first, cut where each class has its share.
        mass = np.append(counts, ends) + 1.0
        self.order = np.argsort(-mass, kind="stable")
        share = np.cumsum(mass[self.order]) / mass.sum()
        of = np.minimum((share * classes).astype(np.int64), classes - 1)
        of = np.unique(of, return_inverse=True)[1]
        self.classes = int(of[-1]) + 1
        self.bounds = np.searchsorted(of, np.arange(self.classes + 1))
        self.place = np.empty(self.words + 1, np.int64)  # column of an id in the output weights
        self.place[self.order] = np.arange(self.words + 1)
        self.class_of = np.concatenate([of[self.place], self.classes + np.arange(rare)])

    def start(self, seed: int = 5) -> Weights:
        r, h, n = np.random.default_rng(seed), HIDDEN, self.begin + 1
        p = {
            "e": r.normal(0, 0.3, (n, EMBED)), "x": r.normal(0, EMBED**-0.5, (EMBED, 3 * h)), "c": np.zeros(3 * h), "u": r.normal(0, h**-0.5, (h, 3 * h)),
            "k": r.normal(0, 0.1, (h, self.classes + self.rare)), "bk": np.zeros(self.classes + self.rare), "o": r.normal(0, 0.1, (h, self.words + 1)), "bo": np.zeros(self.words + 1),
        }
        return {k: v.astype(np.float32) for k, v in p.items()}


def folded(p: Weights) -> tuple[np.ndarray, np.ndarray]:
    """By gate (z, r, n): a table of the inputs' shares and weights of the state's. Signs and factors are folded in, so that
    exp gives the sigmoids, 1 / (1 + exp(-x)), and tanh, 1 - 2 / (1 + exp(2 x))."""
    by_gate = lambda w: np.ascontiguousarray(w.reshape(-1, 3, HIDDEN).transpose(1, 0, 2) * np.array([-1, -1, 2], np.float32)[:, None, None])
    return by_gate(p["e"] @ p["x"] + p["c"]), by_gate(p["u"])


def step(h: np.ndarray, gates: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, the gates, the proposed state, and twice the state's share of that. ``gates`` are used up."""
    hu, zr, n = h @ u, gates[:2], gates[2]
    zr += hu[:2]
    np.exp(zr, out=zr)
    zr += 1
    np.divide(1, zr, out=zr)
    n += zr[1] * hu[2]
    np.exp(n, out=n)
    n += 1
    np.divide(2, n, out=n)
    np.subtract(1, n, out=n)
    new = h - n
    new *= zr[0]
    new += n
    return new, zr[0], zr[1], n, hu[2]


def outputs(p: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes and of the words in them, the last row their biases."""
    return np.vstack([p["k"], p["bk"]]), np.vstack([p["o"], p["bo"]])


def with_one(h: np.ndarray) -> np.ndarray:
    """States, and a one for the bias."""
    out = np.ones((len(h), HIDDEN + 1), np.float32)
    out[:, :HIDDEN] = h
    return out


def mild(h: np.ndarray, *weights: np.ndarray) -> bool:
    """Whether no logit of the states h can leave exp's range."""
    most = max(1.0, float(h.max(initial=0)), -float(h.min(initial=0)))
    return all(most * float(np.abs(w).sum(axis=0).max(initial=0)) < MILD for w in weights)


def exps(x: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """exp of logits, in place, and each row's sum; rows are shifted by their largest first unless ``plain``."""
    if not plain:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], np.float32)


def log_softmax_at(x: np.ndarray, at: np.ndarray, plain: bool) -> np.ndarray:
    """Of each row the one in column ``at``; x is used up."""
    if not plain:
        x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), at]
    return own - np.log(exps(x, True)[1])


def log_probs(p: Weights, shape: Shape, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probabilities of targets (of a rare word: of its class)."""
    out, (k1, o1) = np.empty(len(target)), outputs(p)
    plain = mild(h, k1, o1)
    for at in range(0, len(target), ROWS):
        some = slice(at, at + ROWS)
        cls = shape.class_of[target[some]].astype(np.int16)
        order = np.argsort(cls, kind="stable")
        cls, hs, place = cls[order], with_one(h[some].take(order, 0)), shape.place[np.minimum(target[some], shape.end)[order]]
        found = log_softmax_at(hs @ k1, cls, plain)
        cuts = np.searchsorted(cls, np.arange(shape.classes + 1, dtype=np.int16))
        for k in range(shape.classes):
            own = slice(cuts[k], cuts[k + 1])
            a, b = shape.bounds[k], shape.bounds[k + 1]
            if cuts[k + 1] > cuts[k] and b - a > 1:
                found[own] += log_softmax_at(hs[own] @ o1[:, a:b], place[own] - a, plain)
        out[some][order] = found
    return out


def train(shape: Shape, docs: list[np.ndarray], epochs: int = 3, seed: int = 5, rate: float = 0.01, start: Weights | None = None) -> Weights:
    """docs: target ids of each document, its end last. Goes on from ``start`` if there is one."""
    p, rng = shape.start(seed) if start is None else {k: v.copy() for k, v in start.items()}, np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    done = 0
    # So many streams that there are about UPDATES steps, whatever the number of tokens; within bounds.
    width = int(np.clip(sum(map(len, docs)) // (STEPS * UPDATES), STREAMS, MOST_STREAMS))
    for _ in range(epochs if docs else 0):
        streams: list[list[np.ndarray]] = [[] for _ in range(width)]
        sizes = [(0, k) for k in range(width)]
        for i in rng.permutation(len(docs)):
            size, k = sizes[0]
            streams[k].append(docs[i])
            heapq.heapreplace(sizes, (size + len(docs[i]), k))
        # Longest first, so that the streams that still last are the first ones.
        target = sorted((np.concatenate(parts) for parts in streams if parts), key=len, reverse=True)
        inputs = [np.concatenate([np.array([shape.begin], t.dtype), t[:-1]]) for t in target]
        for t, x in zip(target, inputs):
            x[1:][t[:-1] == shape.end] = shape.begin
        last = -np.array([len(t) for t in target])
        h = np.zeros((len(target), HIDDEN), np.float32)
        for at in range(0, -int(last[0]), STEPS):
            n, steps = int(np.searchsorted(last, -at)), min(STEPS, -int(last[0]) - at)
            ids, goal = np.full((steps, n), shape.begin, np.int64), np.full((steps, n), -1, np.int64)
            for k in range(n):
                some = target[k][at : at + steps]
                goal[: len(some), k] = some
                ids[: len(some), k] = inputs[k][at : at + steps]
            h, g = gradients(p, shape, ids, goal, h[:n])
            done += 1
            lr = rate * min(1.0, done / 20)
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p[name] -= (lr * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-6)).astype(np.float32)
    return p


@np.errstate(over="ignore")  # of a gate: 1 / inf is 0, as it should be
def gradients(p: Weights, shape: Shape, ids: np.ndarray, goal: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, Weights]:
    """The state after a window (steps, streams) and the gradients of its mean loss; goal -1: nothing."""
    table, u = folded(p)
    fresh = (ids != shape.begin).astype(np.float32)[:, :, None]
    n_steps, n = ids.shape
    s, before, saved = np.empty((n_steps, n, HIDDEN), np.float32), np.empty((n_steps, n, HIDDEN), np.float32), []
    for t in range(n_steps):
        np.multiply(h, fresh[t], out=before[t])
        h, z, r, new, hu = step(before[t], table.take(ids[t], 1), u)
        saved.append((z, r, new, hu))
        s[t] = h
    # Tokens by class, so that each class's are neighbours.
    real = np.flatnonzero(goal.ravel() >= 0)
    cls = shape.class_of[goal.ravel()[real]].astype(np.int16)
    order = np.argsort(cls, kind="stable")
    real, cls = real[order], cls[order]
    hs, place = with_one(s.reshape(-1, HIDDEN).take(real, 0)), shape.place[np.minimum(goal.ravel()[real], shape.end)]
    scale, (k1, o1) = np.float32(1 / max(1, len(real))), outputs(p)
    plain, d_hs = mild(s, k1, o1), np.empty((len(real), HIDDEN), np.float32)
    g_k, g_o = np.zeros_like(k1), np.zeros_like(o1)
    for at in range(0, len(real), PART):
        own = slice(at, at + PART)
        d, total = exps(hs[own] @ k1, plain)
        d *= (scale / total)[:, None]
        d[np.arange(len(d)), cls[own]] -= scale
        g_k += (d.T @ hs[own]).T
        np.matmul(d, k1[:HIDDEN].T, out=d_hs[own])
    cuts = np.searchsorted(cls, np.arange(shape.classes + 1, dtype=np.int16))
    for k in range(shape.classes):
        own = slice(cuts[k], cuts[k + 1])
        a, b = shape.bounds[k], shape.bounds[k + 1]
        if cuts[k + 1] > cuts[k] and b - a > 1:
            d, total = exps(hs[own] @ o1[:, a:b], plain)
            d *= (scale / total)[:, None]
            d[np.arange(len(d)), place[own] - a] -= scale
            g_o[:, a:b] = (d.T @ hs[own]).T
            d_hs[own] += d @ o1[:HIDDEN, a:b].T
    d_s = np.zeros_like(s)
    d_s.reshape(-1, HIDDEN)[real] = d_hs
    # Of the gates' sums: dg; of the state's share of them: the same, but for the proposed state's, which r weighs.
    dg, dhu = [np.empty_like(s) for _ in range(3)], np.empty_like(s)
    back = [np.ascontiguousarray(p["u"][:, k * HIDDEN : (k + 1) * HIDDEN].T) for k in range(3)]
    dh = np.zeros((n, HIDDEN), np.float32)
    for t in range(n_steps - 1, -1, -1):
        z, r, new, hu = saved[t]
        dh += d_s[t]
        dz, dr, dn = dg[0][t], dg[1][t], dg[2][t]
        keep = dh * z
        np.subtract(dh, keep, out=dn)
        np.subtract(before[t], new, out=dz)
        dz *= keep
        np.subtract(1, z, out=z)
        dz *= z
        np.multiply(new, new, out=new)
        np.subtract(1, new, out=new)
        dn *= new
        np.multiply(dn, r, out=dhu[t])
        np.subtract(1, r, out=r)
        np.multiply(dhu[t], hu, out=dr)
        dr *= r
        dr *= np.float32(0.5)  # hu is twice the share
        dh = dz @ back[0]
        dh += dr @ back[1]
        dh += dhu[t] @ back[2]
        dh += keep
        dh *= fresh[t]
    flat_ids, h0 = ids.ravel(), before.reshape(-1, HIDDEN)
    dg, dhu = [d.reshape(-1, HIDDEN) for d in dg], dhu.reshape(-1, HIDDEN)
    x = [p["x"][:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3)]
    read, ones = p["e"].take(flat_ids, 0), np.ones(len(flat_ids), np.float32)
    # What the inputs' embeddings get, each word's added up.
    got = dg[0] @ x[0].T
    got += dg[1] @ x[1].T
    got += dg[2] @ x[2].T
    order = np.argsort(flat_ids.astype(np.uint16), kind="stable")
    by_id = flat_ids[order]
    first = np.flatnonzero(np.append(True, by_id[1:] != by_id[:-1]))
    g_e = np.zeros_like(p["e"])
    g_e[by_id[first]] = np.add.reduceat(np.ascontiguousarray(got.take(order, 0).T), first, axis=1).T
    g = {
        "e": g_e, "x": np.hstack([read.T @ d for d in dg]), "c": np.concatenate([ones @ d for d in dg]),
        "u": np.hstack([h0.T @ d for d in (dg[0], dg[1], dhu)]), "k": g_k[:HIDDEN], "bk": g_k[HIDDEN], "o": g_o[:HIDDEN], "bo": g_o[HIDDEN],
    }
    return h, {k: v.astype(np.float32, copy=False) for k, v in g.items()}


@np.errstate(over="ignore")
def score(p: Weights, shape: Shape, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document (target ids, the end last) given the classes of rare words."""
    sizes = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    ids = np.concatenate([docs[i] for i in order]) if len(docs) else np.zeros(0, np.int64)
    size = sizes[order]
    begin = np.cumsum(size) - size
    table, u = folded(p)
    out = np.zeros(len(docs))
    h = np.zeros((len(docs), HIDDEN), np.float32)
    for at in range(0, int(size[0]) if len(docs) else 0, WINDOW):
        states, goals, owners = [], [], []
        for t in range(at, min(at + WINDOW, int(size[0]))):
            n = int(np.searchsorted(-size, -t))  # documents longer than t come first
            place = begin[:n] + t
            read = ids[place - 1] if t else np.full(n, shape.begin)
            h = step(h[:n], table.take(read, 1), u)[0]
            states.append(h)
            goals.append(ids[place])
            owners.append(np.arange(n))
        found = log_probs(p, shape, np.concatenate(states), np.concatenate(goals))
        out += np.bincount(np.concatenate(owners), found, len(out))
    back = np.empty(len(docs))
    back[order] = out / LN10
    return back


def flat(p: Weights) -> bytes:
    """All weights in one piece, by name."""
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32).tobytes()


def shaped(raw: bytes, like: Weights) -> Weights:
    """``flat`` undone, for weights of the same shapes."""
    values, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def mean(parts: list[tuple[bytes, int]]) -> tuple[bytes, int]:
    """The mean of weights, each counted by its tokens, and all tokens."""
    tokens = sum(n for _, n in parts)
    total = sum(np.frombuffer(raw, np.float32).astype(np.float64) * (n / max(1, tokens)) for raw, n in parts)
    return total.astype(np.float32).tobytes(), tokens
