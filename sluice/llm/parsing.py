"""Prefix-free parsing: the suffix order of repetitive texts from a dictionary and a parse.

Rolling-hash triggers cut every text into phrases; a phrase runs from one trigger to the end of the next, so
neighbours overlap by a trigger and no phrase suffix longer than a trigger is a prefix of another. Suffixes of
the distinct phrases (the dictionary) and of the sequences of phrases (the parse) are sorted by themselves; a
text suffix is ordered by the class of its phrase's suffix, then by the rank of the parse behind that phrase.
"""

from __future__ import annotations

import numpy as np

from sluice.llm.passages import BYTES, Rolling

#: Bytes of a trigger, and one in how many places is one.
TRIGGER, MODULUS = 8, 32
#: Ends a text; no byte of UTF-8.
END = b"\xff"
SYMBOLS = np.append(np.arange(2, 257), 1).astype(np.uint64)


def ranked(first: np.ndarray, depth: int, room: np.ndarray, most: int) -> np.ndarray:
    """Ranks of suffixes by prefix doubling from ranks ``first`` of their first ``depth`` symbols.

    room: symbols from each place to the end of its string; suffixes stop there, the shorter first. Only suffixes
    that still share a rank are sorted again.
    """
    _, rank, counts = np.unique(first, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[rank]  # a class's rank is its first place in the order
    n = len(rank)
    while depth < most:
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(open_):
            break
        after = np.where(room[open_] > depth, rank[np.minimum(open_ + depth, n - 1)] + 1, 0)
        values, back, counts = np.unique(rank[open_] * (n + 1) + after, return_inverse=True, return_counts=True)
        own, before = values // (n + 1), np.cumsum(counts) - counts
        rank[open_] = (own + before - before[np.searchsorted(own, own)])[back]
        depth *= 2
    return rank


def phrases_of(text: bytes) -> np.ndarray:
    """Where phrases begin."""
    if len(text) <= TRIGGER:
        return np.zeros(1, np.int64)
    hashes = Rolling(BYTES[np.frombuffer(text, np.uint8)]).all(TRIGGER)
    at = np.flatnonzero(hashes % np.uint64(MODULUS) == 0)
    return at if len(at) and at[0] == 0 else np.concatenate([[0], at])


def suffix_order(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the concatenated texts (parts of UTF-8) in suffix order, as far as ``depth`` bytes, and each text's begin."""
    known: dict[bytes, int] = {}
    parse, begins, sizes = [], [], []
    for text in texts:
        at = phrases_of(text)
        ends = np.append(at[1:] + TRIGGER, len(text))
        cut = [text[a:b] for a, b in zip(at.tolist(), ends.tolist())]
        cut[-1] += END
        parse.append([known.setdefault(w, len(known)) for w in cut])
        begins.append(at)
        sizes.append(len(text))
    # Dictionary: symbols are bytes + 2; 1 ends the last phrase of a text, 0 pads.
    symbols = SYMBOLS[np.frombuffer(b"".join(known), np.uint8)]
    lengths = np.fromiter(map(len, known), np.int64, len(known))
    starts = np.cumsum(lengths) - lengths
    room = np.repeat(starts + lengths, lengths) - np.arange(len(symbols))
    packed = np.zeros(len(symbols), np.uint64)
    padded = np.concatenate([symbols, np.zeros(7, np.uint64)])
    for k in range(7):
        packed = (packed << np.uint64(9)) | np.where(room > k, padded[k : k + len(symbols)], np.uint64(0))
    suffix = ranked(packed, 7, room, min(int(lengths.max()), depth))
    # Parse: phrases by the rank of the whole phrase; texts end.
    phrase = suffix[starts]
    flat = np.array([i for p in parse for i in p], dtype=np.int64)
    counts = np.array([len(p) for p in parse])
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(flat))
    tail = ranked(phrase[flat], 1, left, depth)
    # Every byte of a text: its phrase's suffix, then the parse from the next phrase on.
    shift = np.cumsum(sizes) - np.array(sizes, dtype=np.int64)
    at = np.concatenate([b + s for b, s in zip(begins, shift)])
    total = int(sum(sizes))
    span = np.diff(np.append(at, total))
    of = np.repeat(np.arange(len(at)), span)
    keep = of < len(flat)
    key = suffix[starts[flat][of] + np.arange(total) - at[of]]
    follow = np.where(left > 1, tail[np.minimum(np.arange(len(flat)) + 1, len(flat) - 1)] + 1, 0)
    return np.argsort(key[keep] * (len(flat) + 2) + follow[of][keep]), shift
