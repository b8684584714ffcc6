"""BK-trees over 64-bit fingerprints, many at a time.

In a BK-tree a child's key is its integer Hamming distance to the parent, and no two children of a node share
a key. A search around q that finds node v at distance d follows only the edges with keys from d - r to d + r
(the triangle inequality leaves no match elsewhere). Trees of many shards are built and searched level by level
in numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

KEYS = 65  # distances 0 to 64


class Forest:
    """One tree for each shard; ``values`` are uint64, ``shard`` is ascending."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        n = len(values)
        self.values = values
        begins = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.shards = shard[begins] if n else shard
        self.roots = begins
        edge, child = [], []
        left = np.setdiff1d(np.arange(n), begins, assume_unique=True)
        node = begins[np.searchsorted(self.shards, shard[left])] if n else left
        while len(left):
            key = node * KEYS + np.bitwise_count(values[left] ^ values[node])
            at, first, back = np.unique(key, return_index=True, return_inverse=True)
            edge.append(at)
            child.append(left[first])
            down = left[first][back]
            stay = down != left
            left, node = left[stay], down[stay]
        self.edge = np.concatenate(edge) if edge else np.zeros(0, np.int64)
        self.child = np.concatenate(child) if child else np.zeros(0, np.int64)
        order = np.argsort(self.edge, kind="stable")
        self.edge, self.child = self.edge[order], self.child[order]

    def search(self, values: np.ndarray, shard: np.ndarray, radius: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (query, node, distance) within the radius. Queries go in portions, so that what is held stays near ``most``."""
        if not len(self.values):
            return
        at = np.searchsorted(self.shards, shard)
        at = np.minimum(at, len(self.shards) - 1)
        known = np.flatnonzero(self.shards[at] == shard)
        size = np.diff(np.append(self.roots, len(self.values)))[at[known]]
        portion = np.cumsum(size) // most
        for p in np.unique(portion):
            query = known[portion == p]
            node = self.roots[at[query]]
            while len(query):
                d = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield query[near], node[near], d[near]
                low = np.searchsorted(self.edge, node * KEYS + np.maximum(d - radius, 0))
                high = np.searchsorted(self.edge, node * KEYS + np.minimum(d + radius, KEYS - 1), side="right")
                n = high - low
                total = int(n.sum())
                step = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
                query, node = np.repeat(query, n), self.child[step]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union by links a-b: every label becomes the smallest index of its set."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        la, lb = la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
