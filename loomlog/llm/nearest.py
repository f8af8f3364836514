"""Nearest examples by exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded number of labelled examples. Examples stand in blocks
of similar ones; for each term and block the largest weight is kept. A query's
products with these give an upper bound per block; blocks are opened from the
largest bound on, and the search ends when no bound left exceeds the k-th best
cosine found. The result is exactly that of comparing with every example.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

LETTERS = re.compile(r"[^\W\d_]+")
#: Blocks opened at once.
STEP = 8
#: Random axes that put similar examples together.
SKETCH = 64


@dataclass
class Prefixes:
    """Words cut to their first `length` letters (a stem that suits any language), counted."""

    length: int

    def __call__(self, text: str | None) -> Counter:
        return Counter([w[: self.length] for w in LETTERS.findall((text or "").lower())])


def weigh(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and unit-length weights of (1 + ln count) * idf."""
    ids = np.fromiter(counts.keys(), np.int64, len(counts))
    tf = 1.0 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    weights = tf * idf[ids]
    norm = np.sqrt((weights**2).sum())
    return ids, weights / norm if norm > 0 else weights


@dataclass
class BlockMaxIndex:
    """Inverted lists cut into blocks of examples, with the largest weight of each cut.

    A block keeps the terms that occur in it and, for each, the weights of its
    examples; texts are searched many at a time, so that the lists of a block
    are run through once for all texts that have to open it.
    """

    vocabulary: dict[str, int]
    idf: np.ndarray
    examples: np.ndarray  # of each position: the caller's number of the example
    block: int
    terms: list[np.ndarray]  # of each block: its terms
    lists: list[np.ndarray]  # of each block: term x example
    largest: np.ndarray  # term x block

    @classmethod
    def build(
        cls, rows: Iterable[dict[int, int]], vocabulary: dict[str, int], idf: np.ndarray, block: int = 64
    ) -> BlockMaxIndex:
        """`rows`: for each example its counts by term number; read once, kept as weights."""
        weighed = [weigh(counts, idf) for counts in rows]
        order = similar_first(weighed, len(vocabulary))
        starts = range(0, len(order), block)
        terms, lists, largest = [], [], np.zeros((len(vocabulary), len(starts)), np.float32)
        for b, at in enumerate(starts):
            some = [weighed[i] for i in order[at : at + block]]
            own = np.unique(np.concatenate([ids for ids, _ in some]))
            cut = np.zeros((len(own), len(some)), np.float32)
            for j, (ids, weights) in enumerate(some):
                cut[np.searchsorted(own, ids), j] = weights
            terms.append(own)
            lists.append(cut)
            largest[own, b] = cut.max(1)
        return cls(vocabulary, idf, order, block, terms, lists, largest)

    def numbers(self, counts: Counter) -> dict[int, int]:
        return {self.vocabulary[t]: c for t, c in counts.items() if t in self.vocabulary}

    def search(self, queries: list[dict[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text (its counts by term number) the k nearest examples, nearest
        first, and their cosines; ties to the example that stands first in the index."""
        n, blocks = len(self.examples), len(self.lists)
        k = min(k, n)
        weights = np.zeros((len(queries), len(self.vocabulary)), np.float32)
        for i, counts in enumerate(queries):
            ids, own = weigh(counts, self.idf)
            weights[i, ids] = own
        bound = weights @ self.largest + 1e-5  # more than rounding can take away
        order = np.argsort(-bound, axis=1, kind="stable")
        cosine = np.full((len(queries), n), -1.0, np.float32)
        floor = np.full(len(queries), -1.0, np.float32)
        for at in range(0, blocks, STEP):
            some = order[:, at : at + STEP]
            wanted = np.take_along_axis(bound, some, 1) >= floor[:, None]
            if not wanted.any():
                break
            for b in np.unique(some[wanted]):
                rows = np.flatnonzero(((some == b) & wanted).any(1))
                lists, first = self.lists[b], b * self.block
                found = weights[np.ix_(rows, self.terms[b])] @ lists
                cosine[rows, first : first + lists.shape[1]] = found
            floor = np.partition(cosine, n - k, axis=1)[:, n - k]
        best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        return self.examples[best], np.take_along_axis(cosine, best, 1).astype(np.float64)


def similar_first(weighed: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """An order in which similar examples stand together, so that block bounds are tight.

    By the leading axes of the examples' random projection; the results of a search
    do not depend on it.
    """
    n = len(weighed)
    if n < 2:
        return np.arange(n)
    signs = np.random.default_rng(0).choice(np.array([-1, 1], np.float32), (size, SKETCH))
    sketch = np.stack([weights.astype(np.float32) @ signs[ids] for ids, weights in weighed])
    axes = np.linalg.svd(sketch, full_matrices=False)[0][:, 1 : min(n, 5)]
    return np.lexsort((*axes.T[:1], *(axes >= 0).T[::-1]))
