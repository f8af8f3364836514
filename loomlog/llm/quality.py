"""Quality by votes of the nearest labelled examples in a latent semantic space.

A bounded sample of labelled rows (`per_class` of each label, by hash of the id)
spans the space: their TF-IDF vectors, with document frequencies over all
documents, are reduced to `dimensions` by a singular value decomposition. Every
document is folded into the space, its cosines with all examples come from one
matrix product per block of documents, and the labels of the nearest ones vote
with their similarity. A logistic curve, fitted to the examples' own left-out
votes and weighed to the labels' real proportions, makes the vote a probability.

Terms are what quality shows in: the shapes of words (case, digits, signs), word
beginnings, and words that repeat the one before.

Per document the work is bounded by the sample; nothing is shuffled but the
document frequencies of the sample's terms.

Defined cases: texts of any length are read whole; of equally near examples any may
vote. A null or empty text, and one without a known term, gets the
share of label 1 as its score. Labels that are null, or that contradict each
other for an id, are not learned from. Without examples of both labels every
score is that of the only label, or 0. Columns other than doc_id and text are
ignored, whatever their names; rows that repeat an id are scored each for itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from loomlog.llm.common import map_texts
from loomlog.llm.examples import document_frequencies, labelled_examples, logistic
from loomlog.llm.nearest import weigh

PER_CLASS = 2000
DIMENSIONS = 48
#: Neighbours that vote, as a share of the examples of the rarer label.
NEIGHBOURS = 0.02
#: Documents in one matrix product.
BLOCK = 512
#: Words whose terms a task remembers.
REMEMBERED = 300_000
#: Marks that may end a word.
MARKS = ",.;:!?)"


class WordTerms(dict):
    """Of each word its shape and its beginning, found when first asked for."""

    def __missing__(self, word: str) -> tuple[str, str]:
        stem = word.rstrip(MARKS)
        if stem.isalpha():  # letters and marks: what the general rule gives, without it
            shape = "A" if stem.isupper() else "Aa" if stem[0].isupper() else "a"
            shape += word[len(stem) :]
            if len(word) - len(stem) > 2:
                shape = re.sub(r"(.)\1+", r"\1\1", shape)
            self[word] = found = "#" + shape[:8], word[:3].lower()
            return found
        shape = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a", word)
        shape = re.sub(r"\d+", "0", shape)
        self[word] = found = "#" + re.sub(r"(.)\1+", r"\1\1", shape)[:8], word[:3].lower()
        return found


@dataclass
class ShapeTerms:
    known: WordTerms = field(default_factory=WordTerms)

    def of(self, words: Iterable[str]) -> Iterable[str]:
        """The terms of the words, one after another."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return chain.from_iterable(map(self.known.__getitem__, words))

    def __call__(self, text: str | None) -> Counter:
        words = (text or "").split()
        counts = Counter(self.of(words))
        repeats = sum(map(str.__eq__, words, words[1:]))
        if repeats:
            counts["##repeat"] = repeats
        return counts

    def distinct(self, text: str | None) -> set[str]:
        words = (text or "").split()
        found = set(self.of(set(words)))
        if any(map(str.__eq__, words, words[1:])):
            found.add("##repeat")
        return found

    def __getstate__(self):
        return {"known": WordTerms()}


@dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    basis: np.ndarray | None  # term x dimension
    latent: np.ndarray | None  # example x dimension, unit length
    labels: np.ndarray
    k: int
    prior: float
    curve: tuple[float, float]
    terms: ShapeTerms

    def fold(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors of the texts in the space; zero where no term is known."""
        out = np.zeros((len(texts), self.basis.shape[1]), np.float64)
        for i, text in enumerate(texts):
            counts = {self.vocabulary[t]: c for t, c in self.terms(text).items() if t in self.vocabulary}
            if counts:
                ids, weights = weigh(counts, self.idf)
                out[i] = weights @ self.basis[ids]
        return unit(out)

    def votes(self, latent: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Share of label 1 among the nearest; `own`: examples to leave out, one per row."""
        cosine = latent @ self.latent.T
        if own is not None:
            cosine[np.arange(len(own)), own] = -2.0
        k = min(self.k, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6)
        return (weights * self.labels[near]).sum(1) / weights.sum(1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.basis is None:
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        a, b = self.curve
        for i in range(0, len(texts), BLOCK):
            latent = self.fold(texts[i : i + BLOCK])
            scores = 1.0 / (1.0 + np.exp(-(a * self.votes(latent) + b)))
            out[i : i + BLOCK] = np.where(latent.any(1), scores, self.prior)
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows**2).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def fit(
    docs: DataFrame, labelled: DataFrame, per_class: int = PER_CLASS, dimensions: int = DIMENSIONS,
    neighbours: float = NEIGHBOURS,
) -> Model:
    """A model from `labelled` (doc_id, quality), whose texts are in `docs`."""
    terms = ShapeTerms()
    prior, sample = labelled_examples(docs, labelled, "quality", per_class)
    labels = np.array([y for _, y, _ in sample], np.float64)
    counts_of = [terms(text) for _, _, text in sample]
    spread = Counter(t for counts in counts_of for t in counts)
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, n in spread.items() if n > 4))}
    if len(set(labels)) < 2 or not vocabulary:
        return Model({}, np.zeros(0), None, None, labels, 1, prior, (0.0, 0.0), terms)
    n_docs, df = document_frequencies(docs, vocabulary, terms)
    idf = np.log((n_docs + 1.0) / (df + 1.0)) + 0.1
    matrix = np.zeros((len(sample), len(vocabulary)), np.float32)
    for i, counts in enumerate(counts_of):
        known = {vocabulary[t]: c for t, c in counts.items() if t in vocabulary}
        if known:
            ids, weights = weigh(known, idf)
            matrix[i, ids] = weights
    left, values = principal(matrix, dimensions)
    basis = (matrix.T @ left) / values
    latent = unit(matrix.astype(np.float64) @ basis)
    zeros, ones = (labels == 0).sum(), (labels == 1).sum()
    model = Model(
        vocabulary, idf, basis, latent, labels, max(5, round(neighbours * min(zeros, ones))), prior,
        (0.0, 0.0), terms,
    )
    share = np.concatenate(
        [model.votes(latent[i : i + BLOCK], np.arange(i, min(i + BLOCK, len(latent)))) for i in range(0, len(latent), BLOCK)]
    )
    weights = np.where(labels == 1, prior / ones, (1 - prior) / zeros) * len(labels)
    model.curve = logistic(share, labels, weights)
    return model


def principal(matrix: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest left singular vectors and values, by subspace iteration."""
    rank = min(dimensions, *matrix.shape)
    start = np.random.default_rng(0).standard_normal((matrix.shape[1], min(rank + 8, *matrix.shape)))
    space = np.linalg.qr(matrix @ start.astype(np.float32))[0]
    for _ in range(6):
        space = np.linalg.qr(matrix @ (matrix.T @ space))[0]
    inner, values, _ = np.linalg.svd(space.T @ matrix, full_matrices=False)
    return (space @ inner)[:, :rank], np.maximum(values[:rank], 1e-9)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) per row of `docs`."""
    rows = lambda texts: ((float(s),) for s in model.score(texts))
    return map_texts(docs, "doc_id bigint", lambda: rows, "score double")
