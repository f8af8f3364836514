"""Toxicity by distance-weighted votes of the nearest labelled examples.

A bounded sample of labelled rows (`per_class` of each label, by hash of the id)
forms a block-max inverted index of TF-IDF vectors; the document frequencies
cover all documents. Every document is compared with the index exactly, its
nearest examples vote with the inverse of their distance, and the share of
votes is turned into a probability by a logistic curve fitted to the examples'
own left-out votes, weighed to the labels' real proportions. The nearest
examples are returned as evidence.

Per document the work is bounded by the index; nothing is shuffled but the
document frequencies of the index's terms.

Defined cases: texts of any length are read whole. Of equally near examples the one that
stands first in the index votes. A null or empty text, and one without a term of the index, gets
the share of toxic labels as its score and no evidence. Labels that are null,
or that contradict each other for an id, are not learned from. Without examples
of both labels every score is that of the only label, or 0. Columns other than
doc_id and text are ignored, whatever their names; rows that repeat an id are
scored each for itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomlog.llm.common import TEXTS_MB, hand_back, handing_back, in_bytes, map_texts
from loomlog.llm.examples import document_frequencies, labelled_examples, logistic
from loomlog.llm.nearest import BlockMaxIndex, Prefixes

PER_CLASS = 1000
#: Neighbours that vote, as a share of the examples of the rarer label.
NEIGHBOURS = 0.12
PREFIX = 4
IDF_POWER = 2
#: Texts searched together.
BLOCK = 256
SCORES = "score double, evidence array<struct<doc_id:bigint,toxic:int,cosine:double>>"


@dataclass
class Model:
    index: BlockMaxIndex | None
    ids: np.ndarray
    labels: np.ndarray
    k: int
    prior: float
    curve: tuple[float, float]
    terms: Prefixes

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """For each text its score and the evidence."""
        if self.index is None:
            yield from ((self.prior, []) for _ in texts)
            return
        a, b = self.curve
        for i in range(0, len(texts), BLOCK):
            queries = [self.index.numbers(self.terms(t)) for t in texts[i : i + BLOCK]]
            found, cosine = self.index.search(queries, self.k)
            for counts, near, cos in zip(queries, found, cosine):
                if not counts:
                    yield self.prior, []
                    continue
                score = 1.0 / (1.0 + np.exp(-(a * vote(self.labels[near], cos) + b)))
                evidence = zip(self.ids[near[:5]], self.labels[near[:5]], cos[:5])
                yield float(score), [(int(d), int(y), float(c)) for d, y, c in evidence]


def vote(labels: np.ndarray, cosine: np.ndarray) -> float:
    weights = 1.0 / (1.02 - np.minimum(cosine, 1.0))
    return float((weights * labels).sum() / weights.sum())


def fit(
    docs: DataFrame, labelled: DataFrame, per_class: int = PER_CLASS,
    neighbours: float = NEIGHBOURS, prefix: int = PREFIX, idf_power: float = IDF_POWER,
) -> Model:
    """A model from `labelled` (doc_id, toxic), whose texts are in `docs`.

    Of each label the `per_class` rows whose ids hash lowest become examples:
    2 * per_class texts are the most that reach the driver.
    """
    terms = Prefixes(prefix)
    prior, sample = labelled_examples(docs, labelled, "toxic", per_class)
    ids = np.array([doc_id for doc_id, _, _ in sample], np.int64)
    toxic = np.array([label for _, label, _ in sample], np.int64)
    numbers: dict[str, int] = {}
    held = []  # of each example its terms' numbers and counts
    for counts in (terms(text) for _, _, text in sample):
        own = np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), np.int64, len(counts))
        held.append((own, np.fromiter(counts.values(), np.int64, len(counts))))
    del sample
    spread = np.bincount(np.concatenate([n for n, _ in held] or [np.zeros(0, np.int64)]), minlength=len(numbers))
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, n in numbers.items() if spread[n] > 1))}
    if len(set(toxic)) < 2 or not vocabulary:
        return Model(None, ids, toxic, 1, prior, (0.0, 0.0), terms)
    n_docs, df = document_frequencies(docs, vocabulary, terms)
    idf = np.log((n_docs + 1.0) / (df + 1.0)) ** idf_power
    place = np.full(len(numbers), -1)
    place[[numbers[t] for t in vocabulary]] = np.arange(len(vocabulary))

    def counts_of(example: int) -> dict[int, int]:
        own, counts = held[example]
        return {i: c for i, c in zip(place[own].tolist(), counts.tolist()) if i >= 0}

    index = BlockMaxIndex.build((counts_of(i) for i in range(len(held))), vocabulary, idf)
    k = max(5, round(neighbours * min(toxic.sum(), (1 - toxic).sum())))
    share = np.zeros(len(ids))
    for first in range(0, len(held), BLOCK):
        some = range(first, min(first + BLOCK, len(held)))
        for i, near, cos in zip(some, *index.search([counts_of(i) for i in some], k + 1)):
            others = np.flatnonzero(near != i)[:k]  # its own vote left out
            share[i] = vote(toxic[near[others]], cos[others])
    weights = np.where(toxic == 1, prior / toxic.sum(), (1 - prior) / (1 - toxic).sum()) * len(ids)
    hand_back()  # the examples, now weights in the index
    return Model(index, ids, toxic, k, prior, logistic(share, toxic, weights), terms)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (nearest examples with label and cosine) per row of `docs`."""

    def rows(texts: list[str | None]) -> Iterator[tuple]:
        for value, seen in model.score(texts):
            yield value, [{"doc_id": i, "toxic": y, "cosine": c} for i, y, c in seen]

    return map_texts(docs, "doc_id bigint", lambda: rows, SCORES)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that score below the threshold, with their columns."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [s < threshold for s, _ in model.score(batch.column("text").to_pylist())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return in_bytes(docs, TEXTS_MB).mapInArrow(handing_back(per_task), docs.schema)
