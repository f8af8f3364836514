"""Labelled examples and corpus statistics for classifiers that vote by examples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import TEXTS_MB, few_rows, handing_back, in_bytes


def labelled_examples(
    docs: DataFrame, labelled: DataFrame, label: str, per_class: int
) -> tuple[float, list[tuple[int, int, str]]]:
    """The share of label 1 among all labels, and of each label the `per_class`
    rows (doc_id, label, text) whose ids hash lowest, among those with a text.

    Ids with a null label or with two different ones are left out. At most
    2 * per_class texts reach the driver.
    """
    labels = (
        labelled.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("other"))
        .where("y = other")
        .select("doc_id", "y")
        .join(docs.select("doc_id").hint("merge"), "doc_id", "left_semi")
    )
    totals = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = [labels.where(F.col("y") == y).orderBy(*order).limit(per_class).collect() for y in (0, 1)]
    of = {r["doc_id"]: r["y"] for rows in drawn for r in rows}
    # Only the texts of the drawn ids move; an id that repeats gives one of them.
    ids = few_rows(docs.sparkSession, [(i,) for i in of], "doc_id bigint")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    text_of = {r["doc_id"]: r["text"] for r in texts.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return totals.get(1, 0) / max(1, sum(totals.values())), [(i, y, text_of[i]) for i, y in of.items()]


def document_frequencies(
    docs: DataFrame, vocabulary: dict[str, int], terms: Callable[[str | None], Counter]
) -> tuple[int, np.ndarray]:
    """The number of all documents, and of those that hold each term of the vocabulary.

    `terms` may have a method `distinct` that gives a text's terms without counts.
    """
    size, distinct = len(vocabulary), getattr(terms, "distinct", terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            df[size] += len(batch)
            for text in batch["text"]:
                df[[vocabulary[t] for t in distinct(text) if t in vocabulary]] += 1
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": some, "n": df[some]})

    counted = in_bytes(docs.select("text"), TEXTS_MB).mapInPandas(handing_back(count), "term bigint, n bigint")
    df = np.zeros(size + 1, np.int64)
    for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return int(df[size]), df[:size]


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted, lightly damped logistic fit."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weights * (y - p)) - 1e-3 * beta
        hessian = (design * (weights * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])
