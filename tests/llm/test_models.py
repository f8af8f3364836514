"""Toxicity, quality and the language model: exactness, held-out accuracy, edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import class_lm, quality, toxicity
from loomlog.llm.nearest import BlockMaxIndex, Prefixes, weigh

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BAD = ("blarg", "zorkish", "quonk", "fribble", "gnarp", "spluk", "drozz", "kvetch")


@pytest.fixture(scope="module")
def corpus(spark):
    """Every fifth text holds bad words, every third is shouted; all are labelled."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(400):
        words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(60)]
        if i % 5 == 0:
            for _ in range(15):
                words[rng.randrange(60)] = rng.choice(BAD)
        if i % 3 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, 0 if i % 3 == 0 else 1, 1 if i % 5 == 0 else 0))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "zz 99", None, None, None), (1003, "bala " * 30_000, None, None, None)]
    labels += [(2000, 1, 1), (None, 1, 1), (3, None, None), (7, 1, 1), (7, 1, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_block_max_search_is_exact():
    rng = random.Random(1)
    vocabulary = {f"t{i}": i for i in range(300)}
    counts = lambda: {rng.randrange(300): rng.randrange(1, 5) for _ in range(25)}
    rows, queries = [counts() for _ in range(500)], [counts() for _ in range(40)] + [{}]
    idf = np.random.default_rng(0).uniform(0, 5, 300)
    index = BlockMaxIndex.build(rows, vocabulary, idf, block=16)
    found, cosine = index.search(queries, 7)

    def dense(counts):
        ids, weights = weigh(counts, idf)
        row = np.zeros(300)
        row[ids] = weights
        return row

    matrix = np.array([dense(r) for r in rows])
    for q, near, cos in zip(queries, found, cosine):
        want = matrix @ dense(q)
        assert np.allclose(np.sort(want)[::-1][:7], cos, atol=1e-5)
        assert np.allclose(want[near], cos, atol=1e-5)


def check_scores(scored, labels, column, least):
    rows = {r.doc_id: r.score for r in scored.collect()}
    assert len(rows) == 404 and all(0 <= s <= 1 for s in rows.values())
    own = {r.doc_id: r[column] for r in labels.collect()}
    right = [(rows[i] >= 0.3) == bool(own[i]) for i in range(400) if i % 4 == 2]
    assert sum(right) >= least * len(right)
    return rows


def test_toxicity_held_out(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels.where("doc_id IS NULL OR doc_id % 4 != 2"))
    rows = check_scores(toxicity.score(docs, model), labels, "toxic", 0.9)
    assert rows[1000] == rows[1001] == model.prior  # empty texts
    evidence = toxicity.score(docs, model).where("doc_id = 5").first().evidence
    assert evidence[0].doc_id == 5 and abs(evidence[0].cosine - 1) < 1e-5
    kept = toxicity.reject_toxic(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == [*docs.columns, "score"]
    assert {r.doc_id for r in kept.collect()} == {i for i, s in rows.items() if s < 0.3}


def test_quality_held_out(corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels.where("doc_id IS NULL OR doc_id % 4 != 2"))
    rows = check_scores(quality.score(docs, model), labels, "quality", 0.95)
    assert rows[1000] == rows[1001] == model.prior


def test_models_without_labels_or_documents(corpus):
    docs, labels = corpus
    for module in (toxicity, quality):
        model = module.fit(docs, labels.limit(0))
        assert {r.score for r in module.score(docs, model).collect()} == {0.0}
        model = module.fit(docs.limit(0), labels)
        assert module.score(docs.limit(0), model).count() == 0


def test_ids_beside_nulls_stay_whole(spark, corpus):
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "a b", None, None, None), (None, "c", None, None, None)], DOCS)
    model = toxicity.fit(docs, corpus[1].limit(0))
    assert {r.doc_id for r in toxicity.score(docs, model).collect()} == {big, None}
    assert {r.doc_id for r in toxicity.reject_toxic(docs, model).collect()} == {big, None}
    assert {r.doc_id for r in class_lm.score(docs, F.lit(True)).collect()} == {big, None}


def brute_base(rows, learn):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in rows}
    counts = Counter(w for i in tokens if learn(i) for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    return {
        i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        for i, ws in tokens.items()
    }


def test_language_model(corpus):
    docs = corpus[0].where("doc_id IS NOT NULL").withColumn("score", F.lit("x"))
    learn = F.col("doc_id") % 7 != 2
    got = class_lm.score(docs, learn, core=64, classes=8).collect()
    want = brute_base([(r.doc_id, r.text) for r in docs.collect()], lambda i: i % 7 != 2)
    assert len(got) == len(want)
    for r in got:
        n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0
    held = [r for r in got if not r.learn]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_without_training_texts(corpus):
    docs = corpus[0].limit(20)
    rows = class_lm.score(docs, F.lit(False)).collect()
    assert len(rows) == 20 and all(r.train_tokens == 0 and r.base_score == 0.0 and math.isfinite(r.score) for r in rows)
    assert class_lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_exchange_finds_alternating_classes():
    flow = np.zeros((12, 12), np.int64)
    flow[:6, 6:], flow[6:, :6] = 10, 10  # two kinds of words that alternate
    of = class_lm.exchange(flow, classes=2)
    assert len(set(of[:6])) == len(set(of[6:])) == 1 and of[0] != of[6]
    chain = 10 ** class_lm.transitions(flow, of, 2)
    assert np.allclose(chain.sum(1), 1)


def test_prefix_terms():
    assert Prefixes(4)("Idiotic idiots 42 été_x") == Counter({"idio": 2, "été": 1, "x": 1})
