"""Packing, licences, personal data and nearest neighbours on small cases; the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomlog.llm import disclosure, graph_ann, licenses, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DEFINITION = open(PATH, encoding="utf-8").read()
TOKENIZER, WORDS = Tokenizer.from_str(DEFINITION), packing.WordTokenizer(DEFINITION)
ODD = list("abcABCİßéÉ'.,!-_<|>@0123 \n\t\x0b\x1c\u0085 　́") + ["<|endoftext|>", "'s", "<|ENDOFTEXT|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(ODD)), max_size=20).map("".join))
def test_word_tokenizer_equals_the_library(text):
    assert WORDS.encode([text])[0] == array("I", TOKENIZER.encode(text, add_special_tokens=False).ids).tobytes()


def test_packing_round_trip(documents):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta!", "Ünit"]) for _ in range(rng.choice([0, 1, 9, 300, 700, 9000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (2**60 + 1, "big id"), (None, "null id"), (7, "again"), (7, "again")]
    pieces = packing.pack(documents(*rows), PATH).collect()
    want = Counter()
    for doc_id, text in rows:
        want[doc_id, array("I", [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]).tobytes()] += 1
    got, open_ = Counter(), {}
    for p in sorted(pieces, key=lambda p: (p.doc_id or -1, p.start, p.doc_tokens)):
        assert len(p.ids) == 4 * p.length
        key = (p.doc_id, p.doc_tokens)
        begun = open_.setdefault(key, [])
        if p.start == 0:
            begun.append(b"")
        at = next(i for i, b in enumerate(begun) if len(b) == 4 * p.start)
        begun[at] += p.ids
    for (doc_id, _), texts in open_.items():
        got.update((doc_id, t) for t in texts)
    assert got == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.window))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _, _ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))]
        total = sum(n for _, n, _ in parts)
        assert total == parts[0][2] <= 4096 and total & (total - 1) == 0
    assert packing.pack(documents(), PATH).count() == 0


def test_step_groups_hold_equally_many_tokens(documents):
    rng = random.Random(1)
    rows = [" ".join(["word"] * rng.randrange(1, 900)) for _ in range(300)]
    pieces = packing.pack(documents(*rows).coalesce(1), PATH, step_tokens=8192).collect()
    groups = Counter()
    for _, window, group in {(p.sequence_id, p.window, p.step_group) for p in pieces}:
        groups[window, group] += window
    full = [n for (window, _), n in groups.items() if n == 8192]
    assert len(full) >= len(groups) - 2 * len({w for w, _ in groups})
    assert max(groups.values()) == 8192


def scan(text):
    return licenses.Scanner().matches(licenses.words_of(text))


def test_template_markup():
    t = licenses.Template("x", "a [ b | c d ] ( e | f g ) {2} h")
    accepts = lambda s: t.end_at(s.encode().split(), 0) == len(s.split())
    assert all(map(accepts, ["a e h", "a b e h", "a c d f g h", "a f g 1 h", "a e 1 2 h"]))
    assert not any(map(accepts, ["a h", "a b c d e h", "a e 1 2 3 h", "a d e h", "e h"]))


def test_licence_notices():
    labels = lambda text: {m[0] for m in scan(text)}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by", "CC-BY-NC"}
    assert labels("Licensed under the Apache License, Version 2.0.") == {"Apache-2.0"}
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl", "GPL-3.0"}
    assert labels("released under the terms of the MIT license") == {"MIT"}
    assert labels("Copyright (c) 2020 Some One. All rights reserved.") == {"reserved", "copyright"}
    assert labels("released under a MIT license; the general public") == set()
    assert scan("") == scan(None) == []


ACCEPTED = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License);"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"
            " provided that the following conditions are met:"),
    ("CC-BY", "Licensed under a Creative Commons Attribution 4.0 licence."),
    ("CC-BY-NC", "under CC BY-NC 4.0"),
    ("CC-BY-SA", "the Creative Commons Attribution-ShareAlike 3.0 licence"),
    ("CC0", "This data is released under CC0."),
    ("CC0", "CC0 1.0 Universal"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation;"
                " either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation,"
                " either version 3 of the License"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without"
            " fee is hereby granted"),
    ("LGPL", "the GNU Lesser General Public License"),
    ("MIT", "Distributed under the terms of the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and'
            ' associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("copyright", "Copyright (c) 2020 Some One. All rights reserved."),
]


@pytest.mark.parametrize(("label", "text"), ACCEPTED)
def test_every_template_accepts_its_notice(label, text):
    assert label in {m[0] for m in scan(text) if not m[1]}


def test_each_template_has_an_accepted_text():
    for label, markup in licenses.TEMPLATES:
        alone = licenses.Scanner((), [(label, markup)])
        assert any(alone.matches(licenses.words_of(text)) for _, text in ACCEPTED), markup


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["cc", "by", "CC", "general", "public", "license", "all", "rights", "reserved", "é", "x1"]), max_size=30), st.sampled_from([" ", "-", ". ", "\n"]))
def test_base_phrases_equal_brute_force(words, between):
    text = between.join(words)
    lower = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    want = sorted(
        (label, i) for label, phrase in licenses.PHRASES for i in range(len(lower)) if lower[i : i + len(phrase.split())] == phrase.split()
    )
    assert sorted((m[0], m[2]) for m in scan(text) if m[1]) == want


def test_scan_keeps_rows(clashing):
    rows = licenses.scan(clashing((1, None), (None, "cc by"), (2**61 + 1, "x"))).collect()
    assert {(r.doc_id, r.n_words, len(r.matches)) for r in rows} == {(1, 0, 0), (None, 2, 1), (2**61 + 1, 1, 0)}


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0) for i, c in enumerate(d[::-1])) % 10 == 0

    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    found = [(m.start(), k, m.end(), name) for k, (name, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok[name](m[0])]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def test_base_spans_equal_brute_force(documents):
    rng = random.Random(9)
    parts = ["a@b.cc", "x.y@z-z.org", "@", ".", "192.168.0.1", "300.1.1.1", "0.00.000.0007", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+49 (30) 1234567", "+1", " ", "é", "😀", "%", "q@w.v%r@t.u", "5", "55.5", "-", "+"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    texts += [None, "", "1 " * 30_000, "9" * 50_000, "a" * 40_000 + "@b.c", "+1" + " 1" * 20_000, "1.2.3.4 " * 500]
    rows = disclosure.find(documents(*texts)).select("doc_id", disclosure.written(F.col("base")).alias("base")).collect()
    assert {r.doc_id: r.base for r in rows} == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_query_counts_each_kind(spark, documents, tmp_path):
    from loomlog.llm.queries import QUERIES

    texts = ["10.0.0.1 10.0.0.2 10.0.0.3", "a@b.cc c@d.ee", "4111 1111 1111 1111", "+49 (30) 1234567 and 1.2.3.4", None, "none"]
    documents(*texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op9_disclosure"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        kinds = [span.partition(":")[0] for span in brute_spans(text).split(",")]
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]


def test_disclosing_terms(clashing):
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice(["the", "and", "some", "other", "words"]) for _ in range(n))
    rows = [f"{noise(5)} Zebulon wrote to zeb@mail.org {noise(5)} {i}" for i in range(4)]
    rows += [f"{noise(6)} ZEBULON was here {noise(3)} {i}" for i in range(3)] + [f"{noise(12)} {i}" for i in range(60)]
    rows += [None, "", rows[0], rows[0]]
    docs = clashing(*rows)
    got = {r.doc_id: r for r in disclosure.find(docs).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        marked = {text[s.start : s.end].lower() for s in got[i].terms} if text else set()
        assert ("zebulon" in marked) == bool(text and "zebulon" in text.lower())
        assert not marked & {"the", "and", "some", "other", "words"}
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "[TERM]" in clean[4] and "zeb" not in clean[0].lower()
    assert clean[10] == rows[10]
    assert disclosure.find(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(20, size=1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    x[1000:1400] = x[0]  # one vector with more than a quarter of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] * 24), (2150, [None] + [1.0] * 23), (None, [1.0] * 24), (2200, [1.0, 2.0]), (50, x[50].tolist())]
    return x, spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))


def test_graph_search_recall(vectors):
    x, frame = vectors
    rows = graph_ann.valid(frame, "vec_id", "embedding").cache()
    index = graph_ann.build_index(rows, keep=6, shard_rows=400)
    assert index.where("dim = 24").count() > 1
    found = graph_ann.search(index, rows.where("id % 50 = 0"), k=5).collect()
    wide = x.astype(np.float64)
    length = np.sqrt((wide**2).sum(1))
    hits, by_query = 0, {}
    for r in found:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert set(by_query) == set(range(0, 1500, 50))  # 2200 has no candidate of its length
    for q, got in by_query.items():
        cosine = wide @ wide[q] / (length * length[q])
        want = [i for i in np.lexsort((np.arange(1500), -cosine.round(12))) if i != q][:5]
        assert [r for r, _, _ in sorted(got)] == [1, 2, 3, 4, 5]
        assert all(abs(cosine[i] - s) < 1e-12 for _, i, s in got)
        hits += len(set(want) & {i for _, i, _ in got})
    assert hits >= 0.95 * 5 * len(by_query)
    few = graph_ann.valid(frame.where("vec_id in (0, 50, 7)"), "vec_id", "embedding")
    got = graph_ann.search(graph_ann.build_index(few, keep=6), few.where("id % 50 = 0"), k=5)
    assert sorted((r.query_id, r["rank"]) for r in got.collect()) == [(0, 1), (0, 2), (50, 1), (50, 2)]
    empty = few.limit(0)
    assert graph_ann.search(graph_ann.build_index(empty, keep=6), empty, k=5).count() == 0


def test_pipeline_stages(spark):
    """Each stage against a plain statement of what it must have done."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.collect(), docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test-stage")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            assert set(after) <= set(before)
        if name == "toxicity":
            assert not toxic & {r.doc_id for r in after} and len(after) > 0.6 * len(before)
        if name == "exact_dedup":
            last = {}
            for r in before:
                last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(last.values())
        if name == "near_dedup":
            assert len(before) * 0.9 < len(after) <= len(before)
        if name == "source_mix":
            assert max(Counter(r.doc_id for r in after).values()) <= 2
            words = lambda rows: sum(len((r.text or "").split()) for r in rows)
            assert abs(words(after) / words(before) - 1.5) < 0.1
        if name == "packing":
            want = Counter()
            for r in before:
                want[r.doc_id] += len(TOKENIZER.encode(r.text or "", add_special_tokens=False).ids) + 1
            got = Counter()
            for r in after:
                got[r.doc_id] += r.length
            assert got == want
