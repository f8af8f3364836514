"""Exact dedup, near dedup, components and mixing on small cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import exact_dedup, mixing, near_dedup
from loomlog.llm.components import components


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_largest_id_stays_and_nulls_are_empty(documents):
    docs = documents((1, "a"), (5, "a"), (3, "b"), (7, None), (2, ""), (None, "a"))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.new_index(docs.sparkSession).add(docs).collect()}
    assert got == {
        (1, 5, 3, False), (5, 5, 3, True), (None, 5, 3, False), (3, 3, 1, True), (7, 7, 2, True), (2, 7, 2, False),
    }


def test_second_load_is_deduplicated_against_the_first(documents):
    index = exact_dedup.new_index(documents().sparkSession)
    assert index.add(documents((1, "a"), (2, "b"))).where("kept").count() == 2
    second = documents((3, "a"), (9, "c"), (8, "c"))
    for _ in range(2):  # a load given again gets the same answer
        got = {(r.doc_id, r.keep_id, r.kept) for r in index.add(second).collect()}
        assert got == {(3, 1, False), (9, 9, True), (8, 9, False)}
    assert index.table().count() == 3


def test_rows_equal_in_id_and_text_leave_one(clashing):
    docs = clashing((1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"))
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "c"), (1, "a"), (1, "b")]


def test_empty_tables(documents):
    empty = documents()
    assert exact_dedup.new_index(empty.sparkSession).add(empty).count() == 0
    assert near_dedup.near_duplicate_classes(empty).count() == 0
    assert mixing.sample_copies(empty).count() == 0
    assert mixing.mix(empty).columns == empty.columns


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    rng = random.Random(1)
    rng.shuffle(links)
    got = {r.node: r["class"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


@pytest.fixture(scope="module")
def near(spark):
    """Groups of near copies, a chain, texts that share a passage, and short texts."""
    rng = random.Random(7)
    passage, texts = words(rng, 40), []
    for _ in range(6):
        base = words(rng, 150)
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(150)] = "changed"
            texts.append(" ".join(copy))
    texts += [" ".join(words(rng, 60) + passage) for _ in range(15)]
    texts += ["", None, "one", "one", "one two three", "ONE two THREE", " ".join(words(rng, 20_000))]
    return list(enumerate(texts))


def brute_classes(rows, threshold=0.8):
    docs = [near_dedup.WordHashes()(t) for _, t in rows]
    slots, n = {}, len(rows)
    for w in docs:
        for s in set(near_dedup.slots(w).tolist()):
            slots[s] = slots.get(s, 0) + 1
    import numpy as np

    idf = np.log((n + 1.0) / (np.zeros(1 << near_dedup.SLOT_BITS) + 1.0)) + 1.0
    for s, df in slots.items():
        idf[s] = np.log((n + 1.0) / (df + 1.0)) + 1.0
    sets = [near_dedup.weighted_shingles(w, idf) for w in docs]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            empty = not len(sets[i][0]) and not len(sets[j][0])
            both = len(sets[i][0]) and len(sets[j][0])
            if empty or (both and near_dedup.similarity(*sets[i], *sets[j]) >= threshold):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[root(i)][0] for i in range(n)}


def test_near_classes_equal_brute_force(near, clashing):
    rows = near_dedup.near_duplicate_classes(clashing(*near)).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(near)
    sizes = {}
    for r in rows:
        sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_size == sizes[r.class_id] for r in rows)


def test_one_document_of_each_near_class_stays(near, documents):
    kept = [r.doc_id for r in near_dedup.drop_near_duplicates(documents(*near)).collect()]
    assert sorted(kept) == sorted(set(brute_classes(near).values()))


def test_samples_agree_as_often_as_texts_are_similar():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(1 << 63, size=399).astype(np.uint64))
    weights = rng.uniform(1, 8, 399).astype(np.float32)
    a, b = slice(0, 300), slice(60, 399)
    sampler = near_dedup.Sampler(bands=4000, rows=1)
    same = (sampler.bands_of(keys[a], weights[a])[0] == sampler.bands_of(keys[b], weights[b])[0]).mean()
    assert abs(same - near_dedup.similarity(keys[a], weights[a], keys[b], weights[b])) < 0.03


def test_mix_reaches_targets_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["x"] * rng.choice([0, 3, 50, 400])), None, rng.choice(["a", "a", "a", "b", None]), None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    one, two = (sorted(mixing.sample_copies(docs).collect()) for _ in range(2))
    assert one == two
    taken, targets = {}, {}
    for r in one:
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        targets[r.source] = (r.target, r.source_size)
    for source, (target, size) in targets.items():
        assert abs(taken[source] - target) <= 0.02 * target + 400
        assert target <= 2 * size
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * sum(s for _, s in targets.values())) < 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in one)


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100)], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    total = 1.5 * 1110
    assert got == {"a": 20.0, "b": total - 20 - 200 if (total - 20) / 3 > 200 else (total - 20) * 2 / 3, "c": 200.0}


def test_mix_of_hot_size_and_nulls(spark):
    rows = [(i if i % 7 else None, "same words here", None, None, None) for i in range(5000)] + [(1, None, None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mixing.sample_copies(docs)
    assert got.count() == 5001
    assert got.where(F.col("size") == 0).select("copies").first()[0] == 0
    assert got.groupBy().agg(F.sum("copies")).first()[0] == 7500


def test_copies_that_were_each_changed_elsewhere_are_one_class(documents):
    """Most pairs of them are below the threshold; the text they came from is near to all."""
    rng = random.Random(3)
    base, rows = words(rng, 300), []
    for i in range(120):
        copy = list(base)
        for place in rng.sample(range(300), rng.randrange(1, 8)):
            copy[place] = f"new{i}"
        rows.append((i, " ".join(copy)))
    rows += [(500, " ".join(base)), (501, " ".join(words(rng, 300)))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(documents(*rows)).collect()}
    want = brute_classes(rows)
    assert list(want.values()).count(0) > 60  # most are one class
    assert sum(got[i] == c for i, c in want.items()) >= 0.97 * len(want)
    assert got[501] == 501


def test_members_left_over_meet_block_by_block(spark, monkeypatch):
    """Pairs that no pivot joins are found whatever the size of the blocks."""
    import numpy as np

    keys = {n: np.arange(n // 3 * 100, n // 3 * 100 + 50, dtype=np.uint64) for n in range(60)}  # classes of three
    weights = np.ones(50, np.float32)
    shingles = spark.createDataFrame(
        [(n, k.tobytes(), weights.tobytes()) for n, k in keys.items()], "node bigint, keys binary, weights binary"
    )
    sampler = near_dedup.Sampler()
    sketch = {n: sampler.bands_of(k, weights)[1].tolist() for n, k in keys.items()}
    schema = "key bigint, node bigint, class bigint, sketch array<bigint>, main boolean"
    now = spark.createDataFrame([(n % 2, n, n, sketch[n], n < 2) for n in keys], schema)
    for members, size in ((1024, 4 << 20), (4, 900)):
        monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
        found = near_dedup.left_over(now, shingles, 0.8).select("a", "b").collect()
        joined = {tuple(sorted((r.a, r.b))) for r in found}
        assert joined == {(n, n + 2) for n in range(0, 60, 3)}, (members, joined)


def test_samples_are_the_least_of_all_shingles():
    """What the bound passes over changes no sample."""
    rng = np.random.default_rng(4)
    sampler = near_dedup.Sampler()
    for n in (1, 2, 40, 256, 257, 3000):
        keys = np.sort(rng.integers(1 << 62, size=n).astype(np.uint64))
        weights = (np.exp(rng.normal(0, 3, n)) + 1e-3).astype(np.float32)
        ln = np.log(weights)
        value, t = sampler.value(keys[:, None] * sampler.factor, ln[:, None])
        low = value.argmin(0)
        drawn = near_dedup.mixed(keys[low] + near_dedup.mixed(t.min(0, initial=np.inf, where=np.arange(n)[:, None] == low).astype(np.int64).astype(np.uint64)))
        bands = np.arange(near_dedup.BANDS, dtype=np.uint64)
        for row in range(near_dedup.ROWS):
            bands = near_dedup.mixed(bands * np.uint64(0x5851F42D4C957F2D) + drawn.reshape(near_dedup.BANDS, -1)[:, row])
        assert (sampler.bands_of(keys, weights)[0].view(np.uint64) == bands).all()


def test_texts_are_hashed_and_sampled_together(monkeypatch):
    """Few calls for many texts, few shingles computed, and the results those of each text alone."""
    rng = random.Random(11)
    texts = [" ".join(words(rng, 100)) for _ in range(100)]
    texts += ["", None, "one", " \x1fa\tb ", "Ein\u2003Wort \u00c4h\xa0da\x85zu \U0001f600", "one one one one one one", "  ", " ".join(words(rng, 9000))]
    hashes, sampler, idf = near_dedup.WordHashes(), near_dedup.Sampler(), np.linspace(1, 9, 1 << near_dedup.SLOT_BITS)
    computed, value = [], sampler.value
    monkeypatch.setattr(sampler, "value", lambda bits, ln: computed.append(len(bits)) or value(bits, ln))
    together = list(sampler.many_bands(near_dedup.text_shingles(texts, hashes, idf)))
    monkeypatch.undo()
    sets = [near_dedup.weighted_shingles(hashes(t), idf) for t in texts]
    shingles = sum(len(k) for k, _ in sets)
    assert len(computed) < 30 and sum(computed) < 0.4 * shingles * near_dedup.BANDS * near_dedup.ROWS
    for (bands, sketch), one in zip(together, sets, strict=True):
        alone = sampler.bands_of(*one)
        assert bands.tolist() == alone[0].tolist() and sketch.tolist() == alone[1].tolist()
    known = {}
    for text in texts:
        of_text, plain = hashes(text).tolist(), (text or "").lower().split()
        assert len(of_text) == len(plain)
        assert all(known.setdefault(w, h) == h for w, h in zip(plain, of_text))
    assert len(set(known.values())) == len(known)
