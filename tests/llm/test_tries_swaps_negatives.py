"""Burst trie, packing by swaps and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomlog.llm import burst_trie, hard_negatives, swap_packing
from loomlog.llm.word_ids import WordTokenizer, words_stand_alone

TURNS = "conv_id bigint, turn bigint, role string, text string, head string, path string"
VECTORS = "vec_id bigint, embedding array<float>, label int, score string, shard string"


def plain_trie(paths: dict[int, list]) -> set[tuple]:
    """Nodes of conversations given as lists of (role, text)."""
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda m: [n for n in members if len(n) == len(m) + 1 and n[: len(m)] == m]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((
            min(own), len(node), parent, len(own), len(kids(node)), sum(not kids(n) for n in below), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def nodes_of(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize("rows", [1, 3, 4096])
def test_trie_equals_the_plain_one_at_every_container_size(spark, rows):
    rng = random.Random(rows)
    paths = {c: [("user", f"t{rng.randrange(2)}é") for _ in range(rng.randrange(6))] for c in range(40)}
    paths |= {c: [("user", "t0é")] * 4 for c in range(100, 130)}  # many equal ones
    paths |= {c: [("system", "long")] * 20 + [("user", str(c % 3))] for c in range(200, 209)}  # a long shared beginning
    turns = [(c, t, *turn, "x", "y") for c, own in paths.items() for t, turn in enumerate(own)]
    rng.shuffle(turns)
    frame = burst_trie.sequences(spark.createDataFrame(turns, TURNS))
    have = {c: own for c, own in paths.items() if own}  # a conversation without rows is not in the table
    got = nodes_of(burst_trie.trie(frame, container_rows=rows))
    assert len(got) == len(set(got)) and set(got) == plain_trie(have)


def test_trie_with_shared_beginnings_nulls_ties_and_turnless_conversations(spark):
    rows = [
        (5, 0, "user", "a"), (5, 1, None, "b"), (5, None, "system", None),
        (6, 0, "user", "own"), (6, 1, "user", "more"), (6, 2, "user", "last"),
        (7, 0, "user", "own"), (11, 3, "user", "lonely"), (None, 0, "user", "nobody's"),
        (8, 0, "user", "same"), (8, 0, "user", "same"), (8, 0, "user", "other"),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    count = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    own = burst_trie.sequences(frame)
    rebuilt = {r.conv_id: bytes(r.path) for r in burst_trie.with_shared_beginnings(own, 5, count.cast("int")).collect()}
    paths = {r.conv_id: bytes(r.path) for r in own.collect()}
    assert set(rebuilt) == {5, 6, 7, 8, 11}
    for c, path in rebuilt.items():
        h = zlib.crc32(str(c).encode()) % 9 * 20
        assert path == paths.get(c - c % 5, b"")[:h] + paths[c][h:]
    assert b"" in rebuilt.values()  # the others' beginning is absent, its own is replaced
    got = nodes_of(burst_trie.trie(burst_trie.with_shared_beginnings(own, 5, count.cast("int"))))
    root = next(r for r in got if r[1] == 0)
    assert root[0] == 5 and root[3] == 5 and root[2] is None
    assert root[7] == hashlib.sha256(",".join(str(c) for c in sorted(rebuilt) if not rebuilt[c]).encode()).hexdigest()
    assert paths[5].hex()[:32].upper() == hashlib.sha256(b"6:system").hexdigest()[:32].upper()  # null turn first
    assert paths[8] in {bytes.fromhex(a + a + b) for a, b in [turn_pair()]} | {bytes.fromhex(b + a + a) for a, b in [turn_pair()]}
    empty = spark.createDataFrame([], TURNS)
    assert nodes_of(burst_trie.trie(burst_trie.sequences(empty))) == []


def turn_pair():
    same, other = (hashlib.sha256(b"4:user" + t).hexdigest()[:32] + f"{len(t):08x}" for t in (b"same", b"other"))
    return same, other


def test_ids_of_equal_conversations_join_over_all_ranges(spark):
    ids = [1, 2, 65_535, 65_536, 200_000, 9, -3]
    frame = spark.createDataFrame([(i, b"a" * 20) for i in ids], "conv_id bigint, path binary")
    row = burst_trie.unique_paths(frame).collect()
    want = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert [(r.n, r.first, r.ends) for r in row] == [(7, -3, want)]


SIZES = {
    "lognormal": lambda rng: np.clip(rng.lognormal(6, 1.2, 600), 1, 4096),
    "medium": lambda rng: rng.integers(1200, 1500, 300),
    "equal": lambda rng: np.full(200, 2100),
    "tiny": lambda rng: rng.integers(1, 30, 5000),
    "one": lambda rng: np.array([4096]),
}


@pytest.mark.parametrize("kind", SIZES)
def test_local_search_keeps_items_and_never_needs_more_bins(kind):
    sizes = SIZES[kind](np.random.default_rng(1)).astype(np.int64)
    start, bins = swap_packing.best_fit(sizes, 4096), swap_packing.pack_sizes(sizes, 4096)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert max(sizes[b].sum() for b in bins) <= 4096
    least = -(-sizes.sum() // 4096)
    assert least <= len(bins) <= len(start)
    assert kind != "medium" or len(bins) < len(start)


def test_exchanges_of_every_kind_empty_a_bin():
    cases = {
        "move": ([[6], [3, 2], [1]], [6, 3, 2, 1], 10),
        "one for one": ([[7, 2], [3, 6]], None, 10),
        "two for one": ([[3, 3], [5, 4]], None, 10),
        "one for two": ([[5], [2, 2, 4]], None, 10),
    }
    for name, (held, _, capacity) in cases.items():
        sizes = np.array([s for b in held for s in b], np.int64)
        places, at = [], 0
        for b in held:
            places.append(list(range(at, at + len(b))))
            at += len(b)
        before = sum(int(sizes[b].sum()) ** 2 for b in places)
        after = swap_packing.LocalSearch(sizes, places, capacity).run()
        assert sum(int(sizes[b].sum()) ** 2 for b in after) >= before, name
        assert all(sizes[b].sum() <= capacity for b in after)


def test_swap_packing_round_trip(spark, documents, clashing):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["word", "Étude,", "x1", "don't", "ß"]) for _ in range(rng.randrange(0, 300))) for _ in range(120)]
    texts += [None, "", "a " * 9000, texts[0], "b " * 4095]
    docs = clashing(*[(None if i == 3 else i % 100, t) for i, t in enumerate(texts)]).repartition(7)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = swap_packing.pack(docs, path).collect()
    whole, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= 4096 and len(r.ids) == 4 * r.length
        assert r.piece == r.start // 4096 and (r.length == 4096 or r.start + r.length == r.doc_tokens)
        whole[r.doc_id].append((r.start, bytes(r.ids)))
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    tokenizer = Tokenizer.from_file(path)
    want = defaultdict(list)
    for i, t in enumerate(texts):
        ids = array("I", tokenizer.encode(t or "", add_special_tokens=False).ids + [1]).tobytes()
        want[None if i == 3 else i % 100] += [(s // 4, ids[s : s + 4 * 4096]) for s in range(0, len(ids), 4 * 4096)]
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
    # Seven small partitions lose no bin each: their open bins are packed together.
    assert len(filled) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert swap_packing.pack(documents(), path).count() == 0


def test_words_are_encoded_as_the_library_encodes_texts():
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    assert words_stand_alone(definition)
    own, tokenizer = WordTokenizer(definition), Tokenizer.from_str(definition)
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(32, 0x250), 0x301, 0x1E9E, 0x4E2D, 0xAC00, 0x200B, 0x2028, 9, 10, 13, 0x85, 0xA0, 0x660, 0x1F600]]
    pool += ["'s", "<|endoftext|>", " ", " ", "\n", "ΣΑΣ", "İI"]
    for text in ("".join(rng.choices(pool, k=rng.randrange(12))) for _ in range(5000)):
        assert own.encode([text])[0] == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_a_file_with_other_habits_is_left_to_the_library():
    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    assert not words_stand_alone(definition)
    text = "Two  words, and\n\nmore"
    want = array("I", Tokenizer.from_str(definition).encode(text, add_special_tokens=False).ids).tobytes()
    assert WordTokenizer(definition).encode([text]) == [want]


def plain_negatives(rows, anchors, k, part, whole):
    out = set()
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(rows[a][1], rows[b][1]))
    for a in anchors:
        others = [b for b in rows if b != a and len(rows[b][1]) == len(rows[a][1])]
        ranked = sorted(others, key=lambda b: (-score(a, b), b))
        for p in [b for b in ranked if rows[b][0] == rows[a][0]][:k]:
            top = score(a, p)
            fit = [b for b in ranked if rows[b][0] != rows[a][0] and part * top <= whole * score(a, b) <= whole * top]
            out |= {(a, p, r + 1, b, top, score(a, b)) for r, b in enumerate(fit[:k])}
    return out


@pytest.mark.parametrize("shape", ["random", "clusters", "copies", "large"])
def test_hard_negatives_equal_brute_force(spark, shape):
    rng = np.random.default_rng(7)
    n = 500
    x = rng.normal(size=(n, 12)) / 3
    if shape == "clusters":
        x = rng.normal(size=(5, 12))[rng.integers(0, 5, n)] + rng.normal(size=(n, 12)) / 50
    if shape == "copies":
        x[::3] = x[0]  # a third of all rows are one vector
        x[5] = 0
    if shape == "large":
        x *= 30_000  # products beyond what a double holds
    x = x.astype(np.float32)
    labels = rng.integers(0, 4, n)
    frame = spark.createDataFrame(
        [(i, [float(v) for v in x[i]], int(labels[i]), "x", "y") for i in range(n)], VECTORS
    )
    rows = hard_negatives.valid(frame, "vec_id", "embedding", F.col("label"))
    miner = hard_negatives.Miner(rows, shard_rows=100)
    anchors = rows.where("id % 10 = 0")
    got = [tuple(r) for r in miner.mine(anchors, miner.positives(anchors, 5), 5, (80, 100)).collect()]
    plain = {i: (int(labels[i]), np.floor(256 * x[i].astype(np.float64))) for i in range(n)}
    want = plain_negatives(plain, range(0, n, 10), 5, 80, 100)
    assert want and len(got) == len(set(got)) and set(got) == want


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (3, [0.9, 0.0], 3), (3, [0.9, 0.0], 3),
        (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 0.0], 2), (8, [1.0, 0.0], None),
        (None, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 2), (10, [0.0, 0.0], 2), (11, [], 2), (12, [1e30, 0.0], 2), (13, [0.1, 0.0], 2),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    valid = hard_negatives.valid(frame, "vec_id", "embedding", F.col("label"))
    assert sorted(r.id for r in valid.collect()) == [0, 1, 2, 3, 9, 10, 11, 13]
    miner = hard_negatives.Miner(valid)
    anchors = valid.where("id % 100 = 0")
    got = sorted(tuple(r) for r in miner.mine(anchors, miner.positives(anchors, 5), 5, (80, 100)).collect())
    assert got == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 3, 65536, 58880)]
    none = hard_negatives.valid(frame.limit(0), "vec_id", "embedding", F.col("label"))
    miner = hard_negatives.Miner(none)
    assert miner.mine(none, miner.positives(none, 5), 5, (80, 100)).count() == 0


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(-300, 300, (200, 8)), rng.integers(-2, 3, (50, 8)), np.zeros((1, 8), int), np.full((1, 8), 2**20)]).astype(np.int32)
    references = hard_negatives.far_apart(rows[:50], 6)
    length, angle = hard_negatives.angles_to(rows, references)
    below, above = hard_negatives.score_bounds(length, angle, length, length, angle, angle)
    exact = rows.astype(np.int64) @ rows.astype(np.int64).T
    assert (below <= exact).all() and (exact <= above).all()
