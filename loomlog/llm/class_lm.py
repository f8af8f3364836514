"""A class-based bigram language model: word classes by exchange clustering.

P(word | previous) = P(class | previous class) * P(word | class). The classes come
from exchange clustering of the training text's class bigrams: unit by unit moves
to the class that raises the likelihood most, until a round moves few. Units are the
`CORE` most frequent words, each on its own, and groups of all other words by
ending and punctuation; so every word, also an unseen one, has a class, and the
clustering's counts are of bounded size at any size of the corpus. Emissions use
the exact training count of each word, with absolute discounting; what the
discount frees in a class belongs to its unseen words. Transitions are smoothed
by the classes' own frequencies.

How the exact counts reach the texts: documents are gathered in blocks of
bounded text size and numbered word by word within their block; what is shuffled
is one row per block and distinct word, once to sum its counts and once back to
its block, where the blocks' documents are scored. Nothing else grows with the
vocabulary.

Defined cases: a null or empty text is its end token alone; texts of any length are
scored whole, in one block each. Of words equally frequent the smaller is core first, and
of classes equally good a word takes the first. Words are what white
space separates after A-Z became lower case. Repeated rows and null ids are rows
like others (a null id counts as '' for what is held out). Other columns are
ignored, whatever their names. Without training texts every count is 0 and
all scores are those of the smoothing. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import arrow_schema, in_bytes
from loomlog.session import scratch_path

CORE = 1024
GROUPS = 512
CLASSES = 48
ROUNDS = 12
#: Characters of text in one block, about.
BLOCK_CHARS = 24_000_000
#: Pseudo-count of the class frequencies in a transition.
BACKING = 5.0
REMEMBERED = 500_000
#: Pairs of words counted at once.
PAIRS = 4_000_000
#: The end of a text; no word can be equal to it.
END = b" "
#: A-Z to lower case, in UTF-8.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
ENCODED = (
    "kind string, block bigint, doc_id bigint, learn boolean, ids binary,"
    " word string, local int, units int, n bigint"
)
SCORED = (
    "doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
    " base_score double, score double"
)


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8, and the end; bytes are split at just the six white characters."""
    return [*(text or "").encode().translate(LOWER).split(), END]


def group_of(utf8: bytes) -> int:
    """The group of a word outside the core, by its ending, its marks and its digits."""
    word = utf8.decode()
    letters = word.rstrip(MARKS)
    marks = ("a" + word[len(letters) :])[-3:]
    if not letters.isalpha():
        letters = re.sub(r"[\W\d_]+", "", word)
        marks = re.sub(r"[^\W\d_]+", "a", word)[-3:]
    return zlib.crc32(f"{letters[-2:]} {marks if letters else '#' + marks[:1]}".encode("utf-8", "replace")) % GROUPS


def encode(docs: DataFrame, learn: Column) -> str:
    """Documents as numbers within their block, and the words of each block with
    their training counts, below the returned folder in shared storage.
    """

    schema = arrow_schema(ENCODED)
    filled = lambda **columns: pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(columns["kind"]), f.type) for f in schema],
        schema=schema,
    )

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        numbers: dict[bytes, int] = {}
        counts = np.zeros(1 << 16, np.int64)
        chars = 0

        def documents(rows: list[tuple]) -> pa.RecordBatch:
            doc_id, learns, ids = zip(*rows) if rows else ((), (), ())
            return filled(kind=["doc"] * len(rows), block=[block] * len(rows), doc_id=doc_id, learn=learns, ids=ids)

        def vocabulary() -> pa.RecordBatch:
            n = len(numbers)
            return filled(
                kind=["word"] * n, block=np.full(n, block), word=[w.decode() for w in numbers], local=np.arange(n, dtype=np.int32),
                units=np.array([0 if w == END else group_of(w) for w in numbers], np.int32), n=counts[:n],
            )

        for batch in batches:
            rows = []
            for doc_id, text, learns in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "learn"))):
                if chars > BLOCK_CHARS:
                    yield documents(rows)
                    yield vocabulary()
                    rows, chars, block = [], 0, block + 1
                    numbers, counts = {}, np.zeros(1 << 16, np.int64)
                words = tokens(text)
                for word in set(words).difference(numbers):
                    numbers[word] = len(numbers)
                ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                if len(numbers) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(numbers)), np.int64)])
                if learns:
                    counts[: len(numbers)] += np.bincount(ids, minlength=len(numbers))
                chars += len(text or "")
                rows.append((doc_id, bool(learns), ids.tobytes()))
            yield documents(rows)
        if numbers:
            yield vocabulary()

    path = scratch_path(docs.sparkSession, "lm-encoded")
    rows = in_bytes(docs.select("doc_id", "text", learn.alias("learn"))).mapInArrow(per_task, ENCODED)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


@dataclass
class Units:
    """Numbers of words: the core's first, then those of the groups."""

    core: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.core) + GROUPS

    def of(self, word: bytes) -> int:
        number = self.core.get(word)
        return len(self.core) + group_of(word) if number is None else number


def unit_bigrams(docs: DataFrame, units: Units) -> np.ndarray:
    """How often each unit follows each other one in `docs`; texts begin after an end."""
    size = units.size

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            seen, held = [], 0
            for text in batch["text"]:
                words = tokens(text)
                for word in set(words).difference(known):
                    known[word] = units.of(word)
                line = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                seen.append(np.concatenate([[known[END]], line[:-1]]) * size + line)
                held += len(line)
                if held > PAIRS:
                    total += np.bincount(np.concatenate(seen), minlength=len(total))
                    seen, held = [], 0
            if seen:
                total += np.bincount(np.concatenate(seen), minlength=len(total))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"pair": some, "n": total[some]})

    pairs = in_bytes(docs.select("text")).mapInPandas(count, "pair bigint, n bigint")
    total = np.zeros(size * size, np.int64)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["pair"]] = r["n"]
    return total.reshape(size, size)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Of each unit its class: a local maximum of the class bigram likelihood.

    Units move in order of frequency; they start in classes dealt at random.
    """
    flow = bigrams.astype(np.float64)
    size = len(flow)
    weight = flow.sum(0) + flow.sum(1)
    order = np.argsort(-weight, kind="stable")
    of = np.random.default_rng(0).permutation(np.arange(size) % classes)
    member = np.eye(classes)[of]
    between = member.T @ flow @ member
    onward, backward = flow @ member, flow.T @ member  # unit x class

    def plogp(x):
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(rounds):
        moved = 0
        for w in order[weight[order] > 0]:
            a, own = of[w], flow[w, w]
            right, left = onward[w].copy(), backward[w].copy()
            right[a] -= own
            left[a] -= own
            between[a, :] -= right
            between[:, a] -= left
            between[a, a] -= own
            out, into = between.sum(1) + left, between.sum(0) + right  # flows to and from the word stay
            gain = (plogp(between + right) - plogp(between)).sum(1)
            gain += (plogp(between + left[:, None]) - plogp(between)).sum(0)
            own_cell = np.diag(between)
            gain -= plogp(own_cell + right) + plogp(own_cell + left) - 2 * plogp(own_cell)
            gain += plogp(own_cell + right + left + own) - plogp(own_cell)
            gain -= plogp(out + right.sum() + own) - plogp(out)
            gain -= plogp(into + left.sum() + own) - plogp(into)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            between[b, :] += right
            between[:, b] += left
            between[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                onward[:, a] -= flow[:, w]
                onward[:, b] += flow[:, w]
                backward[:, a] -= flow[w, :]
                backward[:, b] += flow[w, :]
        if moved <= size // 200:
            break
    return of


def transitions(bigrams: np.ndarray, of: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """log10 P(next class | class)."""
    member = np.eye(classes)[of]
    between = member.T @ bigrams @ member
    single = (between.sum(0) + 1) / (between.sum() + classes)
    return np.log10((between + BACKING * single) / (between.sum(1, keepdims=True) + BACKING))


def score(docs: DataFrame, learn: Column, core: int = CORE, classes: int = CLASSES) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score per row of
    `docs`; the model learns from the rows where `learn` holds.
    """
    spark = docs.sparkSession
    path = encode(docs, learn)
    encoded = lambda: spark.read.schema(ENCODED).parquet(path)
    in_blocks = encoded().where("kind = 'word'").select("block", "local", "word", "units", "n")
    words = in_blocks.groupBy("word").agg(F.sum("n").alias("n"), F.first("units").alias("units")).where("n > 0")
    top = words.where(F.col("word") != END.decode()).orderBy(F.desc("n"), "word").limit(core).select("word").collect()
    units = Units({w: i for i, w in enumerate([END, *(r["word"].encode() for r in top)])})
    bigrams = unit_bigrams(docs.where(learn), units)
    of = exchange(bigrams, classes)
    chain = transitions(bigrams, of, classes)

    core_class = F.broadcast(  # at most `core` + 1 rows
        spark.createDataFrame([(w.decode(), int(of[i])) for w, i in units.core.items()], "word string, own int")
    )
    group_class = F.array(*[F.lit(int(c)) for c in of[len(units.core) :]])
    classed = lambda rows: rows.join(core_class, "word", "left").withColumn(
        "class", F.coalesce("own", F.get(group_class, F.col("units")))
    )
    sums = (
        classed(words)
        .groupBy("class")
        .agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        .collect()
    )
    n_all, types = sum(r["n"] for r in sums), sum(r["types"] for r in sums)
    spread = {r["class"]: r for r in sums}
    emission = []
    for c in range(classes):
        r = spread.get(c)
        discount = 0.5 if not r or not r["n1"] else min(0.95, max(0.05, r["n1"] / (r["n1"] + 2 * r["n2"])))
        size = r["n"] if r else 0
        unseen = np.log10(discount * r["types"] / size) if r else 0.0
        emission.append((c, float(discount), float(size), float(unseen)))
    emission = F.broadcast(spark.createDataFrame(emission, "class int, discount double, size double, unseen double"))
    counted = in_blocks.withColumn("n", F.sum("n").over(Window.partitionBy("word")))
    looked_up = classed(counted).join(emission, "class").select(
        "block", "local", "n", "class",
        F.when(F.col("n") > 0, F.log10((F.col("n") - F.col("discount")) / F.col("size")))
        .otherwise(F.col("unseen")).alias("emission"),
    )
    scale = float(np.log10(n_all + types + 1.0))

    schema = arrow_schema(SCORED)

    def per_block(texts: pa.Table, block: pa.Table) -> pa.Table:
        place = block.column("local").to_numpy()
        n, klass, logp = (np.zeros(len(place), t) for t in (np.int64, np.int64, np.float64))
        for into, column in ((n, "n"), (klass, "class"), (logp, "emission")):
            into[place] = block.column(column).to_numpy()
        base = np.log10(n + 1.0) - scale
        out = []
        for ids in texts.column("ids").to_pylist():
            ids = np.frombuffer(ids, np.int32)
            line = klass[ids]
            before = np.concatenate([line[-1:], line[:-1]])  # a text begins after an end, as it ends
            total = logp[ids].sum() + chain[before, line].sum()
            out.append((len(ids), int((n[ids] > 0).sum()), n_all, base[ids].sum(), total))
        columns = zip(*out) if out else [()] * 5
        arrays = [texts.column("doc_id"), texts.column("learn")]
        arrays += [pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:])]
        return pa.Table.from_arrays(arrays, schema=schema)

    texts = encoded().where("kind = 'doc'").select("block", "doc_id", "learn", "ids")
    return (
        texts.groupBy("block")
        .cogroup(looked_up.groupBy("block"))
        .applyInArrow(per_block, SCORED)
    )
