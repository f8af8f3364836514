"""Hard negatives by angular triangle filtering.

Vectors are taken as whole numbers, floor(256 x). Each keeps its length and its angles
to a few reference directions. The angle between two vectors is at least the largest
difference of their angles to a reference, and at most the smallest sum (or what the sum
leaves of a full turn): this gives an interval of their cosine, and, times the lengths,
bounds of their inner product, widened by more than rounding can take away. Rows stand in
groups of near angles; first a group's bounds, then a row's, are laid beside the window of
scores that is wanted, and only where these overlap is the integer product taken. For an
anchor's positives the window is open above and begins at the best scores found so far;
for its negatives it is the share of a positive's score that the caller names.

Rows are dealt by hash to shards of bounded size, anchors to blocks; each block meets
each shard once for the positives and once for the negatives, and only the best few of
each meeting are shuffled. Angles are stored with the shards. References are picked, far
from one another, from a bounded sample of rows (`SAMPLE`); they serve to filter only, so
results do not depend on them.

Defined cases: rows with a null id or label, a null vector, or null or non-finite parts
take no part; nor do vectors whose numbers are longer than 2^28 together, since products
of such might not fit in 64 bits. Vectors of different lengths are never compared. Of rows that
repeat an id, the one with the smallest (label, vector) counts. Zero and empty vectors
score 0 with everything. Ties go to the smaller id. Other columns are ignored, whatever
their names. An empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import arrow_rows, stored

SHARD_ROWS = 8192
ANCHOR_BLOCK = 4096
REFERENCES, SAMPLE = 8, 1024
#: Rows with one pair of bounds, and anchors compared together.
GROUP, TOGETHER = 128, 64
#: Widening of angles, and of scores as a share of the two lengths.
ANGLE_SLACK, SCORE_SLACK = 1e-7, 1e-9
LONGEST = float(1 << 28)
SHARD = "dim int, shard int, ids binary, labels binary, numbers binary, angles binary"
FOUND = "anchor_id bigint, positive_id bigint, id bigint, score bigint"


def valid(vectors: DataFrame, id_column: str, vector_column: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part, as whole numbers, one per id."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate("wide", F.lit(0.0), lambda s, x: s + x * x)
    return (
        vectors.where(F.col(id_column).isNotNull() & label.isNotNull() & v.isNotNull() & finite)
        .select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: 256.0 * x).alias("wide"))
        .where(length < LONGEST**2)
        .select("id", "label", F.transform("wide", lambda x: F.floor(x).cast("int")).alias("vector"))
        .groupBy("id")
        .agg(F.min(F.struct("label", "vector")).alias("row"))
        .select("id", "row.*")
    )


def far_apart(rows: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of up to `count` rows, each far from those before it."""
    length = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
    unit = rows[length > 0] / length[length > 0, None]
    chosen: list[np.ndarray] = []
    nearest = np.full(len(unit), -1.0)
    while len(unit) and len(chosen) < count:
        chosen.append(unit[nearest.argmin()])
        nearest = np.maximum(nearest, unit @ chosen[-1])
    return np.array(chosen).reshape(len(chosen), rows.shape[1])


def angles_to(numbers: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows and their angles to the references, row x reference."""
    wide = numbers.astype(np.float64)
    length = np.sqrt((wide**2).sum(1))
    cosine = (wide @ references.T) / np.where(length > 0, length, 1)[:, None]
    return length, np.arccos(np.clip(cosine, -1, 1))


def score_bounds(
    length: np.ndarray, angle: np.ndarray, least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of inner products, anchor x group.

    An anchor has its `length` and `angle` to each reference; a group lengths from
    `least` to `most` and angles from `low` to `high`.
    """
    near = np.zeros((len(length), len(most)))
    far = np.full((len(length), len(most)), np.pi)
    for r in range(angle.shape[1]):
        a, lo, hi = angle[:, r, None], low[None, :, r], high[None, :, r]
        np.maximum(near, np.maximum(lo - a, a - hi), out=near)
        np.minimum(far, np.minimum(a + hi, 2 * np.pi - a - lo), out=far)
    nearest, farthest = np.cos(np.maximum(near - ANGLE_SLACK, 0)), np.cos(np.minimum(far + ANGLE_SLACK, np.pi))
    top, bottom = length[:, None] * most, length[:, None] * least
    slack = SCORE_SLACK * top + 1e-6
    above = np.where(nearest > 0, top * nearest, bottom * nearest) + slack
    below = np.where(farthest < 0, top * farthest, bottom * farthest) - slack
    return below, above


class Shard:
    """Rows of one shard, sorted by label and angle, with the bounds of their groups."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, numbers: bytes, angles: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.numbers = np.frombuffer(numbers, np.int32).reshape(len(self.ids), dim)
        self.angles = np.frombuffer(angles, np.float64).reshape(len(self.ids), -1)
        self.length = np.sqrt((self.numbers.astype(np.float64) ** 2).sum(1))
        self.wide = self.numbers.astype(np.float64)

    def starts(self, first: int, end: int) -> np.ndarray:
        return np.arange(first, end, GROUP)

    def overlapping(self, length: np.ndarray, angle: np.ndarray, first: int, end: int, windows: np.ndarray) -> np.ndarray:
        """Rows from `first` to `end` whose score with some of the anchors may lie in one
        of its windows (anchor x window x 2, both ends inclusive)."""
        at = self.starts(first, end)
        cut = lambda what, values: what.reduceat(values[first:end], at - first, axis=0)
        below, above = score_bounds(
            length, angle, cut(np.minimum, self.length), cut(np.maximum, self.length),
            cut(np.minimum, self.angles), cut(np.maximum, self.angles),
        )
        rows = np.concatenate(
            [np.arange(s, min(s + GROUP, end)) for s in at[self.touch(below, above, windows)]] or [np.zeros(0, np.int64)]
        )
        if not len(rows):
            return rows
        own = self.length[rows], self.length[rows], self.angles[rows], self.angles[rows]
        return rows[self.touch(*score_bounds(length, angle, *own), windows)]

    @staticmethod
    def touch(below: np.ndarray, above: np.ndarray, windows: np.ndarray) -> np.ndarray:
        hit = np.zeros(below.shape[1], bool)
        for w in range(windows.shape[1]):
            low, high = windows[:, w, 0, None], windows[:, w, 1, None]
            hit |= ((low <= high) & (above >= low) & (below <= high)).any(0)
        return hit

    def upper(self, length: np.ndarray, angle: np.ndarray, first: int, end: int) -> np.ndarray:
        own = self.length[first:end], self.length[first:end], self.angles[first:end], self.angles[first:end]
        return score_bounds(length, angle, *own)[1]

    def scores(self, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products, anchor x row."""
        wide = numbers.astype(np.float64)
        size = np.sqrt((wide**2).sum(1)).max(initial=0) * self.length[rows].max(initial=0)
        if size < 2.0**52:  # all sums on the way are whole numbers that a double holds
            return (wide @ self.wide[rows].T).astype(np.int64)
        return numbers.astype(np.int64) @ self.numbers[rows].astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` first by descending score, then ascending id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def find_positives(shard: Shard, block: list[dict], references: np.ndarray, k: int) -> Iterator[tuple]:
    """Of each anchor the `k` best other rows of its label in the shard."""
    block = sorted(block, key=lambda a: (a["label"], a["id"]))
    labels = np.array([a["label"] for a in block], np.int64)
    for label in np.unique(labels):
        first, end = np.searchsorted(shard.labels, [label, label + 1])
        own = np.flatnonzero(labels == label)
        for i in range(0, len(own) if end > first else 0, TOGETHER):
            some = own[i : i + TOGETHER]
            ids = np.array([block[a]["id"] for a in some])
            numbers = np.array([block[a]["vector"] for a in some], np.int32).reshape(len(some), -1)
            length, angle = angles_to(numbers, references)
            # Scores of the most promising rows say where the window begins.
            above = shard.upper(length, angle, first, end)
            above[ids[:, None] == shard.ids[first:end]] = -np.inf
            few = min(k, end - first)
            start = np.unique(np.argpartition(-above, few - 1, axis=1)[:, :few]) + first
            known = shard.scores(numbers, start).astype(np.float64)
            known[ids[:, None] == shard.ids[start]] = -np.inf
            floor = np.partition(known, len(start) - few, axis=1)[:, len(start) - few]
            windows = np.stack([floor, np.full(len(some), np.inf)], 1)[:, None]
            rows = shard.overlapping(length, angle, first, end, windows)
            for a, scores in zip(ids, shard.scores(numbers, rows)):
                other = np.flatnonzero(shard.ids[rows] != a)
                for j in best(scores[other], shard.ids[rows[other]], k):
                    yield int(a), None, int(shard.ids[rows[other[j]]]), int(scores[other[j]])


def find_negatives(shard: Shard, block: list[dict], references: np.ndarray, k: int, share: tuple[int, int]) -> Iterator[tuple]:
    """Of each anchor and positive the `k` best rows of other labels in the window."""
    part, whole = share
    block = sorted(block, key=lambda a: (a["label"], a["id"]))
    for i in range(0, len(block), TOGETHER):
        some = block[i : i + TOGETHER]
        numbers = np.array([a["vector"] for a in some], np.int32).reshape(len(some), -1)
        length, angle = angles_to(numbers, references)
        windows = np.zeros((len(some), max(len(a["positives"]) for a in some), 2))
        windows[:, :, 0] = 1  # no window
        for a, anchor in enumerate(some):
            for p, positive in enumerate(anchor["positives"]):
                windows[a, p] = -(-part * positive["score"] // whole), positive["score"]
        rows = shard.overlapping(length, angle, 0, len(shard.ids), windows)
        if not len(rows):
            continue
        for anchor, scores in zip(some, shard.scores(numbers, rows)):
            other = np.flatnonzero(shard.labels[rows] != anchor["label"])
            scores = scores[other]
            for positive in anchor["positives"]:
                top = positive["score"]
                within = np.flatnonzero((part * top <= whole * scores) & (scores <= top))
                for j in best(scores[within], shard.ids[rows[other[within]]], k):
                    yield anchor["id"], positive["id"], int(shard.ids[rows[other[within[j]]]]), int(scores[within[j]])


class Miner:
    """The stored shards of `vectors` (id, label, vector, one row per id), and searches in them."""

    def __init__(self, vectors: DataFrame, shard_rows: int = SHARD_ROWS):
        self.vectors = vectors
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
        by_length: dict[int, list] = {}
        for row in sample:
            by_length.setdefault(len(row["vector"]), []).append(row["vector"])
        fitted = {n: far_apart(np.array(rows, np.int32).reshape(len(rows), n), REFERENCES) for n, rows in by_length.items()}

        def references(dim: int) -> np.ndarray:
            if dim not in fitted:  # a length that the sample does not hold
                fitted[dim] = far_apart(np.random.default_rng(dim).normal(size=(REFERENCES, dim)), REFERENCES)
            return fitted[dim]

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            dim, ids, labels = key[0].as_py(), rows.column("id").to_numpy(), rows.column("label").to_numpy()
            numbers = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            _, angles = angles_to(numbers, references(dim))
            near = angles.argmin(1) if angles.shape[1] else np.zeros(len(ids))
            closest = angles.min(1, initial=np.pi)
            order = np.lexsort((ids, closest, near, labels))
            blobs = [a[order].tobytes() for a in (ids, labels, numbers.astype(np.int32), angles)]
            return pa.Table.from_batches([arrow_rows([(dim, key[1].as_py(), *blobs)], SHARD)])

        self.references = references
        self.count = max(1, -(-vectors.count() // shard_rows))
        placed = vectors.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(self.count)).cast("int"))
        self.shards = stored(placed.groupBy("dim", "shard").applyInArrow(build, SHARD), "negative-shards")

    def meet(self, anchors: DataFrame, find) -> DataFrame:
        """What `find` gives for every block of `anchors` and every shard."""
        n = 1 + anchors.count() // ANCHOR_BLOCK
        blocks = (
            anchors.withColumn("dim", F.size("vector"))
            .groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"))
            .agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
        )
        places = self.shards.select("dim", "shard")
        # A stated set of anchors meets all rows, block by shard.
        asked = places.join(blocks, "dim").repartition(max(1, n * self.count), "dim", "shard", "block")
        references = self.references

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard(row["dim"], row["ids"], row["labels"], row["numbers"], row["angles"])
                    yield arrow_rows(list(find(shard, row["anchors"], references(row["dim"]))), FOUND)

        return asked.join(self.shards.hint("shuffle_hash"), ["dim", "shard"]).mapInArrow(look, FOUND)

    def positives(self, anchors: DataFrame, k: int) -> DataFrame:
        """anchor_id, positive_id, score, rank: each anchor's `k` best rows of its label."""
        found = self.meet(anchors.select("id", "label", "vector"), lambda s, b, r: find_positives(s, b, r, k))
        order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("anchor_id", F.col("id").alias("positive_id"), "score", "rank")

    def mine(self, anchors: DataFrame, positives: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
        anchor and positive the `k` best rows of other labels whose score s has
        share * positive score <= s <= positive score; `share` is a fraction as two numbers.
        """
        positives = stored(positives.select("anchor_id", "positive_id", "score"), "positives")
        lists = positives.groupBy(F.col("anchor_id").alias("id")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score"))).alias("positives")
        )
        asked = stored(anchors.select("id", "label", "vector").join(lists, "id"), "anchors")
        found = self.meet(asked, lambda s, b, r: find_negatives(s, b, r, k, share))
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        scores = positives.withColumnRenamed("score", "positive_score")
        return ranked.join(scores, ["anchor_id", "positive_id"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
