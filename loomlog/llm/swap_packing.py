"""Best-fit packing of documents into sequences, improved by swaps.

A document longer than a sequence fills sequences of its own; what is left, and
every shorter document, is packed whole. Documents wait in a pool; when it is
full they are put, largest first, where they fit best, and the bins that are not
full are improved by local search: the emptiest bin gives a document to another
(a move), changes one for a smaller one, two for one, or one for two smaller ones.
Of the exchanges that increase the sum of squared fills the one that increases it
most is made, until the bin is empty or stuck; then the next is tried. The search
ends when no exchange is left, or when the bins are as few as the tokens allow.

Each task packs its own partition, with a pool of bounded size. Bins without a gap
worth filling are given out; the rest wait for the next documents. The few bins open
at the end of the tasks are packed again together, for some tasks at a time: so a
table in many small partitions loses no more than one bin for each `TASKS` of them.
Ids depend only on the partition and its rows, so a task that runs again gives the
same sequences.

Defined cases: a null or empty text is one piece, the end token alone. A text of any
length is cut into pieces of exactly one sequence, but the last. Rows that repeat an
id, and equal texts, are packed each for itself; a null id is kept. Of equal exchanges
the first is made, in the order of the rows. Other columns are ignored, whatever
their names. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import arrow_schema, in_bytes
from loomlog.llm.word_ids import WordTokenizer
from loomlog.session import scratch_path

CAPACITY = 4096
END_ID = 1
#: Tokens that wait in a task's pool before they are packed.
POOL_TOKENS = 4_000_000
#: A gap of so many tokens (a share of 1 in 512) is not worth waiting.
SLACK = 8
#: Bins that a task may leave open, and tasks whose open bins are packed together.
OPEN_BINS, TASKS = 64, 64
PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids binary, doc_tokens bigint,"
    " sequence_id bigint, offset bigint"
)
#: Sequences of bins packed again have ids from here on.
AGAIN = 1 << 62


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each where the least room is left."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: some bin has a gap of g
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            place = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
            bins[place].append(item)
        else:
            gap, place = capacity, len(bins)
            bins.append([item])
        gap -= size
        if gap:
            by_gap[gap].append(place)
            gaps |= 1 << gap
    return bins


class LocalSearch:
    """Bins that are not full, improved by moves and swaps until some are empty."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.bins, self.capacity = sizes, [list(b) for b in bins], capacity
        self.fill = np.array([sizes[b].sum() for b in bins], np.int64)
        self.parts = [self.units(b) for b in range(len(bins))]

    def units(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """What bin `b` may give back, by weight and number: nothing, an item, two items."""
        if self.fill[b] in (0, self.capacity):
            return np.zeros(0, np.int64), np.zeros(0, np.int8)
        held = self.sizes[self.bins[b]]
        single = np.unique(held)
        pairs = single[:, None] + single[None, :]
        several = np.array([(held == s).sum() > 1 for s in single])
        pairs = np.unique(pairs[np.triu(np.ones(pairs.shape, bool), 1) | np.diag(several)])
        weight = np.concatenate([[0], single, pairs])
        return weight, np.repeat(np.array([0, 1, 2], np.int8), [1, len(single), len(pairs)])

    def gather(self) -> None:
        self.weight = np.concatenate([w for w, _ in self.parts])
        self.number = np.concatenate([n for _, n in self.parts])
        self.owner = np.repeat(np.arange(len(self.parts)), [len(w) for w, _ in self.parts])

    def best(self, donor: int, weight: int, number: int) -> tuple[int, int, int, int]:
        """The exchange of `weight` (`number` items) from the donor that increases the
        squared fill most, as (gain, receiver, weight and number of what comes back)."""
        more = weight - self.weight
        allowed = (more > 0) & (more <= self.capacity - self.fill[self.owner]) & (self.owner != donor)
        allowed &= self.number == 1 if number == 2 else True
        at = np.flatnonzero(allowed)
        if not len(at):
            return 0, -1, 0, 0
        gain = 2 * more[at] * (self.fill[self.owner[at]] - self.fill[donor] + more[at])
        top = at[gain.argmax()]
        return int(gain.max()), int(self.owner[top]), int(self.weight[top]), int(self.number[top])

    def take(self, b: int, weight: int, number: int) -> list[int]:
        """Remove `number` items of together `weight` from bin `b`."""
        held = self.bins[b]
        found: list[int] = []
        if number == 1:
            found = [next(i for i in held if self.sizes[i] == weight)]
        elif number == 2:
            first: dict[int, int] = {}
            for item in held:
                other = first.get(weight - int(self.sizes[item]))
                if other is not None:
                    found = [other, item]
                    break
                first.setdefault(int(self.sizes[item]), item)
        self.bins[b] = [i for i in held if i not in found]
        return found

    def exchange(self, donor: int, receiver: int, given: tuple[int, int], back: tuple[int, int]) -> None:
        out, into = self.take(donor, *given), self.take(receiver, *back)
        self.bins[receiver] += out
        self.bins[donor] += into
        for b in (donor, receiver):
            self.fill[b] = self.sizes[self.bins[b]].sum()
            self.parts[b] = self.units(b)
        self.gather()

    def relieve(self, donor: int, stuck: set[tuple[int, int]]) -> bool:
        """Give from the donor while the squared fill increases; whether anything moved.

        `stuck` remembers what no bin takes as long as nothing moves.
        """
        moved = False
        while self.bins[donor]:
            options = [(0, -1, 0, 0, 0, 0)]
            for weight, number in zip(*(a.tolist() for a in self.parts[donor])):
                if number and (weight, number) not in stuck:
                    found = self.best(donor, weight, number)
                    options.append((*found, weight, number))
                    if found[0] <= 0:
                        stuck.add((weight, number))
            gain, receiver, weight, number, given, many = max(options, key=lambda o: o[0])
            if gain <= 0:
                break
            self.exchange(donor, receiver, (given, many), (weight, number))
            stuck.clear()
            moved = True
        return moved

    def run(self) -> list[list[int]]:
        least = -(-int(self.fill.sum()) // self.capacity)
        stuck: set[tuple[int, int]] = set()
        moved = len(self.bins) > 1
        while moved:
            moved = False
            self.gather()
            for donor in np.argsort(self.fill, kind="stable").tolist():
                if np.count_nonzero(self.fill) <= least:
                    break
                if 0 < self.fill[donor] < self.capacity:
                    moved |= self.relieve(donor, stuck)
        return [b for b in self.bins if b]


def pack_sizes(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers for items of `sizes`, each from 1 to `capacity`."""
    bins = best_fit(sizes, capacity)
    full = [b for b in bins if sizes[b].sum() == capacity]
    rest = [b for b in bins if sizes[b].sum() < capacity]
    return full + (LocalSearch(sizes, rest, capacity).run() if rest else [])


class SwapPacker:
    """Packs documents as they come; `packed` gives finished pieces as rows of PIECES."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.first_id, self.sequences = capacity, first_id, 0
        self.pool: list[tuple] = []  # doc_id, piece, start, length, ids, tokens of the document
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        size = len(ids) // 4
        for piece, start in enumerate(range(0, size, self.capacity)):
            length = min(self.capacity, size - start)
            cut = (doc_id, piece, start, length, ids[4 * start : 4 * (start + length)], size)
            if length == self.capacity:
                self.give([cut])
            else:
                self.put(cut)

    def put(self, cut: tuple) -> None:
        self.pool.append(cut)
        self.waiting += cut[3]

    def give(self, cuts: list[tuple]) -> None:
        offset, sequence = 0, self.first_id + self.sequences
        for cut in cuts:
            self.rows.append((*cut, sequence, offset))
            offset += cut[3]
        self.sequences += 1

    def pack(self, keep_bins: int) -> None:
        """Pack the pool; at most `keep_bins` bins, the emptiest with a gap, stay in it."""
        if not self.pool:
            return
        pool, self.pool, self.waiting = self.pool, [], 0
        sizes = np.array([cut[3] for cut in pool], np.int64)
        bins = sorted(pack_sizes(sizes, self.capacity), key=lambda b: int(sizes[b].sum()))
        for n, items in enumerate(bins):
            cuts = [pool[i] for i in items]
            if n < keep_bins and self.capacity - sizes[items].sum() > SLACK:
                for cut in cuts:
                    self.put(cut)
            else:
                self.give(cuts)

    def packed(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of sequences, one row each: `ids` (little-endian unsigned 32-bit numbers), the
    document's from `start` on, stand in `sequence_id` from `offset` on.
    """
    with open(tokenizer_path, encoding="utf-8") as file:  # a few MB, the same for any corpus
        definition = file.read()
    end = end_id.to_bytes(4, "little")
    schema = arrow_schema(f"{PIECES}, part bigint")

    def batch_of(rows: list[tuple], part: int | None) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * (len(schema) - 1)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
        arrays.append(pa.array([part] * len(rows), pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, part = WordTokenizer(definition), TaskContext.get().partitionId()
        packer = SwapPacker(capacity, part << 32)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(texts), 500):
                encoded = tokenizer.encode([t or "" for t in texts[i : i + 500]])
                for doc_id, tokens in zip(ids[i : i + 500], encoded):
                    packer.add(doc_id, tokens + end)
                if packer.waiting >= POOL_TOKENS:
                    packer.pack(keep_bins=POOL_TOKENS // capacity // 2)
                yield batch_of(packer.packed(), None)
        packer.pack(keep_bins=OPEN_BINS)
        yield batch_of(packer.packed(), None)
        yield batch_of([(*cut, None, None) for cut in packer.pool], part)

    def again(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py() if len(rows) else 0
        packer = SwapPacker(capacity, AGAIN + (part // TASKS << 32))
        columns = [rows.column(c).to_pylist() for c in schema.names[:6]]
        for cut in sorted(zip(rows.column("part").to_pylist(), *columns), key=lambda c: (*c[:1], c[1] is None, c[1] or 0, *c[2:])):
            packer.put(cut[1:])
        packer.pack(keep_bins=0)
        return pa.Table.from_batches([batch_of(packer.packed(), None)]).select(range(8))

    spark = docs.sparkSession
    path = scratch_path(spark, "packed-pieces")
    pieces = in_bytes(docs.select("doc_id", "text")).mapInArrow(per_task, f"{PIECES}, part bigint")
    pieces.write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(pieces.schema).parquet(path)
    open_ = pieces.where("part IS NOT NULL")
    joined = open_.groupBy((F.col("part") / TASKS).cast("bigint")).applyInArrow(again, PIECES)
    return pieces.where("part IS NULL").drop("part").unionByName(joined)
