"""Hierarchical packing of documents into sequences of several context sizes.

A document gives whole windows of the largest size; what is left is routed to
the smallest tier that holds it. From the longest tier down, each left-over
opens a window of its tier, and the gap is filled from the shorter tiers: the
largest document that fits, again and again, and at last a cut of one. So all
windows are full; only the end of a partition leaves tokens over, which become
windows of powers of two. Windows of one size are numbered into step groups of
equally many tokens.

Each task packs its own partition in one pass and holds one pool of bounded
size; nothing is shuffled. Ids depend only on the partition and its rows, so a
task that runs again gives the same sequences.

Defined cases: a null or empty text is one piece, the end token alone. Rows
that repeat an id are packed each for itself; a null id is kept. Other columns
are ignored, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomlog.llm.common import TEXTS_MB, arrow_schema, handing_back, in_bytes
from loomlog.llm.word_ids import WordTokenizer

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens that wait for a window before they are packed.
POOL_TOKENS = 4_000_000
STEP_TOKENS = 1 << 17
#: Pieces handed to Spark at once, of at most 4096 tokens each.
ROWS_OUT = 500
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint,"
    " sequence_id bigint, offset bigint, window int, step_group bigint"
)


class Packer:
    """Packs (doc_id, ids) into windows; `packed` gives pieces as batches of PIECES."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_id: int, schema: pa.Schema):
        self.tiers, self.step_tokens, self.first_id = sorted(tiers), step_tokens, first_id
        self.pool: list[tuple[int, int, int, tuple]] = []  # length, order, start, document
        self.waiting = self.order = self.sequences = 0
        self.filled: dict[int, int] = {}
        self.rows: list[tuple] = []
        self.schema = schema

    def add(self, doc_id, ids: bytes) -> None:
        size, longest = len(ids) // 4, self.tiers[-1]
        document = (doc_id, ids, size)
        whole = size - size % longest
        for start in range(0, whole, longest):
            self.close(longest, [(longest, start, document)])
        if size > whole:
            self.put(size - whole, whole, document)

    def put(self, length: int, start: int, document: tuple) -> None:
        self.pool.append((length, self.order, start, document))
        self.order += 1
        self.waiting += length

    def close(self, window: int, pieces: list[tuple[int, int, tuple]]) -> None:
        """Give out a full window."""
        sequence = self.first_id + self.sequences
        step = self.filled.get(window, 0) * window // self.step_tokens
        group = self.first_id + (window.bit_length() << 26) + step
        offset = 0
        for length, start, (doc_id, ids, size) in pieces:
            cut = ids[4 * start : 4 * (start + length)]
            self.rows.append((doc_id, start, length, cut, size, sequence, offset, window, group))
            offset += length
        self.filled[window] = self.filled.get(window, 0) + 1
        self.sequences += 1

    def pack(self, last: bool = False) -> None:
        pool = sorted(self.pool, key=lambda p: p[:2])
        left: list[tuple[int, int, tuple]] = []
        for tier in reversed(self.tiers):
            while pool and (pool[-1][0] > tier // 2 or tier == self.tiers[0]):
                length, _, start, document = pool.pop()
                pieces, gap = [(length, start, document)], tier - length
                while gap and pool:
                    at = bisect_right(pool, gap, key=lambda p: p[0])
                    length, order, start, document = pool.pop(at - 1 if at else 0)
                    take = min(length, gap)
                    pieces.append((take, start, document))
                    if take < length:
                        insort(pool, (length - take, order, start + take, document), key=lambda p: p[:2])
                    gap -= take
                if gap:
                    left += pieces
                else:
                    self.close(tier, pieces)
        self.pool, self.waiting = [], 0
        for piece in left:
            self.put(*piece)
        if last:
            self.finish()

    def finish(self) -> None:
        """Windows of powers of two from what is left, largest first."""
        while self.waiting:
            window = min(1 << (self.waiting.bit_length() - 1), self.tiers[-1])
            pieces, gap = [], window
            while gap:
                length, order, start, document = self.pool.pop(0)
                take = min(length, gap)
                pieces.append((take, start, document))
                if take < length:
                    self.pool.insert(0, (length - take, order, start + take, document))
                gap -= take
            self.close(window, pieces)
            self.waiting -= window

    def packed(self) -> Iterator[pa.RecordBatch]:
        """What was given out, some rows at a time: a whole pool would be in memory thrice."""
        rows, self.rows = self.rows, []
        for i in range(0, len(rows), ROWS_OUT):
            columns = zip(*rows[i : i + ROWS_OUT])
            arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def pack(
    docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pieces of sequences, one row each: the document's ids from `start` on stand
    in `sequence_id` from `offset` on. `tiers` must be powers of two.
    """
    with open(tokenizer_path, encoding="utf-8") as file:  # a few MB, the same for any corpus
        definition = file.read()
    end = end_id.to_bytes(4, "little")

    schema = arrow_schema(PIECES)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = WordTokenizer(definition)
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 32, schema)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(texts), 500):
                encoded = tokenizer.encode([t or "" for t in texts[i : i + 500]])
                for doc_id, tokens in zip(ids[i : i + 500], encoded):
                    packer.add(doc_id, tokens + end)
                if packer.waiting >= POOL_TOKENS:
                    packer.pack()
                yield from packer.packed()
        packer.pack(last=True)
        yield from packer.packed()

    return in_bytes(docs.select("doc_id", "text"), TEXTS_MB).mapInArrow(handing_back(per_task), PIECES)
