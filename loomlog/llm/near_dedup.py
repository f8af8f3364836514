"""Near-duplicates by improved consistent weighted sampling of TF-IDF shingles.

A text is the weighted set of its five-word shingles; a shingle weighs its count
times the mean inverse document frequency of its words. (A frequency of the
shingle itself would fall as a group of copies grows, so that a large group
would drop below any threshold; word frequencies don't.) Frequencies are counted
over all documents, in a table of hashed words of fixed size: words that share a
slot share their frequency, everywhere alike.

Consistent weighted sampling draws `BANDS * ROWS` samples of each text such that
two texts agree in one with a probability equal to their weighted Jaccard
similarity; texts that agree in all samples of a band are candidates. At 0.8 the
bands miss 2 pairs in 1000. Candidates are verified by the weighted Jaccard
similarity of their whole shingle sets:

1. Equal texts become one node.
2. In each bucket all texts are compared with a pivot, not with each other;
   three choices of pivots, by band, keep a group of copies from hanging on one.
3. Links make classes. Where a bucket still holds several, its members are compared
   with its centre: the member that agrees best with what most members drew. Copies
   that were each changed elsewhere differ from one another, but not from the text
   they were made from. The same is done among the members outside its largest class.
4. What is left are the pairs of a bucket in different classes. The members outside
   its largest class meet the others inside tasks, block by block: those whose samples
   agree well enough are compared, until their classes are one. Of pairs at the threshold itself 1 in 20 fails here (at 0.82 1 in 75, at
   0.85 1 in 1000), if no chain links it.

Defined cases: texts of any length are compared by all their shingles; of members equally
central the one with the largest node number is taken. Words are what white space separates, in lower case; a text of
fewer than five words has one shingle of all its words; null and empty texts
have none and are equal to each other only. Repeated rows and null ids are rows
like others; a class is named by its smallest id (null if it has none). Other
columns are ignored, whatever their names. An empty table gives no classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import TEXTS_MB, arrow_rows, hand_back, handing_back, in_bytes, map_texts, stored, text_of
from loomlog.llm.components import components
from loomlog.llm.exact_dedup import one_row_each

SHINGLE = 5
#: Factor of a word's hash from byte to byte; 3 more than a multiple of 8.
POWER = 0x9E3779B97F4A7C13
SIMILARITY = 0.8
BANDS = 20
ROWS = 6
PIVOTS = 3
#: Slots of the table of document frequencies (2 ** SLOT_BITS).
SLOT_BITS = 18
#: Draws that samples choose from, by hash.
DRAW_BITS = 16
#: Members of a block, bytes of a block of whole sets, members compared at once.
BLOCK_MEMBERS, BLOCK_BYTES, MEETING = 1024, 4 << 20, 128
#: Shingles sampled at once, hashes looked at together, steps of the table of bounds, the first
#: value that samples are looked for below (times the total weight), and the most that rounding
#: can move a bound.
CHUNK, CELLS, STEPS, AIM = 4096, 1 << 17, 4096, 6.0
MARGIN = np.float32(0.01)
#: Characters of the texts whose words are hashed together.
TOGETHER = 1 << 16
#: What separates words (all of it, in texts of ASCII).
SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r\x1c\x1d\x1e\x1f"))


class WordHashes:
    """Hashes of the words of texts, from sums over their bytes in UTF-8 of a number for the
    byte times a power for its place: all words of some texts at once."""

    def __init__(self):
        self.byte = np.random.default_rng(5).integers(1 << 63, size=256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.inverse = np.zeros(0, np.uint64)

    def groups(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The numbers of words of some texts, and the hashes of all these words in order."""
        some, chars = [], 0
        for text in texts:
            text = (text or "").lower()
            if not text.isascii():
                text = " ".join(text.split())  # other spaces than those of ASCII
            if some and chars + len(text) > TOGETHER:
                yield self._hashed(some)
                some, chars = [], 0
            some.append(text.encode("utf-8", "surrogatepass"))
            chars += len(text)
        if some:
            yield self._hashed(some)

    def _hashed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join((*texts, b"")), np.uint8)  # a space ends each text
        ends = np.cumsum([len(t) + 1 for t in texts])
        space = SPACES.take(data)
        turn = np.flatnonzero(np.not_equal(space[1:], space[:-1])) + 1
        begin, end = (np.append(0, turn) if not space[0] else turn).reshape(-1, 2).T
        if len(self.power) < len(data):
            n = max(len(data), 2 * TOGETHER)
            self.power, self.inverse = (
                np.multiply.accumulate(np.full(n, f, np.uint64)) for f in (POWER, pow(POWER, -1, 1 << 64))
            )
        total = np.append(np.uint64(0), np.cumsum(self.byte.take(data) * self.power[: len(data)]))
        return np.diff(np.searchsorted(begin, ends), prepend=0), mixed((total[end] - total[begin]) * self.inverse[begin])

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.groups([text]))[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def windows(words: np.ndarray, each: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each n words in a row, and the means of their weights."""
    count = max(len(words) - n + 1, 0)
    factor = [np.uint64(pow(0x5851F42D4C957F2D, i + 1, 1 << 64)) for i in range(n)]
    keys = mixed(sum((words[i : i + count] * factor[i] for i in range(1, n)), words[:count] * factor[0]))
    return keys, sum((each[i : i + count] for i in range(1, n)), each[:count].copy()) / n


def distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and their weights times how often they stand there."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    times = np.append(first[1:], len(keys)) - first
    return keys[first], (weight[order[first]] * times).astype(np.float32)


def shingle_sets(sizes: Iterable[int], words: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of texts with so many words each: sorted hashes of the distinct shingles, and their weights."""
    each = idf.take(slots(words))
    keys, weight = windows(words, each, SHINGLE)
    at = 0
    for size in sizes:
        if size >= SHINGLE:
            here = slice(at, at + size - SHINGLE + 1)
            yield distinct(keys[here], weight[here])
        elif size:
            here = slice(at, at + size)
            yield distinct(*windows(words[here], each[here], size))
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.float32)
        at += size


def weighted_shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of one text, and their weights."""
    return next(shingle_sets([len(words)], words, idf))


def text_shingles(texts: Iterable[str | None], hashes: WordHashes, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for sizes, words in hashes.groups(texts):
        yield from shingle_sets(sizes.tolist(), words, idf)


class Sampler:
    """Improved consistent weighted sampling: r, c ~ Gamma(2, 1) and b ~ U(0, 1) per
    shingle and sample; r and c are taken by hash from a table of draws, b from other
    bits of the hash.

    A sample is the shingle whose a is least, ln a = ln c - r (t - b + 1) with
    t = floor(ln w / r + b). As r (t - b) is at most ln w, ln a is at least ln c - r - ln w.
    The draws stand in order of ln c - r: the hash itself tells whether a shingle can come
    below a value. The least a of a text of total weight W is exponential with mean 1 / W:
    the shingles that can come below AIM / W are computed, and for the samples whose least
    is not, those that can come below 8 times as much, until each sample is known.
    """

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = 1 << DRAW_BITS
        r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        ln_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        order = np.argsort(ln_c - r, kind="stable")
        self.r, self.ln_c = r[order], ln_c[order]
        lowest = self.ln_c - self.r
        self.start, self.step = float(lowest[0]), float(lowest[-1] - lowest[0]) / STEPS
        self.draws = np.searchsorted(lowest, self.start + self.step * np.arange(1, STEPS + 2), "right")
        self.draws[-2:] = n
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(1 << 62, size=bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.bits, self.low = np.zeros(CELLS, np.uint32), np.zeros(CELLS + 7, bool)

    def value(self, bits: np.ndarray, ln: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a, of which a sample takes the least, and t. The draw is the upper part of
        the lower half of `bits`, b the upper half."""
        draw = (bits.astype(np.uint32) >> np.uint32(32 - DRAW_BITS)).astype(np.int64)
        b = (bits >> np.uint64(32)).astype(np.float32) * np.float32(2.0**-32)
        r = self.r.take(draw)
        t = np.floor(ln / r + b)
        return self.ln_c.take(draw) - r * (t - b + 1), t

    def below(self, values: np.ndarray, keys: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `samples` and in `keys`, by sample and then by key, where ln c - r may
        be at most the key's of `values`."""
        step = ((values - self.start) / self.step).astype(np.int64).clip(0, STEPS)
        most = ((self.draws.take(step) << (32 - DRAW_BITS)) - 1).astype(np.uint32)
        factor, some, found = self.factor[samples].astype(np.uint32)[:, None], keys.astype(np.uint32), []
        if len(self.bits) < len(some):
            self.bits, self.low = np.zeros(len(some), np.uint32), np.zeros(len(some) + 7, bool)
        rows = len(self.bits) // len(some)
        for at in range(0, len(samples), rows):
            here = factor[at : at + rows]
            size = len(here) * len(some)
            bits, low = (x[:size].reshape(len(here), len(some)) for x in (self.bits, self.low))
            np.less_equal(np.multiply(here, some, out=bits), most, out=low)
            self.low[size : size + 7] = False
            eights = self.low[: (size + 7) // 8 * 8].view(np.uint64)  # most hold none
            few = np.flatnonzero(eights != 0)
            place = np.flatnonzero(eights[few].view(bool))
            found.append(few[place >> 3] * 8 + (place & 7) + at * len(some))
        place = np.concatenate(found)
        s = place // len(some)
        return s, place - s * len(some)

    def samples_of(self, sizes: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """All samples (columns) of texts with so many shingles each, none without."""
        texts, many = len(sizes), len(self.factor)
        text, begin = np.repeat(np.arange(texts), sizes), np.cumsum(sizes) - sizes
        ln = np.log(weights).astype(np.float32)
        first_most = -np.log(np.add.reduceat(weights, begin, dtype=np.float64))
        sample, unknown = np.zeros((many, texts), np.uint64), np.ones((many, texts), bool)
        left, aim = np.arange(many), AIM
        while len(left):
            most = (first_most + np.log(aim)).astype(np.float32)
            values = most[text] + ln + MARGIN
            every = np.minimum.reduceat(values, begin) >= self.start + self.step * STEPS
            values[~unknown.any(0)[text]] = -np.inf
            s, i = self.below(values.clip(self.start), keys, left)
            group = left[s] * texts + text[i]
            if aim > AIM:
                s, i, group = (x[unknown.ravel()[group]] for x in (s, i, group))
            if len(s):
                value, t = self.value(keys.take(i) * self.factor.take(left.take(s)), ln.take(i))
                new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                least = np.minimum.reduceat(value, new)
                found = np.flatnonzero(value == np.repeat(least, np.append(new[1:], len(s)) - new))
                found = found[np.append(True, group[found[1:]] != group[found[:-1]])]  # of equal values the first
                whose = text[i[found]]
                found = found[(least <= most[whose]) | every[whose]]
                known = group[found]
                sample.ravel()[known] = mixed(keys[i[found]] + mixed(t[found].astype(np.int64).astype(np.uint64)))
                unknown.ravel()[known] = False
                left = np.flatnonzero(unknown.any(1))
            aim *= 8
        return sample

    def many_bands(self, sets: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What `bands_of` gives for each of `sets`; as many at once as make a chunk."""
        some, shingles = [], 0
        for keys, weights in sets:
            if some and shingles + len(keys) > CHUNK:
                yield from self._bands(some)
                some, shingles = [], 0
            some.append((keys, weights))
            shingles += len(keys)
        yield from self._bands(some)

    def _bands(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(keys) for keys, _ in sets], np.int64)
        none = np.zeros(0, np.int64)
        if not sizes.any():
            yield from ((none, none) for _ in sets)
            return
        sample = self.samples_of(sizes[sizes > 0], *map(np.concatenate, zip(*sets))).T
        grid, many = sample.reshape(-1, self.bands, self.rows), len(self.factor)
        bands = np.arange(self.bands, dtype=np.uint64)
        for row in range(self.rows):
            bands = mixed(bands * np.uint64(0x5851F42D4C957F2D) + grid[:, :, row])
        bits = np.zeros((len(grid), -(-many // 16) * 16), np.uint64)
        bits[:, :many] = mixed(sample) & np.uint64(15)
        sketch = (bits.reshape(len(grid), -1, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(2, dtype=np.uint64)
        found = zip(bands.view(np.int64), sketch.view(np.int64))
        yield from (next(found) if size else (none, none) for size in sizes)

    def bands_of(self, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One 64-bit key per band, and all samples, four bits of each; none without shingles."""
        return next(self._bands([(keys, weights)]))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Of each slot, ln((N + 1) / (df + 1)) + 1 over all documents."""
    size = 1 << SLOT_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, df = WordHashes(), np.zeros(size + 1, np.int64)
        for batch in batches:
            df[size] += len(batch)
            for sizes, words in hashes.groups(batch["text"]):
                for slot in np.split(slots(words), np.cumsum(sizes)[:-1]):
                    df[slot] += 1  # once for a slot, however often it stands there
        some = np.flatnonzero(df)
        yield pd.DataFrame({"slot": some, "n": df[some]})

    counted = in_bytes(docs.select("text"), TEXTS_MB).mapInPandas(handing_back(count), "slot bigint, n bigint")
    df = np.zeros(size + 1, np.int64)
    for r in counted.groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["slot"]] = r["n"]
    hand_back()  # the rows
    return np.log((df[size] + 1.0) / (df[:size] + 1.0)) + 1.0


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = b[at] == a
    common = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    return common / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - common)


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """`pairs` (a, b) with the weighted Jaccard similarity of the nodes' texts."""
    left = shingles.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("weights").alias("wa"))
    right = shingles.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("weights").alias("wb"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                similarity(
                    np.frombuffer(ka, np.uint64), np.frombuffer(wa, np.float32),
                    np.frombuffer(kb, np.uint64), np.frombuffer(wb, np.float32),
                )
                for ka, wa, kb, wb in zip(batch["ka"], batch["wa"], batch["kb"], batch["wb"])
            ]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": found})

    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return in_bytes(both, TEXTS_MB).mapInPandas(handing_back(compare), "a bigint, b bigint, similarity double")


def most_unlike(threshold: float) -> int:
    """As many samples differ at most in 19 of 20 pairs of that similarity."""
    many, differ = BANDS * ROWS, (1 - threshold) * 15 / 16
    return int(many * differ + 1.645 * (many * differ * (1 - differ)) ** 0.5)


def divided(members: DataFrame, sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """key, node, class, sketch, main: the members of buckets with several classes; `main`
    in the bucket's largest class."""
    now = members.join(classes.hint("merge"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    sizes = now.groupBy("key", "class").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "class"))["class"].alias("most"), F.count("*").alias("classes"))
    now = now.join(largest.where("classes > 1").hint("merge"), "key")
    return stored(
        now.join(sketches.hint("merge"), "node").select("key", "node", "class", "sketch", (F.col("class") == F.col("most")).alias("main")),
        "near-divided",
    )


def with_centre(now: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's central member and those of other classes.

    Central is who agrees in most samples with what most members drew: of copies that
    were each changed in another place, the text they were made from. Linear in members.
    """
    each = F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1))
    drawn = F.transform(
        each,
        lambda i: F.struct(
            i.alias("at"),
            F.call_function("shiftright", F.get("sketch", F.floor(i / 16).cast("int")), (i % 16 * 4).cast("int"))
            .bitwiseAND(F.lit(15)).alias("value"),
        ),
    )
    samples = now.select("key", "node", "class", F.inline(drawn))
    counts = samples.groupBy("key", "at", "value").agg(F.count("*").alias("n"))
    usual = counts.groupBy("key", "at").agg(F.max(F.struct("n", "value"))["value"].alias("usual"))
    agree = samples.join(usual.hint("merge"), ["key", "at"]).groupBy("key", "node", "class").agg(
        F.count_if(F.col("value") == F.col("usual")).alias("agree")
    )
    centre = agree.groupBy("key").agg(F.max(F.struct("agree", "node", "class")).alias("centre"))
    pairs = now.select("key", "node", "class").join(centre.hint("merge"), "key").where("class != centre.class")
    return pairs.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct()


def in_blocks(rows: DataFrame, size: Column, limit: int, *fields: str) -> DataFrame:
    """key, part, rest, members: the members of each bucket, dealt by hash into blocks of
    about `limit` together; `rest` where one stands outside the bucket's largest class."""
    totals = rows.groupBy("key").agg(F.ceil(F.sum(size) / limit).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    return (
        rows.join(totals.hint("merge"), "key")
        .groupBy("key", part.alias("part"))
        .agg(F.max(~F.col("main")).alias("rest"), F.collect_list(F.struct("node", "class", "main", "sketch", *fields)).alias("members"))
    )


def meetings(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of a bucket, each once, of which one holds members of the rest.

    What is joined are blocks: their members meet inside a task, and only what is found
    leaves it.
    """
    blocks = stored(blocks, "near-blocks")
    one, two = blocks.where("rest").alias("one"), blocks.alias("two")
    once = ~F.col("two.rest") | (F.col("one.part") <= F.col("two.part"))
    return one.join(two.hint("merge"), (F.col("one.key") == F.col("two.key")) & once).select(
        "one.key", F.col("one.members").alias("one"), F.col("two.members").alias("two"), (F.col("one.part") == F.col("two.part")).alias("same")
    )


class Block:
    """Members as arrays."""

    def __init__(self, members: list[dict]):
        self.members = members
        self.node, self.klass = (np.array([m[c] for m in members], np.int64) for c in ("node", "class"))
        self.main = np.array([m["main"] for m in members], bool)
        width = max((len(m["sketch"]) for m in members), default=0)
        self.sketch = np.array([m["sketch"] or [0] * width for m in members], np.int64).reshape(len(members), width).view(np.uint64)

    def close_to(self, other: Block, same: bool, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of members of different classes that differ in at most so many samples,
        and in how many; neither pairs inside the largest class nor pairs twice."""
        for at in range(0, len(self.members), MEETING):
            some = slice(at, at + MEETING)
            x = self.sketch[some, None] ^ other.sketch[None]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(2, dtype=np.int64)
            close = (differ <= most) & (self.klass[some, None] != other.klass) & ~(self.main[some, None] & other.main)
            if same:
                close &= self.node[some, None] < other.node
            i, j = np.nonzero(close)
            yield i + at, j, differ[i, j]


def promising(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Members whose samples agree well enough with another's, by bucket."""
    for batch in batches:
        for row in batch.to_pylist():
            one, two = Block(row["one"]), Block(row["two"])
            found: set[int] = set()
            for i, j, _ in one.close_to(two, row["same"], most):
                found.update(one.node[i].tolist(), two.node[j].tolist())
            yield arrow_rows([(row["key"], n) for n in found], "key bigint, node bigint")


def block_links(batches: Iterator[pa.RecordBatch], most: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between members of different classes, most alike samples first; once a link
    has made two classes one, their other members need none."""
    for batch in batches:
        for row in batch.to_pylist():
            one, two = Block(row["one"]), Block(row["two"])
            found = [np.concatenate(c) for c in zip(*one.close_to(two, row["same"], most))] or [np.zeros(0, np.int64)] * 3
            up: dict[int, int] = {}

            def top(k: int) -> int:
                while k in up:
                    k = up[k]
                return k

            out = []
            for n in np.argsort(found[2], kind="stable"):
                x, y = one.members[found[0][n]], two.members[found[1][n]]
                a, b = top(x["class"]), top(y["class"])
                if a == b:
                    continue
                sets = [np.frombuffer(m[c], t) for m in (x, y) for c, t in (("keys", np.uint64), ("weights", np.float32))]
                like = similarity(*sets)
                if like >= threshold:
                    up[a] = b
                    out.append((x["node"], y["node"], like))
            yield arrow_rows(out, "a bigint, b bigint, similarity double")


def left_over(now: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, similarity) that join the classes left in the buckets.

    Members outside a bucket's largest class meet all others, block by block: first by
    their samples alone, then, where these agree well enough, by their whole sets.
    """
    most = most_unlike(threshold)
    by_samples = in_bytes(meetings(in_blocks(now, F.lit(1), BLOCK_MEMBERS)), TEXTS_MB)
    some = by_samples.mapInArrow(handing_back(lambda b: promising(b, most)), "key bigint, node bigint").distinct()
    some = stored(now.join(some.hint("merge"), ["key", "node"], "left_semi"), "near-promising")
    sets = some.join(shingles.hint("merge"), "node")
    size = F.octet_length("keys") + F.octet_length("weights") + 256
    by_sets = in_bytes(meetings(in_blocks(sets, size, BLOCK_BYTES, "keys", "weights")), TEXTS_MB)
    return by_sets.mapInArrow(handing_back(lambda b: block_links(b, most, threshold)), "a bigint, b bigint, similarity double")


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (node, class) with those that `links` (a, b) join made one: only links
    between classes are followed, not all links again."""
    own = lambda name: classes.select(F.col("node").alias(name), F.col("class").alias(f"{name}_class"))
    between = links.select("a", "b").join(own("a").hint("merge"), "a", "left").join(own("b").hint("merge"), "b", "left")
    between = stored(
        between.select("a", "b", F.coalesce("a_class", "a").alias("one"), F.coalesce("b_class", "b").alias("two")), "near-between"
    )
    larger = components(between.select(F.col("one").alias("a"), F.col("two").alias("b")))
    larger = larger.select(F.col("node").alias("class"), F.col("class").alias("into"))
    both = between.select(F.col("a").alias("node")).unionByName(between.select(F.col("b").alias("node"))).distinct()
    every = classes.unionByName(both.join(classes.hint("merge"), "node", "left_anti").withColumn("class", F.col("node")))
    return stored(
        every.join(larger.hint("merge"), "class", "left").select("node", F.coalesce("into", "class").alias("class")), "near-joined"
    )


def near_duplicate_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (the smallest doc_id of its
    class), class_size, digest (of the text), first (whether the text is the one
    that represents the class).
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    digest = F.unhex(F.sha2(text_of(), 256)).alias("digest")

    def sample():
        hashes, sampler = WordHashes(), Sampler()
        return lambda texts: sampler.many_bands(text_shingles(texts, hashes, idf.value))

    rows = stored(
        map_texts(docs.select("doc_id", "text", digest), "doc_id bigint, digest binary", sample, "bands array<bigint>, sketch array<bigint>"),
        "near-samples",
    )
    nodes = stored(
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()),
        "near-nodes",
    )
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    family = F.xxhash64(F.col("band") % PIVOTS, "node")
    buckets = (
        members.groupBy("key")
        .agg(F.min(F.struct(family.alias("rank"), "node")).alias("pivot"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key", F.col("pivot.node").alias("pivot"))
    )
    members = stored(members.select("key", "node").join(buckets.hint("merge"), "key"), "near-members")
    candidates = members.select("node").distinct()
    wanted = nodes.join(candidates, "node", "left_semi").select("node", "digest", "doc_id")

    def shingle():
        hashes = WordHashes()
        return lambda texts: (tuple(part.tobytes() for part in s) for s in text_shingles(texts, hashes, idf.value))

    texts = docs.select("text", digest, F.col("doc_id").alias("id"))
    own = wanted.join(
        texts.hint("merge"),
        (texts["digest"] == wanted["digest"]) & wanted["doc_id"].eqNullSafe(texts["id"]),
    ).select("node", "text", wanted["digest"])
    own = own.dropDuplicates(["digest"])  # the join has dealt the rows by digest already
    shingles = stored(
        map_texts(own, "node bigint", shingle, "keys binary, weights binary"), "near-shingles"
    )
    idf.destroy()  # what used it is stored
    pairs = members.where("node != pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    )
    compared = stored(verified(pairs.distinct(), shingles), "near-compared")
    links = compared.where(F.col("similarity") >= threshold)
    classes = components(links)

    sketches = nodes.select("node", "sketch")
    now = divided(members.select("key", "node"), sketches, classes)
    central = with_centre(now).unionByName(with_centre(now.where("NOT main"))).distinct()
    central = verified(central.join(compared.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), shingles)
    classes = joined(classes, stored(central.where(F.col("similarity") >= threshold), "near-central"))
    now = divided(members.select("key", "node"), sketches, classes)
    classes = joined(classes, stored(left_over(now, shingles, threshold), "near-left-over"))
    classes = (
        nodes.join(classes.hint("merge"), "node", "left")
        .withColumn("class", F.coalesce("class", "node"))
    )
    named = classes.groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"),
        F.sum("copies").alias("class_size"),
    )
    named = stored(
        classes.join(named.hint("merge"), "class").select(
            "digest", F.col("best.doc_id").alias("class_id"), "class_size",
            (F.col("node") == F.col("best.node")).alias("first"),
        ),
        "near-classes",
    )
    return rows.select("doc_id", "digest").join(named.hint("merge"), "digest").select(
        "doc_id", "class_id", "class_size", "digest", "first"
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stay, one of each class, with their columns."""
    classes = near_duplicate_classes(docs, threshold)
    return one_row_each(docs, classes.where("first").where(F.col("doc_id").eqNullSafe(F.col("class_id"))))
