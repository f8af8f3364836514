"""Prefix trie of conversations by burst tries.

A conversation is the row of its turns' ids (20 bytes a turn: a digest of role and text,
and the text's length). Equal conversations become one row that knows how many there are,
the smallest, and the hash of all their ids. All rows begin in one container below the
root. A container with too many rows is burst: the turns that all its rows share become a
chain of trie heads, rows that end there stay with the chain, and the rest go, by the id
of their next turn, to containers of their own; so each burst divides. What is left are
containers of bounded size, dealt by hash to shards; each is sorted and swept into nodes,
with sums from the leaves up. Then the heads are summed from the last burst to the root.

Only ids are shuffled after the first step, and what a container, a head or the ids of
equal conversations need is aggregated before it is: a first turn or a conversation that
a third of all share is burst, or becomes one row. The ids of the turns of a single
conversation (20 bytes each, whatever their texts) must fit in a task.

Defined cases: a null role or text is empty. Turns stand in order of `turn`, null first;
turns of equal number in order of their ids, so that the result does not depend on the
order of rows, and a row given twice is two turns. Rows without a conversation's id take no part. Texts
of any length count by their digest and length. Other columns are ignored, whatever their
names. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import arrow_rows, in_bytes, stored

#: Rows, and bytes of turn ids, from which a container is burst.
CONTAINER_ROWS, CONTAINER_BYTES = 4096, 8 << 20
#: Bytes of a turn's id; the last four hold the length of its text.
WIDTH = 20
#: Ids that are joined to one text at most, by their quotient with it.
ID_RANGE = 1 << 16
#: Parts into which the rows of one container are dealt when it meets a single row.
SALTS = 64
NONE = hashlib.sha256(b"").hexdigest()
UNIQUE = "path binary, n bigint, first bigint, ends string"
NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,"
    " saved_tokens bigint, ends_sha256 string, head binary, parent binary"
)


def turn_id() -> Column:
    """Hexadecimal id of a turn from its role and text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 2 * WIDTH - 8), F.lpad(F.hex(F.octet_length(text)), 8, "0"))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, path: the ids of a conversation's turns, in order."""
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", turn_id().alias("id"))
    in_order = F.sort_array(F.collect_list(F.struct("turn", "id")))
    path = F.unhex(F.array_join(F.transform(in_order, lambda t: t["id"]), ""))
    return turns.groupBy("conv_id").agg(path.alias("path"))


def first_turns(path: Column, count: Column) -> Column:
    return F.substr(path, F.lit(1), count * WIDTH)


def rest_turns(path: Column, count: Column) -> Column:
    return F.substr(path, count * WIDTH + 1)


def ends_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per path from rows in order of (key, part) with a part of its ids each."""
    key, row, digest = None, None, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["key"] == key:
                digest.update(b",")
                row[1] += r["n"]
            else:
                if row:
                    out.append((*row, digest.hexdigest()))
                key, row, digest = r["key"], [r["path"], r["n"], r["first"]], hashlib.sha256()
            digest.update(r["ids"].encode())
        yield arrow_rows(out, UNIQUE)
    if row:
        yield arrow_rows([(*row, digest.hexdigest())], UNIQUE)


def unique_paths(rows: DataFrame) -> DataFrame:
    """Each distinct path of `rows` (conv_id, path) with the number of its conversations,
    the smallest, and the hash of all their ids."""
    parts = (
        rows.select(F.unhex(F.sha2("path", 256)).alias("key"), F.floor(F.col("conv_id") / ID_RANGE).alias("part"), "conv_id", "path")
        .groupBy("key", "part")
        .agg(
            F.any_value("path").alias("path"), F.count("*").alias("n"), F.min("conv_id").alias("first"),
            F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"),
        )
    )
    in_order = parts.repartition("key").sortWithinPartitions("key", "part")
    return in_bytes(in_order).mapInArrow(ends_digests, UNIQUE)


def to_heads(rows: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """Join `rows` with one row of `few` for each `key`, of which one may hold most rows."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    each = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(each, [key, "_salt"], how).drop("_salt")


def sweep(depth: int, rows: Iterable[tuple[bytes, int, int, str]]) -> list[list]:
    """Nodes of one container, its head at `depth` first, from rows (path, n, first, ends)
    in order of their paths: [depth, place of the parent, conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256]."""
    nodes: list[list] = []
    stack: list[int] = []
    before = b""
    for path, n, first, ends in rows:
        turns = len(path) // WIDTH
        shared, most = depth - 1, min(turns, len(before) // WIDTH)
        if nodes:
            shared = depth
            while shared < most and path[shared * WIDTH : (shared + 1) * WIDTH] == before[shared * WIDTH : (shared + 1) * WIDTH]:
                shared += 1
        del stack[shared - depth + 1 :]
        for d in range(shared + 1, turns + 1):
            own = int.from_bytes(path[d * WIDTH - 4 : d * WIDTH], "big") if d else 0
            nodes.append([d, stack[-1] if stack else -1, first, 0, 0, 0, 0, NONE, own])
            stack.append(len(nodes) - 1)
        end = nodes[stack[-1]]
        end[2], end[3], end[7] = min(end[2], first), end[3] + n, ends
        before = path
    for node in reversed(nodes):  # children stand after their parents
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * node.pop()
        if node[1] >= 0:
            up = nodes[node[1]]
            up[2], up[3], up[4] = min(up[2], node[2]), up[3] + node[3], up[4] + 1
            up[5], up[6] = up[5] + node[5], up[6] + node[6]
    return nodes


def sweep_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all containers of a shard; its rows come in order of (head, path)."""
    now, rows = None, []

    def close() -> list[tuple]:
        head, depth, parent = now
        nodes = sweep(depth, rows)
        out = [(*n[2:3], n[0], nodes[n[1]][2], *n[3:], None, None) for n in nodes[1:]]
        top = nodes[0]
        return [(top[2], top[0], None, *top[3:], head, parent), *out]

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now and r["head"] != now[0]:
                out += close()
                rows = []
            now = (r["head"], r["depth"], r["parent"])
            rows.append((r["path"], r["n"], r["first"], r["ends"]))
        yield arrow_rows(out, NODES)
    if now:
        yield arrow_rows(close(), NODES)


def chain_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The heads of burst containers: a node for every turn that their rows share."""
    for batch in batches:
        for r in batch.to_pylist():
            path, out = r["shared"], []
            last = len(path) // WIDTH
            saved = r["saved"]
            for depth in range(last, r["depth"] - 1, -1):
                size = int.from_bytes(path[depth * WIDTH - 4 : depth * WIDTH], "big") if depth else 0
                saved += (r["n"] - 1) * size
                top = depth == r["depth"]
                out.append((
                    r["first"], depth, None if top else r["first"], r["n"], r["children"] if depth == last else 1,
                    r["leaves"], saved, r["ends"] if depth == last else NONE,
                    r["head"] if top else None, r["parent"] if top else None,
                ))
            yield arrow_rows(out, NODES)


def shared_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole turns with which both `low` and `high`, and all paths between, begin."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            low, high = r["low"], r["high"]
            turns, most = r["depth"], min(len(low), len(high)) // WIDTH
            while turns < most and low[turns * WIDTH : (turns + 1) * WIDTH] == high[turns * WIDTH : (turns + 1) * WIDTH]:
                turns += 1
            out.append((r["head"], r["depth"], r["parent"], low[: turns * WIDTH], turns))
        yield arrow_rows(out, BURST)


BURST = "head binary, depth bigint, parent binary, shared binary, turns bigint"


def head_of(path: Column) -> Column:
    return F.unhex(F.sha2(path, 256))


def trie(paths: DataFrame, container_rows: int = CONTAINER_ROWS, container_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """The nodes of the trie of `paths` (conv_id, path; one row per conversation):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    rows = stored(
        unique_paths(paths).select(
            head_of(F.lit(b"")).alias("head"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("parent"),
            "path", "n", "first", "ends",
        ),
        "trie-rows",
    )
    settled, bursts = [], []
    while True:
        size = F.octet_length("path") - F.col("depth") * WIDTH
        sizes = rows.groupBy("head").agg(F.count("*").alias("_rows"), F.sum(size).alias("_bytes"))
        large = stored(sizes.where(f"_rows > 1 AND (_rows > {container_rows} OR _bytes > {container_bytes})").select("head"), "trie-large")
        if large.isEmpty():
            settled.append(rows)
            break
        marked = stored(to_heads(rows, large.withColumn("_large", F.lit(True)), "head", "left"), "trie-marked")
        settled.append(marked.where("_large IS NULL").drop("_large"))
        heavy = marked.where("_large").drop("_large")
        ranges = heavy.groupBy("head", "depth", "parent").agg(F.min("path").alias("low"), F.max("path").alias("high"))
        burst = stored(ranges.mapInArrow(shared_turns, BURST), "trie-bursts")
        spread = stored(to_heads(heavy.drop("depth", "parent"), burst.select("head", "turns"), "head", "inner"), "trie-spread")
        bursts.append((burst, spread.where(F.octet_length("path") == F.col("turns") * WIDTH)))
        rows = spread.where(F.octet_length("path") > F.col("turns") * WIDTH).select(
            head_of(first_turns(F.col("path"), F.col("turns") + 1)).alias("head"), (F.col("turns") + 1).alias("depth"),
            F.col("head").alias("parent"), "path", "n", "first", "ends",
        )
    containers = settled[0]
    for more in settled[1:]:
        containers = containers.unionByName(more)
    shards = containers.repartition("head").sortWithinPartitions("head", "path")
    swept = stored(in_bytes(shards).mapInArrow(sweep_shard, NODES), "trie-nodes")
    nodes, heads = swept, swept.where("head IS NOT NULL")
    for burst, ended in reversed(bursts):
        below = heads.where("parent IS NOT NULL").groupBy(F.col("parent").alias("head")).agg(
            F.sum("n_convs").alias("n"), F.min("conv_id").alias("first"), F.count("*").alias("children"),
            F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        )
        own = ended.select("head", F.col("n").alias("_n"), F.col("first").alias("_first"), F.col("ends").alias("_ends"))
        summed = burst.join(below, "head").join(own, "head", "left").select(
            "head", "depth", "parent", "shared", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
            F.least("first", "_first").alias("first"), "children", "leaves", "saved", F.coalesce("_ends", F.lit(NONE)).alias("ends"),
        )
        chain = stored(summed.mapInArrow(chain_nodes, NODES), "trie-heads")
        nodes, heads = nodes.unionByName(chain), heads.unionByName(chain.where("head IS NOT NULL"))
    wanted = [c.split()[0] for c in NODES.split(", ")][:-2]
    inner = nodes.where("head IS NULL").select(*wanted)
    if not bursts:
        return inner.unionByName(heads.select(*wanted))
    # A head's parent is the last node of the chain of the container it came from.
    above = heads.join(burst_heads(bursts), "head").select(F.col("head").alias("parent"), F.col("conv_id").alias("_above"))
    placed = to_heads(heads, above, "parent", "left").withColumn("parent_conv_id", F.col("_above"))
    return inner.unionByName(placed.select(*wanted))


def burst_heads(bursts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    found = bursts[0][0].select("head")
    for burst, _ in bursts[1:]:
        found = found.unionByName(burst.select("head"))
    return found


def with_shared_beginnings(own: DataFrame, group: int, count: Column) -> DataFrame:
    """conv_id, path: each of `own` (conv_id, path) with its first `count` turns changed for
    those of the conversation whose id is the next lower multiple of `group`."""
    own = stored(own, "trie-sequences")
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.col("path").alias("_lead"))
    joined = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).join(base, "_base", "left")
    lead = F.coalesce(first_turns(F.col("_lead"), count), F.lit(b""))
    return joined.select("conv_id", F.concat(lead, rest_turns(F.col("path"), count)).alias("path"))
