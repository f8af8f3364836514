"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors that are equal become one node, which keeps the smallest of their ids;
so a vector with a third of all rows is one node. Nodes are dealt by hash to
shards of bounded size. In a shard every node gets its edges from a greedy search
of the graph as it stands: of the nodes met, the nearest is linked, those that are
much nearer to it than to the node are dropped, and so on (relaxed by `ALPHA`);
linked nodes link back and are pruned alike. A query runs a beam search in each
shard, in blocks of many queries; what it finds is ranked by the exact cosine of
the original vectors in double precision, and the shards' best are merged.

Defined cases: vectors that are null, zero, or hold null or non-finite parts take
no part, nor do rows with a null id. Vectors of different lengths are never
compared: shards hold one length, and a query meets those of its own. A row given
twice counts once. Other columns are ignored, whatever their names. With fewer
candidates than asked for, all are returned; an empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import stored

SHARD_ROWS = 4096
DEGREE = 28
BEAM = 64
ALPHA = 1.2
#: Nodes that search the graph together while it is built, and queries in a block.
BATCH = 512
QUERY_BLOCK = 4096
#: Nodes expanded at once in a search step.
WIDTH = 4
SHARD = "shard int, dim int, vectors binary, ids array<array<bigint>>, edges binary, entry int"


def valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Distinct (id, vector) of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    return (
        vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & finite & nonzero)
        .select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>").alias("vector"))
        .distinct()
    )


def beam_search(
    x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `beam` nearest nodes met (-1: none), nearest first, and all
    nodes expanded on the way. Distances are 2 - 2 * cosine of unit vectors.
    """
    n, m = len(x), len(queries)
    rows = np.arange(m)[:, None]
    ids = np.full((m, beam), -1, np.int32)
    far = np.full((m, beam), np.inf, np.float32)
    done = np.zeros((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    ids[:, 0], seen[:, entry], seen[:, n] = entry, True, True
    far[:, 0] = 2 - 2 * queries @ x[entry]
    trail = []
    while True:
        open_ = ~done & (ids >= 0)
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :WIDTH]
        real = np.take_along_axis(open_, pick, 1)
        if not real.any():
            break
        np.put_along_axis(done, pick, np.take_along_axis(done, pick, 1) | real, 1)
        at = np.where(real, np.take_along_axis(ids, pick, 1), -1)
        trail.append(at)
        near = np.where(at[:, :, None] >= 0, edges[at], -1).reshape(m, -1)
        near = np.where(seen[rows, near], -1, near)  # -1 looks at the column that is always set
        seen[rows, near] = True
        d = 2 - 2 * np.einsum("mrd,md->mr", x[near], queries)
        d[near < 0] = np.inf
        ids, far = np.concatenate([ids, near], 1), np.concatenate([far, d], 1)
        done = np.concatenate([done, near < 0], 1)
        order = np.argsort(far, axis=1, kind="stable")
        ids, far, done = (np.take_along_axis(a, order, 1) for a in (ids, far, done))
        again = np.zeros_like(done)
        again[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (ids[:, 1:] >= 0)
        if again.any():
            far[again], ids[again], done[again] = np.inf, -1, True
            order = np.argsort(far, axis=1, kind="stable")
            ids, far, done = (np.take_along_axis(a, order, 1) for a in (ids, far, done))
        ids, far, done = ids[:, :beam], far[:, :beam], done[:, :beam]
    return ids, np.concatenate(trail, 1) if trail else np.full((m, 0), -1, np.int32)


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Out-edges (padded with -1) for `nodes` from their rows of `candidates` (-1: none)."""
    out = np.full((len(nodes), degree), -1, np.int32)
    step = max(1, 4_000_000 // max(1, candidates.shape[1] ** 2))
    for i in range(0, len(nodes), step):
        own, cand = nodes[i : i + step], np.sort(candidates[i : i + step], axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == own[:, None]] = -1
        v = x[cand]
        far = 2 - 2 * np.einsum("mcd,md->mc", v, x[own])
        between = 2 - 2 * v @ v.transpose(0, 2, 1)
        alive = cand >= 0
        rows = np.arange(len(own))
        for slot in range(degree):
            best = np.where(alive, far, np.inf).argmin(1)
            there = alive[rows, best]
            if not there.any():
                break
            out[i + rows[there], slot] = cand[rows, best][there]
            alive &= (alpha * alpha * between[rows, best] > far) & there[:, None]
            alive[rows, best] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (node x degree, padded with -1) and the entry node, for unit vectors `x`."""
    n = len(x)
    rng = np.random.default_rng(0)
    entry = int((x @ x.mean(0)).argmax())
    edges = np.full((n, degree), -1, np.int32)
    if n > 1:
        few = min(n - 1, degree // 2)
        shift = rng.integers(1, n, (n, few))
        edges[:, :few] = (np.arange(n)[:, None] + shift) % n
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            batch = order[i : i + BATCH]
            found, trail = beam_search(x, edges, entry, x[batch], beam)
            edges[batch] = robust_prune(x, batch, np.concatenate([found, trail, edges[batch]], 1), relax, degree)
            link_back(x, edges, batch, relax, degree)
    return edges, entry


def link_back(x: np.ndarray, edges: np.ndarray, batch: np.ndarray, alpha: float, degree: int) -> None:
    """Let the nodes that `batch` links to link back; prune those with too many edges."""
    target = edges[batch].ravel()
    source = np.repeat(batch, degree)[target >= 0]
    target = target[target >= 0]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    order = np.argsort(count, kind="stable")
    for i in range(0, len(nodes), 256):  # nodes with about as many new edges together
        some = order[i : i + 256]
        widest = count[some].max()
        at = first[some][:, None] + np.arange(widest)
        new = np.where(np.arange(widest) < count[some][:, None], source[np.minimum(at, len(source) - 1)], -1)
        both = np.concatenate([edges[nodes[some]], new.astype(np.int32)], 1)
        edges[nodes[some]] = robust_prune(x, nodes[some], both, alpha, degree)


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.sqrt((wide**2).sum(1, keepdims=True))).astype(np.float32)


def build_index(vectors: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored index of `vectors` (id, vector, distinct rows): one row per shard.

    `keep` is the number of ids that a node keeps of equal vectors, the smallest.
    """
    smallest = Window.partitionBy("vector").orderBy("id")
    nodes = stored(
        vectors.withColumn("place", F.row_number().over(smallest))
        .where(F.col("place") <= keep)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids")),
        "ann-nodes",
    )
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy(F.size("vector").alias("dim")).count().collect()}
    dim = F.size("vector")
    shards = F.lit(1)
    for length, count in sizes.items():
        shards = F.when(dim == length, -(-count // shard_rows)).otherwise(shards)
    placed = nodes.select(
        dim.alias("dim"), F.pmod(F.xxhash64("vector"), shards).cast("int").alias("shard"), "vector", "ids"
    )

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda ids: ids.map(lambda i: i[0]))
        x = np.array(rows["vector"].tolist(), np.float32)
        edges, entry = build_graph(unit(x))
        return pd.DataFrame(
            [(int(key[1]), int(key[0]), x.tobytes(), [list(i) for i in rows["ids"]], edges.tobytes(), entry)],
            columns=[c.split()[0] for c in SHARD.split(", ")],
        )

    return stored(placed.groupBy("dim", "shard").applyInPandas(build, SHARD), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """query_id, rank, id, score: the `k` nearest rows found for each of `queries`
    (id, vector), other than the row of the query's own id.
    """
    blocks = (
        queries.withColumn("dim", F.size("vector"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(1 + queries.count() // QUERY_BLOCK)))
        .groupBy("dim", "block")
        .agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    )
    shards = index.select("dim", "shard").groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = blocks.join(shards, "dim").withColumn("shard", F.explode("shards")).drop("shards")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                x = np.frombuffer(row.vectors, np.float32).reshape(-1, row.dim)
                edges = np.frombuffer(row.edges, np.int32).reshape(len(x), -1)
                close, wide = unit(x), x.astype(np.float64)
                length = np.sqrt((wide**2).sum(1))
                own = np.array([q["id"] for q in row.queries], np.int64)
                asked = np.array([q["vector"] for q in row.queries], np.float32)
                for i in range(0, len(own), BATCH):
                    found, _ = beam_search(close, edges, row.entry, unit(asked[i : i + BATCH]), beam)
                    out = []
                    for q, vector, nodes in zip(own[i : i + BATCH], asked[i : i + BATCH], found[:, : 2 * k + 6]):
                        nodes = nodes[nodes >= 0]
                        v = vector.astype(np.float64)
                        score = (wide[nodes] * v).sum(1) / (length[nodes] * np.sqrt((v**2).sum()))
                        near = [(-s, j) for s, node in zip(score, nodes) for j in row.ids[node] if j != q]
                        out += [(q, j, -s) for s, j in sorted(near)[:k]]
                    yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        asked.join(index, ["dim", "shard"])
        .mapInPandas(look, "query_id bigint, id bigint, score double")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
