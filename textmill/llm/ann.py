"""Approximate nearest neighbours by largest inner product, on a robust-pruned directed graph per shard.

Vectors get one more component, so that all have the norm of the longest and the largest inner product is the least
distance. A shard's graph starts with random edges. Batches of points search it greedily; what their beams meet are
proposed as neighbours. Pruning takes the nearest proposal, drops all that are nearer to it (times `alpha`) than to
the point, and repeats, which keeps edges that lead in different directions. Edges are added in reverse, and pruned
again where a point has too many. A query's beam runs over every shard; what it finds is scored on the original
vectors in double precision.

Vectors are shuffled once, to their shard by hash of the vector, about `shard` to each. Equal vectors are one node with
its smallest ids, as many as a result can hold; more of them don't leave the partition they are read in. Graphs stay
where they are written: queries come to them in blocks of BLOCK_BYTES, and a task merges what a query finds in all of
its shards, so results are shuffled once per query and task.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite components take no part, neither as
queries nor as candidates; nor do rows without an id. Vectors meet those of their own length only. Rows that share
the query's id are its own and no candidates; equal scores go to the smaller id; without candidates a query has no
rows. Repeated queries are one. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA, BLOCK = 4096, 32, 48, 64, 1.2, 512
#: Queries that are sent to all graphs at a time.
BLOCK_BYTES = 16 << 20
#: ids: of all nodes, one after another; counts: how many each node has; single: whether vectors are of single precision.
GRAPH = "dim int, shard int, ids binary, counts binary, vectors binary, single boolean, edges binary, entry int"
FOUND = "query_id long, id long, score double"


def extended(x: np.ndarray) -> np.ndarray:
    """Rows scaled to a norm of 1 at most, with the component that makes the norms equal, less 1: distances don't change, and short vectors keep their precision."""
    x = x / max(float(np.abs(x).max(initial=0)), 1e-300)
    norm = np.einsum("ij,ij->i", x, x)
    most = float(norm.max(initial=0)) or 1.0
    x, norm = x / np.sqrt(most), norm / most
    return np.concatenate([x, -(norm / (1 + np.sqrt(np.maximum(1 - norm, 0))))[:, None]], axis=1).astype(np.float32)


def beam_search(x: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the beam of each query, nearest first; -1 where it isn't full. Distances lack |query|^2; with squares of 0 they are inner products."""
    n, b, degree = len(edges), len(queries), edges.shape[1]  # x has one row more, which stands for no node
    rows = np.arange(b)
    nodes = np.full((b, beam), -1, np.int32)
    far = np.float32(np.inf)
    dist = np.full((b, beam), far, np.float32)
    open_ = np.zeros((b, beam), bool)
    start = squares[entry] - 2 * queries @ x[entry].T
    order = np.argsort(start, axis=1)
    nodes[:, : len(entry)] = entry[order]
    dist[:, : len(entry)] = np.take_along_axis(start, order, axis=1)
    open_[:, : len(entry)] = True
    seen = np.zeros((b, n + 1), bool)
    seen[:, entry] = True
    seen[:, n] = True
    while True:
        active = np.flatnonzero(open_.any(axis=1))
        if not len(active):
            return nodes, dist
        best = np.where(open_[active], dist[active], far).argmin(axis=1)
        open_[active, best] = False
        near = edges[nodes[active, best]]
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        d = squares[near] - 2 * np.matmul(x[near], queries[active][:, :, None])[:, :, 0]
        d = np.where(new, d, far)
        worst = dist[active, -1]
        some = (d < worst[:, None]).any(axis=1)
        if not some.any():
            continue
        at = active[some]
        all_d = np.concatenate([dist[at], d[some]], axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        take = np.take_along_axis(all_d, keep, axis=1)
        order = np.argsort(take, axis=1)
        keep, take = np.take_along_axis(keep, order, axis=1), np.take_along_axis(take, order, axis=1)
        all_n = np.concatenate([nodes[at], near[some]], axis=1)
        all_o = np.concatenate([open_[at], np.ones((len(at), degree), bool)], axis=1)
        finite = np.isfinite(take)
        nodes[at] = np.where(finite, np.take_along_axis(all_n, keep, axis=1), -1)
        dist[at] = take
        open_[at] = np.take_along_axis(all_o, keep, axis=1) & finite


def pruned(x: np.ndarray, points: np.ndarray, proposals: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each point among its proposals (-1: none), -1 where there are fewer than `degree`."""
    b, k = proposals.shape
    body = x[np.maximum(proposals, 0)]
    apart = body - x[points][:, None]
    d = np.einsum("bkd,bkd->bk", apart, apart)
    alive = (proposals >= 0) & (proposals != points[:, None])
    order = np.argsort(np.where(alive, d, np.inf), axis=1, kind="stable")
    proposals, d, alive = (np.take_along_axis(v, order, axis=1) for v in (proposals, d, alive))
    body = np.take_along_axis(body, order[:, :, None], axis=1)
    norms = np.einsum("bkd,bkd->bk", body, body)
    out, rows = np.full((b, degree), -1, np.int32), np.arange(b)
    for r in range(degree):
        pick = alive.argmax(axis=1)
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, r] = proposals[rows, pick][has]
        chosen = body[rows, pick]
        between = norms + norms[rows, pick][:, None] - 2 * np.matmul(body, chosen[:, :, None])[:, :, 0]
        alive &= ~((alpha * alpha * between <= d) & has[:, None])
        alive[rows, pick] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = BLOCK, seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges, entry point) of the graph over the rows of `vectors`."""
    x = extended(vectors)
    n = len(x)
    rng = np.random.default_rng(seed)
    degree = min(degree, max(1, n - 1))
    squares = np.append(np.einsum("ij,ij->i", x, x), 0).astype(np.float32)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = rng.integers(0, n, (n, degree)).astype(np.int32)
    padded = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    order = rng.permutation(n)
    for lo in range(0, n, batch):
        points = order[lo : lo + batch]
        met, _ = beam_search(padded, np.where(edges < 0, n, edges), np.array([entry]), x[points], beam, squares)
        edges[points] = pruned(x, points, np.concatenate([met, edges[points]], axis=1), degree, alpha)
        source, target = np.repeat(points, degree), edges[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        held, first, count = np.unique(target, return_index=True, return_counts=True)
        come = np.full((len(held), int(count.max()) if len(held) else 0), -1, np.int32)
        row = np.repeat(np.arange(len(held)), count)
        come[row, np.arange(len(target)) - first[row]] = source
        for i in range(0, len(held), batch):
            h = held[i : i + batch]
            both = np.concatenate([edges[h], come[i : i + batch]], axis=1)
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            free = (both >= 0).sum(axis=1) <= degree
            packed = np.sort(np.where(both < 0, n, both), axis=1)[:, :degree]
            edges[h[free]] = np.where(packed[free] == n, -1, packed[free])
            if (~free).any():
                edges[h[~free]] = pruned(x, h[~free], both[~free], degree, alpha)
    return edges, entry


def search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Nodes of each query's beam over the extended vectors x, nearest first; all nodes in shards that the beam could hold."""
    n = len(x)
    if n <= beam:
        return np.tile(np.arange(n), (len(queries), 1))
    x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    longest = np.maximum(np.abs(queries).max(axis=1, keepdims=True), 1e-300)
    q = np.concatenate([queries / longest, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    edges, flat = np.where(edges < 0, n, edges), np.zeros(n + 1, np.float32)
    # the last component is least for the longest vectors, which many queries want
    starts = np.union1d(np.argpartition(x[:n, -1], beam - 1)[: beam - 1], [entry])
    return np.concatenate([beam_search(x, edges, starts, q[i : i + BLOCK], beam, flat)[0] for i in range(0, len(q), BLOCK)])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; single precision stays so."""
    element = vectors.schema[vector_col].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) else "double"
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _fewer_copies(most: int):
    """Of the rows of a partition with the same hash of the vector at most about `most` a batch, the smallest ids: none that is larger than as many that went before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}  # hash to its smallest ids, as many as `most`; a partition's rows at most
        for batch in batches:
            ids, h = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            keep = np.ones(len(ids), bool)
            for i, (key, one) in enumerate(zip(h.tolist(), ids.tolist(), strict=True)):
                held = seen.get(key)
                if held is None:
                    seen[key] = [one]
                elif len(held) < most:
                    bisect.insort(held, one)
                elif one < held[-1]:
                    held.pop()
                    bisect.insort(held, one)
                else:
                    keep[i] = False
            yield (batch if keep.all() else batch.filter(pa.array(keep))).select([0, 1, 2, 3])

    return run


def _graphs(most: int, degree: int, beam: int, alpha: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        ids, dim = table.column("id").to_numpy(), table.column("dim")[0].as_py()
        x = _matrix(table.column("v"), dim) + 0.0  # -0.0 is 0.0
        _, first, node = np.unique(np.ascontiguousarray(x).view(f"V{x.dtype.itemsize * dim}").ravel(), return_index=True, return_inverse=True)
        order = np.argsort(first)  # nodes by their smallest id
        node = np.argsort(order)[node]
        by = np.lexsort((ids, node))
        rank = np.arange(len(by)) - np.searchsorted(node[by], node[by])
        by = by[rank < most]
        x = x[first[order]]
        edges, entry = build(x, degree, beam, alpha)
        row = {
            "dim": dim, "shard": table.column("shard")[0].as_py(), "ids": ids[by].tobytes(), "counts": np.bincount(node[by]).astype(np.int32).tobytes(),
            "vectors": x.tobytes(), "single": x.dtype == np.float32, "edges": edges.tobytes(), "entry": entry,
        }
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.int32()]
        return pa.Table.from_pylist([row], schema=pa.schema(list(zip(row, kinds, strict=True))))

    return run


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard: int = SHARD, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> DataFrame:
    """A row per shard: its graph, its vectors, and the k + 1 smallest ids of each node (equal vectors). Written."""
    rows = usable(vectors, id_col, vector_col).withColumn("dim", F.size("v"))
    sizes = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}  # a row per length
    shards = {d: -(-n // shard) for d, n in sizes.items()}
    number = F.lit(1)
    for d, n in shards.items():
        number = F.when(F.col("dim") == d, n).otherwise(number)
    h = F.xxhash64("v")
    placed = rows.select("dim", F.pmod(F.xxhash64(h, F.lit(1)), number).cast("int").alias("shard"), "id", "v", h.alias("h"))
    kind = placed.schema["v"].dataType.simpleString()
    placed = placed.mapInArrow(_fewer_copies(k + 1), f"dim int, shard int, id long, v {kind}")
    # a stated number of partitions, or the few small rows of all shards end in one task
    return written(placed.repartition(max(1, sum(shards.values())), "dim", "shard").groupBy("dim", "shard").applyInArrow(_graphs(k + 1, degree, beam, alpha), GRAPH))


def _answers(shared: Broadcast, k: int, beam: int):
    """Graphs to the k best ids that each query of a block finds in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value  # length to (ids, vectors)
        best: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in asked:
                    continue
                who, q = asked[dim]
                ids, counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int32)
                x = np.frombuffer(row["vectors"], np.float32 if row["single"] else np.float64).reshape(-1, dim)
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(x), -1)
                lifted, first = extended(x.astype(np.float64)), np.cumsum(counts) - counts
                for lo in range(0, len(who), BLOCK):
                    mine = slice(lo, lo + BLOCK)
                    found = search(lifted, edges, row["entry"], q[mine].astype(np.float64), beam)
                    query = np.repeat(np.arange(len(found)), found.shape[1])[found.ravel() >= 0] + lo
                    node = found.ravel()[found.ravel() >= 0]
                    score = np.concatenate([np.einsum("ij,ij->i", x[node[i : i + (1 << 14)]].astype(np.float64), q[query[i : i + (1 << 14)]].astype(np.float64)) for i in range(0, len(node), 1 << 14)])
                    many = counts[node]
                    at = np.repeat(first[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    query, score, one = np.repeat(query, many), np.repeat(score, many), ids[at]
                    if held := best.get((dim, lo)):
                        query, one, score = (np.concatenate(v) for v in zip(held, (query, one, score), strict=True))
                    other = one != who[query]
                    query, one, score = query[other], one[other], score[other]
                    order = np.lexsort((one, -score, query))
                    query, one, score = query[order], one[order], score[order]
                    near = np.arange(len(query)) - np.searchsorted(query, query) < k
                    best[dim, lo] = [query[near], one[near], score[near]]
        for (dim, _), (query, one, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[dim][0][query]), pa.array(one), pa.array(score)], names=["query_id", "id", "score"])

    return run


def _gathered(rows: list, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r)
    return {d: (np.array([r["id"] for r in part], np.int64), np.array([r["v"] for r in part], kind)) for d, part in by.items()}


def nearest(graphs: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, beam: int = BEAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query, its own id left out. graphs: of index() with the same k or more.

    A query id with several vectors has results of all of them, together.
    """
    spark = graphs.sparkSession
    q = usable(queries, id_col, vector_col).distinct()
    kind = "f4" if isinstance(q.schema["v"].dataType.elementType, T.FloatType) else "f8"
    q = written(q)
    total = q.agg(F.sum(F.size("v") * int(kind[1]) + 8)).first()[0] or 0
    passes = max(1, -(-total // block_bytes))
    tasks = 2 * spark.sparkContext.defaultParallelism
    found = []
    for p in range(passes):
        part = q.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(passes)) == p) if passes > 1 else q
        shared = spark.sparkContext.broadcast(_gathered(part.collect(), kind))  # about block_bytes
        one = graphs.coalesce(tasks).mapInArrow(_answers(shared, k, beam), FOUND)
        found.append(written(one) if passes > 1 else one)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    if q.count() != q.select("id").distinct().count():
        rows = rows.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
