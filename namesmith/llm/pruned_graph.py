"""Nearest neighbours by largest inner product, from a robust-pruned graph in each shard.

Distinct vectors are dealt into shards of about 4,000. A shard's graph is built point by
point: a greedy beam search over the graph so far proposes neighbours, and pruning keeps a
candidate only if no kept one is nearer to it than the point is, by the relaxation ``ALPHA``.
Queries are distinct vectors in blocks; each block is searched by beam in every shard, past
whose graph, read once, the blocks stream, and the shards' best are merged. Inner products become distances by one more coordinate that
gives all vectors of a shard the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import stage

NEAREST = 20
#: distinct vectors of a shard and distinct query vectors of a block, on average
SHARD, BLOCK = 4_000, 500
#: edges kept by pruning; candidates of a build search and of a query's beam
DEGREE, BUILD_BEAM, QUERY_BEAM = 32, 48, 80
ALPHA = 1.2
#: points inserted, or queries searched, side by side
_TOGETHER = 256


def beam_search(
    queries: np.ndarray, points: np.ndarray, squares: np.ndarray, edges: np.ndarray,
    entry: int, width: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest points met from the entry, and their distances less |query|²,
    for many queries in step. -1 fills up.

    Each step expands every query's nearest point not yet expanded.
    """
    n_queries = len(queries)
    found = np.full((n_queries, width), -1, np.int32)
    far = np.full((n_queries, width), np.inf, np.float32)
    open_ = np.zeros((n_queries, width), bool)
    seen = np.zeros((n_queries, len(points)), bool)
    found[:, 0] = entry
    far[:, 0] = squares[entry] - 2 * (queries @ points[entry])
    open_[:, 0] = True
    seen[:, entry] = True
    rows = np.arange(n_queries)
    while len(rows):
        best = np.where(open_[rows], far[rows], np.inf).argmin(axis=1)
        alive = open_[rows, best]
        rows, best = rows[alive], best[alive]
        if not len(rows):
            break
        open_[rows, best] = False
        near = edges[found[rows, best]]
        new = (near >= 0) & ~seen[rows[:, None], near]
        near = np.where(new, near, -1)
        at, slot = np.nonzero(new)
        seen[rows[at], near[at, slot]] = True
        away = np.where(new, squares[near] - 2 * np.einsum(
            "bd,brd->br", queries[rows], points[near]), np.inf).astype(np.float32)
        all_far = np.concatenate([far[rows], away], axis=1)
        order = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        far[rows] = np.take_along_axis(all_far, order, 1)
        found[rows] = np.take_along_axis(np.concatenate([found[rows], near], axis=1), order, 1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], new], axis=1), order, 1)
    order = far.argsort(axis=1, kind="stable")
    return np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)


def robust_prune(point: int, candidates: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Diverse neighbours: each is nearer to the point than, relaxed, to those before it."""
    candidates = np.unique(candidates)
    candidates = candidates[(candidates >= 0) & (candidates != point)]
    own = points[candidates]
    gap = own - points[point]
    away = np.einsum("ij,ij->i", gap, gap)
    order = np.argsort(away, kind="stable")
    candidates, own, away = candidates[order], own[order], away[order]
    squares = np.einsum("ij,ij->i", own, own)
    between = squares[:, None] + squares[None, :] - 2 * (own @ own.T)
    alive = np.ones(len(candidates), bool)
    kept = []
    while len(kept) < DEGREE and alive.any():
        i = int(alive.argmax())
        kept.append(i)
        alive &= ALPHA**2 * between[i] > away
        alive[i] = False
    return candidates[kept]


def build_graph(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Edges (-1 fills up) and the entry, the point nearest to the mean."""
    n = len(points)
    squares = np.einsum("ij,ij->i", points, points)
    edges = np.full((n, 2 * DEGREE), -1, np.int32)
    degree = np.zeros(n, np.int32)
    order = np.random.RandomState(0).permutation(n)
    gap = points - points.mean(axis=0)
    entry = int(np.einsum("ij,ij->i", gap, gap).argmin())
    order = np.r_[entry, order[order != entry]]

    def link(a: int, b: int) -> None:
        if degree[a] == edges.shape[1]:
            kept = robust_prune(a, np.r_[edges[a], b], points)
            edges[a] = -1
            edges[a, : len(kept)] = kept
            degree[a] = len(kept)
        elif b not in edges[a, : degree[a]]:
            edges[a, degree[a]] = b
            degree[a] += 1

    at = 1
    while at < n:
        # first batches are small, as their points do not see each other
        batch = order[at : at + min(_TOGETHER, max(1, at // 2))]
        met, _ = beam_search(points[batch], points, squares, edges, entry, BUILD_BEAM)
        for p, candidates in zip(batch.tolist(), met):
            kept = robust_prune(p, candidates, points)
            for q in kept.tolist():
                link(p, q)
                link(q, p)
        at += len(batch)
    return edges, entry


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, so that all have the length of the longest."""
    # large values would overflow as float32 squares
    scaled = vectors / np.abs(vectors).max()
    squares = np.einsum("ij,ij->i", scaled, scaled)
    rest = np.sqrt(np.maximum(squares.max() - squares, 0))
    return np.column_stack([scaled, rest]).astype(np.float32)


_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()),
                    ("vectors", pa.binary()), ("edges", pa.binary()), ("entry", pa.int32())])
_INDEX_DDL = "dim int, shard int, ids binary, vectors binary, edges binary, entry int"


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group, in the order of the ids."""
    ids = np.array(table.column("vid").to_pylist(), np.int64)
    flat = table.column("v").combine_chunks().flatten().to_numpy()
    order = np.argsort(ids)
    return ids[order], flat.reshape(len(ids), -1).astype(np.float64)[order]


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    ids, vectors = _matrix(table)
    edges, entry = build_graph(lengthened(vectors))
    return pa.Table.from_pylist([{
        "dim": key[0].as_py(), "shard": key[1].as_py(), "ids": ids.tobytes(),
        "vectors": vectors.tobytes(), "edges": edges.tobytes(), "entry": entry}], _INDEX)


def _pack_block(key: tuple, table: pa.Table) -> pa.Table:
    ids, vectors = _matrix(table)
    return pa.Table.from_pylist([{
        "dim": key[0].as_py(), "block": key[1].as_py(), "q_ids": ids.tobytes(),
        "q_vectors": vectors.tobytes()}], pa.schema([
            ("dim", pa.int32()), ("block", pa.int32()), ("q_ids", pa.binary()),
            ("q_vectors", pa.binary())]))


@dataclass
class _Graph:
    """A shard's graph, ready to be searched."""

    key: tuple[int, int]
    ids: np.ndarray
    vectors: np.ndarray
    points: np.ndarray
    squares: np.ndarray
    edges: np.ndarray
    entry: int

    @classmethod
    def of(cls, r: dict) -> _Graph:
        vectors = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
        ids = np.frombuffer(r["ids"], np.int64)
        points = lengthened(vectors)
        return cls((r["dim"], r["shard"]), ids, vectors, points,
                   np.einsum("ij,ij->i", points, points),
                   np.frombuffer(r["edges"], np.int32).reshape(len(ids), -1), r["entry"])

    def search(self, r: dict, top: int) -> Iterator[pa.RecordBatch]:
        """The ``top`` nearest points found for each query of a block."""
        q_ids = np.frombuffer(r["q_ids"], np.int64)
        q_vectors = np.frombuffer(r["q_vectors"]).reshape(-1, r["dim"])
        unit = q_vectors / np.abs(q_vectors).max(axis=1, keepdims=True)
        flat = np.column_stack([unit, np.zeros(len(unit))]).astype(np.float32)
        width = max(QUERY_BEAM, 2 * top)
        for at in range(0, len(q_ids), _TOGETHER):
            own = q_vectors[at : at + _TOGETHER]
            met, _ = beam_search(flat[at : at + _TOGETHER], self.points, self.squares, self.edges,
                                 self.entry, width)
            score = np.einsum("bd,bwd->bw", own, self.vectors[met])
            score[met < 0] = -np.inf
            # nearest first, ties to the smaller id: points stand in the order of their ids
            order = np.lexsort((met, -score), axis=1)[:, :top]
            met, score = np.take_along_axis(met, order, 1), np.take_along_axis(score, order, 1)
            row, col = np.nonzero(met >= 0)
            yield pa.record_batch([
                pa.array(q_ids[at + row]), pa.array(self.ids[met[row, col]]),
                pa.array(score[row, col])], _FOUND)


_FOUND = pa.schema([("qvid", pa.int64()), ("vid", pa.int64()), ("score", pa.float64())])


def _searcher(top: int):
    """Searches a stream in which a shard's graph comes before the blocks of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["edges"] is not None:
                    graph = _Graph.of(r)
                # vectors of a length may be in some shards only
                elif graph is not None and graph.key == (r["dim"], r["shard"]):
                    yield from graph.search(r, top)

    return run


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero, and has only finite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """Each vector once: its least id ``vid``, its ``top + 1`` smallest ids, ``dim``, ``v``.

    No query needs more of the ids that share a vector, its own among them. They are
    cut to that number before the shuffle, however many rows share one.
    """
    own = Window.partitionBy("_h", "_g").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= top + 1)
    return few.groupBy("_h", "_g").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("v").alias("v")
    ).select("_h", "_g", F.col("ids")[0].alias("vid"), "ids", F.size("v").alias("dim"), "v")


def nearest(
    embeddings: DataFrame, is_query: Column, top: int = NEAREST, shard_size: int = SHARD
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` found for each query row.

    ``embeddings`` has ``vec_id`` and ``embedding``; ``is_query`` tells the query rows.
    Scores are inner products in double precision, ties go to the smaller id, and a query's
    own id is no candidate. Rows without an id, and vectors that are null, zero or hold a
    null or non-finite component take no part; vectors of another length are no candidates;
    an id names one vector, so repeated rows count once, and of different vectors under one id
    the one of the least hash counts; an empty table gives an empty result.
    """
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("_q"),
        F.col("embedding").cast("array<double>").alias("v"),
    ).where("vec_id is not null").where(usable(F.col("v")))
    # 0.0 and -0.0 are equal components
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0))
    rows = rows.withColumns({"_h": F.xxhash64("v"), "_g": F.xxhash64(F.lit(1), "v")})
    one = rows.groupBy("vec_id").agg(F.min(F.struct("_h", "_g", "_q", "v")).alias("_one"))
    rows = stage(one.select("vec_id", "_one.*"), "vectors")
    vectors = stage(distinct_vectors(rows, top), "distinct_vectors")
    asked = stage(rows.where("_q").join(
        vectors.select("_h", "_g", F.col("vid").alias("qvid")), ["_h", "_g"]
    ).select(F.col("vec_id").alias("query_id"), "qvid"), "queries")

    shards = max(1, -(-vectors.count() // shard_size))
    place = F.pmod(F.xxhash64("vid"), F.lit(shards)).cast("int")
    index = stage(
        vectors.select("dim", place.alias("shard"), "vid", "v")
        .repartition(shards, "dim", "shard").groupBy("dim", "shard")
        .applyInArrow(_build_shard, _INDEX_DDL), "graphs")
    q_vectors = vectors.join(asked.select(F.col("qvid").alias("vid")).distinct(), "vid", "left_semi")
    blocks = max(1, -(-asked.select("qvid").distinct().count() // BLOCK))
    packed = (
        q_vectors.select("dim", F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int").alias("block"),
                         "vid", "v")
        .groupBy("dim", "block").applyInArrow(
            _pack_block, "dim int, block int, q_ids binary, q_vectors binary")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    # graphs sort first, as they have no block
    found = (
        index.unionByName(packed, allowMissingColumns=True)
        .repartition(shards, "dim", "shard")
        .sortWithinPartitions("dim", "shard", F.asc_nulls_first("block"))
        .mapInArrow(_searcher(top + 1), "qvid long, vid long, score double")
    )
    best = Window.partitionBy("qvid").orderBy(F.desc("score"), "vid")
    merged = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top + 1)
    # at most (top + 1) squared ids for each query vector
    lists = (
        merged.join(vectors.select("vid", "ids"), "vid")
        .select("qvid", (-F.col("score")).alias("_s"), F.explode("ids").alias("vec_id"))
        .groupBy("qvid").agg(F.sort_array(F.collect_list(F.struct("_s", "vec_id"))).alias("_near"))
        .withColumn("_near", F.slice("_near", 1, top + 1))
    )
    others = F.filter("_near", lambda x: x["vec_id"] != F.col("query_id"))
    return (
        asked.join(lists, "qvid")
        .select("query_id", F.posexplode(F.slice(others, 1, top)).alias("_at", "_x"))
        .select("query_id", (F.col("_at") + 1).cast("int").alias("rank"),
                F.col("_x.vec_id").alias("vec_id"), (-F.col("_x._s")).alias("score"))
    )
