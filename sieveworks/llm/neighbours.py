"""Nearest neighbours by inner product, as a block matrix join over int8 tiles.

Queries and candidates are dealt to a grid of tiles by a hash of their id, so that every query meets every candidate in exactly
one tile and a tile holds a bounded number of queries, whatever the data. In a tile the vectors are rounded to int8 with a
scale each; the product of the rounded vectors, with a bound on its error from the rounding residues
(|q|·|x - x'| + |q - q'|·|x'|), gives for each query a floor that its k-th neighbour reaches. Pairs whose ceiling is below the
floor go; the others are computed anew in double precision on the original vectors and kept in a heap of k for each query.
The heaps of a query's tiles are merged at the end. The result is exact: its recall is 1.

Cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors are compared with those
of their own length only; rows with a null id take no part; an id that occurs repeatedly has several rows, each a candidate
for all rows but itself, and each a query with k neighbours of its own where its id is one; ties go to the smaller id, then to
the row read first; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.llm.common import materialize, shuffle_partitions

K = 20
#: Queries and candidates that a tile holds at most, about; candidates pass through it in blocks of BLOCK, for QUERIES queries at a time.
TILE_QUERIES, TILE_ROWS, BLOCK, QUERIES = 16384, 65536, 1024, 1024
#: Products of int8 vectors of up to this length are exact in float32.
EXACT = 1024


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (held in float32 for the matrix product), scales, norms of the rounded vectors, norms of the residues."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components whatever the block."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Tile:
    """The queries of a tile, each with a heap of its k best candidates. A row is known by its number, a result by its id."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        self.rows, self.ids, self.x, self.k = rows, ids, x, k
        self.q, self.scale, _, self.residue = rounded(x)
        self.norm = np.linalg.norm(x, axis=1)
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in rows]
        self.floor = np.full(len(rows), -np.inf)

    def meet(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(rows), BLOCK):
            some = slice(at, at + BLOCK)
            block = rounded(x[some])
            for first in range(0, len(self.rows), QUERIES):
                self._block(slice(first, first + QUERIES), rows[some], ids[some], x[some], *block)

    def _block(self, mine: slice, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, scale: np.ndarray, norm: np.ndarray, residue: np.ndarray) -> None:
        own_q, own_norm = self.q[mine], self.norm[mine]
        product = np.zeros((len(own_q), len(rows)))
        for d in range(0, q.shape[1], EXACT):
            product += own_q[:, d : d + EXACT] @ q[:, d : d + EXACT].T
        product *= self.scale[mine, None]
        product *= scale
        bound = np.outer(own_norm, residue) + np.outer(self.residue[mine], norm)
        bound += 1e-12 * (1 + np.outer(own_norm, norm + residue))  # what float arithmetic itself may lose
        own = self.rows[mine, None] == rows
        floor = self.floor[mine]
        if len(rows) > self.k:
            low = product - bound
            low[own] = -np.inf
            floor = np.maximum(floor, np.partition(low, -self.k, axis=1)[:, -self.k])
        at, columns = np.nonzero((product + bound >= floor[:, None]) & ~own)
        at += mine.start
        for start in range(0, len(at), 1 << 15):
            r, c = at[start : start + (1 << 15)], columns[start : start + (1 << 15)]
            for i, score, vec, row in zip(r.tolist(), exact(self.x[r], x[c]).tolist(), ids[c].tolist(), rows[c].tolist(), strict=True):
                heap, item = self.heaps[i], (score, -vec, -row)
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        self.floor[mine] = [h[0][0] if len(h) == self.k else -np.inf for h in self.heaps[mine]]

    def result(self) -> pa.RecordBatch:
        found = [(row, q, -vec, -other, score) for row, q, heap in zip(self.rows.tolist(), self.ids.tolist(), self.heaps, strict=True) for score, vec, other in heap]
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "query_id", "vec_id", "row", "score"])


def _tiles(k: int):
    """For rows sorted by (tile, size, candidate or not): each tile's heaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, now, waiting = None, None, []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            rows, ids, flat = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False), batch.column(5)
            cuts = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                group, candidate = tuple(key[:2, a].tolist()), bool(key[2, a])
                if group != now:
                    if tile is not None:
                        yield tile.result()
                    tile, now, waiting = None, group, []
                x = flat.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
                if not candidate:
                    waiting.append((rows[a:b], ids[a:b], x))
                    continue
                if tile is None and waiting:
                    tile = Tile(*(np.concatenate(w) for w in zip(*waiting, strict=True)), k)
                if tile is not None:
                    tile.meet(rows[a:b], ids[a:b], x)
        if tile is not None:
            yield tile.result()

    return run


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``queries`` (a condition on ``vec_id`` and ``v``) holds."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].alias("v"))
    usable = "vec_id is not null and size(v) > 0 and exists(v, x -> x <> 0) and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    rows = rows.where("v is not null").where(usable)
    n, different, asked = rows.agg(F.count("*"), F.countDistinct("vec_id"), F.count_if(queries)).first()
    # Where ids are unique they number the rows; else the numbers are written once, as a number made anew may differ.
    rows = rows.withColumn("row", F.col("vec_id")) if n == different else materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    down = max(1, -(-asked // TILE_QUERIES))
    across = max(1, -(-n // TILE_ROWS), shuffle_partitions(spark) // down)
    part = lambda sides, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(sides))
    every = lambda sides: F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
    one = rows.where(queries).select("row", "vec_id", "v", part(down, 1).alias("r"), every(across).alias("c"), F.lit(0).alias("candidate"))
    two = rows.select("row", "vec_id", "v", every(down).alias("r"), part(across, 2).alias("c"), F.lit(1).alias("candidate"))
    both = one.unionByName(two).select((F.col("r") * across + F.col("c")).cast("int").alias("tile"), F.size("v").alias("size"), "candidate", "row", "vec_id", "v")
    dealt = both.repartitionById(down * across, "tile").sortWithinPartitions("tile", "size", "candidate")
    found = dealt.mapInArrow(_tiles(k), "query long, query_id long, vec_id long, row long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
