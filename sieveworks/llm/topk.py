"""Exact top-k search over integer vectors by an impact-ordered index, gone through score at a time.

``build`` deals the vectors to shards by a hash of their row and writes an index: for each shard and component the rows of a
quantised impact (the component without its lowest bits) form one posting segment, which keeps its least and greatest value;
beside the segments a shard keeps its vectors, packed. ``search`` sends blocks of queries to every shard. For a query, each
segment promises at most its end value times the query's component; segments that promise something are processed from the
greatest promise down, each adding its promise to its rows' sums. What the segments not yet processed still promise, the
greatest of each component, bounds what any row may gain. The best sums are scored exactly now and then, which gives a floor
that the k-th result reaches. A query stops only when few rows' bounds reach the floor, or nothing is promised any more; all
rows whose bounds reach the floor are then scored exactly, so the result is exact. The shards' k best are merged.

A task holds one shard's segments, of a bounded number of rows, and sees queries in batches.

Cases: a component is ``floor(256 * x)`` of x as a double; vectors that are null or hold a null or non-finite component, or one
beyond a long, take no part; zero and empty vectors do; a component that only one of two vectors has counts as zero; a score
beyond a long wraps. Rows with a null id take no part; an id that occurs repeatedly has several rows, each a candidate for all
rows but itself, and each a query of its own where its id is one. Ties go to the smaller id, then to the row read first; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.llm.common import materialize, shuffle_partitions

K = 5
SCALE = 256
#: A shard has up to MOST_ROWS rows, about, and blocks of queries get smaller down to LEAST_QUERIES to use all tasks.
MOST_ROWS, LEAST_QUERIES = 32768, 256
#: Components that a shard has at most, about, so that its index stays at some tens of megabytes whatever the vectors' length.
MOST_COMPONENTS = 1 << 22
#: Bits of an impact that are kept, and how often a query looks whether it may stop.
BITS, LOOKS = 5, 4
#: A query may stop once so many rows, or this part of a shard, can still be members.
FEW, PART = 64, 16

_INDEX = "shard int, term int, lo long, hi long, packed binary"
_VECTORS, _ROWS, _IDS = -3, -2, -1  # terms of a shard's vectors, row numbers and ids


def _packed(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integers that hold them."""
    top = int(np.abs(x).max()) if x.size and x.min() > np.iinfo(np.int64).min else (1 << 63) - 1 if x.size else 0
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index rows of whole shards, which come sorted by shard."""
    now, held = None, []

    def made() -> Iterator[pa.RecordBatch]:
        rows, ids, vectors = ([x for h in held for x in h[i]] for i in range(3))
        width = max(map(len, vectors), default=0)
        x = np.zeros((len(rows), width), np.int64)
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        order = np.argsort(np.array(rows, np.int64), kind="stable")
        x = _packed(x[order])
        parts = [(_VECTORS, x.dtype.itemsize, width, x.tobytes())]
        parts += [(term, 8, 1, np.array(of, np.int64)[order].tobytes()) for term, of in ((_ROWS, rows), (_IDS, ids))]
        shift = max(0, int(max(np.abs(x.astype(np.float64)).max(initial=0), 1)).bit_length() - BITS)
        for term in range(width):
            column = x[:, term].astype(np.int64)
            places = np.flatnonzero(column)
            impact = column[places] >> shift
            places = places[np.argsort(impact, kind="stable")]
            cuts = np.flatnonzero(np.diff(np.sort(impact))) + 1
            for segment in np.split(places, cuts) if len(places) else []:
                of = column[segment]
                parts.append((term, int(of.min()), int(of.max()), segment.astype(np.int32).tobytes()))
        for at in range(0, len(parts), 4096):
            term, lo, hi, packed = zip(*parts[at : at + 4096], strict=True)
            columns = [pa.array([now] * len(term), pa.int32()), pa.array(term, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "term", "lo", "hi", "packed"])

    for batch in batches:
        shard = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(shard)) + 1 if len(shard) else []
        for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
            if a == b:
                continue
            if held and shard[a] != now:
                yield from made()
                held = []
            now = int(shard[a])
            held.append([batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist(), batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False)])
    if held:
        yield from made()


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``row, vec_id, v array<long>``: the vectors that take part. Where ids are unique they number the rows."""
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].alias("v"))
    rows = rows.where(f"vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x * {SCALE}D) >= 9.2e18D)")
    rows = rows.withColumn("v", F.expr(f"transform(v, x -> cast(floor({SCALE}D * cast(x as double)) as bigint))"))
    n, different = rows.agg(F.count("*"), F.countDistinct("vec_id")).first()
    if n == different:
        return rows.select(F.col("vec_id").alias("row"), "vec_id", "v")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered").select("row", "vec_id", "v")


def build(rows: DataFrame, shards: int) -> DataFrame:
    """The index of ``row, vec_id, v``, as a table: ``shard, term, lo, hi, packed``; a row for each segment."""
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "vec_id", "v")
    return materialize(dealt.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(_index, _INDEX), "impacts")


class Shard:
    """The segments of one shard. ``looked`` counts postings processed, for tests."""

    def __init__(self, parts: list[tuple[int, int, int, bytes]], k: int):
        own = {term: (lo, hi, packed) for term, lo, hi, packed in parts if term < 0}
        size, self.width, packed = own[_VECTORS]
        self.rows, self.ids = (np.frombuffer(own[t][2], np.int64) for t in (_ROWS, _IDS))
        self.x = np.frombuffer(packed, f"i{size}").reshape(len(self.rows), self.width)
        segments = [p for p in parts if p[0] >= 0]
        self.term, self.lo, self.hi = (np.array([p[i] for p in segments], np.int64) for i in range(3))
        self.places = [np.frombuffer(p[3], np.int32).astype(np.int64) for p in segments]
        self.sizes = np.array([len(p) for p in self.places], np.int64)
        self.most = np.abs(self.x.astype(np.float64)).max(axis=0, initial=0)
        self.k, self.looked = k, 0

    def exact(self, places: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
        if small:  # float products and their sums are whole numbers below 2^53
            return np.einsum("ij,j->i", self.x[places].astype(np.float64), q.astype(np.float64)).astype(np.int64)
        return (self.x[places].astype(np.int64) * q).sum(axis=1)

    def members(self, q: np.ndarray, own: int | None) -> np.ndarray:
        """Places of all rows that may be among the k best, and a few more."""
        promise = np.maximum(q[self.term] * self.lo, q[self.term] * self.hi)
        order = np.flatnonzero(promise > 0)
        order = order[np.argsort(-promise[order], kind="stable")]
        sums, never = np.zeros(len(self.rows)), -np.inf  # whole numbers below 2^53
        cuts = np.searchsorted(np.cumsum(self.sizes[order]), np.linspace(0, self.sizes[order].sum(), LOOKS + 1)[1:-1]) if len(order) else []
        others = len(self.rows) - (own is not None)
        at, floor, best = 0, never, np.zeros(0, np.int64)
        for cut in [*cuts, len(order)]:
            if cut > at:
                some = order[at:cut]
                places = np.concatenate([self.places[s] for s in some.tolist()])
                sums += np.bincount(places, np.repeat(promise[some], self.sizes[some]), len(sums))
                self.looked += len(places)
            at = cut
            if others <= self.k:
                continue
            if own is not None:
                sums[own] = never
            ahead = np.zeros(self.width, np.int64)
            np.maximum.at(ahead, self.term[order[at:]], promise[order[at:]])
            most = min(others, 4 * self.k)
            best = np.union1d(best, np.argpartition(sums, -most)[-most:])
            floor = max(floor, np.partition(self.exact(best, q, True), -self.k)[-self.k])
            reach = np.flatnonzero(sums + ahead.sum() >= floor)
            if len(reach) <= max(FEW, len(self.rows) // PART):
                return reach
        return np.arange(len(self.rows)) if others <= self.k else np.flatnonzero(sums >= floor)

    def search(self, row: int, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows but the query's own."""
        q = np.zeros(self.width, np.int64)
        q[: len(vector)] = vector[: self.width]
        i = int(np.searchsorted(self.rows, row))
        own = i if i < len(self.rows) and self.rows[i] == row else None
        small = float(np.abs(q.astype(np.float64)) @ self.most) < 2.0**52
        places = self.members(q, own) if small else np.arange(len(self.rows))
        places = places[places != own] if own is not None else places
        scores = self.exact(places, q, small)
        first = np.lexsort((self.rows[places], self.ids[places], np.invert(scores)))[: self.k]
        return places[first], scores[first]


def _searched(k: int):
    """For rows sorted by (tile, shard's parts first): each query's k best of the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard = None, [], None
        for batch in batches:
            found: list[tuple[int, int, int, int, int]] = []
            tiles, terms = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (tile, term) in enumerate(zip(tiles, terms, strict=True)):
                if tile != now:
                    now, parts, shard = tile, [], None
                if term is not None:
                    parts.append((term, batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()))
                    continue
                if shard is None:
                    if not parts:
                        continue
                    shard, parts = Shard(parts, k), []
                row, vec_id = batch.column(5)[i].as_py(), batch.column(6)[i].as_py()
                places, scores = shard.search(row, batch.column(7)[i].values.to_numpy(zero_copy_only=False))
                found += [(row, vec_id, *r) for r in zip(shard.ids[places].tolist(), shard.rows[places].tolist(), scores.tolist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query", "query_id", "vec_id", "row", "score"])

    return run


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, most_rows: int = MOST_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``queries`` (a condition on ``vec_id`` and ``v``) holds."""
    rows = usable(vectors, vec_id, vector)
    n, asked, components = rows.agg(F.count("*"), F.count_if(queries), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    tasks = shuffle_partitions(vectors.sparkSession)
    across = max(1, -(-n // most_rows), -(-components // MOST_COMPONENTS))
    down = max(1, min(-(-tasks // across), -(-asked // LEAST_QUERIES)))
    index = build(rows, across)
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    parts = index.select("*", copies(down).alias("r")).select((F.col("r") * across + F.col("shard")).cast("int").alias("tile"), "term", "lo", "hi", "packed", *none("long", "row", "vec_id"), *none("array<long>", "v"))
    asking = rows.where(queries).select("row", "vec_id", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(down)).alias("r"), copies(across).alias("c"))
    asking = asking.select((F.col("r") * across + F.col("c")).cast("int").alias("tile"), *none("int", "term"), *none("long", "lo", "hi"), *none("binary", "packed"), "row", "vec_id", "v")
    dealt = parts.unionByName(asking).repartitionById(down * across, "tile").sortWithinPartitions("tile", F.asc_nulls_last("term"))
    found = dealt.mapInArrow(_searched(k), "query long, query_id long, vec_id long, row long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
