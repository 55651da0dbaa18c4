"""SimHash near duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. To find all fingerprints within ``radius``
bits, every bit position gets a non-zero vector of ``radius + 1`` bits; each of the ``2 ** (radius + 1) - 1`` non-zero vectors
``v`` makes a mask of the positions whose vector has an odd product with ``v``. At most ``radius`` differing positions cannot
span the whole space, so some ``v`` has product 0 with all of them: its mask leaves them out and the pair shares that bucket.
No link is lost, whatever the data.

Equal fingerprints are one class from the start, so copies are never paired. A bucket yields a spanning forest of its links,
not its pairs. A bucket of more than ``BUCKET`` fingerprints is dealt again by a second covering family on top of the first, and
by a third on top of both. The families of radius 4 are chosen so that fingerprints in one cell of the second agree on 44 bits
at least, and in one of the third on 50: that holds 2 ** 14 different fingerprints at most, whatever the data. Classes are joined
into components by alternating star contractions over tables in the shared folder; the join that names a component's classes
is salted, as one component may hold a third of them.

Cases: a null or empty text has fingerprint zero and links like any other; equal rows share a class; rows with a null id get a
fingerprint and a component but are never the component's id, and ``dedupe`` keeps them; extra columns are not read by
``components`` and are passed through by ``dedupe``; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import materialize
from sieveworks.operators import graph

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints that a bucket may hold before it is dealt again.
BUCKET = 2048
#: Seeds of the orders in which the families deal vectors to positions; None is the order of the positions.
FAMILIES = (None, 11, 72)
#: Parts into which the classes of a component are dealt to be named.
SALTS = 32


def shingles(raw: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of a text's shingles, in UTF-8. A-Z are lower-cased; words part at the six ASCII spaces; a shorter text is one shingle."""
    tokens = (raw or b"").lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, tokens), np.int64, n)
    end = np.cumsum(size + 1) - 1
    starts, ends = (end - size)[: n - words + 1].tolist(), end[words - 1 :].tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(raw: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number."""
    return majority(shingles(raw, words))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 255):  # sums of 255 bits fit in a byte
        counts += np.add.reduce(np.unpackbits(octets[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id long, fp long``, a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS, step: int = 1, seed: int | None = None) -> list[int]:
    """The covering masks, signed; families with different ``step`` or ``seed`` deal the vectors to the positions differently."""
    whole = (1 << (radius + 1)) - 1
    order = list(range(64))
    if seed is not None:
        random.Random(seed).shuffle(order)
    vectors = [0] * 64
    for at, position in enumerate(order):
        vectors[position] = (at * step) % whole + 1
    out = [sum(1 << i for i, m in enumerate(vectors) if bin(v & m).count("1") % 2) for v in range(1, whole + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between different fingerprints."""
    rest, edges = fps.view(np.uint64), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                edges += [(int(x.view(np.int64)), y) for y in found.view(np.int64).tolist()]
                todo += list(found)
    return edges


def _linked(radius: int, most: int | None):
    """For rows sorted by (key, fp): edges (a, b, False), or the rows (fp, key, True) of a bucket with over ``most`` fingerprints."""
    schema = ("a", "b", "again")

    def packed(edges: list[tuple[int, int]], again: bool) -> pa.RecordBatch:
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy()), pa.array(np.full(len(a), again))], names=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)  # keys and fingerprints of the bucket that may go on
        spilling = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]])
            if spilling is not None:
                end = int(np.searchsorted(rows[0], spilling, "right")) if rows.shape[1] else 0
                if end:
                    yield packed(list(zip(rows[1, :end].tolist(), rows[0, :end].tolist(), strict=True)), True)
                if end == rows.shape[1]:
                    continue
                rows, spilling = rows[:, end:], None
            rows = np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            held, done = rows[:, cut:], rows[:, :cut]
            yield from buckets(done)
            if most is not None and held.shape[1] > most:
                spilling = int(held[0, 0])
                yield packed(list(zip(held[1].tolist(), held[0].tolist(), strict=True)), True)
                held = held[:, :0]
        yield from buckets(held)

    def buckets(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, fps = rows
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        edges: list[tuple[int, int]] = []
        for at, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            if most is not None and n > most:
                yield packed([(x, int(keys[at])) for x in fps[at : at + n].tolist()], True)
            else:
                edges += forest(fps[at : at + n], radius)
        if edges:
            yield packed(edges, False)

    return run


def _dealt(rows: DataFrame, family: list[int], radius: int, most: int | None) -> DataFrame:
    """The buckets of one covering family within the cells of ``rows`` (``fp, cell``), each whole and sorted in one task."""
    cells = F.explode(F.array(*[F.xxhash64("cell", F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(family)]))
    dealt = rows.select(cells.alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_linked(radius, most), "a long, b long, again boolean")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` between different fingerprints that connect exactly those which links connect; ``distinct`` has ``fp``."""
    rows, out = distinct.select("fp", F.lit(0).cast("long").alias("cell")), []
    for seed in FAMILIES:
        found = materialize(_dealt(rows, masks(radius, seed=seed), radius, bucket if seed != FAMILIES[-1] else None), "simhash-links")
        out.append(found.where("not again").select("a", "b"))
        rows = found.where("again").select(F.col("a").alias("fp"), F.col("b").alias("cell"))
        if rows.isEmpty():
            break
    return reduce(DataFrame.union, out)


def roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node with an edge to a lesser one; root is the least node of its component."""
    return graph.components(edges, rounds, one_task=0)


def named(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for rows ``doc_id, fp`` and the edges between different ``fp``."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = roots(edges)
    rooted = classes.join(root, classes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = rooted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    least = least.select("root", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.struct("component_id").alias("of"))
    of_class = rooted.join(least, ["root", "salt"], "left").select("fp", F.when(F.col("of").isNull(), F.col("least")).otherwise(F.col("of.component_id")).alias("component_id"))
    return fps.join(of_class, "fp").select("doc_id", "fp", "component_id")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component_id``, a row for each row of ``docs``; component_id is the least doc_id that links reach."""
    fps = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    return named(fps, links(fps.select("fp").distinct(), radius, bucket))


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: Callable[..., DataFrame] = components) -> DataFrame:
    """The rows of ``docs`` whose id is their component's by ``near``; of rows with one id, one stays; rows with a null id stay."""
    kept = materialize(near(docs, doc_id, text).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    ids = kept.select(F.col("doc_id").alias("_kept"))
    out = docs.join(ids.hint("shuffle_hash"), docs[doc_id] == ids["_kept"], "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates([doc_id])
    return out.unionByName(docs.where(docs[doc_id].isNull()))
