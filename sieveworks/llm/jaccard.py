"""Near duplicates by SimHash, verified by the Jaccard similarity of five-word shingles; MinHash bands add what SimHash's radius misses.

Texts with equal sets of shingles are one class from the start, so copies are never paired. A class has a SimHash fingerprint of
its different shingles and a key for each covering mask of ``simhash``: classes within ``simhash.RADIUS`` bits share a bucket,
whatever the data. A link is a similarity of at least SIMILARITY, computed from both whole sets. Most pairs of similarity 0.8 differ
in more bits than a covering family can reach (see README), so a class has BANDS MinHash keys of ROWS minima besides: a pair of
similarity s that is beyond the radius shares none with probability (1 - s ** ROWS) ** BANDS, 2.6e-5 at the least similarity that
links and less above it. Buckets with the same classes are one bucket. A bucket gets its classes' texts and yields a spanning forest
of the links, not its pairs. Components are those of ``simhash``.

No task gets more than MOST shingles of a bucket, but for single texts that are longer:

- classes of a crowded bucket are dealt again by a second covering family and by finer bands (a pair at the least similarity and
  beyond the radius shares none with probability 2.8e-5), which part texts that have only a template in common;
- what is crowded there is dealt in cells, and each text is compared with the bucket's least class. Near copies end here. Texts that
  are not near it are compared with all texts of the bucket, a block of them and a cell at a time, so no link is lost; that is
  quadratic only in texts that agree on many minima and yet are not alike.

Similarities are compared in whole numbers, so exactly 0.8 links. Cases are those of ``simhash``: null and empty texts share a class
that has no other links; a text of fewer words than a shingle is one shingle; rows with a null id link like any other but don't name a component; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import simhash
from sieveworks.llm.common import materialize

#: A link has at least SIMILARITY[0] / SIMILARITY[1] of both texts' different shingles in common.
SHINGLE_WORDS, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 20, 4
#: The same of the family for crowded buckets.
FINE_BANDS, FINE_ROWS = 57, 8
#: Shingles of a bucket that one task takes.
MOST = 1 << 20
_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Two covering families of masks for fingerprints, the second for crowded buckets, and what makes keys of them.
_MASKS, _FINE_MASKS = (np.array(simhash.masks(seed=x), np.int64).view(np.uint64) for x in simhash.FAMILIES[:2])
_COVER = np.random.default_rng(44).integers(0, 1 << 63, (2, len(_MASKS)), np.uint64) * np.uint64(2) + np.uint64(1)
_FINE = np.random.default_rng(43).integers(0, 1 << 63, (2, FINE_BANDS * FINE_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles whose values under all hash functions are held at once.
CHUNK = 1024


def shingle_set(raw: bytes | None) -> np.ndarray:
    """The different shingles of a text, sorted."""
    return np.unique(simhash.shingles(raw, SHINGLE_WORDS))


def name(found: np.ndarray) -> int:
    """A set's class, as a signed 64-bit number; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)) if len(found) else 0


def bands(found: np.ndarray, drawn: np.ndarray = _DRAWN, rows: int = ROWS) -> np.ndarray:
    """The keys of a set: one for each band, none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(drawn.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        part = found[at : at + CHUNK, None]
        least = np.minimum(least, ((part ^ (part >> np.uint64(29))) * drawn[0]).min(axis=0))
    return (least * drawn[1]).reshape(-1, rows).sum(axis=1, dtype=np.uint64).view(np.int64)


def cover(found: np.ndarray, masks: np.ndarray = _MASKS) -> np.ndarray:
    """The keys of a set's fingerprint: one for each covering mask, none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    fingerprint = np.int64(simhash.majority(found)).view(np.uint64)
    return (((fingerprint & masks) ^ _COVER[0]) * _COVER[1]).view(np.int64)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets link."""
    low, high = SIMILARITY
    common = len(np.intersect1d(x, y, assume_unique=True))
    return high * common >= low * (len(x) + len(y) - common)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, t, size long, keys array<long>``, a row for each row of ``docs``; ``fp`` is the class, ``t`` tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column(2)]
            keys = pa.array([np.concatenate([cover(x), bands(x)]) for x in sets], pa.list_(pa.int64()))
            fp = pa.array([name(x) for x in sets], pa.int64())
            size = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, batch.column(1), size, keys], names=["doc_id", "fp", "t", "size", "keys"])

    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("t"), docs[text].cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long, t long, size long, keys array<long>")


def forest(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between different sets."""
    sizes = np.array([len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    parts = np.split(number, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(number), bool)
    low, high = SIMILARITY
    rest, edges = np.arange(len(sets)), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            size, of = sizes[x], sizes[rest]
            fits = np.flatnonzero((high * np.minimum(of, size) >= low * np.maximum(of, size)))
            if not len(fits):
                continue
            marked[parts[x]] = True
            chosen = [parts[i] for i in rest[fits]]
            starts = np.concatenate([[0], np.cumsum(of[fits])[:-1]])
            common = np.add.reduceat(marked[np.concatenate(chosen)], starts, dtype=np.int64)
            marked[parts[x]] = False
            near = np.zeros(len(rest), bool)
            near[fits] = high * common >= low * (size + of[fits] - common)
            found, rest = rest[near], rest[~near]
            edges += [(names[x], names[y]) for y in found]
            todo += list(found)
    return edges


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows ``key, fp, text`` sorted by key and fp: the edges ``a, b`` of each bucket; a class that comes twice counts once."""

    def done(names: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        edges = forest(names, sets) if len(names) > 1 else []
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], names=["a", "b"])

    last, names, sets = None, [], []
    for batch in batches:
        for key, fp, text in zip(*batch.columns, strict=True):
            key, fp = key.as_py(), fp.as_py()
            if key != last:
                yield done(names, sets)
                last, names, sets = key, [], []
            if not names or names[-1] != fp:
                names.append(fp)
                sets.append(shingle_set(text.as_py()))
    yield done(names, sets)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the finer families for rows ``fp, t, size, text``."""
    for batch in batches:
        sets = [shingle_set(x.as_py()) for x in batch.column(3)]
        keys = pa.array([np.concatenate([cover(x, _FINE_MASKS), bands(x, _FINE, FINE_ROWS)]) for x in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], keys], names=["fp", "t", "size", "keys"])


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows ``key, cell, centre, fp, t, size, least, text`` sorted by key, cell and, centres first, centre: ``near`` instead of texts."""
    at, found = None, None
    for batch in batches:
        near = []
        for key, cell, centre, text in zip(*(batch.column(i) for i in (0, 1, 2, 7)), strict=True):
            mine = shingle_set(text.as_py())
            if centre.as_py():
                at, found = (key.as_py(), cell.as_py()), mine
            elif at != (key.as_py(), cell.as_py()):
                raise ValueError("a cell without its centre")
            near.append(alike(found, mine))
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(near, pa.bool_())], names=["key", "cell", "centre", "fp", "t", "size", "least", "near"])


def _members(cells: DataFrame, most: int) -> DataFrame:
    """``key, fp, t, size, crowded`` of the buckets of ``cells`` (``fp, t, size, key``) with several classes; equal buckets are one."""
    buckets = cells.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("whole"), F.sum("size").alias("weight")).where("n > 1")
    once = buckets.groupBy("n", "whole").agg(F.min("key").alias("key"), (F.max("weight") > most).alias("crowded"))
    return materialize(cells.join(once.select("key", "crowded"), "key").select("key", "fp", "t", "size", "crowded"), "members")


def _texts(docs: DataFrame, members: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``t, _text`` of the members' texts, each once: copies are dealt by salts, and all but one go before texts are dealt by their hash."""
    texts = docs.select(F.xxhash64(docs[text]).alias("t"), docs[text].cast("binary").alias("_text"), F.pmod(F.xxhash64(docs[doc_id]), F.lit(simhash.SALTS)).cast("int").alias("salt"))
    wanted = members.select("t").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(simhash.SALTS - 1))))
    return texts.join(wanted.hint("shuffle_hash"), ["t", "salt"], "left_semi").select("t", "_text").dropDuplicates(["t"])


def _forests(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges within each bucket of ``members`` (``key, fp, t``), a bucket to a task."""
    dealt = members.join(texts, "t").select("key", "fp", "_text").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_linked, "a long, b long")


def _in_cells(members: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Edges that connect what the links of crowded buckets connect, by a centre and by blocks of what is not near it."""
    half, c = max(1, most // 2), F.col
    number = lambda of, name: F.ceil(of / half).cast("int").alias(name)
    stats = members.groupBy("key").agg(F.min(F.struct("fp", "t", "size")).alias("least"), number(F.sum("size"), "cells"))
    sent = members.join(stats, "key").withColumn("cell", F.pmod(F.xxhash64("fp"), "cells").cast("int"))
    sent = sent.where("fp <> least.fp").select("key", "cell", F.lit(False).alias("centre"), "fp", "t", "size", c("least.fp").alias("least"))
    centres = stats.select("key", F.explode(F.sequence(F.lit(0), c("cells") - 1)).alias("cell"), F.lit(True).alias("centre"), "least.fp", "least.t", "least.size", c("least.fp").alias("least"))
    dealt = sent.union(centres).join(texts, "t").select("key", "cell", "centre", "fp", "t", "size", "least", "_text")
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", c("centre").desc())
    star = materialize(dealt.mapInArrow(_starred, "key long, cell int, centre boolean, fp long, t long, size long, least long, near boolean").where("not centre"), "stars")
    edges = star.where("near").select(c("least").alias("a"), c("fp").alias("b"))
    rest = star.where("not near")
    if rest.isEmpty():
        return edges
    blocks = rest.groupBy("key").agg(number(F.sum("size"), "blocks")).join(stats.select("key", "cells"), "key")
    each = F.explode(F.sequence(F.lit(0), c("cells") - 1)).alias("cell")
    asked = rest.join(blocks, "key").select("key", F.pmod(F.xxhash64("fp", F.lit(1)), "blocks").cast("int").alias("block"), each, "fp", "t")
    every = star.join(blocks, "key").select("key", F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias("block"), "cell", "fp", "t")
    return edges.union(_forests(asked.union(every).select(F.xxhash64("key", "block", "cell").alias("key"), "fp", "t"), texts))


def links(docs: DataFrame, sketched: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """Edges ``a, b`` between classes that connect those which links within buckets connect."""
    classes = sketched.groupBy("fp").agg(F.min(F.struct("t", "size", "keys")).alias("of")).select("fp", "of.t", "of.size", F.explode("of.keys").alias("key"))
    members = _members(materialize(classes, "cells"), most)
    edges = _forests(members.where("not crowded"), _texts(docs, members.where("not crowded"), text, doc_id))
    crowded = members.where("crowded")
    if crowded.isEmpty():
        return edges
    again = crowded.select("fp", "t", "size").distinct()
    texts = materialize(_texts(docs, again, text, doc_id), "crowded")
    finer = again.join(texts, "t").select("fp", "t", "size", "_text").mapInArrow(_finer, "fp long, t long, size long, keys array<long>")
    members = _members(materialize(finer.select("fp", "t", "size", F.explode("keys").alias("key")), "cells"), most)
    edges = edges.union(_forests(members.where("not crowded"), texts))
    crowded = members.where("crowded")
    return edges if crowded.isEmpty() else edges.union(_in_cells(crowded, texts, most))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """``doc_id, fp, component_id``, a row for each row of ``docs``; component_id is the least doc_id that links reach."""
    sketched = materialize(sketches(docs, doc_id, text), "sketches")
    return simhash.named(sketched.select("doc_id", "fp"), links(docs, sketched, text, doc_id, most))


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's; of rows with one id, one stays; rows with a null id stay."""
    return simhash.dedupe(docs, doc_id, text, components)
