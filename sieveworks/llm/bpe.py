"""Byte-level BPE encoding and decoding.

A text is cut by the vocabulary's pattern; each piece is merged on its own. The merge keeps a segment tree over the piece's
byte positions whose leaves hold the rank of the pair that starts there; the root is the leftmost pair of least rank, and a
merge touches three live neighbours with one logarithmic point update each, so a piece of n bytes takes O(n log n) however
long it is.

Cases: a null or empty text has no tokens and decodes to no bytes; repeated rows are encoded each; extra columns are not read.
Documents are independent, so nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import struct
from collections import ChainMap, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces that a worker remembers (a full memory is emptied), and the longest of them, in bytes; longer ones are merged one by
#: one. Only speed depends on these.
REMEMBERED, LONGEST = 200_000, 32
#: Documents in one batch that goes back to Spark.
ROWS, CHARS = 512, 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranks of a piece after all merges, least rank first and leftmost among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    none = 1 << 62
    # A node is rank * width + position, so that the minimum of two nodes is the leftmost pair of least rank.
    tree = [none] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for k in range(width - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    after = list(range(1, n + 1))  # where the token at a live position ends, which is where the next one starts
    before = list(range(-1, n - 1))

    def put(at: int, value: int) -> None:
        k = width + at
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            best = value if value < other else other
            if tree[k] == best:
                return
            tree[k] = value = best

    while tree[1] != none:
        at = tree[1] % width
        gone = after[at]
        end = after[gone]
        after[at] = end
        if end < n:
            before[end] = at
            rank = get(piece[at : after[end]])
            put(at, none if rank is None else rank * width + at)
        else:
            put(at, none)
        if gone < n - 1:
            put(gone, none)
        prior = before[at]
        if prior >= 0:
            rank = get(piece[prior:end])
            put(prior, none if rank is None else rank * width + prior)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Pairs:
    """For two neighbouring tokens, the token that they merge into: every split of a vocabulary entry into two others."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values(), default=0) + 1
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left * self.base + right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.to = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged rank, or -1."""
        if not len(self.keys):
            return np.full(left.shape, -1, np.int64)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.to[at], -1)


NONE = np.int64(1 << 62)


def merge_many(pieces: list[bytes], pairs: Pairs, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``merge`` for many pieces of 2 to ``width`` bytes (a power of two) at once, a tree each in the rows of one array.

    Returns all ids, one piece after the other, and how many each piece has. No piece is itself an entry.
    """
    n = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
    column = np.arange(width, dtype=np.int64)
    inside = column < size[:, None]
    token = np.full((n, width + 1), -1, np.int64)
    token[:, :width] = np.where(inside, pairs.single[raw], -1)
    after = np.tile(np.arange(1, width + 3, dtype=np.int64), (n, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
    live = inside.copy()
    tree = np.full((n, 2 * width), NONE, np.int64)
    first = pairs.ranks(token[:, : width - 1], token[:, 1:width])
    tree[:, width : 2 * width - 1] = np.where(first >= 0, first * width + column[:-1], NONE)
    level = width
    while level > 1:
        half = level // 2
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
        level = half
    flat, row = tree.reshape(-1), np.arange(n, dtype=np.int64)
    while True:
        row = row[tree[row, 1] != NONE]
        if not len(row):
            break
        best, end_of = tree[row, 1], size[row]
        at, merged = best % width, best // width
        gone = after[row, at]
        end = np.minimum(after[row, gone], end_of)
        after[row, at] = end
        before[row, end] = at
        token[row, at] = merged
        live[row, gone] = False
        right = pairs.ranks(merged, np.where(end < end_of, token[row, end], -1))
        prior = before[row, at]
        has = prior >= 0
        left = pairs.ranks(np.where(has, token[row, prior], -1), merged)
        base = row * (2 * width)
        flat[base + width + gone] = NONE
        flat[base + width + at] = np.where(right >= 0, right * width + at, NONE)
        behind = base[has] + width + prior[has]
        flat[behind] = np.where(left[has] >= 0, left[has] * width + prior[has], NONE)
        # Point updates: from the three leaves to the root, level by level.
        paths = [(base, width + at), (base, width + gone), (base[has], width + prior[has])]
        level = width
        while level > 1:
            level //= 2
            paths = [(b, k >> 1) for b, k in paths]
            for b, k in paths:
                two = b + 2 * k
                flat[b + k] = np.minimum(flat[two], flat[two + 1])
    return token[:, :width][live], live.sum(axis=1)


class Codec:
    """Encodes texts and decodes ids for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: Pairs | None = None):
        self._ranks = ranks
        self._pairs = pairs or Pairs(ranks)
        self._cut = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}
        self._tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self._tokens[rank] = token

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of pieces as packed int32; those of more than LONGEST bytes are merged one by one."""
        out, by_width, pack = {}, defaultdict(list), struct.Struct("=i").pack
        for piece in pieces:
            raw = piece.encode()
            rank = self._ranks.get(raw)
            if rank is not None:
                out[piece] = pack(rank)
            elif 1 < len(raw) <= LONGEST:
                by_width[1 << (len(raw) - 1).bit_length()].append((piece, raw))
            else:
                out[piece] = np.array(merge(raw, self._ranks), np.int32).tobytes()
        for width, group in by_width.items():
            for start in range(0, len(group), 1 << 14):
                some = group[start : start + (1 << 14)]
                flat, counts = merge_many([raw for _, raw in some], self._pairs, width)
                packed, ends = flat.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
                out.update((piece, packed[a:b]) for (piece, _), a, b in zip(some, [0, *ends], ends, strict=False))
        return out

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; pieces not met before are merged together."""
        cut = [self._cut(x) if x else [] for x in texts]
        met = set().union(*cut)
        if len(self._known) > REMEMBERED:
            self._known.clear()
        learnt = self._learn(met - self._known.keys())
        long = {k: v for k, v in learnt.items() if len(k) > LONGEST}
        self._known.update(learnt if not long else {k: v for k, v in learnt.items() if k not in long})
        known = self._known if not long else ChainMap(long, self._known)
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32) for pieces in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._tokens.__getitem__, ids))


_CODECS: dict[tuple, Codec] = {}


def _cut_small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ROWS texts, and CHARS characters unless one text has more."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = min(max(start + 1, int(np.searchsorted(sizes, before + CHARS, "right"))), start + ROWS)
        yield batch.slice(start, end - start)
        start = end


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns, ``token_ids array<int>`` and, if asked for, ``decoded binary``: the bytes that the ids stand for.

    ``ranks_path`` names a rank file on the driver; its entries (tens of thousands, whatever the input) are broadcast.
    """
    clash = {"token_ids", "decoded", "_text"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}: results carry these names")
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, Pairs(ranks)))
    name = (ranks_path, pattern)
    source = docs.select(*keep, docs[text].cast("string").alias("_text"))
    fields = [source.schema[c] for c in keep] + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("decoded", T.BinaryType())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODECS.get(name)
        if codec is None:
            ranks, pairs = shared.value
            codec = _CODECS[name] = Codec(ranks, pattern, pairs)
        for batch in batches:
            for part in _cut_small(batch):
                ids = codec.encode_many(part.column("_text").to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids)
                columns = [part.column(c) for c in keep] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([codec.decode(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded binary``; null ids decode to no bytes."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    source = rows.select(*keep, rows[ids].alias("_ids"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, "")
        for batch in batches:
            out = pa.array([codec.decode(x or ()) for x in batch.column("_ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], names=schema.names)

    return source.mapInArrow(run, schema)
