"""Detection of periodic runs of words by bit-parallel lags.

A run is a stretch of words whose smallest period is q, of at least ``LEAST`` words and ``TIMES`` periods, that no neighbouring
word extends. The words of a text get numbers; each bit of the numbers is a plane, one big integer with a bit for each word.
For a lag q, a plane and itself moved by q differ where words q apart do; the planes' differences together are the mismatches.
Stretches of at least m words without a mismatch are what is left after ANDs with the agreement moved by 1, 2, 4, ... up to m
places; where nothing is left after the first planes, the other planes of that lag are not looked at, as they can only add
mismatches. A stretch that a divisor of q has found with the same bounds has that smaller period.

A text costs its words times a quarter of them, 64 at a time (a lag is a handful of operations on integers of a bit a word);
texts are worked on where they are read, without a shuffle.

Cases: words are what lies between blanks (space and bytes 9 to 13); null, empty and blank texts have no word and no run, and
an empty collapsed text; rows with equal or null ids each have their own result; extra columns are passed through only where
``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 6, 4


def planes(words: list[bytes]) -> list[int]:
    """A big integer for each bit of the words' numbers, lowest first; bit i is of word i."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    bits = (len(number) - 1).bit_length() if number else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(bool), bitorder="little").tobytes(), "little") for b in range(bits)]


def stretched(bits: int, m: int) -> int:
    """Bit i stays where bits i to i + m - 1 are all set."""
    have = 1
    while have < m and bits:
        step = min(have, m - have)
        bits &= bits >> step
        have += step
    return bits


def runs_of(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    n, by_plane = len(words), planes(words)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, n // times + 1):
        m = max(least, times * q) - q
        if m > n - q:
            break
        agree = (1 << (n - q)) - 1
        starts = -1
        for at, plane in enumerate(by_plane):
            agree &= ~(plane ^ (plane >> q))
            if at in (0, 1, 3, 7) and at + 1 < len(by_plane) and not stretched(agree, m):
                starts = 0
                break
        starts = starts and stretched(agree, m)
        while starts:
            low = (starts & -starts).bit_length() - 1
            gap = ~(agree >> low)
            size = (gap & -gap).bit_length() - 1  # words that agree from here on
            found.setdefault((low, size + q), q)  # lags rise, so the least period comes first
            starts = starts >> (low + size) << (low + size)
    return sorted((s, size, q) for (s, size), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    edges = [0] * (len(words) + 1)
    for start, size, q in runs:
        edges[start + q] += 1
        edges[start + size] -= 1
    kept, inside = [], 0
    for word, edge in zip(words, edges, strict=False):
        inside += edge
        if not inside:
            kept.append(word)
    return kept


def _found(least: int, times: int, extra: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(extra)
            for at in range(0, batch.num_rows, 256):
                runs, left = [], []
                for text in texts.slice(at, 256):
                    words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                    own = runs_of(words, least, times)
                    runs.append([{"start": s, "length": size, "period": q} for s, size, q in own])
                    left.append(b" ".join(collapsed(words, own)).decode())
                columns = [batch.column(i).slice(at, 256) for i in range(extra)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(runs, kind), pa.array(left, pa.string())], names=[*batch.schema.names[:extra], "runs", "collapsed"])

    return run


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns of ``keep``, ``runs array<struct<start, length, period>>`` by start and period, ``collapsed string``."""
    clash = {"runs", "collapsed"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}: this operator uses these names")
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_found(least, times, len(keep)), f"{schema}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def strongest(runs: str = "runs") -> str:
    """SQL for the run with the greatest exact length / period, of equal ones the first; null without a run."""
    return f"aggregate({runs}, get({runs}, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))"
