"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in hash order, are cut into blocks. With weight w (its share of all weights), block i of a source is released
at slot floor(i / w) and due at slot ceil((i + 1) / w); earliest deadline first over the released blocks gives every block a
slot in time, so that at any slot a source has had less than one block more or less than its weight asks for.

Weights are whole numbers. After as many slots as their sum every source stands exactly at its target and the schedule repeats,
so one period is laid out by itself and a block's slot is a formula of its number. When a source has no more blocks, the others
go on in a new phase by their weights among themselves: nothing is dropped or repeated. There are at most as many phases as
named sources, so the table that is broadcast is bounded by the configuration and not by the data.

A row's number in its source comes from counts of small hash buckets, running sums of these, and its place in its bucket. A
source has as many buckets as its rows need, so one with a third of all rows is dealt to a third of the tasks.

Cases: a source that the weights don't name, null among them, belongs to the source named "" (weight 1, if not given); rows
with a null id go by a hash of their text; repeated rows are rows of their own, in any order; extra columns are passed through, those with a
name that this operator uses, in either case, are an error;
an empty table gives an empty result; a last block may be short.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.llm.common import shuffle_partitions

#: Rows in a block; rows in a bucket of which one task sorts several.
BLOCK, BUCKET = 8, 2048
#: Sources that may be named, and the largest sum of weights: they bound what is broadcast.
MOST_SOURCES, LONGEST_PERIOD = 1000, 100_000
OWN = ("_source", "_hash", "_bucket", "_number", "_before", "block", "slot", "position")


def period(weights: Mapping[str, int]) -> Iterator[str]:
    """The sources of one period's slots, by earliest deadline among released blocks; ties go to the lesser name."""
    total = sum(weights.values())
    due: list[tuple[int, str, int]] = []
    coming = [(0, s, 0) for s in weights]
    heapq.heapify(coming)
    for slot in range(total):
        while coming and coming[0][0] <= slot:
            _, s, i = heapq.heappop(coming)
            heapq.heappush(due, (-(-(i + 1) * total // weights[s]), s, i))
        _, s, i = heapq.heappop(due)
        if i + 1 < weights[s]:
            heapq.heappush(coming, ((i + 1) * total // weights[s], s, i + 1))
        yield s


@dataclass(frozen=True)
class Span:
    """Blocks ``first`` to ``end`` (exclusive) of a source in a phase that begins at slot ``start``."""

    source: str
    first: int
    end: int
    start: int
    weight: int
    period: int
    slots: tuple[int, ...]

    def slot(self, block: int) -> int:
        turn, at = divmod(block - self.first, self.weight)
        return self.start + turn * self.period + self.slots[at]


def schedule(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[Span]:
    """Where each source's blocks go, phase by phase, until no source has any left."""
    left, used, start, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        now = {s: weights[s] for s in left}
        order = list(period(now))
        whole = min(n // now[s] for s, n in left.items())
        given = {s: whole * w for s, w in now.items()}
        slots = whole * len(order)
        if not any(given[s] == n for s, n in left.items()):
            for s in order:
                given[s] += 1
                slots += 1
                if given[s] == left[s]:
                    break
        out += [Span(s, used[s], used[s] + given[s], start, w, len(order), tuple(i for i, x in enumerate(order) if x == s)) for s, w in now.items()]
        for s in now:
            used[s] += given[s]
            left[s] -= given[s]
        left = {s: n for s, n in left.items() if n}
        start += slots
    return out


def plan(docs: DataFrame, weights: Mapping[str, int], source: str = "source", doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``block, slot, position long``: a row's block in its source, the block's slot, its place in the mix from 0."""
    clash = {*OWN} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}: this operator uses these names")
    weights = {"": 1} | dict(weights)
    if len(weights) > MOST_SOURCES or sum(weights.values()) > LONGEST_PERIOD or min(weights.values()) < 1:
        raise ValueError(f"weights are whole numbers from 1; at most {MOST_SOURCES} sources with a sum of {LONGEST_PERIOD}")
    spark = docs.sparkSession
    named = F.when(docs[source].isin([s for s in weights if s]), docs[source]).otherwise("")
    place = F.xxhash64(F.lit(8), docs[doc_id])
    if text in docs.columns:
        place = F.when(docs[doc_id].isNull(), F.xxhash64(docs[text])).otherwise(place)
    counts = {r["_source"]: r["count"] for r in docs.groupBy(named.alias("_source")).count().collect()}  # one row for each named source
    # A source has buckets by its size, so that buckets of all sources hold about as many rows.
    parts = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, -(-n // BUCKET))])[named] if counts else F.lit(1)
    keyed = docs.withColumns({"_source": named, "_hash": place, "_bucket": F.pmod(place, parts)})
    sizes = keyed.groupBy("_source", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    spans = schedule(weights, {s: -(-n // block) for s, n in counts.items()})
    fields = "source string, first long, end long, start long, weight long, period long, slots array<long>"
    table = spark.createDataFrame([(x.source, x.first, x.end, x.start, x.weight, x.period, list(x.slots)) for x in spans], fields)
    ends = {x.source: x.slot(x.end - 1) for x in spans}  # of a source's spans the last one stays
    short = [(ends[s], -n % block) for s, n in counts.items() if n % block]
    missing = "+".join(f"if(slot > {slot}L, {gap}L, 0L)" for slot, gap in short) or "0L"
    within = Window.partitionBy("_source", "_bucket").orderBy("_hash", docs[doc_id])
    numbered = keyed.withColumn("_number", F.row_number().over(within) - 1).join(offsets.hint("shuffle_hash"), ["_source", "_bucket"]).withColumn("_number", F.col("_number") + F.col("_before"))
    blocked = numbered.withColumn("block", F.floor(F.col("_number") / block).cast("long"))
    t = F.broadcast(table).alias("t")
    timed = blocked.join(t, F.expr("_source = t.source and block >= t.first and block < t.end"))
    slotted = timed.withColumn("slot", F.expr("t.start + floor((block - t.first) / t.weight) * t.period + t.slots[cast((block - t.first) % t.weight as int)]").cast("long"))
    return slotted.select(*[numbered[c] for c in docs.columns], "block", "slot", F.expr(f"cast(slot * {block} + _number % {block} - ({missing}) as bigint)").alias("position"))


def arrange(docs: DataFrame, weights: Mapping[str, int], source: str = "source", doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, numbered: bool = False) -> DataFrame:
    """The rows of ``docs`` in the order of the mix: over the partitions, and in each of them; with ``numbered`` also ``position``."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    each = max(1, -(-docs.count() // parts))
    placed = plan(docs, weights, source, doc_id, text, block)
    dealt = placed.repartitionById(parts, F.floor(F.col("position") / each).cast("int"))
    return dealt.sortWithinPartitions("position").drop("block", "slot", *(() if numbered else ("position",)))
