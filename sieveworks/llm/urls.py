"""URL rules by a sort-merge range join.

A rule names a host, with all its subdomains, and a path prefix. A host written label by label from its end, each label with a
dot behind it, is a key in which a rule's hosts are exactly those that begin with the rule's own key: an interval, and any two
of these are nested or apart. Rules and pages are sorted by key together; a sweep keeps the nested rules that are open at its
place on a stack, pops those that the next key leaves, and looks up a page's path in the prefixes of each level. The longest
fitting rule (host and path together, then host) decides; of two rules for one host and path, block does.

Pages are dealt by ranges of (key, path, id), so that one host's pages spread over as many ranges as they need, and each rule
goes to every range that its interval touches. Range ends come from SAMPLED random keys for each range, as Spark's own sorting
does it, whatever the number of pages; they decide only where a page is judged.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; repeated rows are judged each; an empty
path fits no rule, as every rule's path begins with a slash; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import shuffle_partitions

#: Keys of the sample for each range, and the characters of a key and of a path that range ends look at.
SAMPLED, KEY, PATH = 40, 256, 64
ALLOW, BLOCK = "allow", "block"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, locate('://', _url) + 3)"))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def key_of(host: str) -> str:
    """The canonical key of a host: its labels from the last to the first, each with a dot behind it."""
    return "".join(f"{label}." for label in reversed(host.split("."))) if host else ""


def reversed_host(host: Column) -> Column:
    """``key_of`` as a column."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class Level:
    """The open rules of one host: paths with their verdicts, tried from the longest."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.sizes = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if self.paths.get(path) != BLOCK:
            self.paths[path] = verdict
        self.sizes = sorted({*self.sizes, len(path)}, reverse=True)

    def find(self, path: str) -> str | None:
        return next((path[:n] for n in self.sizes if path[:n] in self.paths and len(path) >= n), None)


def best(stack: Iterable[Level], path: str) -> tuple[str | None, str | None]:
    """The longest rule of the open levels that fits, and its verdict."""
    found: tuple[int, int, str, str] | None = None
    for level in stack:
        prefix = level.find(path)
        if prefix is not None and (found is None or (len(level.host) + len(prefix), len(level.host)) > found[:2]):
            found = (len(level.host) + len(prefix), len(level.host), level.host + prefix, level.paths[prefix])
    return found[2:] if found else (None, None)


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Level] = []
        at = None
        for batch in batches:
            out = []
            for part, key, page, row, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    stack, at = [], part
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if page:
                    rule, said = best(stack, path)
                    out.append((row, host, path, rule, said or default))
                else:
                    if not stack or stack[-1].key != key:
                        stack.append(Level(key, host))
                    stack[-1].add(path, verdict)
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] + [pa.string()] * 4, strict=True)], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """``page_id, host, path, rule, verdict``; ``rules`` has ``host, path, verdict``. ``default`` is for pages that no rule fits."""
    spark = pages.sparkSession
    raw = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("_url"))
    host, path = parts(F.col("_url"))
    keyed = raw.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", reversed_host(F.col("host")))
    # A range's key: cut where it is long, and ended by a character below all others, so that no key reaches into the path.
    place = F.concat(F.substring("key", 1, KEY), F.lit("\0"), F.substring("path", 1, PATH), F.lit("\0"), F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"))
    ranges = shuffle_partitions(spark)
    sample = keyed.where(F.rand(42) * pages.count() < SAMPLED * ranges).select(place.alias("place")).collect()
    points = sorted((r["place"] for r in sample), key=str.encode)
    ends = sorted({points[len(points) * i // ranges] for i in range(1, ranges)}, key=str.encode) if points else []
    raw_ends = [e.encode() for e in ends]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [bisect_right(raw_ends, p.encode()) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns[:-1]], names=["part", "key", "page", "page_id", "host", "path", "verdict"])

    fields = "part int, key string, page boolean, page_id long, host string, path string, verdict string"
    of_pages = keyed.select("key", F.lit(True).alias("page"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"), place.alias("place")).mapInArrow(dealt, fields)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = host.translate({c: c + 32 for c in range(65, 91)})
                key = key_of(host)
                low = key[:KEY].encode()
                # From the range of the first key that begins with the rule's to that of the last one.
                for part in range(bisect_left(raw_ends, low), bisect_right(raw_ends, low + b"\xff") + 1):
                    out.append((part, key, False, None, host, path, verdict))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "key", "page", "page_id", "host", "path", "verdict"])

    usable = rules.where("host is not null and host <> '' and path is not null and verdict is not null")
    of_rules = usable.select("host", "path", "verdict").mapInArrow(spread, fields)
    # Rules come before the pages of the same key; ids keep the order of equal rows.
    swept = of_pages.union(of_rules).repartitionById(len(ends) + 1, "part").sortWithinPartitions("part", F.col("key").cast("binary"), "page", "path")
    return swept.mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")
