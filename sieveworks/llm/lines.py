"""Line dedup by overlapping windows of three lines.

Every window of three consecutive lines is hashed (128 bits, from two 64-bit hashes of different order); windows that occur
twice or more anywhere are found by one pre-aggregated grouping, which also gives the first occurrence by (doc_id, line). All
later occurrences mark their three lines; a document's marked positions are merged and those lines go.

Only DataFrame functions are used. A window that is very common meets in a join whose skewed side Spark can split, and in a
grouping that is summed before it is dealt, so no task holds all its occurrences.

Cases: windows of nothing but white space don't count; texts of fewer than three lines, null and empty texts stay as they
are; rows with equal id and text are one document and share its result; rows with a null id come after all others; extra
columns are passed through; a column named like one that this adds is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with a key that is never null: the id, and a hash of the text to part rows that share an id."""
    return docs.withColumns({"_id": F.coalesce(docs[doc_id].cast("long"), F.lit(LAST)), "_of": F.xxhash64(docs[text])})


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _of, at int, h1, h2``: a row for each window with a visible character."""
    lines = _keyed(docs, doc_id, text).select("_id", "_of", F.split(docs[text], "\n", -1).alias("l")).where("size(l) > 2")
    hashed = F.expr("""transform(slice(l, 3, size(l)), (x, i) -> if(concat(l[i], l[i + 1], x) rlike '\\\\S',
        named_struct('h1', xxhash64(l[i], l[i + 1], x), 'h2', xxhash64(x, '|', l[i], l[i + 1])), null))""")
    return lines.select("_id", "_of", F.posexplode(hashed).alias("at", "h")).where("h is not null").select("_id", "_of", "at", "h.h1", "h.h2")


def later(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _of, starts array<int>``: where in a document windows begin that occur before it or earlier in it."""
    every = windows(docs, doc_id, text)
    place = F.struct("_id", "_of", "at")
    repeated = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    found = every.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    return found.groupBy("_id", "_of").agg(F.collect_set("at").alias("starts"))


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with later occurrences taken out of ``text``; with ``counts`` also ``n_lines`` and ``n_removed long``."""
    clash = {"_id", "_of", "starts", "_lines", "n_lines", "n_removed"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}: this operator uses these names")
    marked = later(docs, doc_id, text).hint("shuffle_hash")
    joined = _keyed(docs, doc_id, text).join(marked, ["_id", "_of"], "left")
    gone = "array_distinct(flatten(transform(starts, p -> array(p, p + 1, p + 2))))"
    left = f"array_join(transform(array_except(sequence(0, size(_lines) - 1), {gone}), i -> _lines[i]), '\\n')"
    out = joined.withColumn("_lines", F.when(F.col("starts").isNotNull() | F.lit(counts), F.split(docs[text], "\n", -1)))
    new = {text: F.when(F.col("starts").isNull(), F.col(text)).otherwise(F.expr(left))}
    if counts:
        new |= {"n_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"), "n_removed": F.expr(f"cast(coalesce(size({gone}), 0) as bigint)")}
    return out.select(*[new[c].alias(c) if c == text else F.col(c) for c in docs.columns], *[new[c].alias(c) for c in ("n_lines", "n_removed") if counts])
