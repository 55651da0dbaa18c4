"""Rows of two sides that share words of a place: the best partner that shares enough of them, and how many share any.

Neither pairs rows. Two sets share n words exactly if they share a combination of n words, so each side names its combinations;
the listed side keeps the least of each, and a row takes the least of its own. How many listed rows share any word is the sum
over the combinations of a row's words, of odd size added and of even size taken away, of the listed rows that hold all of one
(inclusion and exclusion). The work grows with the rows, however common a word is, but with a power of a row's words; sets wider
than ``WIDEST`` (for counts ``WIDEST_COUNTED``) are paired instead, by a prefix filter: of all words in one order, longest first,
two sets that share n have one in common among the first ``size - n + 1`` of each.

``mine`` has ``row long, place string, words array<string>`` and ``listed`` has ``ordinal long, place, words``; words of a row
differ from one another. Null or empty places and empty sets share nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST, WIDEST_COUNTED = 24, 7


def combinations(words: str, n: int) -> str:
    """SQL for all combinations of n words of a sorted array, joined by spaces."""

    def ahead(left: int, start: str, said: str) -> str:
        own = f"x{left}" if not said else f"concat({said}, ' ', x{left})"
        rest = f"slice({words}, {start} + 1, size({words}))"
        if left == 1:
            return f"transform({rest}, x1 -> {own})"
        return f"flatten(transform({rest}, (x{left}, i{left}) -> {ahead(left - 1, f'{start} + i{left} + 1', own)}))"

    return ahead(n, "0", "")


def _sets(rows: DataFrame, name: str) -> DataFrame:
    return rows.where("place <> '' and size(words) > 0").select(name, "place", F.array_sort("words").alias("words"))


def _widest(*sides: DataFrame) -> int:
    return max(s.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0] for s in sides)


def _prefixes(rows: DataFrame, name: str, needed: int) -> DataFrame:
    """A row for each word of the prefix."""
    longest = F.expr("array_sort(transform(words, w -> named_struct('n', -length(w), 'w', w)))")
    return rows.select(name, "place", "words", F.explode(F.slice(longest, F.lit(1), F.size("words") - needed + 1)).alias("p")).select(name, "place", "words", F.col("p.w").alias("word"))


def _pairs(mine: DataFrame, listed: DataFrame, needed: int, widest: int) -> DataFrame:
    """``row, ordinal`` of pairs that share enough words and of which one is wide; a pair may come repeatedly."""
    wide = F.size("words") > widest
    meet = [(mine.where(wide), listed), (mine.where(~wide), listed.where(wide))]
    found = [_prefixes(a, "row", needed).join(_prefixes(b, "ordinal", needed).withColumnRenamed("words", "theirs"), ["place", "word"]) for a, b in meet]
    return found[0].unionByName(found[1]).where(F.size(F.array_intersect("words", "theirs")) >= needed).select("row", "ordinal")


def first_sharing(mine: DataFrame, listed: DataFrame, needed: int, widest: int = WIDEST) -> DataFrame:
    """``row, ordinal``: for each row that shares at least ``needed`` words with a listed one of its place, the least such ordinal."""
    mine, listed = (_sets(s, n).where(F.size("words") >= needed) for s, n in ((mine, "row"), (listed, "ordinal")))
    key = F.explode(F.expr(combinations("words", needed))).alias("key")
    narrow = F.size("words") <= widest
    least = listed.where(narrow).select("ordinal", "place", key).groupBy("place", "key").agg(F.min("ordinal").alias("ordinal"))
    found = mine.where(narrow).select("row", "place", key).join(least, ["place", "key"]).select("row", "ordinal")
    if _widest(mine, listed) > widest:
        found = found.unionByName(_pairs(mine, listed, needed, widest))
    return found.groupBy("row").agg(F.min("ordinal").alias("ordinal"))


def count_sharing(mine: DataFrame, listed: DataFrame, widest: int = WIDEST_COUNTED) -> DataFrame:
    """``row, n``: how many listed rows of its place share any word with a row; rows that share none are left out."""
    mine, listed = _sets(mine, "row"), _sets(listed, "ordinal")
    narrow = F.size("words") <= widest
    every = F.expr("flatten(array(" + ", ".join(f"transform({combinations('words', n)}, k -> named_struct('key', k, 'sign', {1 if n % 2 else -1}))" for n in range(1, widest + 1)) + "))")
    held = listed.where(narrow).select("place", F.explode(every).alias("k")).groupBy("place", "k.key").agg(F.count("*").alias("n"))
    found = mine.where(narrow).select("row", "place", F.explode(every).alias("k")).select("row", "place", "k.*").join(held, ["place", "key"]).select("row", (F.col("n") * F.col("sign")).alias("n"))
    if _widest(mine, listed) > widest:
        found = found.unionByName(_pairs(mine, listed, 1, widest).distinct().select("row", F.lit(1).cast("long").alias("n")))
    return found.groupBy("row").agg(F.sum("n").alias("n")).where("n > 0")
