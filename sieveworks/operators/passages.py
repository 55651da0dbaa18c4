"""Every pair of a text and a passage that stands in it, of many passages and many texts, in time linear in the texts.

Up to ``MOST_CHARS`` characters of different passages are one automaton (Aho-Corasick), sent to every task once; texts are
read where they are. Beyond that, passages of at least ``LEAST_WORDS`` words are found by winnowed fingerprints: of each stretch
of ``WINDOW`` consecutive hashes of ``GRAM`` words the least is kept, so a text and a passage in it keep one in common; these
meet in a join, and pairs are verified. The passage's first and last words may be parts of words of the text and are left out.
Shorter passages beyond the bound go through several automatons in turn.

Cases: null and empty texts and passages match nothing; equal passages each have their own pairs, and equal texts too; a text
holds a passage once however often it occurs; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.operators.graph import placed, written

#: Characters of passages in one automaton; it takes some tens of bytes for each of them in a task.
MOST_CHARS = 4_000_000
GRAM, WINDOW = 3, 4
LEAST_WORDS = GRAM + WINDOW + 1


def _hits(passages: list[str]):
    """For rows (key, text): key and the number of each different passage in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, passage in enumerate(passages):
            automaton.add_word(passage, i)
        automaton.make_automaton()
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {i for _, i in automaton.iter(text.as_py())} if text.is_valid else ()
                keys += [key] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.int64())], names=["text_key", "n"])

    return run


def _by_automaton(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """``text_key, passage_key`` for few passages (``passage_key, passage``)."""
    listed = passages.collect()  # of bounded size
    if not listed:
        return passages.select(F.lit(0).cast("long").alias("text_key"), "passage_key").limit(0)
    keys = passages.sparkSession.createDataFrame([(i, r["passage_key"]) for i, r in enumerate(listed)], "n long, passage_key long")
    found = texts.select("text_key", "text").mapInArrow(_hits([r["passage"] for r in listed]), "text_key long, n long")
    return found.join(F.broadcast(keys), "n").select("text_key", "passage_key")


def winnowed(rows: DataFrame, words: str, *keep: str) -> DataFrame:
    """``keep``, ``mark``: the different winnowed fingerprints of an array of words; too few words have none."""
    grams = f"transform(sequence(1, size({words}) - {GRAM - 1}), i -> xxhash64({', '.join(f'{words}[i + {j - 1}]' for j in range(GRAM))}))"
    least = f"array_distinct(transform(sequence(1, size(_g) - {WINDOW - 1}), i -> array_min(slice(_g, i, {WINDOW}))))"
    long = rows.where(F.size(words) >= GRAM + WINDOW - 1).withColumn("_g", F.expr(grams))
    return long.select(*keep, F.explode(F.expr(least)).alias("mark"))


def _by_fingerprints(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """``text_key, passage_key`` for passages of many words."""
    inner = passages.withColumn("w", F.split("passage", " ")).withColumn("w", F.slice("w", F.lit(2), F.size("w") - 2))
    # One fingerprint of a passage is enough, as the text keeps all of them: the least is as likely to be rare as any.
    marks = winnowed(inner, "w", "passage_key").groupBy("passage_key").agg(F.min("mark").alias("mark"))
    met = winnowed(texts.withColumn("w", F.split("text", " ")), "w", "text_key").join(marks, "mark").select("text_key", "passage_key").distinct()
    return met.join(passages, "passage_key").join(texts, "text_key").where(F.contains("text", F.col("passage"))).select("text_key", "passage_key")


def find(texts: DataFrame, passages: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """``text_key, passage_key`` of ``texts`` (text_key long, text) and ``passages`` (passage_key long, passage).

    Words of a text are parted by single spaces, as ``functions.text.anchor`` leaves them. Keys number the rows.
    """
    texts = texts.select(F.col("text_key").cast("long").alias("text_key"), "text").where("text <> ''")
    every = passages.select(F.col("passage_key").cast("long").alias("passage_key"), "passage").where("passage <> ''")
    once = written(every.groupBy("passage").agg(F.min("passage_key").alias("passage_key")), "passages")
    chars = once.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    if chars <= most_chars:
        found = _by_automaton(texts, once)
    else:
        many = F.size(F.split("passage", " ")) >= LEAST_WORDS
        found = _by_fingerprints(texts, once.where(many))
        short = placed(once.where(~many).withColumn("size", F.length("passage")), ["passage_key"])
        each = max(1, most_chars // max(1, short.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]))  # passages that surely fit
        for at in range(0, short.count(), each):
            found = found.unionByName(_by_automaton(texts, short.where(F.col("place").between(at + 1, at + each)).select("passage_key", "passage")))
    same = every.join(once.withColumnRenamed("passage_key", "n"), "passage").select("n", "passage_key")
    return found.withColumnRenamed("passage_key", "n").join(same, "n").select("text_key", "passage_key")
