"""A training corpus from ``documents`` in five stages; each works on all that the one before it kept.

Every stage's result is written as Parquet and read again, so a later stage never repeats an earlier one. All stages but the
last return the columns of ``documents``; the third keeps the least id of each group of near duplicates, the fourth lays rows
out in the order of the mix, over the files and in each; the last numbers them in that order.

Cases: an empty table goes through all stages and gives no rows; without labels no text is judged and all are kept; null and
empty texts are kept by the first stage, have no shingles and so are one group, of which the third keeps the least id, and have
no tokens; rows with a null id are kept by all stages; of equal rows the third keeps one; extra columns are passed through by
all stages but the last, and a name that an operator uses itself is an error.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import bpe, jaccard, lines, mixing, quality
from sieveworks.llm.common import materialize, table
from sieveworks.llm.queries import VOCABULARY, WEIGHTS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps; texts in a language without trusted text, null and empty ones are kept."""
    judged = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.where("kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; n_chars follows the text. No row goes: a text may become empty."""
    return lines.dedupe(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash and MinHash over five-word shingles, Jaccard similarity 0.8; rows with a null id stay."""
    return jaccard.dedupe(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; unknown and null sources share one weight."""
    return mixing.arrange(docs, WEIGHTS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``position, doc_id, lang, source, n_tokens, token_ids, decoded_sha256``: ids, and the digest of the text that they decode to.

    Reading files again loses the order of rows. The mix is a function of ids, sources and weights, so it is laid out again here;
    rows come in its order and carry their place in it.
    """
    path = public_tokenizers.path(VOCABULARY)
    placed = mixing.arrange(docs, WEIGHTS, numbered=True)
    done = bpe.encode(placed, path, public_tokenizers.PATTERN, keep=("position", "doc_id", "lang", "source"), decoded=True)
    return done.select("position", "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Fingerprints use a hash that DuckDB lacks: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
