"""What grows with the square of a set, or is sent to all tasks, is refused beyond a stated size."""

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import evidence, resolve


def test_long_paste_is_an_error(spark):
    records = spark.createDataFrame([("a", ""), ("b", None)], "id string, context_text string")
    pasted = spark.createDataFrame([(2, "two"), (1, "one"), (3, None)], "position int, text string")
    assert {(r["id"], r["context_text"], r["source_confidence"]) for r in evidence.with_manual_content(records, pasted).collect()} == {(x, "one\n\n---\n\ntwo", "partial") for x in "ab"}
    with pytest.raises(ValueError, match="pasted"):
        evidence.with_manual_content(records, pasted, most=5)
    none = spark.createDataFrame([], "position int, text string")
    assert evidence.with_manual_content(records, none).count() == 2


def test_explaining_many_pairs_is_an_error(spark):
    rows = spark.createDataFrame([(str(i), "Bay Clinic", f"{i // 2} Oak St", "10001") for i in range(6)], "id string, practice_name string, address_street string, address_zip string")
    ident = resolve.identified(resolve.conformed(rows)).withColumn("row", F.col("id").cast("long"))
    noise, umbrella = resolve.domain_policy()
    shared = sorted({*noise, *umbrella})
    told = resolve.explained(ident, noise, shared, most=6).collect()
    assert len(told) == 15 and sum(r["verdict"] == "merge" for r in told) == 3
    with pytest.raises(ValueError, match="explained"):
        resolve.explained(ident, noise, shared, most=5)
