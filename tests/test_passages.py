"""All passages against all texts, by plain Python."""

import random

import pyarrow.parquet as pq
import pytest

from sieveworks import queries
from sieveworks.operators import passages

SMALL = "/root/testdata/sf0.01"


def test_every_passage_meets_every_text(spark):
    read = lambda name, key: pq.read_table(f"{SMALL}/{name}.parquet", columns=[key, "text"]).to_pydict()
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    texts, quotes = ([" ".join((x or "").lower().split()) for x in t["text"]] for t in (docs, items))
    want = {(d, i) for d, t in zip(docs["doc_id"], texts, strict=True) for i, q in zip(items["item_id"], quotes, strict=True) if q and q in t}
    got = [tuple(r) for r in queries.QUERIES["passage_audit"](spark, SMALL).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(i != d % 40 for d, i in want)  # pairs that anchor_audit does not look at
    print(len(want), sum(i == d % 40 for d, i in want))


@pytest.mark.parametrize("most_chars", [passages.MOST_CHARS, 40])
def test_passages_against_all_pairs(spark, most_chars):
    rng = random.Random(most_chars)
    words = ["a", "bb", "ccc", "dd", "e", "é", "x\u2003y"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(120)] + [None, "", "a" * 50_000]
    quotes = [t[i : i + rng.randint(1, 60)].strip() for t in texts[:100] if t and (i := rng.randint(0, len(t) - 1)) >= 0]
    quotes += [None, "", "a", "bb ccc", quotes[0], "not there", " ".join(["dd"] * 12), "zz " * 20 + "z"]
    one = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "text_key long, text string, passage string").repartition(5)
    two = spark.createDataFrame(list(enumerate(quotes)), "passage_key long, passage string")
    want = {(i, j) for i, t in enumerate(texts) for j, q in enumerate(quotes) if t and q and q in t}
    got = [tuple(r) for r in passages.find(one, two, most_chars).collect()]
    assert len(got) == len(want) and set(got) == want
    assert passages.find(one, two.limit(0)).count() == 0 and passages.find(one.limit(0), two, most_chars).count() == 0


def test_no_nested_loop_joins(spark):
    plan = queries.QUERIES["passage_audit"](spark, SMALL)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
