"""The pipeline's near duplicates against brute-force Jaccard similarity."""

import random

import pyarrow.parquet as pq

import corpus_pipeline
from sieveworks.llm import jaccard

SMALL = "/root/testdata/sf0.001"


def plain_sets(texts):
    out = []
    for text in texts:
        words = ("" if text is None else text.translate({c: c + 32 for c in range(65, 91)})).encode().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def plain_components(sets):
    """Components by comparing everything."""
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            both = len(x & y)
            if x == y or 5 * both >= 4 * (len(x) + len(y) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in range(len(sets))}


def test_near_duplicates_against_brute_force_jaccard(spark):
    texts = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"])["text"].to_pylist()
    rng = random.Random(6)
    for base in range(12):  # near copies from similarity 1 to below 0.8
        words = [f"w{base}x{rng.randrange(5000)}" for _ in range(300)]
        for _ in range(8):
            copy = list(words)
            for at in rng.sample(range(300), rng.randint(0, 9)):
                copy[at] = f"changed{rng.random()}"
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "One", "one two", "one two three four five", "One two three four five"] + texts[:5]
    rows = [(i, x, "en", "src0", len(x or "")) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = plain_components(plain_sets(texts))
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(docs).collect()} == want
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SMALL)
    assert stage.columns == docs.columns
    assert sorted(r["doc_id"] for r in stage.collect()) == sorted(set(want.values()))


def test_near_duplicates_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard.components(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "z y x w v")], schema)
    assert sorted(((r["doc_id"] or -1), r["component_id"]) for r in jaccard.components(rows).collect()) == [(-1, 3), (3, 3), (3, 3), (9, 9)]
    assert sorted((r["doc_id"] or -1) for r in jaccard.dedupe(rows).collect()) == [-1, 3, 9]


def test_crowded_buckets_are_dealt_in_parts(spark):
    """Near copies and texts of one template whose buckets no task may take whole: components as by comparing everything."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(200)]
    texts = []
    for _ in range(150):  # a template with bodies of many lengths: alike, just below and far from alike
        at = rng.randrange(200)
        body = [f"b{rng.randrange(10**6)}" for _ in range(rng.choice([2, 10, 25, 40, 60, 120]))]
        texts.append(" ".join(template[:at] + body + template[at:]))
    for base in range(2):
        words = [f"n{base}x{i}" for i in range(250)]
        for _ in range(60):
            copy = list(words)
            for i in rng.sample(range(250), rng.randint(0, 6)):
                copy[i] = f"changed{rng.random()}"
            texts.append(" ".join(copy))
    want = plain_components(plain_sets(texts))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    for most in (300, 2000, 20000, jaccard.MOST):
        assert {r["doc_id"]: r["component_id"] for r in jaccard.components(docs, most=most).collect()} == want, most
