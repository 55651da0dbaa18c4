"""SimHash in the pipeline's near duplicates: pairs within its radius are candidates, whatever their minima."""

import random

import corpus_pipeline
from sieveworks.llm import jaccard, simhash


def pair(k):
    """Two texts of 45 shingles, 40 of them in common."""
    rng = random.Random(305)
    words = [f"w{rng.randrange(10**6)}" for _ in range(49)]
    return " ".join(words), " ".join([*words[:26], f"c{k}", *words[27:]])


def test_pairs_within_the_radius_always_share_a_key():
    rng = random.Random(5)
    for n in (1, 6, 300):
        x = jaccard.shingle_set(" ".join(f"w{rng.random()}" for _ in range(n + 4)).encode())
        fingerprint = simhash.majority(x)
        assert len(jaccard.cover(x)) == 31 and fingerprint in range(-(1 << 63), 1 << 63)
    assert len(jaccard.cover(jaccard.shingle_set(b""))) == 0
    for k in (25, 542, 1589, 1769, 1902):
        x, y = (jaccard.shingle_set(t.encode()) for t in pair(k))
        assert bin((simhash.majority(x) ^ simhash.majority(y)) & (1 << 64) - 1).count("1") <= simhash.RADIUS and jaccard.alike(x, y)
        for masks in (jaccard._MASKS, jaccard._FINE_MASKS):
            assert set(jaccard.cover(x, masks).tolist()) & set(jaccard.cover(y, masks).tolist())


def test_pairs_without_a_common_band_are_linked(spark):
    texts = [t for k in (25, 1902) for t in pair(k)[1:]]
    x = pair(0)[0]
    mine = set(jaccard.bands(jaccard.shingle_set(x.encode())).tolist())
    assert not any(mine & set(jaccard.bands(jaccard.shingle_set(t.encode())).tolist()) for t in texts)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for i, t in enumerate(texts):
        docs = spark.createDataFrame([(10 + i, t, "en", "src0", len(t)), (1, x, "en", "src0", len(x)), (99, "a b c d e f", "en", "src0", 11)], schema)
        for most in (30, jaccard.MOST):
            assert {r["doc_id"]: r["component_id"] for r in jaccard.components(docs, most=most).collect()} == {1: 1, 10 + i: 1, 99: 99}
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()) == [1, 99]
