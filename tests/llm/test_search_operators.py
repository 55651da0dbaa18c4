"""Near duplicates, URL rules, neighbours, mixing and the quality classifier against plain Python versions."""

import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from sieveworks.llm import mixing, neighbours, quality, simhash, urls

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = ("" if text is None else text.translate({c: c + 32 for c in range(65, 91)})).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Components by comparing everything."""
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_covering_masks_lose_no_pair():
    rng = random.Random(4)
    for step in (1, 3):
        family = [m & (1 << 64) - 1 for m in simhash.masks(4, step)]
        assert len(family) == 31
        for _ in range(3000):
            bits = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not bits & m for m in family)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_simhash_components_against_all_pairs(spark, bucket):
    texts = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"])["text"].to_pylist()
    rng = random.Random(6)
    long = texts[0].split(" ")
    for _ in range(60):
        words = list(long)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "  ", "One", "one two", "one two three", "One two three four"] + texts[:5]
    docs = spark.createDataFrame([(i, x, "e") for i, x in enumerate(texts)], "doc_id long, text string, extra string")
    got = simhash.components(docs, bucket=bucket).collect()
    fps = {i: plain_fingerprint(x) for i, x in enumerate(texts)}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    want = plain_components(fps)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    if bucket == simhash.BUCKET:
        kept = simhash.dedupe(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in simhash.roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}


def test_simhash_odd_tables(spark):
    schema = "doc_id long, text string"
    assert simhash.components(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "z y x w v")], schema)
    assert sorted(((r["doc_id"] or -1), r["component_id"]) for r in simhash.components(rows).collect()) == [(-1, 3), (3, 3), (3, 3), (9, 9)]
    assert sorted((r["doc_id"] or -1) for r in simhash.dedupe(rows).collect()) == [-1, 3, 9]


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_url_rules_against_every_rule(spark, partitions):
    rng = random.Random(8)
    labels, paths = ["a", "b", "com", "org", "x-y"], ["/", "/a", "/a/", "/a/b", "/b"]
    rules = [(".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(60)] + [("", "/", "block")]
    urls_ = ["http://" + ".".join(rng.choices([*labels, "A"], k=rng.randint(1, 4))) + rng.choice(["", *paths]) + rng.choice(["", "?q", "#f", "c"]) for _ in range(600)]
    urls_ += [None, "", "no scheme", "://", "http://", "http:///a", "HTTP://A.com:80/a", "x://u://org/a", "http://org?://a", "http://org\n.com/a\nb"] + ["http://a.com/a/b"] * 300
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls_)], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rules = [r for r in rules if r[0]]
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(urls_)}
    assert urls.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:200] = x[100] + 0.0001 * rng.normal(size=(100, 16)).astype(np.float32)
    x[200:230] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (920, []), (940, [0.0] * 16), (960, [float("nan")] * 16), (980, [None] + [1.0] * 15), (None, [1.0] * 16), (1000, [float("inf")] + [0.0] * 15), (1020, [1.0, 2.0]), (1021, [2.0, 1.0]), (0, x[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.search(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 400, 20), 1020}
    assert got[1020] == [(1, 1021, 4.0)]
    # Row 400 repeats row 0: either is a candidate for the other, and both are queries.
    y, ids = np.concatenate([x, x[:1]]).astype(np.float64), [*range(400), 0]
    want = defaultdict(list)
    for q in [*range(0, 400, 20), 400]:
        score = neighbours.exact(np.repeat(y[q : q + 1], 401, axis=0), y)
        order = [i for i in sorted(range(401), key=lambda i: (-score[i], ids[i], i)) if i != q][:20]
        want[ids[q]] += [(n, ids[i], score[i]) for n, i in enumerate(order, 1)]
    for q, rows_ in want.items():
        assert sorted(got[q]) == sorted(rows_)
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pfair_deviates_by_less_than_a_block():
    weights = {"a": 7, "b": 1, "c": 3, "d": 2}
    order = list(mixing.period(weights))
    total = sum(weights.values())
    for t in range(1, total + 1):
        for s, w in weights.items():
            assert abs(order[:t].count(s) - w * t / total) < 1
    spans = mixing.schedule(weights, {"a": 20, "b": 9, "c": 1, "d": 30})
    slots = sorted(x.slot(b) for x in spans for b in range(x.first, x.end))
    assert slots == list(range(60))


def test_mixing_places_every_row(spark):
    rows = [(i, "s%d" % (0 if i % 3 else i % 7), "t") for i in range(700)] + [(None, None, "x"), (None, "s1", "y"), (5, "s1", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.plan(docs, {"s0": 3, "s1": 2, "s2": 1}).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    place = {(r["slot"], r["source"] if r["source"] in ("s0", "s1", "s2") else "") for r in got}
    assert len(place) == len({s for s, _ in place})  # a slot has one source
    by_slot = dict(place)
    gone = min(max(t for t, s in by_slot.items() if s == name) for name in set(by_slot.values()))
    for t in range(1, gone + 1):  # until the first source has no more blocks
        assert abs([by_slot[s] for s in range(t)].count("s0") - 3 * t / 7) < 1
    laid = mixing.arrange(docs, {"s0": 3, "s1": 2, "s2": 1})
    assert laid.columns == docs.columns
    order = sorted(got, key=lambda r: r["position"])
    assert [r["source"] for r in laid.collect()] == [r["source"] for r in order]
    assert mixing.plan(docs.limit(0), {"s0": 3}).count() == 0
    with pytest.raises(ValueError):
        mixing.plan(docs.withColumn("slot", F.lit(1)), {"s0": 1})


def test_quality_model_is_a_distribution_and_matches_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(docs, labels)
    en = model.languages["en"]
    p = np.exp2(-en.bits().astype(float)).reshape(-1, quality.SYMBOLS).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-3)
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    texts = [r["text"] for r in docs.where("lang = 'en'").collect() if r["doc_id"] in good]
    grams, _ = quality.grams(texts)
    kinds, n = np.unique(grams, return_counts=True)
    # Plain modified Kneser-Ney at the highest order.
    d = quality.discounts(*[(n == i).sum() for i in range(1, 5)])
    context = kinds // quality.SYMBOLS
    total = np.bincount(context, n, quality.SYMBOLS**3)
    share = (n - np.array(d)[np.minimum(n, 3) - 1]) / total[context]
    got_gram, got_share = en.shares[-1]
    order = np.argsort(got_gram)
    assert (got_gram[order] == kinds).all() and np.allclose(got_share[order], share)
    # Lower orders count distinct predecessors.
    assert sorted(en.shares[2][0].tolist()) == sorted(set((kinds % quality.SYMBOLS**3).tolist()))


def test_quality_separates_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = quality.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("toxic = 0").collect()
    good, junk = ([r["kept"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.4 * len(junk)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, None, "en"), (3, "", None), (4, "x", "xx"), (None, "日本", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == 5 and got[2]["kept"] and got[3]["kept"] and got[4]["bits"] is None and got[4]["kept"]
    nothing = quality.fit(docs, labels.limit(0))
    assert all(r["kept"] for r in quality.classify(docs, nothing).collect())
