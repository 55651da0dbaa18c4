"""Clusters under a veto: rounds against the loop over edges."""

import random

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import clusters, resolve


def by_rounds(spark, edges, keys, one_task=0):
    frame = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "a long, b long, rank long").repartition(5)
    held = spark.createDataFrame([(n, s, z, u) for n, own in keys.items() for s, z, u in own], "node long, street string, zip string, unit string")
    groups = {}
    for r in clusters.constrained(frame, held, one_task).collect():
        groups.setdefault(r["cluster"], []).append(r["node"])
    return {tuple(sorted(g)) for g in groups.values()}


def by_loop(edges, keys):
    units = {}
    for n, own in keys.items():
        for s, z, u in own:
            units.setdefault(n, {}).setdefault(s, set()).add((z, u))
    groups = {}
    for n, c in clusters.sequential(edges, units).items():
        groups.setdefault(c, []).append(n)
    return {tuple(sorted(g)) for g in groups.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_against_the_loop(spark, seed):
    rng = random.Random(seed)
    edges, keys = [], {}
    for block in range(14):
        nodes = [block * 100 + i for i in range(rng.randint(3, 24))]
        streets = [f"s{block}", f"t{block}"]
        for n in nodes:
            if rng.random() < 0.6:
                keys[n] = [(rng.choice(streets), rng.choice(["", "1", "2"]), rng.choice("ABC")) for _ in range(rng.randint(1, 2)) if rng.random() < 0.8]
                keys[n] = keys[n][:1]
        edges += [tuple(rng.sample(nodes, 2)) for _ in range(len(nodes) * 2)]
    rng.shuffle(edges)
    want = by_loop(edges, keys)
    assert by_rounds(spark, edges, keys) == want
    assert any(len(g) > 3 for g in want) and len(want) > 20


def test_rest_goes_through_one_task(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MOST_ROUNDS", 0)
    edges = [(i, i + 1) for i in range(40)]
    keys = {i: [("s", "", "AB"[i // 7 % 2])] for i in range(0, 41, 3)}
    assert by_rounds(spark, edges, keys, one_task=100) == by_loop(edges, keys)


def test_a_star_of_unit_free_rows_takes_few_rounds(spark):
    """40,000 edges at two hubs of one building: the loop's result, in a handful of rounds."""
    n = 20_000
    edges = spark.range(n).select((F.col("id") + 10).alias("a"), F.lit(0).cast("long").alias("b"), (F.col("id") * 2 + 1).alias("rank"))
    edges = edges.union(spark.range(n).select((F.col("id") + 10).alias("a"), F.lit(1).cast("long").alias("b"), ((n - F.col("id")) * 2).alias("rank")))
    keys = spark.createDataFrame([(0, "s", "", "1"), (1, "s", "", "2")], "node long, street string, zip string, unit string")
    sizes = {r["cluster"]: r["count"] for r in clusters.constrained(edges, keys, 0).groupBy("cluster").count().collect()}
    assert sorted(sizes.values()) == [10_000, 10_002] or sorted(sizes.values()) == [10_001, 10_001]


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_locations_do_not_depend_on_the_way(spark, one_task):
    from test_passes import plain_clusters

    rng = random.Random(11)
    rows = [(f"{i:03}", rng.choice(["alpha beta", "zyx wvu tsr"]), f"{b} elm st", rng.choice(["", "", "1", "2", "3"]), f"{10000 + b}", f"41555500{b:02}", rng.choice(["", f"d{b}.com"])) for i in range(90) for b in [rng.randrange(5)]]
    frame = spark.createDataFrame([(i, n, s, f"Ste {u}" if u else "", z, p, f"https://{d}" if d else "") for i, n, s, u, z, p, d in rows], "id string, practice_name string, address_street string, address_unit string, address_zip string, phone string, website_url string")
    identified = resolve.written(resolve.identified(resolve.conformed(frame)).withColumn("row", F.monotonically_increasing_id()), "t")
    pairs = resolve.written(resolve.scored(resolve.candidates(identified, []), []), "t")
    members, marked = resolve.clustered(identified, pairs, one_task)
    got = {tuple(sorted(r["ids"])) for r in members.groupBy("cluster").agg(F.collect_list("id").alias("ids")).collect()}
    assert got == plain_clusters(rows)
    assert marked.where("applied").count() > 0 and marked.where("score >= 7 and not applied").count() >= 0
