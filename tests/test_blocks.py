"""Crowded addresses: pairs by what may join them give the locations and reviews of all pairs."""

import random
import time

from pyspark.sql import functions as F

from sieveworks.operators import resolve

SCHEMA = "id string, practice_name string, address_street string, address_unit string, address_zip string, phone string, website_url string"


def rows_of(rng, n, buildings):
    base = ["bay heart clinic", "north valley eye care", "smith jones md"]
    out = []
    for i in range(n):
        name = list(rng.choice(base))
        for _ in range(rng.choice([1, 2, 9, 9, 9])):
            name[rng.randrange(len(name))] = rng.choice("abcdefghijklmnopqrstuvwxyz ")
        b = rng.randrange(buildings)
        domain = rng.choice(["", f"d{rng.randrange(40)}.com", "facebook.com"])
        out.append((f"{i:03}", "".join(name), f"{b} elm st", rng.choice(["", "", "", f"Ste {rng.randrange(30)}"]), f"{10000 + b}", "" if rng.random() < 0.1 else f"41555501{rng.randrange(90) + 10}", f"https://{domain}" if domain else ""))
    return out


def test_locations_and_reviews_are_those_of_all_pairs(spark):
    frame = spark.createDataFrame(rows_of(random.Random(9), 130, 3), SCHEMA).repartition(3)

    def result(large):
        locations, asked, _ = resolve.consolidate(frame, large=large)
        return (
            {tuple(r["source_row_ids"]) for r in locations.select("source_row_ids").collect()},
            {(r["x"], r["y"], r["score"], r["review_reason"]) for r in asked.select(F.least("left_id", "right_id").alias("x"), F.greatest("left_id", "right_id").alias("y"), "score", "review_reason").collect()},
        )

    all_pairs, few = result(10**6), result(2)
    assert few == all_pairs
    assert len(few[0]) > 20 and len(few[1]) > 20 and any(len(c) > 2 for c in few[0])


def test_names_that_may_be_alike_are_all_met(spark):
    from difflib import SequenceMatcher

    rng = random.Random(2)
    names = [n.lower() for _, n, *_ in rows_of(rng, 60, 1)]
    for n in names[:40]:
        m = list(n)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(m) + 1)
            m[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        names.append("".join(m))
    names += ["a", "a", "ab", "ab", "abc", "abd", "abcd", "abcde", "abxde", "abcdef", "zabcdef", "x" * 22, "x" * 27]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names) if n], "row long, name string").select("row", F.lit("z").alias("k1"), F.lit("s").alias("k2"), F.struct("name").alias("ident"), F.lpad(F.col("row").cast("string"), 4, "0").alias("signature"))
    got = {(r["a"]["row"], r["b"]["row"]) for r in resolve._alike(frame).collect()}
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if names[i] and names[j] and SequenceMatcher(None, names[i], names[j]).ratio() >= 0.85}
    assert want <= got and len(want) > 30


def test_a_crowded_building_of_strangers_finishes(spark):
    """6,000 rows of one address, each with a phone, a domain and a name of its own: 18 million pairs share the address alone."""
    k = F.col("id").cast("string")
    rows = spark.range(6_000).select(
        k.alias("id"), F.substring(F.translate(F.sha2(k, 256), "0123456789", "ghijklmnop"), 1, 24).alias("practice_name"), F.lit("1 Tower Plaza").alias("address_street"), F.lit("").alias("address_unit"),
        F.lit("94110").alias("address_zip"), (F.col("id") + 4150000000).cast("string").alias("phone"), F.concat(F.lit("https://s"), k, F.lit(".com")).alias("website_url"),
    )
    rows = resolve.written(resolve.identified(resolve.conformed(rows)).withColumn("row", F.monotonically_increasing_id()), "t")
    began = time.time()
    assert resolve.candidates(rows, []).count() < 1000
    assert time.time() - began < 150
