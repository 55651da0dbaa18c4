"""Suppression and number lookup against all pairs: states, ZIPs, providers, both own numbers, common words, wide names."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import match, overlap

WORDS = ["bay", "heart", "foot", "eye", "north", "south", "valley", "oak", "river", "hill", "stone", "lake", "pine", "west", "east", "sun", "moon", "star", "bell", "fox"]


def sets(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, place string, words array<string>")


def made(rng, n, most, places=3):
    rows = [(i, rng.choice(["a", "b", "c"][:places]), rng.sample(WORDS, rng.randint(0, most))) for i in range(n)]
    return rows + [(n, "", ["bay", "heart", "foot"]), (n + 1, None, ["bay", "heart", "foot"]), (n + 2, "a", None)]


@pytest.mark.parametrize("needed", [1, 2, 3])
@pytest.mark.parametrize("widest", [24, 4])
def test_first_sharing_against_all_pairs(spark, needed, widest):
    rng = random.Random(needed * widest)
    mine, listed = made(rng, 150, 9), made(rng, 120, 9)
    shares = lambda a, b: a[1] == b[1] and bool(a[1]) and len(set(a[2] or ()) & set(b[2] or ())) >= needed
    want = {a[0]: min(b[0] for b in listed if shares(a, b)) for a in mine if any(shares(a, b) for b in listed)}
    got = overlap.first_sharing(sets(spark, mine, "row").repartition(7), sets(spark, listed, "ordinal"), needed, widest).collect()
    assert len(got) == len(want) and {r["row"]: r["ordinal"] for r in got} == want


@pytest.mark.parametrize("widest", [7, 3])
def test_count_sharing_against_all_pairs(spark, widest):
    rng = random.Random(widest)
    mine, listed = made(rng, 120, 9), made(rng, 200, 8)
    want = {a[0]: n for a in mine if a[1] and a[2] and (n := sum(a[1] == b[1] and bool(set(a[2]) & set(b[2] or ())) for b in listed))}
    got = overlap.count_sharing(sets(spark, mine, "row"), sets(spark, listed, "ordinal"), widest).collect()
    assert len(got) == len(want) and {r["row"]: r["n"] for r in got} == want


def test_combinations(spark):
    one = spark.range(1).select(*[F.expr(overlap.combinations("array('a', 'b', 'c', 'd')", n)).alias(f"c{n}") for n in (1, 2, 3, 4)], F.expr(overlap.combinations("array('a')", 2)).alias("none")).first()
    assert one["c1"] == ["a", "b", "c", "d"] and one["c2"] == ["a b", "a c", "a d", "b c", "b d", "c d"] and one["c3"] == ["a b c", "a b d", "a c d", "b c d"]
    assert one["c4"] == ["a b c d"] and one["none"] == []


def plain_suppression(row, listed):
    npis = {c["npi"].strip() for c in listed if c["npi"].strip()}
    for npi in (row["npi_number"], row["npi_optional"]):
        if npi.strip() in npis:
            return f"Existing customer — NPI match: {npi.strip()}"
    for name, npi in row["providers"] or ():
        if npi.strip() in npis:
            return "Existing customer — provider at this location is a current customer: " + (f"{name} (NPI {npi})" if name else f"NPI {npi}")
    own = set(row["practice_name"].split())
    for place, field, least, label in (("address_zip", "zip", 2, "ZIP"), ("address_state", "state", 3, "state")):
        for c in sorted(listed, key=lambda c: c["ordinal"]):
            if row[place] and row[place] == c[field] and len(own & set(c["name"].split())) >= least:
                return f"Existing customer — name+{label} match: {c['name']}"
    return ""


def test_suppression_against_all_pairs(spark):
    rng = random.Random(5)
    name = lambda k: " ".join(rng.sample(WORDS, k))
    rows = [
        dict(id=i, practice_name=name(rng.randint(1, 6)), address_zip=rng.choice(["", "94110", "10001"]), address_state=rng.choice(["", "CA", "NY"]), npi_number=rng.choice(["", str(rng.randint(1, 60))]), npi_optional=rng.choice(["", str(rng.randint(1, 60))]),
             providers=rng.choice([None, [], [(rng.choice(["Ann", ""]), str(rng.randint(1, 90))), ("Bob", str(rng.randint(1, 90)))]]))
        for i in range(300)
    ]
    listed = [dict(ordinal=i, npi=rng.choice(["", " ", str(rng.randint(1, 60))]), name=name(rng.randint(1, 6)), zip=rng.choice(["", "94110", "10001"]), state=rng.choice(["", "CA", "NY"])) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, practice_name string, address_zip string, address_state string, npi_number string, npi_optional string, providers array<struct<name:string,npi:string>>")
    customers = spark.createDataFrame(listed, "ordinal long, npi string, name string, zip string, state string")
    want = {r["id"]: plain_suppression(r, listed) for r in rows}
    for parts in (1, 9):
        got = match.suppression(frame.repartition(parts), customers.repartition(parts)).collect()
        assert {r["id"]: r["suppression_reason"] for r in got} == want and all(r["customer_suppressed"] == bool(r["suppression_reason"]) for r in got)
    assert len({w.split(":")[0] for w in want.values()}) == 5


def plain_lookup(row, snapshot):
    words = set(row["practice_name"].split())
    near, agreed = 0, []
    for number, kind, called, tel, zip_, _ in snapshot:
        theirs = set(called.split())
        phone = bool(row["phone"]) and row["phone"] == tel
        if zip_ != row["address_zip"] or not (words & theirs or phone):
            continue
        near += 1
        if phone or (words and theirs and len(words & theirs) >= (1 if min(len(words), len(theirs)) <= 1 else 2)):
            agreed.append((kind != "NPI-2", number))
    return (min(agreed)[1], "confident", near) if agreed else (None, "ambiguous" if near else "none", None)


def test_lookup_against_all_pairs(spark):
    rng = random.Random(8)
    name = lambda low, high: " ".join(rng.sample(WORDS, rng.randint(low, high)))
    phone = lambda: rng.choice(["", "", f"415555{rng.randint(1000, 1030)}"])
    rows = [dict(id=i, practice_name=name(1, 9), address_zip=rng.choice(["94110", "10001"]), phone=phone(), npi_optional="") for i in range(200)]
    snapshot = [(f"{i:05}", rng.choice(["NPI-1", "NPI-2"]), name(0, 9), phone(), rng.choice(["94110", "10001"]), ["t"]) for i in range(60)]
    got = match.npi_lookup(spark.createDataFrame(rows, "id long, practice_name string, address_zip string, phone string, npi_optional string"), spark.createDataFrame(snapshot, match.SNAPSHOT)).collect()
    assert {r["id"]: (r["npi_number"], r["npi_match_confidence"], r["npi_provider_count"]) for r in got} == {r["id"]: plain_lookup(r, snapshot) for r in rows}


def test_names_of_common_words_are_never_paired(spark):
    """20,000 rows a side of ten words out of twenty in one state: 400 million pairs would share words."""
    word = F.array(*[F.lit(w) for w in WORDS])
    frame = spark.range(20_000).select(F.col("id").alias("row"), F.lit("CA").alias("place"), F.slice(F.array_sort(F.transform(word, lambda w: F.struct(F.xxhash64(w, "id").alias("h"), w.alias("w")))), 1, 10)["w"].alias("words"))
    began = time.time()
    found = overlap.first_sharing(frame, frame.withColumnRenamed("row", "ordinal"), 3)
    assert found.agg(F.count("*")).first()[0] == 20_000
    assert time.time() - began < 120
