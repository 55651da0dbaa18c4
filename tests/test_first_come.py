"""Rows that take keys in order: rounds against the loop, for uploads and for the registry."""

import random

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import graph, match, registry


def loop(rows):
    """``key: owner`` by going through the rows."""
    owner = {}
    for row, keys in sorted(rows.items()):
        if keys and not any(k in owner for k in keys):
            owner.update(dict.fromkeys(keys, row))
    return owner


def settled(spark, rows, one_task):
    frame = spark.createDataFrame([(r, k) for r, own in rows.items() for k in own] + [(10**6, None)], "row long, key string").repartition(6)
    got = graph.first_come(frame, one_task).collect()
    assert len(got) == len({r["key"] for r in got})
    return {r["key"]: r["owner"] for r in got}


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_rounds_against_the_loop(spark, one_task):
    rng = random.Random(one_task + 1)
    rows = {i: {f"u{rng.randrange(150)}", f"n{rng.randrange(120)}"} for i in range(300)}
    rows |= {1000 + i: {"hot", f"h{i % 40}"} for i in range(200)}  # a key that a third wants
    rows |= {2000 + i: {f"c{i}", f"c{i + 1}"} for i in range(9)}  # a chain
    rows |= {3000: {"alone"}, 3001: {"a", "b", "c"}}
    assert settled(spark, rows, one_task) == loop(rows)


def test_rows_that_wait_long_go_through_one_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 2)
    rows = {i: {f"c{i}", f"c{i + 1}"} for i in range(60)}
    rows |= {100 + i: {"hot"} for i in range(30)}
    assert settled(spark, rows, 70) == loop(rows)


def test_upload_duplicates_by_rounds(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["", f"https://a{rng.randrange(60)}.com/"]), rng.choice(["", f"Clinic {rng.randrange(50)}"]), rng.choice(["CA", "ca ", ""])) for i in range(260)]
    frame = spark.createDataFrame(rows, "row_idx long, website_url string, practice_name string, address_state string").repartition(5)
    urls, named, want = {}, {}, set()
    for i, url, name, state in rows:
        url, key = url.rstrip("/"), (name.lower(), state.strip().upper())
        if url and url in urls:
            want.add((i, urls[url], "url"))
        elif all(key) and key in named:
            want.add((i, named[key], "name_state"))
        else:
            urls |= {url: i} if url else {}
            named |= {key: i} if all(key) else {}
    for one_task in (0, 10**6):
        assert {(r["row_idx"], r["first_row"], r["basis"]) for r in match.upload_duplicates(frame, one_task).collect()} == want
    assert {b for *_, b in want} == {"url", "name_state"}


def test_upsert_by_rounds(spark):
    rng = random.Random(6)
    site = lambda: rng.choice(["", f"https://s{rng.randrange(40)}.com"])
    rows = [(i, f"r{i}", f"Clinic {rng.randrange(30)}", site(), rng.choice(["", f"415555{1000 + rng.randrange(30)}"]), "", "", "CA", "94110", "", "", "", "complete", "CLEAR", "") for i in range(150)]
    records = spark.createDataFrame(rows, "ordinal long, id string, practice_name string, website_url string, phone string, google_place_id string, address_city string, address_state string, address_zip string, specialty string, npi_optional string, npi string, enrichment_status string, exclusion_status string, target_tier string")
    empty, _ = registry.upsert(records.limit(0), _entries(spark), "r0", "t0")
    old, _ = registry.upsert(records.where("ordinal < 20"), empty, "r1", "t1")
    by = [registry.upsert(records.where("ordinal >= 20").repartition(n), old, "r2", "t2", one_task=k) for n, k in ((1, 10**6), (7, 0))]
    logs = [{r["record_id"]: (r["outcome"], r["entry_id"]) for r in log.collect()} for _, log in by]
    assert logs[0] == logs[1] and {o for o, _ in logs[0].values()} >= {"inserted", "updated", "needs_manual_merge"}
    # The loop over records, with the keys that they have.
    keys = {}
    fields = records.where("ordinal >= 20").withColumns(match.fields_from_record()).withColumn("row_idx", F.col("ordinal"))
    for r in match.exploded_keys(fields, "row_idx").collect():
        keys.setdefault(r["row_idx"], []).append((r["basis"], r["value"]))
    index = {(r["basis"], r["value"]): r["entry_id"] for r in match.registry_index(old).collect()}
    rejected = {r["record_id"] for r in by[0][1].where("outcome = 'rejected'").collect()}
    made, want = {}, {}
    for row in sorted(keys):
        if f"r{row}" in rejected:
            continue
        found = {made.get(k) or index.get(k) for k in keys[row]} - {None}
        want[f"r{row}"] = "needs_manual_merge" if len(found) > 1 else "updated" if found else "inserted"
        if not found:
            made |= dict.fromkeys(keys[row], f"new {row}")
    assert {k: o for k, (o, _) in logs[0].items() if o != "rejected"} == want


def _entries(spark):
    names = ", ".join(f"{f} string" for f in dict.fromkeys(registry.ENTRY))
    return spark.createDataFrame([], f"{names}, change_history {registry.HISTORY}, ordinal long")


@pytest.mark.parametrize("hot", [7, 10**6])
def test_numbers_inside_keys(spark, hot):
    rng = random.Random(hot)
    rows = [(i, rng.choice(["one", "one", "one", "two", f"k{rng.randrange(40)}"]), rng.randrange(50)) for i in range(600)]
    got = graph.numbered(spark.createDataFrame(rows, "id long, key string, v int").repartition(9), "key", ["v", F.desc("id")], "n", hot)
    assert got.columns == ["id", "key", "v", "n"]
    want, seen = {}, {}
    for i, k, _ in sorted(rows, key=lambda r: (r[1], r[2], -r[0])):
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert {r["id"]: r["n"] for r in got.collect()} == want
