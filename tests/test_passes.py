"""Numbers under shuffles, decisions that fail closed, passes, numbering over ranges, clusters against plain unions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.operators import match, passes, resolve, rules
from sieveworks.operators import signals as S
from sieveworks.operators.graph import components, placed
from sieveworks.plans import config, enrichment
from sieveworks.sources import readers, writers



def named(spark, n):
    rng = random.Random(3)
    words = ["bay", "heart", "foot", "eye", "care", "north", "south", "valley"]
    rows = [(i, " ".join(rng.sample(words, 3)), f"9{i % 7:04}", str(i) if i % 5 == 0 else "") for i in range(n)]
    return spark.createDataFrame(rows, "k long, practice_name string, address_zip string, npi string")


def test_suppression_and_lookup_do_not_depend_on_partitions(spark):
    rows = named(spark, 1500).withColumns({"address_state": F.lit(""), "npi_number": F.col("npi"), "npi_optional": F.lit(""), "providers": F.array().cast("array<struct<name:string,npi:string>>"), "phone": F.lit("")})
    listed = named(spark, 40).select(F.col("k").alias("ordinal"), "npi", F.col("practice_name").alias("name"), F.col("address_zip").alias("zip"), F.lit("").alias("state"))
    want = {r["k"]: (r["customer_suppressed"], r["suppression_reason"]) for r in match.suppression(rows.coalesce(1), listed).collect()}
    assert {r["k"]: (r["customer_suppressed"], r["suppression_reason"]) for r in match.suppression(rows.repartition(8), listed).collect()} == want
    numbers = {str(i) for i in range(0, 40, 5)}
    assert all(want[i][0] for i in range(1500) if i % 5 == 0 and str(i) in numbers)
    snapshot = named(spark, 60).select(F.col("k").cast("string").alias("number"), F.lit("NPI-2").alias("enumeration_type"), F.col("practice_name").alias("organization_name"), F.lit("").alias("telephone_number"), F.col("address_zip").alias("postal_code"), F.array(F.lit("1")).alias("taxonomy_codes"))
    found = lambda df: {r["k"]: (r["npi_number"], r["npi_match_confidence"], r["npi_provider_count"]) for r in match.npi_lookup(df, snapshot).collect()}
    assert found(rows.repartition(8)) == found(rows.coalesce(1))


def test_decisions_fail_closed(spark):
    defs = (S.SignalDef("a", "Alpha", 60),)
    entry = [dict(signal_id="a", signal_state="yes", evidence_text="q", source_url="https://x.com", confidence="high", attribution="")]
    rows = spark.createDataFrame([("1", entry, None), ("2", entry, 95), ("3", None, 95), ("4", [], None)], f"id string, response {S.RESPONSE}, bullseye_score int").withColumn("signals", F.when(F.col("id") != "3", S.cleaned("response", defs)))
    rows = rows.drop("response").withColumns({"enrichment_status": F.lit("complete"), "source_confidence": F.lit("complete")})
    put = enrichment.shaped(rows).withColumn("signals", F.when(F.col("id") != "3", F.col("signals")))
    out = {r["id"]: r for r in rules.decided(put, rules.RunConfig()).collect()}
    assert [out[i]["target_tier"] for i in "1234"] == [K.MANUAL, K.BULLSEYE, K.MANUAL, K.MANUAL]
    assert all(r["exclusion_status"] == "CLEAR" for r in out.values()) and out["1"]["tier_cap_reason"] == ""
    assert {r["record_id"]: r["error"] for r in rules.undecided(put).collect()} == {"1": "no score", "3": "no signals", "4": "no score"}
    excluded = put.withColumn("customer_suppressed", F.lit(True))
    assert {r["target_tier"] for r in rules.decided(excluded, rules.RunConfig()).collect()} == {K.EXCLUDED}
    assert rules.undecided(excluded).count() == 0


def test_earlier_rows_over_spans(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), "x" if rng.random() < 0.6 else str(i % 3)) for i in range(300)]
    last, want = {}, {}
    for i, basis, value in rows:
        want[i] = last.get((basis, value))
        last[basis, value] = i
    frame = spark.createDataFrame(rows, "row_idx long, basis string, value string").repartition(5)
    for span in (7, 1 << 16):
        assert {r["row_idx"]: r["dup"] for r in match.with_earlier(frame, span).collect()} == want


def test_numbers_over_ranges(spark):
    rows = [(i, (i * 37) % 101) for i in range(500)]
    got = placed(spark.createDataFrame(rows, "id long, v long").repartition(7), [F.desc("v"), F.asc("id")]).collect()
    assert {r["id"]: r["place"] for r in got} == {i: n for n, (_, i) in enumerate(sorted((-v, i) for i, v in rows), 1)}
    assert placed(spark.createDataFrame([], "id long"), [F.asc("id")]).count() == 0


def test_components_by_one_task_and_by_rounds(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(260)], "a long, b long")
    one, rounds = ({tuple(r) for r in components(edges, one_task=n).collect()} for n in (10**6, 0))
    assert one == rounds


def test_csv_files_are_numbered_on(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text("Name,Note\n" + "".join(f'r{n}-{i},"two\nlines"\n' for i in range(4)))
    rows = readers.read_csv(spark, str(tmp_path)).collect()
    assert sorted(r["row_idx"] for r in rows) == list(range(12)) and {r["note"] for r in rows} == {"two\nlines"}
    by_file = {}
    for r in sorted(rows, key=lambda r: r["row_idx"]):
        by_file.setdefault(r["name"][:2], []).append(r["name"])
    assert all(names == sorted(names) for names in by_file.values())


def test_versions_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    writers.to_version(spark.range(3), path, 1, 0)
    with pytest.raises(RuntimeError):
        writers.to_version(spark.range(9), path, 1, 0)
    with pytest.raises(RuntimeError):
        writers.to_version(spark.range(9), path, 3, 1)
    assert spark.read.parquet(path).count() == 3


def test_responses_are_repaired(spark):
    one = lambda text: '{"signals": [{"signal_id": "a", "evidence_text": "%s", "source_url": "https://x.com/a?b=c"}], "sales_angle": ["x"]}' % text
    texts = [one("plain"), one('they say "cash only" here'), one("two\nlines\tand tab"), one(r"already \"escaped\""), one("x").replace('"]', '",]'), one("x")[:-1], "no json", None, '{"signals": []}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.parsed_response(F.col("t")).alias("p")).orderBy("i").collect()
    quotes = [r["p"]["signals"][0]["evidence_text"] if r["p"] and r["p"]["signals"] else None for r in rows]
    assert quotes[:5] == ["plain", 'they say "cash only" here', "two lines and tab", 'already "escaped"', "x"]
    assert all(r["p"] is None for r in rows[6:])


def test_redundant_signals_go():
    drafts = [{"signal_label": "Insurance-only billing"}, {"signal_label": "x", "prompt_instruction": "only accepts insurance payers"}, {"signal_label": "Cash pay"}]
    assert config.without_inverse_billing(drafts) == drafts[2:]


def test_a_roster_is_pruned_before_enrichment_only(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    left, counts = passes.pruned_roster(rows, spark.createDataFrame([("2",), ("9",), ("2",)], "id string"), "ingested")
    assert sorted(r["id"] for r in left.collect()) == ["1", "3"] and tuple(counts.first()) == (1, 2)
    with pytest.raises(ValueError):
        passes.pruned_roster(rows, rows, "complete")


def plain_clusters(rows, most_contacts=12):
    """Clusters by going through all pairs of a block, the strongest first; rows are (id, name, street, unit, zip, phone, domain)."""
    by = {}
    for r in rows:
        by.setdefault(("at", r[4], r[2]), []).append(r)
        if r[5] and r[6]:
            by.setdefault(("by", r[5], r[6]), []).append(r)
    pairs = {frozenset((a[0], b[0])): (a, b) for key, block in by.items() if key[0] == "at" or len(block) <= most_contacts for a, b in itertools.combinations(block, 2)}
    sig = {r[0]: "|".join([r[4], r[2].lower().replace(" st", " street"), f"suite {r[3]}" if r[3] else "", r[5], r[6], r[1].lower(), r[0]]) for r in rows}
    edges = []
    for a, b in pairs.values():
        a, b = sorted((a, b), key=lambda r: sig[r[0]])
        same_place = a[2] == b[2] and a[4] == b[4]
        if same_place and a[3] and b[3] and a[3] != b[3]:
            continue
        score = K.ADDRESS_SCORE * same_place + K.UNIT_SCORE * (same_place and a[3] != "" and a[3] == b[3]) + K.PHONE_SCORE * (a[5] != "" and a[5] == b[5])
        score += (K.DOMAIN_SCORE if a[6] == b[6] else K.DOMAIN_CONFLICT_SCORE) * (a[6] != "" and b[6] != "") + K.NAME_SCORE * (a[1] == b[1])
        if score >= K.MERGE_AT:
            edges.append((-score, sig[a[0]], sig[b[0]], a[0], b[0]))
    cluster = {r[0]: {r[0]} for r in rows}
    unit = {r[0]: (r[2], r[4], r[3]) for r in rows}
    for *_, a, b in sorted(edges):
        x, y = cluster[a], cluster[b]
        clash = any(unit[i][:2] == unit[j][:2] and unit[i][2] and unit[j][2] and unit[i][2] != unit[j][2] for i in x for j in y)
        if x is not y and not clash:
            both = x | y
            for i in both:
                cluster[i] = both
    return {tuple(sorted(c)) for c in cluster.values()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_against_plain_unions(spark, seed):
    rng = random.Random(seed)
    names = ["alpha beta", "gamma delta", "zyx wvu tsr"]
    rows = []
    for i in range(160):
        b = rng.randrange(14)
        rows.append((f"{i:03}", rng.choice(names), f"{b} elm st", rng.choice(["", "", "1", "2", "3"]), f"{10000 + b}", rng.choice(["", f"41555500{b:02}", f"41555501{b:02}"]), rng.choice(["", f"d{b}.com", f"e{b}.com"])))
    frame = spark.createDataFrame([(i, n, s, f"Ste {u}" if u else "", z, p, f"https://{d}" if d else "") for i, n, s, u, z, p, d in rows], "id string, practice_name string, address_street string, address_unit string, address_zip string, phone string, website_url string")
    locations, _, _ = resolve.consolidate(frame.repartition(6))
    got = {tuple(r["source_row_ids"]) for r in locations.collect()}
    assert got == plain_clusters(rows)
    assert any(len(c) > 3 for c in got)


def test_fuzzy_names_against_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(4)
    base = ["bay heart clinic", "north valley eye care", "foot and ankle center"]
    rows = []
    for i in range(60):
        name = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            name[rng.randrange(len(name))] = rng.choice("abcxyz")
        rows.append((i, "".join(name), rng.choice(["CA", "NV"])))
    frame = spark.createDataFrame(rows, "row_idx long, practice_name string, address_state string")
    got = {(r["left"], r["right"]): round(r["ratio"], 9) for r in match.fuzzy_names(frame).collect()}
    want = {}
    for (i, a, s), (j, b, t) in itertools.combinations(rows, 2):
        ratio = SequenceMatcher(None, a, b).ratio()
        if s == t and 0.82 <= ratio < 1:
            want[i, j] = round(ratio, 9)
    assert got == want and want
    assert match.fuzzy_names(frame, most_rows=59).count() == 0
