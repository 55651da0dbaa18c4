"""Signals, rules, resolution, matching, registry, overlays and metrics on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.operators import evidence, match, metrics, overlay, registry, resolve, rules, views
from sieveworks.operators import signals as S
from sieveworks.operators.graph import components
from sieveworks.plans import config, enrichment
from sieveworks.sources import readers, writers

DEFS = (
    S.SignalDef("a", "Alpha", 60, required_for_bullseye=True),
    S.SignalDef("b", "Beta", 40, reinforces="c", not_found_weight=-10),
    S.SignalDef("c", "Gamma", 50, verification_required=True),
    S.SignalDef("n", "Friction", -30, exclude_if_yes=True, inhibited_by="b"),
)
URL = "https://x.com"


def responded(spark, *responses):
    rows = [(str(i), [dict(dict(evidence_text="quote", source_url=URL, confidence="high", attribution=""), **r) for r in one]) for i, one in enumerate(responses)]
    frame = spark.createDataFrame(rows, f"id string, response {S.RESPONSE}")
    return frame.withColumn("signals", S.cleaned("response", DEFS)).orderBy("id")


def says(**states):
    return [dict(signal_id=k, signal_state=v) for k, v in states.items()]


def test_cleaning_and_gates(spark):
    rows = responded(
        spark,
        [dict(signal_id="a", signal_state=" YES "), dict(signal_id="zz", signal_state="yes"), dict(signal_id="b", signal_state="maybe", confidence="sure")],
        [dict(signal_id="a", signal_state="yes", source_url="not_found"), dict(signal_id="b", signal_state="yes", evidence_text="N/A"), dict(signal_id="c", signal_state="yes", attribution="bio")],
        [dict(signal_id="a", signal_state="no"), dict(signal_id="a", signal_state="yes", attribution="treatment_menu")],
        [],
    ).collect()
    one = {s["signal_id"]: s for s in rows[0]["signals"]}
    assert [s["signal_id"] for s in rows[0]["signals"]] == ["a", "b", "c", "n"]
    assert one["a"]["signal_state"] == "yes" and one["b"]["signal_state"] == "not_found" and one["b"]["confidence"] == "low"
    assert [s["not_found_reason"] for s in rows[1]["signals"]] == ["evidence_gate", "evidence_gate", "attribution_gate", ""]
    assert all(s["evidence_text"] == "" for s in rows[1]["signals"])
    assert rows[2]["signals"][0]["signal_state"] == "yes"
    assert all(s["signal_state"] == "not_found" and s["signal_label"] for s in rows[3]["signals"])


def test_scores(spark):
    rows = enrichment.scored(responded(spark, says(a="yes", b="yes"), says(a="yes", b="no", c="no", n="yes"), says(), [dict(signal_id="a", signal_state="yes", confidence="low")]), DEFS).orderBy("id").collect()
    # a and b in full and c inferred: (60 + 40 + 0.6 * 50) / 150
    assert (rows[0]["fit_signal_score"], rows[0]["confidence_score"]) == (round(130 / 150 * 100), round((90 + 90 + 65) / 3))
    assert rows[0]["signals"][2]["state_inferred"] and rows[0]["signals"][2]["inferred_from"] == "b"
    assert (rows[1]["fit_signal_score"], rows[1]["confidence_score"]) == (20, 90)
    assert (rows[2]["fit_signal_score"], rows[2]["confidence_score"]) == (0, K.NO_SIGNAL_CONFIDENCE)
    assert (rows[3]["fit_signal_score"], rows[3]["confidence_score"], rows[3]["confidence_band"]) == (round(20 / 150 * 100), 40, "Low")
    assert rows[0]["fit_confidence_status"] == "HIGH FIT / HIGH EVIDENCE"


def tiers(spark, defs, cases, least=90):
    rows = [(str(i), [dict(signal_id=k, signal_state=v, evidence_text="q", source_url=URL, confidence="high", attribution="") for k, v in states.items()], score, source) for i, (states, score, source) in enumerate(cases)]
    frame = spark.createDataFrame(rows, f"id string, response {S.RESPONSE}, score int, source string").withColumn("signals", S.cleaned("response", defs))
    out = frame.orderBy("id").select(rules.tier(F.col("signals"), F.col("score"), F.lit("complete"), F.col("source"), least).alias("t")).collect()
    return [(r["t"]["tier"], r["t"]["reason"]) for r in out]


def test_tiers(spark):
    defs = (S.SignalDef("m", "Must", 50, required_for_bullseye=True), S.SignalDef("k", "Cap", 10, cap_tier="Watchlist"), S.SignalDef("f", "Floor", 10, floor_tier="Contender"), S.SignalDef("v", "Verify", 10, verification_required=True))
    got = tiers(
        spark, defs,
        [({}, 90, "complete"), ({"k": "yes"}, 40, "complete"), ({"f": "yes"}, 10, "complete"), ({"m": "yes", "v": "yes"}, 55, "complete"), ({"m": "yes", "v": "yes"}, 95, "limited"),
         ({"m": "no", "v": "yes"}, 95, "complete"), ({"v": "yes"}, 95, "complete"), ({"m": "yes", "v": "yes", "k": "yes"}, 95, "complete"), ({"m": "yes"}, 95, "complete")],
    )
    assert [t for t, _ in got] == [K.MANUAL, K.MANUAL, K.CONTENDER, K.BULLSEYE, K.MANUAL, K.CONTENDER, K.VERIFY, K.CONTENDER, K.VERIFY]
    assert got[1][1].startswith("Score 40 is below the 50-point") and got[3][1] == ""
    assert got[7][1] == "Cap confirmed → capped at Contender."
    assert got[5][1] == "Must-have 'Must' confirmed absent → capped at Contender."
    assert got[2][1] == "Must-have 'Must' not found on the site → needs verification. 'Verify' needs verification before Bullseye. Score is below the Bullseye threshold."
    qualifier = (S.SignalDef("q", "Cash", 50, required_for_contender=True), S.SignalDef("o", "Other", 50))
    assert tiers(spark, qualifier, [({"o": "yes"}, 95, "complete"), ({"q": "yes"}, 95, "complete")])[0] == (K.MANUAL, "Cash not confirmed (required to qualify) — manual review required before calling.")


def test_exclusions_and_final_shape(spark):
    run = rules.RunConfig("Cardiology", ("CA",), ("no_web_presence", "hospital_owned"))
    rows = spark.createDataFrame(
        [("1", "Urology", "u", "TX", []), ("2", "Unknown", "u", "", []), ("3", "Cardiologist", "", "ca", []), ("4", "Cardiology", "u", "CA", ["hospital_owned", "practice_closed", "competitor_conflict"]), ("5", "Cardiology", "u", "CA", ["hospital_owned"])],
        "id string, specialty string, website_url string, address_state string, exclusion_triggers array<string>",
    )
    entries = F.array(F.struct(F.lit("a").alias("signal_id"), F.lit("yes").alias("signal_state"), F.lit("q").alias("evidence_text"), F.lit(URL).alias("source_url"), F.lit("high").alias("confidence"), F.lit("").alias("attribution")), F.struct(F.lit("n").alias("signal_id"), F.when(F.col("id") == "2", "yes").otherwise("no").alias("signal_state"), F.lit("q").alias("evidence_text"), F.lit(URL).alias("source_url"), F.lit("high").alias("confidence"), F.lit("").alias("attribution")))
    rows = rows.withColumn("response", entries.cast(S.RESPONSE)).withColumn("signals", S.cleaned("response", DEFS)).withColumns({"enrichment_status": F.lit("complete"), "source_confidence": F.lit("complete"), "context_text": F.lit("")})
    shaped = enrichment.shaped(rows).withColumns({"bullseye_score": F.lit(95), "fit_signal_score": F.lit(95), "confidence_score": F.lit(90)})
    out = {r["id"]: r for r in rules.finalized(rules.decided(shaped, run)).collect()}
    assert out["1"]["exclusion_primary_gate"] == "out_of_scope_specialty" and out["1"]["bullseye_score"] == 40 and out["1"]["exclusion_reason"].count(" | ") == 1
    assert out["2"]["exclusion_primary_gate"] == "n" and out["2"]["exclusion_reason"] == "Friction confirmed present (immediate exclusion)."
    assert out["3"]["target_tier"] == K.EXCLUDED and out["3"]["exclusion_primary_gate"] == "no_web_presence"
    assert out["4"]["exclusion_primary_gate"] == "practice_closed_or_inactive" and out["5"]["exclusion_primary_gate"] == "hospital_employed_physician"
    assert out["5"]["exclusion_reason"] == "Exclusion rules triggered: hospital_owned"
    assert all((r["target_tier"] == K.EXCLUDED) == (r["exclusion_status"] == "EXCLUDED") for r in out.values())
    broken = shaped.withColumns({"bullseye_score": F.lit(150), "confidence_score": F.lit(None).cast("int"), "exclusion_status": F.lit("CLEAR"), "target_tier": F.lit(K.EXCLUDED)}).limit(1)
    fixed = rules.finalized(broken).first()
    assert fixed["bullseye_score"] == 100 and fixed["target_tier"] == K.BULLSEYE and "Invariant violation" in fixed["internal_notes"] and "Missing confidence_score" in fixed["internal_notes"]


@pytest.mark.parametrize("excluded, total, share, tripped", [(9, 10, 0.9, False), (10, 10, 0.9, True), (10, 10, 1.0, False), (0, 10, 0.0, False)])
def test_canary_edges(spark, excluded, total, share, tripped):
    rows = spark.createDataFrame([(i < excluded,) for i in range(total)], "x boolean").withColumn("rules", rules._fired(("outside_geography", F.col("x"), "t")))
    assert rules.canary(rows, rules.RunConfig(max_structural_exclusion_share=share)).first()["tripped"] == tripped


PRACTICES = [
    # id, name, street, unit, zip, phone, url
    ("1", "Bay Medical Group", "100 Main St", "Suite 200", "94110", "415-555-1111", "https://bay.com"),
    ("2", "Bay Medical Group LLC", "100 Main Street", "#200", "94110", "", ""),
    ("3", "Other Clinic", "100 Main St", "Ste 400", "94110", "415-555-1111", "https://bay.com"),
    ("4", "Jane Smith", "100 Main St", "", "94110", "415-555-1111", "https://bay.com"),
    ("5", "Far Office", "9 Elm Rd", "", "95000", "415-555-7777", "https://multi.com"),
    ("6", "Downtown", "7 Oak Rd", "Ste 3", "95001", "415-555-7777", "https://multi.com"),
    ("7", "Alone", "5 Pine Rd", "", "95002", "", "https://yelp.com"),
    ("8", "Neighbour", "5 Pine Rd", "", "95002", "", "https://facebook.com"),
    ("9", "No Address", "", "", "", "", ""),
]


def practices(spark, rows=PRACTICES):
    return spark.createDataFrame(rows, "id string, practice_name string, address_street string, address_unit string, address_zip string, phone string, website_url string")


def test_consolidation(spark):
    locations, asked, summary = resolve.consolidate(practices(spark))
    found = {tuple(r["source_row_ids"]): r for r in locations.collect()}
    # 1-4 and 3-4 are equally strong; 1-4 is first by signature, and 3 is another suite than 1.
    assert set(found) == {("1", "2", "4"), ("3",), ("5", "6"), ("7",), ("8",), ("9",)}
    assert found[("5", "6")]["consolidation"]["score"] == 6
    one = summary.first()
    assert one["input_count"] == 9 and one["output_count"] == 6 and one["rows_merged_away"] == 3 and one["unblocked_count"] == 1 and one["cross_address_merges"] == 1
    assert sum(len(k) for k in found) == 9
    questions = {(r["review_reason"], r["score"]) for r in asked.collect()}
    assert ("phone_absent", 4) in questions  # 7 and 8: one building, no phones
    # The order of rows does not matter.
    shuffled = list(PRACTICES)
    random.Random(3).shuffle(shuffled)
    again, _, _ = resolve.consolidate(practices(spark, shuffled))
    pick = lambda df: sorted((r["practice_id"], tuple(r["source_row_ids"]), r["practice_name"], r["address_unit"]) for r in df.collect())
    assert pick(again) == pick(locations)


def test_pair_scores(spark):
    rows = resolve.identified(resolve.conformed(practices(spark))).withColumn("row", F.col("id").cast("long"))
    noise, umbrella = resolve.domain_policy()
    told = {(r["left"], r["right"]): (r["verdict"], r["score"]) for r in resolve.explained(rows, noise, sorted({*noise, *umbrella})).collect()}
    assert told[(1, 2)] == ("merge", 4 + 3 + 2)
    assert told[(1, 3)][0] == "unit_veto"
    assert told[(5, 6)] == ("merge", 6)
    assert told[(7, 8)] == ("review", 4)
    assert told[(1, 9)][0] == "no_shared_block"


def test_contact_blocks_have_a_limit(spark):
    many = [(str(i), f"Office {i}", f"{i} Long Rd", "", f"9{i:04d}", "415-555-9999", "https://chain.com") for i in range(13)]
    locations, _, summary = resolve.consolidate(practices(spark, many))
    assert locations.count() == 13 and summary.first()["contact_blocks_skipped"] == 1
    assert locations.select("location_count").distinct().collect()[0][0] == 13
    joined, _, _ = resolve.consolidate(practices(spark, many[:12]))
    # No number registry name, no organization's word, several providers, and a domain that does not read as a name.
    assert joined.count() == 1 and joined.first()["practice_name_source"] == "placeholder"


def test_suppression(spark):
    none = F.array().cast("array<struct<name:string,npi:string>>")
    rows = spark.createDataFrame([("1", "Bay Heart Surgeons", "94110", "CA", "77", ""), ("2", "Bay Heart", "94110-1", "CA", "", ""), ("3", "Bay Heart Surgeons", "", "ca", "", ""), ("4", "Heart", "94110", "CA", "", ""), ("5", "X", "", "", "", "88")], "id string, practice_name string, address_zip string, address_state string, npi_number string, npi_optional string")
    rows = rows.withColumn("providers", F.when(F.col("id") == "4", F.array(F.struct(F.lit("Ann").alias("name"), F.lit("99").alias("npi")))).otherwise(none))
    listed = spark.createDataFrame([(0, "77", "A", "", ""), (1, "99", "B", "", ""), (2, "", "Surgeons of the Bay Heart Clinic", "94110", "CA"), (3, "", "Bay Heart", "94110", "")], "ordinal long, npi string, name string, zip string, state string")
    got = {r["id"]: r["suppression_reason"] for r in match.suppression(rows, listed).collect()}
    assert got == {
        "1": "Existing customer — NPI match: 77", "2": "Existing customer — name+ZIP match: Surgeons of the Bay Heart Clinic",
        "3": "Existing customer — name+state match: Surgeons of the Bay Heart Clinic", "4": "Existing customer — provider at this location is a current customer: Ann (NPI 99)", "5": "",
    }


def test_npi_lookup(spark):
    rows = spark.createDataFrame([("1", "Bay Heart Group", "94110", "", "5"), ("2", "Bay Heart Surgeons", "94110", "", ""), ("3", "Zed Foot", "94110", "415-555-1111", ""), ("4", "Bay Zoo Park", "94110", "", ""), ("5", "Elsewhere", "10000", "", "")], "id string, practice_name string, address_zip string, phone string, npi_optional string")
    snapshot = spark.createDataFrame([("5", "NPI-1", "Dr Own", "", "1", ["c"]), ("7", "NPI-2", "Heart Surgeons Bay", "", "94110", ["t"]), ("8", "NPI-2", "Sole", "4155551111", "94110", [])], match.SNAPSHOT)
    got = {r["id"]: (r["npi_number"], r["npi_match_confidence"], r["taxonomy_exclusions"]) for r in match.npi_lookup(rows, snapshot, {"t": "hospital_owned"}).collect()}
    assert got == {"1": ("5", "confident", []), "2": ("7", "confident", ["hospital_owned"]), "3": ("8", "confident", []), "4": (None, "ambiguous", []), "5": (None, "none", [])}


def test_upload_duplicates_go_by_kept_rows(spark):
    rows = spark.createDataFrame([(0, "a.com", "A", "CA"), (1, "a.com", "B", "CA"), (2, "b.com", "B", "CA"), (3, "", "A", "ca"), (4, "", "", "")], "row_idx long, website_url string, practice_name string, address_state string")
    got = {(r["row_idx"], r["first_row"], r["basis"]) for r in match.upload_duplicates(rows).collect()}
    assert got == {(1, 0, "url"), (3, 0, "name_state")}  # 2 shares its name with 1, which was not kept
    alike = match.fuzzy_names(spark.createDataFrame([(0, "Bay Heart Clinic", "CA"), (1, "Bay Heart Clinics", "CA"), (2, "Zed", "CA")], "row_idx long, practice_name string, address_state string")).collect()
    assert [(r["left"], r["right"]) for r in alike] == [(0, 1)]


def records(spark, rows):
    return spark.createDataFrame(rows, "ordinal long, id string, practice_name string, website_url string, phone string, google_place_id string, address_city string, address_state string, address_zip string, specialty string, npi_optional string, npi string, enrichment_status string, exclusion_status string, target_tier string")


EMPTY = "entry_id string, ordinal long, " + ", ".join(f"{f} string" for f in registry.ENTRY[1:]) + f", change_history {registry.HISTORY}"


def test_registry_upsert(spark):
    row = lambda n, i, name, url="", phone="", place="", status="complete", excl="CLEAR": (n, i, name, url, phone, place, "Town", "CA", "94110", "", "", "", status, excl, K.BULLSEYE)
    first = records(spark, [row(0, "r0", "A", "a.com"), row(1, "r1", "A2", "a.com", "4155551111"), row(2, "r2", "C", "", "4155551111"), row(3, "r3", "X", "x.com", status="failed"), row(4, "r4", "Y", "y.com", excl="EXCLUDED"), row(5, "r5", "Z", "z.com", status="needs_review")])
    entries, log = registry.upsert(first, spark.createDataFrame([], EMPTY), "run1", "2024-01-01")
    told = {r["record_id"]: r["outcome"] for r in log.collect()}
    # r1 changes a's entry without indexing its phone, so r2 is new.
    assert told == {"r0": "inserted", "r1": "updated", "r2": "inserted", "r3": "rejected", "r4": "rejected", "r5": "rejected"}
    stored = spark.createDataFrame(entries.collect(), entries.schema)
    assert stored.count() == 2
    a = stored.where("website_domain = 'a.com'").first()
    assert a["practice_name"] == "A2" and {h["field"] for h in a["change_history"]} == {"practice_name", "phone"}
    # Of entries that share a key the last one counts: r2 finds its own again, r1 finds two.
    again, log = registry.upsert(first.where("ordinal in (1, 2)"), stored, "run2", "2024-01-02")
    assert {r["record_id"]: r["outcome"] for r in log.collect()} == {"r1": "needs_manual_merge", "r2": "updated"}
    same, log = registry.upsert(records(spark, [row(0, "r9", "A2", "a.com")]), stored, "run3", "2024-01-03")
    assert [r["outcome"] for r in log.collect()] == ["updated"]
    assert len(same.where("website_domain = 'a.com'").first()["change_history"]) == 2
    assert registry.chosen(first, mode="bullseye_only").count() == 5
    with pytest.raises(LookupError):
        registry.chosen(first, ids=["nope"])


def test_overlays(spark):
    rows = responded(spark, says(a="yes", b="yes"), says(a="yes"))
    brief = S.call_brief(F.col("signals"), F.lit(80), F.lit("Cardiology"), F.struct(*[F.lit(f" {x} ").alias(x) for x in ("opening_line", "likely_objection", "discovery_question", "hours_of_operation")]), F.struct(F.lit("Jane").alias("name"), F.lit("MD").alias("title"), F.lit("owner").alias("reason")))
    rows = rows.withColumn("call_brief", brief).withColumns({"target_tier": F.lit("Watchlist"), "exclusion_status": F.lit("CLEAR"), "sales_angle": F.array(F.lit("x"))})
    first = rows.first()["call_brief"]
    assert first["why_contact"] == "Cardiology practice: Alpha + Beta (fit 80)." and first["key_contact"] == "Ask for Dr. Jane — owner" and first["opening_line"] == "opening_line"
    assert first["missing_to_verify"] == ["Gamma"] and [e["point"] for e in first["top_evidence"]] == ["Alpha", "Beta"]
    over = {"a": ("a", "no", "", "", "me", "now", "yes")}
    reviews = spark.createDataFrame([("0", "approved", over)], f"record_id string, qc_status string, signal_overrides map<string,{overlay.OVERRIDE}>")
    out = {r["id"]: r for r in overlay.with_overrides(overlay.reviewed(rows, reviews)).collect()}
    assert out["0"]["displayed_tier"] == K.CONTENDER and out["0"]["signals"][0]["signal_state"] == "no" and out["0"]["signals"][0]["evidence_text"] == "Operator-verified"
    assert out["0"]["sales_angle"] == [] and out["0"]["call_brief"]["opening_line"] == "" and [e["point"] for e in out["0"]["call_brief"]["top_evidence"]] == ["Beta"]
    assert out["1"]["sales_angle"] == ["x"] and out["1"]["review"]["qc_status"] == "pending"
    cells = views.evidence_slots(F.col("signals"), F.lit("2024-01-01"))
    line = rows.select(*[v.alias(k) for k, v in cells.items()]).first()
    assert line["signal_1_id"] == "a" and line["signal_2_id"] == "b" and line["signal_3_id"] == "" and line["signal_1_captured"] == "2024-01-01"


def test_verification(spark):
    rows = responded(spark, says(a="yes"), says(a="yes"), says(b="yes", a="yes", c="yes"), says(a="yes")).withColumn("context", F.when(F.col("id") == "3", "nothing").otherwise("the QUOTE is here"))
    second = F.when(F.col("id") == "0", F.create_map(F.lit("c"), F.lit("yes"))).otherwise(F.create_map(F.lit("n"), F.lit("yes")))
    got = [r["v"]["action"] for r in rows.select(rules.verified(F.col("signals"), F.col("context"), DEFS, second).alias("v")).collect()]
    assert got == ["promote", "disqualify", "hold", "hold"]


def test_evidence(spark):
    pages = spark.createDataFrame([("r", 2, "https://b", "x" * 20), ("r", 1, "https://a", "Cash pay only"), ("r", 3, "https://c", " ")], "record_id string, page_no int, url string, text string")
    assert [r["file"] for r in evidence.indexed(pages).orderBy("page_no").collect()] == ["page-01.txt", "page-02.txt"]
    assert evidence.context(pages.where("page_no < 3")).first()["context_text"] == "[Source: https://a]\nCash pay only\n\n---\n\n[Source: https://b]\n" + "x" * 20
    quotes = spark.createDataFrame([("r", "s", "cash  PAY"), ("r", "t", "gold"), ("q", "s", "x")], "record_id string, signal_id string, evidence_text string")
    assert {(r["record_id"], r["signal_id"], r["status"], r["page_no"]) for r in evidence.audit(quotes, pages).collect()} == {("r", "s", "anchored", 1), ("r", "t", "missing", None), ("q", "s", "no_pages", None)}
    page = spark.createDataFrame([(1, "https://x.com/", '<a href="/about">About</a><a href="/services">Our services</a><a href="/blog/a">b</a><a href="https://y.com/z">y</a><a href="mailto:a@b">m</a><a href="other#t">o</a>')], "page_id long, url string, html string")
    assert [r["link"] for r in evidence.subpages(page).orderBy("place").collect()] == ["https://x.com/services", "https://x.com/about", "https://x.com/other"]


def test_enrichment_plan_and_rescore(spark):
    run = rules.RunConfig("", ("CA",), ())
    rows = spark.createDataFrame([("1", "P1", "CA", "t" * 200), ("2", "P2", "TX", "t" * 200), ("3", "P3", "CA", "thin"), ("4", "P4", "CA", "t" * 200)], "id string, practice_name string, address_state string, context_text string").withColumns({"website_url": F.lit("https://p.com"), "source_confidence": F.lit("complete")})
    response = responded(spark, says(), says(a="yes", b="yes", c="yes")).where("id = '1'").select("id", "response")
    final, told = enrichment.enriched(rows, response, DEFS, run)
    got = {r["id"]: (r["target_tier"], r["enrichment_status"], r["exclusion_status"]) for r in final.collect()}
    assert got == {"1": (K.BULLSEYE, "complete", "CLEAR"), "2": (K.EXCLUDED, "not_enriched", "EXCLUDED"), "3": (K.MANUAL, "complete", "CLEAR"), "4": (K.MANUAL, "failed", "CLEAR")}
    assert told.first()["excluded"] == 1
    again = enrichment.rescored(final, DEFS, run)
    moved = metrics.transitions(final, again).collect()
    assert all(r["old_tier"] == r["new_tier"] and not r["score_changed"] for r in moved) and sum(r["n"] for r in moved) == 4
    grid = enrichment.simulated(spark, DEFS, run, {"a": ("yes", "no"), "c": ("yes", "not_found")}).collect()
    assert len(grid) == 4


def test_configuration():
    good = {"signals": [{"signal_id": "a", "signal_label": "A", "prompt_instruction": "p", "positive_weight": 5}]}
    assert config.definitions(good)[0].positive_weight == 5
    bad = {"signals": [{"signal_id": "a", "signal_label": "", "positive_weight": True, "cap_tier": "Top", "reinforces": "z"}, {"signal_id": "a", "signal_label": "A", "prompt_instruction": "p", "positive_weight": 1}]}
    assert len(config.signal_errors(bad)) == 6
    assert config.run_errors({"active_exclusion_rules": ["nope"], "bullseye_min_score": 101}) and not config.run_errors({"active_exclusion_rules": ["hospital_owned"]})
    assert config.run_config({"max_structural_exclusion_share": "x"}).max_structural_exclusion_share == K.CANARY_SHARE
    assert config.fingerprint({"b": 1, "a": 2}, "n") == config.fingerprint({"a": 2, "b": 1}, "n")
    with pytest.raises(ValueError):
        config.json_without_doubles('{"a": 1, "a": 2}')


def test_readers_and_writers(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('﻿Name,Full_Address,Site,Type,Phone\n"Bay ""Heart""","1 Elm St, Suite 5, Miami, FL 33101",bay.com/?x=1,cardiologist,1\n,"x, CA",,,\nZed,,N/A,,\n', encoding="utf-8")
    rows, rejected = readers.listings(readers.read_csv(spark, str(path)))
    got = {r["practice_name"]: r for r in rows.collect()}
    assert set(got) == {'Bay "Heart"', "Zed"} and rejected.first()["row_num"] == 3
    bay = got['Bay "Heart"']
    assert (bay["address_street"], bay["address_city"], bay["address_state"], bay["address_zip"], bay["specialty"], bay["website_url"]) == ("1 Elm St, Suite 5", "Miami", "FL", "33101", "Cardiology", "https://bay.com")
    assert got["Zed"]["website_url"] == "" and got["Zed"]["id"].startswith("T-") and set(rows.columns) == set(readers.CANONICAL)
    (tmp_path / "m.csv").write_text("id;practice_name;provider_names;address_state\nk1;M;Jane Smith, MD;texas\n")
    own, _ = readers.manual(readers.read_csv(spark, str(tmp_path / "m.csv")))
    assert own.first()["id"] == "k1" and own.first()["address_state"] == "TX" and own.first()["provider_names"] == ["Jane Smith, MD"]
    (tmp_path / "p.csv").write_text("title,website,permanentlyclosed,postalcode\nA,a.com,true,1\nB,b.com,false,94110\n")
    places, _ = readers.listings(readers.read_csv(spark, str(tmp_path / "p.csv")), spark.createDataFrame([("94110", "SF", "CA")], "zip string, city string, state string"), "places")
    assert [(r["practice_name"], r["address_city"], r["address_state"]) for r in places.collect()] == [("B", "SF", "CA")]
    assert readers.uploads(readers.read_csv(spark, str(path))).where("name_normalized = 'bay heart'").first()["website_domain"] == "bay.com"
    (tmp_path / "run.json").write_text('{"records": [{"id": "1"}, {"id": "2"}]}')
    assert [r["id"] for r in readers.run_records(spark, str(tmp_path / "run.json"), "id:string").orderBy("ordinal").collect()] == ["1", "2"]
    assert readers.registry(spark, str(tmp_path / "none"), "entry_id string").count() == 0
    (tmp_path / "reviews.json").write_text('{"record_id": "1", "qc_status": "approved"}\nbroken\n')
    kept, damaged = readers.reviews(spark, str(tmp_path / "reviews.json"), strict=False)
    assert kept.first()["qc_status"] == "approved" and damaged.count() == 1
    with pytest.raises(Exception):  # noqa: B017
        readers.reviews(spark, str(tmp_path / "reviews.json"))[0].collect()
    writers.to_csv(spark.createDataFrame([("=x", ["a", "b"], None)], "a string, b array<string>, c string"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()][0][:2] == ("'=x", "a | b")
    writers.to_version(spark.range(3), str(tmp_path / "t"), 1, 0)
    with pytest.raises(RuntimeError):
        writers.to_version(spark.range(3), str(tmp_path / "t"), 1, 0)
    done, kept = readers.unioned(spark.range(1), spark.range(1)), views.resumed(spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), spark.createDataFrame([("1", "complete"), ("2", "failed")], "id string, enrichment_status string"))
    assert done.count() == 2 and sorted(r["id"] for r in kept[0].collect()) == ["2", "3"]


def test_discovery(spark):
    fields = "row_idx long, google_place_id string, website_domain string, phone_digits string, name_normalized string, address_normalized string, practice_name string, google_category string"
    rows = spark.createDataFrame([(0, "", "a.com", "", "", "", "A new", ""), (1, "", "a.com", "", "", "", "", ""), (2, "", "n.com", "", "", "", "", ""), (3, "", "n.com", "", "", "", "", ""), (4, "", "n.com", "", "", "", "", ""), (5, "", "", "12", "x", "", "", "")], fields)
    entries = spark.createDataFrame([("e", 0, "", "a.com", "", "", "", "A", "")], fields.replace("row_idx long", "entry_id string, ordinal long"))
    told, counts, ahead = enrichment.discovered(rows, entries, "run")
    got = {r["row_idx"]: (r["classification"], r["duplicate_of_row_idx"]) for r in told.collect()}
    assert got == {0: ("CHANGED", None), 1: ("KNOWN", None), 2: ("NEW", None), 3: ("POSSIBLE_DUPLICATE", 2), 4: ("POSSIBLE_DUPLICATE", 3), 5: ("INSUFFICIENT_DATA", None)}
    assert told.where("row_idx = 0").first()["reason"] == "Changed: Practice name: 'A' → 'A new'"
    assert {r["classification"]: r["n"] for r in counts.collect()} == {"NEW": 1, "CHANGED": 1, "KNOWN": 1, "POSSIBLE_DUPLICATE": 2, "INSUFFICIENT_DATA": 1}
    assert {(r["status"], r["practice_name"]) for r in ahead.collect()} == {("changed", "A new"), ("new", "")}


def test_views(spark):
    a = spark.createDataFrame([("s1", {"x": "1"}), ("s2", {"x": "1"}), ("s3", {"x": "1"})], "signal_id string, given map<string,string>")
    b = spark.createDataFrame([("s1", {"x": "1"}), ("s2", {"x": "2"}), ("s4", {"x": "1"})], "signal_id string, given map<string,string>")
    assert {r["signal_id"]: r["status"] for r in views.profile_diff(a, b, ["x", "y"]).collect()} == {"s1": "unchanged", "s2": "changed", "s3": "removed", "s4": "added"}
    old = spark.createDataFrame([("1", "complete", "o"), ("2", "limited", "o")], "id string, source_confidence string, t string")
    new = spark.createDataFrame([("1", "failed", "n"), ("2", "failed", "n")], "id string, source_confidence string, t string")
    assert {r["id"]: r["t"] for r in views.refreshed(old, new, ["source_confidence", "t"]).collect()} == {"1": "o", "2": "n"}
    runs = spark.createDataFrame([("r", 5, 1000, 2000, 10, None)], "run_id string, llm_call_count int, llm_input_tokens int, llm_output_tokens int, records_output int, consolidation_practice_locations int")
    assert metrics.cost_summary(runs).first()["estimated_cost_usd"] == round(1000 / 1e6 * 3 + 2000 / 1e6 * 15, 4)
    assert [r["case_id"] for r in metrics.scaffold(spark.createDataFrame([("1", "A B"), ("2", "a-b")], "id string, practice_name string")).orderBy("id").collect()] == ["a_b", "a_b_2"]


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
