"""Reading signals again: which records change, and that no list of ids goes through the driver."""

from sieveworks import catalog, queries_runs  # noqa: F401 (registers its queries)
from sieveworks.operators import passes, rules
from sieveworks.operators import signals as S

DEFS = (S.SignalDef("a", "Alpha", 60, required_for_bullseye=True), S.SignalDef("b", "Beta", 40))
TEXT = "text " * 60


def test_only_eligible_records_with_a_response_change(spark):
    rows = [
        ("1", "CLEAR", TEXT, "complete"), ("2", "CLEAR", TEXT, "complete"), ("3", "EXCLUDED", TEXT, "complete"), ("4", "CLEAR", " ", "complete"), ("5", "CLEAR", None, "complete"),
        ("6", "CLEAR", TEXT, "not_enriched"), ("7", None, TEXT, None), ("8", "CLEAR", TEXT, "complete"), ("9", "CLEAR", "thin", "complete"),
    ]
    records = spark.createDataFrame([(*r, "Contender", 5, "complete") for r in rows], "id string, exclusion_status string, context_text string, enrichment_status string, target_tier string, bullseye_score int, source_confidence string")
    yes = [dict(signal_id=s, signal_state="yes", evidence_text="quote", source_url="https://x.com", confidence="high", attribution="") for s in "ab"]
    responses = spark.createDataFrame([(i, yes) for i in "1345679x"] + [("8", None)], f"id string, response {S.RESPONSE}")
    out, moved = passes.reextracted(records, responses, DEFS, rules.RunConfig())
    got = {r["id"]: (r["target_tier"], r["bullseye_score"], r["enrichment_status"]) for r in out.collect()}
    same = {i: ("Contender", 5, "not_enriched" if i == "6" else "complete") for i in "23456"}
    assert len(got) == 9 and {i: got[i] for i in "23456"} == same
    assert got["1"][0] == got["7"][0] == "Bullseye" and got["1"][1] == got["7"][1] > 5
    assert got["8"][2] == "failed" and got["9"][2] == "complete" and got["8"][1] == got["9"][1] == 0
    assert sum(r["n"] for r in moved.collect()) == 4


def test_reextraction_gathers_no_ids_on_the_driver(spark):
    plan = catalog.QUERIES["reextraction"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    anti = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert anti and not any("Broadcast" in line for line in anti)
