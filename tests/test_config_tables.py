"""Checks over tables give what the checks of one configuration give."""

import random

from pyspark.sql import functions as F

from sieveworks.plans import config, config_tables


def test_faults_are_those_of_single_profiles(spark):
    rng = random.Random(1)
    rows, want, kept = [], set(), set()
    for p in range(30):
        listed = []
        for _ in range(rng.randint(1, 6)):
            s = {"signal_id": rng.choice(["a", "b", "c", "d", ""]), "signal_label": rng.choice(["Cash", "", "Insurance-only model"]), "prompt_instruction": rng.choice(["p", " ", "accepts payers"]), "positive_weight": rng.choice([1, 2.5, None]), "cap_tier": rng.choice(["", "Contender", "Gold"]), "column_label": rng.choice(["short", "x" * 25]), "reinforces": rng.choice(["", "", "a", "z"])}
            listed.append({k: v for k, v in s.items() if not (k == "positive_weight" and v is None)})
        want |= {(f"p{p}", e) for e in config.signal_errors({"signals": listed})}
        kept |= {(f"p{p}", listed.index(s)) for s in config.without_inverse_billing(listed)}
        rows += [(f"p{p}", i, s["signal_id"], s["signal_label"], s["prompt_instruction"], str(s["positive_weight"]) if "positive_weight" in s else None, s["cap_tier"], s["column_label"], s["reinforces"]) for i, s in enumerate(listed)]
    drafts = spark.createDataFrame(rows, "profile_id string, at long, signal_id string, signal_label string, prompt_instruction string, positive_weight string, cap_tier string, column_label string, reinforces string").repartition(4)
    got = config_tables.signal_faults(drafts).collect()
    assert {(r["profile_id"], r["message"]) for r in got} == want and len({m.split(": ")[1] for _, m in want}) > 5
    left = {(r["profile_id"], r["at"]) for r in config_tables.without_inverse_billing(drafts).collect()}
    assert kept <= left and len(left) < len(rows)


def test_projects_and_fingerprints(spark):
    projects = [{"project_id": f"p{i}", "client_name": ["C", ""][i % 2], "icp_profile_id": ["x", "y", " "][i % 3]} for i in range(12)]
    frame = spark.createDataFrame([tuple(p.values()) for p in projects], "project_id string, client_name string, icp_profile_id string")
    assert {(r["project"], r["message"]) for r in config_tables.project_faults(frame).collect()} == {(p["project_id"], e) for p in projects for e in config.project_errors(p)}
    used = {r["icp_profile_id"]: (r["n"], r["first"], r["last"]) for r in config_tables.profile_usage(frame).collect()}
    assert used == {k: (len(u), u[0], u[-1]) for k in ("x", "y") for u in [config.projects_using(projects, k)]}
    one = {"b": 'say "x"', "a": "back\\slash"}
    made = spark.range(1).select(config_tables.fingerprint(F.create_map(*[F.lit(v) for kv in one.items() for v in kv]), F.lit("run")).alias("f")).first()["f"]
    assert made == config.fingerprint(one, "run")
