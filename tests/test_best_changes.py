"""The best change of a record's signals, against all changes of every record."""

import random

from pyspark.sql import functions as F

from sieveworks import queries
from sieveworks.operators import signals as S
from sieveworks.plans import enrichment

DEFS = (S.SignalDef("a", "Alpha", 60), S.SignalDef("b", "Beta", 40, reinforces="c", not_found_weight=-10), S.SignalDef("c", "Gamma", 50, no_weight=-5), S.SignalDef("n", "Friction", -30))


def test_best_changes_are_those_of_all_what_ifs(spark):
    rng = random.Random(4)
    entry = lambda: dict(signal_id=rng.choice("abcn"), signal_state=rng.choice(["yes", "no", "not_found", None]), confidence=rng.choice(["high", "medium", "low", None]), evidence_text=str(rng.random()))
    answers = [[entry() for _ in range(rng.randrange(6))] for _ in range(25)]
    rows = [(i, rng.choice(answers)) for i in range(120)] + [(120, None), (121, [])]
    frame = spark.createDataFrame([(i, a and [{f.split(":")[0]: None for f in S.SIGNAL[7:-1].split(",")} | e for e in a]) for i, a in rows], f"id long, signals array<{S.SIGNAL}>")
    order = F.struct((-F.col("fit_signal_score")).alias("s"), "changed_signal", "changed_state")
    own = {r["id"]: r["fit_signal_score"] for r in enrichment.scored(frame, DEFS).collect()}
    best = {r["id"]: tuple(r["b"]) for r in enrichment.what_ifs(frame, DEFS).groupBy("id").agg(F.min(order).alias("b")).collect()}
    want = {i: (s, t, -n, -n - own[i]) for i, (n, s, t) in best.items()}
    got = {r["id"]: tuple(r)[1:] for r in enrichment.best_changes(frame, "id", DEFS).collect()}
    assert len(want) == 122 and got == want


def test_best_change_simulates_equal_answers_once(spark, monkeypatch):
    simulated, what_ifs = [], enrichment.what_ifs
    monkeypatch.setattr(enrichment, "what_ifs", lambda records, *more: simulated.append(records.count()) or what_ifs(records, *more))
    n = queries.QUERIES["best_change"](spark, "/root/testdata/sf0.001").count()
    assert n > 1000 and sum(simulated) <= 3**4 * 3
