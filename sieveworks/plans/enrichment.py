"""The three ways through the engine: enrichment of a list, what-if runs over stored records, discovery of new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.functions.text import strip
from sieveworks.operators import match, rules
from sieveworks.operators import signals as S
from sieveworks.operators.graph import written
from sieveworks.sources.readers import unioned

RECORD = {
    "id": "string", "practice_name": "string", "specialty": "string", "website_url": "string", "address_state": "string", "signals": f"array<{S.SIGNAL}>",
    "taxonomy_exclusions": "array<string>", "bullseye_score": "int", "fit_signal_score": "int", "confidence_score": "int", "enrichment_status": "string",
    "source_confidence": "string", "exclusion_triggers": "array<string>", "exclusion_rationale": "string", "context_text": "string", "customer_suppressed": "boolean",
    "suppression_reason": "string", "internal_notes": "string", "exclusion_status": "string", "exclusion_reason": "string", "target_tier": "string",
    "tier_cap_reason": "string", "sales_angle": "array<string>",
}


def shaped(records: DataFrame) -> DataFrame:
    """Records with every column that the rules read; missing ones are null or empty."""
    put = {}
    for name, kind in RECORD.items():
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
        put[name] = (F.coalesce(F.col(name), empty) if kind.startswith("array") else F.col(name)) if name in records.columns else empty
    return records.withColumns(put)


def first_wins(records: DataFrame, key: str = "id", order: str | Column = "row_num") -> DataFrame:
    """The first row of each id: a summed minimum, so a repeated id is never sorted in one task."""
    return records.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*records.columns), order).alias("_row")).select("_row.*")


def limited(records: DataFrame, most: int, order: str = "row_num") -> DataFrame:
    """The first rows of a list in its order."""
    return records.orderBy(order).limit(most)


def required(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a name and an id, the others)."""
    ok = (F.coalesce("practice_name", F.lit("")) != "") & (F.coalesce("id", F.lit("")) != "")
    return records.where(ok), records.where(~ok)


def scored(records: DataFrame, defs: Sequence[S.SignalDef]) -> DataFrame:
    """Records with inferred signals and the scores that follow."""
    out = records.withColumn("signals", S.reinforced("signals", defs))
    s = S.scores("signals", defs)
    out = out.withColumn("_s", s).withColumns({x: F.col(f"_s.{x}") for x in ("bullseye_score", "fit_signal_score", "confidence_score")}).drop("_s")
    return out.withColumns({"fit_confidence_status": S.quadrant(F.col("fit_signal_score"), F.col("confidence_score")), "confidence_band": S.band(F.col("confidence_score"))})


def signalled(records: DataFrame, responses: DataFrame, defs: Sequence[S.SignalDef], how: str = "left") -> DataFrame:
    """Records with signals: unknown where there is too little text, else from ``responses`` (id, response), cleaned.

    ``how`` joins them: by ``inner``, records without a response go.
    """
    thin = F.length(strip(F.col("context_text"))) < K.LEAST_CONTEXT
    both = records.drop("signals").join(responses.select("id", F.col("response").cast(S.RESPONSE).alias("_response")), "id", how)
    both = both.withColumn("_entries", F.coalesce("_response", F.array().cast(S.RESPONSE)))
    status = F.when(thin | F.col("_response").isNotNull(), "complete").otherwise("failed")
    return both.withColumns({"signals": F.when(thin, S.empty(defs)).otherwise(S.cleaned("_entries", defs)), "enrichment_status": status}).drop("_response", "_entries")


def enriched(records: DataFrame, responses: DataFrame, defs: Sequence[S.SignalDef], config: rules.RunConfig, customers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(final records, the canary's row). Customers and structural exclusions are taken out before anything costly is joined."""
    rows = shaped(records)
    if customers is not None:
        rows = match.suppression(rows, customers)
    rows = written(rows, "rows")
    open_, held = rows.where(~F.coalesce("customer_suppressed", F.lit(False))), rows.where("customer_suppressed")
    screened = rules.prescreened(open_, config)
    told = rules.canary(screened, config)
    out = screened.where(F.size("rules") > 0).drop("rules")
    go = screened.where(F.size("rules") == 0).drop("rules")
    done = rules.decided(scored(signalled(go, responses, defs), defs), config)
    skipped = out.withColumns({"target_tier": F.lit(K.EXCLUDED), "bullseye_score": F.lit(0), "fit_signal_score": F.lit(0), "confidence_score": F.lit(0)})
    kept = rules.decided(held.withColumns({"bullseye_score": F.lit(0), "fit_signal_score": F.lit(0), "confidence_score": F.lit(0), "enrichment_status": F.lit("not_enriched")}), config)
    return rules.finalized(shaped(unioned(done, skipped, kept))), told


def rescored(records: DataFrame, defs: Sequence[S.SignalDef], config: rules.RunConfig) -> DataFrame:
    """Records under new weights: excluded ones stay as they are, tier flags stay those of the stored signals."""
    rows = shaped(records)
    fixed = rows.where(F.col("exclusion_status") == "EXCLUDED")
    moved = rows.where(~F.coalesce(F.col("exclusion_status") == "EXCLUDED", F.lit(False)))
    again = rules.finalized(rules.decided(scored(moved, defs), config))
    return unioned(again, fixed)


def simulated(spark: SparkSession, defs: Sequence[S.SignalDef], config: rules.RunConfig, states: dict[str, Sequence[str]], confidence: str = "high") -> DataFrame:
    """Every combination of the given states per signal: scores, tier and reason."""
    ids = list(states)
    grid = spark.range(1).drop("id")
    for i, signal in enumerate(ids):
        grid = grid.withColumn(f"s{i}", F.explode(F.array(*[F.lit(x) for x in states[signal]])))
    grid = grid.select(F.map_from_arrays(F.array(*[F.lit(x) for x in ids]), F.array(*[F.col(f"s{i}") for i in range(len(ids))])).alias("states"))
    raw = F.array(*[F.struct(F.lit(d.signal_id).alias("signal_id"), F.coalesce(F.try_element_at("states", F.lit(d.signal_id)), F.lit("not_found")).alias("signal_state"), F.lit("simulated").alias("evidence_text"), F.lit("https://example.com").alias("source_url"), F.lit(confidence).alias("confidence"), F.lit("").alias("attribution")) for d in defs])
    made = shaped(grid.withColumn("_entries", raw.cast(S.RESPONSE)).withColumn("signals", S.cleaned("_entries", defs)).withColumns({"enrichment_status": F.lit("complete"), "source_confidence": F.lit("complete")}))
    return rules.decided(scored(made, defs), config).select("states", "bullseye_score", "fit_signal_score", "confidence_score", "exclusion_status", "target_tier", "tier_cap_reason")


def what_ifs(records: DataFrame, defs: Sequence[S.SignalDef], states: Sequence[str] = K.STATES) -> DataFrame:
    """Records with every single change of a signal: ``changed_signal, changed_state``, and the scores that would follow.

    A record comes once for each signal and state, its own states included; inferred states are worked out anew.
    """
    each = F.array(*[F.struct(F.lit(d.signal_id).alias("id"), F.lit(x).alias("state")) for d in defs for x in states])
    rows = records.withColumn("_c", F.explode(each))
    put = F.transform("signals", lambda s: s.withField("signal_state", F.when(s.signal_id == F.col("_c.id"), F.col("_c.state")).otherwise(s.signal_state)).withField("state_inferred", F.lit(False)).withField("inferred_from", F.lit("")))
    rows = rows.withColumns({"signals": put, "changed_signal": F.col("_c.id"), "changed_state": F.col("_c.state")}).drop("_c")
    return scored(rows, defs)


def best_changes(records: DataFrame, key: str, defs: Sequence[S.SignalDef], states: Sequence[str] = K.STATES) -> DataFrame:
    """``key, changed_signal, changed_state, score, lift``: of each record's ``what_ifs`` the one of the highest fit score, of equal ones the
    first by signal and state; and what it adds to the record's own score.

    Scores follow from ids, states and confidences alone, so every such answer is simulated once, and the records that gave it meet
    it in a join. Records without signals are like those with none.
    """
    said = F.transform(F.coalesce("signals", F.array().cast(f"array<{S.SIGNAL}>")), lambda s: F.struct(s.signal_id.alias("signal_id"), s.signal_state.alias("signal_state"), s.confidence.alias("confidence")))
    rows = written(records.select(key, said.alias("answer")), "answers")
    fields = [f.split(":") for f in S.SIGNAL[len("struct<") : -1].split(",")]
    whole = F.transform("answer", lambda a: F.struct(*[(a[f] if f in ("signal_id", "signal_state", "confidence") else F.lit(None).cast(kind)).alias(f) for f, kind in fields]))
    own = scored(rows.select("answer").distinct().withColumn("signals", whole), defs).select("answer", "signals", F.col("fit_signal_score").alias("own"))
    order = F.struct((-F.col("fit_signal_score")).alias("s"), F.col("changed_signal").alias("id"), F.col("changed_state").alias("st"))
    best = what_ifs(own, defs, states).groupBy("answer").agg(F.min(order).alias("b"), F.min("own").alias("own"))
    best = best.select("answer", F.col("b.id").alias("changed_signal"), F.col("b.st").alias("changed_state"), (-F.col("b.s")).alias("score"), (-F.col("b.s") - F.col("own")).alias("lift"))
    return rows.join(written(best, "changes"), "answer").select(key, "changed_signal", "changed_state", "score", "lift")


def discovered(rows: DataFrame, entries: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified rows with reasons, counts by class, the registry as it would be)."""
    from sieveworks.operators.registry import preview

    found = written(match.classified(rows, entries), "classified")
    c = F.col
    told = found.withColumn("reason", match.reason_text(c("classification"), c("match_basis"), c("changed_fields"), c("duplicate_of_row_idx")))
    return told, match.class_counts(found), preview(found, rows, entries, run_id)
