"""Analysts' reviews over records: the latest state from an event log, displayed tiers, signal overrides, export gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.functions.text import any_of, blank
from sieveworks.operators.rules import current_tier

OVERRIDE = "struct<signal_id:string,override_state:string,source_url:string,override_note:string,override_by:string,override_at:string,original_state:string>"
REVIEW = (
    "record_id string, analyst_note string, override_tier string, override_reason string, qc_status string, reviewed_by string, "
    f"reviewed_at string, extra_sales_angles array<string>, signal_overrides map<string,{OVERRIDE}>"
)
PROSE = ("why_contact", "opening_line", "likely_objection", "discovery_question")


def default_review() -> dict[str, Column]:
    """The fields of a review that nobody wrote."""
    return {
        "analyst_note": F.lit(""), "override_tier": F.lit(None).cast("string"), "override_reason": F.lit(""), "qc_status": F.lit("pending"),
        "reviewed_by": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("string"), "extra_sales_angles": F.array().cast("array<string>"),
        "signal_overrides": F.create_map().cast(f"map<string,{OVERRIDE}>"),
    }


def latest(events: DataFrame, key: str, order: tuple[str, ...], values: list[str]) -> DataFrame:
    """Per key the values of its last event by ``order``; nulls in a value leave the one before it. Summed before it is dealt."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values], F.count("*").alias("n_events"))


def displayed_tier(override: Column, tier: Column) -> Column:
    """The analyst's tier if there is one, else the engine's, under current names."""
    return F.when(blank(override) != "", current_tier(override)).otherwise(current_tier(blank(tier)))


def reviewed(records: DataFrame, reviews: DataFrame, record_id: str = "id") -> DataFrame:
    """Records with ``review`` (a struct with defaults where there is none) and ``displayed_tier``."""
    fields = default_review()
    have = [f for f in fields if f in reviews.columns]
    out = records.join(reviews.select(F.col("record_id").alias(record_id), F.struct(*have).alias("_r")), record_id, "left")
    review = F.struct(*[F.coalesce(F.col(f"_r.{f}"), d).alias(f) if f in have else d.alias(f) for f, d in fields.items()])
    return out.withColumn("review", review).drop("_r").withColumn("displayed_tier", displayed_tier(F.col("review.override_tier"), F.col("target_tier")))


def overridden(signals: Column, overrides: Column) -> Column:
    """Signals with analysts' states, notes and sources, and a mark; scores and tiers are not touched."""

    def one(s: Column) -> Column:
        o = F.try_element_at(overrides, s.signal_id)
        note = F.when(blank(o.override_note) != "", o.override_note).otherwise("Operator-verified")
        put = lambda field, value: F.when(o.isNotNull(), value).otherwise(s[field])
        return s.withField("signal_state", put("signal_state", F.coalesce(o.override_state, s.signal_state))).withField("evidence_text", put("evidence_text", note)).withField("source_url", put("source_url", blank(o.source_url))).withField("is_override", o.isNotNull())

    return F.transform(signals, one)


def retracted(signals: Column, overrides: Column) -> Column:
    """Labels of confirmed signals that an analyst withdrew; ``signals`` as the engine wrote them."""
    gone = F.filter(signals, lambda s: (s.signal_state == "yes") & F.coalesce(F.try_element_at(overrides, s.signal_id).override_state != "yes", F.lit(False)))
    return F.filter(F.transform(gone, lambda s: F.coalesce(F.nullif(blank(s.signal_label), F.lit("")), s.signal_id)), lambda x: x != "")


def with_overrides(records: DataFrame) -> DataFrame:
    """Reviewed records with overridden signals; prose and quotes that rest on a withdrawn signal go."""
    c = F.col
    out = records.withColumn("_gone", retracted(c("signals"), c("review.signal_overrides")))
    any_gone = F.size("_gone") > 0
    brief = c("call_brief")
    for field in PROSE:
        brief = brief.withField(field, F.when(any_gone, "").otherwise(c("call_brief")[field]))
    kept = F.filter(c("call_brief.top_evidence"), lambda e: ~F.array_contains(c("_gone"), e.point))
    brief = brief.withField("top_evidence", F.when(any_gone, kept).otherwise(c("call_brief.top_evidence")))
    none = F.array().cast("array<string>")
    return out.withColumns({"signals": overridden(c("signals"), c("review.signal_overrides")), "call_brief": brief, "sales_angle": F.when(any_gone, none).otherwise(c("sales_angle"))}).drop("_gone")


def approved() -> Column:
    """Whether a reviewed record may be exported."""
    r, tier = F.col("review"), F.lower("displayed_tier")
    by_engine = (F.col("exclusion_status") != "EXCLUDED") & ~any_of(F.col("displayed_tier"), (K.VERIFY, K.MANUAL))
    return (r.qc_status == "approved") & (tier != "excluded") & ((blank(r.override_tier) != "") | by_engine)


def export_gate(kind: str) -> Column:
    """The rows of an export: approved, bullseye, contender or excluded."""
    tier = F.lower("displayed_tier")
    return {
        "approved": approved(), "bullseye": approved() & (tier == "bullseye"),
        "contender": (tier == "contender") & (F.col("review.qc_status") != "rejected"), "excluded": tier == "excluded",
        "handoff": F.when(tier == "bullseye", F.col("review.qc_status") == "approved").otherwise((tier == "contender") & (F.col("review.qc_status") != "rejected")),
    }[kind]


def readiness(records: DataFrame) -> DataFrame:
    """One row: state, pending_count and approved_count of the top tier."""
    top = F.lower("displayed_tier") == "bullseye"
    counted = records.agg(F.count_if(top).alias("n"), F.count_if(top & (F.col("review.qc_status") == "pending")).alias("pending_count"), F.count_if(top & (F.col("review.qc_status") == "approved")).alias("approved_count"))
    state = F.when(F.col("pending_count") > 0, "needs_review").when((F.col("n") > 0) & (F.col("approved_count") == 0), "no_approved").otherwise("ready")
    return counted.select(state.alias("state"), "pending_count", "approved_count")


# --- changes to the overlay: each takes the reviews as they are and gives them as they will be --------------------------


def edit_errors(edits: DataFrame) -> DataFrame:
    """``record_id, error``: edits that can't be saved."""
    c = F.col
    error = (
        F.when(~any_of(c("qc_status"), ("pending", "approved", "rejected")), "unknown qc_status")
        .when((blank(c("override_tier")) != "") & ~any_of(current_tier(c("override_tier")), K.TIERS), "unknown tier")
        .when((blank(c("override_tier")) != "") & (F.trim(blank(c("override_reason"))) == ""), "override_reason is required when override_tier is set")
    )
    return edits.select("record_id", error.alias("error")).where("error is not null")


def _with(reviews: DataFrame, edits: DataFrame) -> DataFrame:
    """Reviews (with defaults for records that have none) beside ``_e``, the edit of the record, null where there is none."""
    fields = default_review()
    mine = reviews.select("record_id", *[F.col(f) if f in reviews.columns else d.alias(f) for f, d in fields.items()])
    both = mine.join(edits.select("record_id", F.struct(*[c for c in edits.columns if c != "record_id"]).alias("_e")), "record_id", "full_outer")
    return both.withColumns({f: F.coalesce(F.col(f), d) if f in ("analyst_note", "qc_status", "extra_sales_angles", "signal_overrides") else F.col(f) for f, d in fields.items()})


def _noted(stamp: Column) -> Column:
    before = F.rtrim(blank(F.col("analyst_note")))
    return F.when(before != "", F.concat(before, F.lit("\n"), stamp)).otherwise(stamp)


def saved(reviews: DataFrame, edits: DataFrame, by: str, now: str) -> DataFrame:
    """Reviews after edits (analyst_note, override_tier, override_reason, qc_status): angles and overrides stay; bad edits change nothing."""
    good = edits.join(edit_errors(edits), "record_id", "left_anti")
    e, has = F.col("_e"), F.col("_e").isNotNull()
    reason = F.nullif(F.trim(blank(e.override_reason)), F.lit(""))
    new = {"analyst_note": F.trim(blank(e.analyst_note)), "override_tier": e.override_tier, "override_reason": reason, "qc_status": e.qc_status, "reviewed_by": F.lit(by), "reviewed_at": F.lit(now)}
    return _with(reviews, good).withColumns({k: F.when(has, v).otherwise(F.col(k)) for k, v in new.items()}).drop("_e")


def with_status(reviews: DataFrame, ids: DataFrame, status: str, by: str, now: str) -> DataFrame:
    """Reviews after a bulk change of qc_status; those that have it already stay; a reset to pending clears who and when."""
    hit = F.col("_e").isNotNull() & (F.col("qc_status") != status)
    who, at = (F.lit(None).cast("string"), F.lit(None).cast("string")) if status == "pending" else (F.lit(by), F.lit(now))
    new = {"reviewed_by": who, "reviewed_at": at, "qc_status": F.lit(status)}
    both = _with(reviews, ids.select("record_id", F.lit(1).alias("x")).distinct()).withColumn("_hit", hit)
    return both.withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in new.items()}).drop("_e", "_hit")


def with_override(reviews: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """Reviews after signal overrides (one a record: signal_id, override_state, source_url, override_note, override_by, engine_state).

    The first override of a signal keeps the engine's state as ``original_state``; later ones leave it.
    """
    e = F.col("_e")
    before = F.try_element_at("signal_overrides", e.signal_id)
    one = F.struct(e.signal_id.alias("signal_id"), e.override_state.alias("override_state"), e.source_url.alias("source_url"), e.override_note.alias("override_note"), e.override_by.alias("override_by"), F.lit(now).alias("override_at"), F.when(before.isNotNull(), before.original_state).otherwise(e.engine_state).alias("original_state")).cast(OVERRIDE)
    put = F.map_concat(F.map_filter("signal_overrides", lambda k, v: k != e.signal_id), F.create_map(e.signal_id, one))
    return _with(reviews, edits).withColumn("signal_overrides", F.when(e.isNotNull(), put).otherwise(F.col("signal_overrides"))).drop("_e")


def ruled(reviews: DataFrame, rulings: DataFrame, by: str, now: str) -> DataFrame:
    """Reviews after rulings on pairs (record_id, decision merge or separate, reason), with ``consolidation_decision``; without a reason nothing changes."""
    good = rulings.where("decision in ('merge', 'separate') and trim(coalesce(reason, '')) <> ''")
    e, has = F.col("_e"), F.col("_e").isNotNull()
    stamp = F.concat(F.lit(f"Consolidation review on {now[:10]}: "), F.when(e.decision == "separate", "keep separate").otherwise("merge"), F.lit(" — "), F.trim(e.reason))
    decision = F.struct(e.decision.alias("decision"), F.trim(e.reason).alias("reason"), F.lit(by).alias("decided_by"), F.lit(now).alias("decided_at"))
    new = {"analyst_note": _noted(stamp), "reviewed_by": F.lit(by), "reviewed_at": F.lit(now)}
    return _with(reviews, good).withColumns({k: F.when(has, v).otherwise(F.col(k)) for k, v in new.items()} | {"consolidation_decision": F.when(has, decision)}).drop("_e")


def stamped(reviews: DataFrame, ids: DataFrame, kind: str, now: str) -> DataFrame:
    """Reviews of re-enriched records: decisions stay, a dated line tells that the data under them changed."""
    has = F.col("_e").isNotNull()
    new = {"analyst_note": _noted(F.lit(f"Re-enriched on {now[:10]} ({kind}).")), "reviewed_at": F.lit(now)}
    return _with(reviews, ids.select("record_id", F.lit(1).alias("x")).distinct()).withColumns({k: F.when(has, v).otherwise(F.col(k)) for k, v in new.items()}).drop("_e")
