"""Passes over the records of a finished run: new customers, new responses, merges of re-enriched records, pruned rosters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.text import any_of, blank, strip
from sieveworks.operators import match, metrics, rules, views
from sieveworks.operators import signals as S
from sieveworks.operators.graph import written

# The fields that a re-enrichment refreshes; the others are the roster's own.
REFRESHED = (
    "signals", "sales_angle", "call_brief", "bullseye_score", "fit_signal_score", "confidence_score", "confidence_band", "fit_confidence_status",
    "target_tier", "tier_cap_reason", "exclusion_status", "exclusion_reason", "enrichment_status", "source_confidence", "date_enriched", "website_url",
)


def rechecked(records: DataFrame, customers: DataFrame) -> DataFrame:
    """Records with ``outcome``: ``already`` suppressed (by a mark, or excluded and matched), ``newly`` to suppress, or null; and the reason found."""
    marked = F.coalesce("customer_suppressed", F.lit(False))
    was = blank(F.col("suppression_reason")) if "suppression_reason" in records.columns else F.lit("")
    found = match.suppression(records.withColumns({"_marked": marked, "_was": was}), customers)
    hit, out = F.col("customer_suppressed"), F.col("exclusion_status") == "EXCLUDED"
    outcome = F.when(F.col("_marked") | hit & F.coalesce(out, F.lit(False)), "already").when(hit, "newly")
    reason = F.when(F.col("outcome") == "newly", F.col("suppression_reason")).otherwise(F.col("_was"))
    return found.withColumn("outcome", outcome).withColumns({"customer_suppressed": F.col("_marked") | hit, "suppression_reason": reason}).drop("_marked", "_was")


def suppression_counts(checked: DataFrame) -> DataFrame:
    """One row: newly suppressed, already suppressed, total; of ``rechecked`` records. It is the preview and the pass's report."""
    return checked.agg(F.count_if(F.col("outcome") == "newly").alias("newly_suppressed"), F.count_if(F.col("outcome") == "already").alias("already_suppressed"), F.count("*").alias("total"))


def suppressed(records: DataFrame, customers: DataFrame, config: rules.RunConfig) -> tuple[DataFrame, DataFrame]:
    """(records after the pass, its counts): newly matched records are decided and finalized again, the others stay as they are."""
    checked = written(rechecked(records, customers), "suppressed")
    new = checked.where("outcome = 'newly'").drop("outcome")
    rest = checked.where("outcome is null or outcome <> 'newly'").drop("outcome")
    kept = rest.select(*records.columns, *(c for c in rest.columns if c not in records.columns))
    return kept.unionByName(rules.finalized(rules.decided(new, config)).select(*kept.columns), allowMissingColumns=True), suppression_counts(checked)


def reextractable() -> Column:
    """Whether a record's signals can be read again: it was enriched, is not excluded and has stored text."""
    fresh = F.coalesce(F.col("enrichment_status") == "not_enriched", F.lit(False))
    out = F.coalesce(F.col("exclusion_status") == "EXCLUDED", F.lit(False))
    return ~fresh & ~out & (strip(F.col("context_text")) != "")


def reextracted(records: DataFrame, responses: DataFrame, defs: Sequence[S.SignalDef], config: rules.RunConfig) -> tuple[DataFrame, DataFrame]:
    """(records after the pass, ``old_tier, new_tier, score_changed, n`` of those that were read again).

    Eligible records with a response get new signals, scores and tiers; one without a response failed and stays as it was.
    """
    from sieveworks.plans import enrichment

    rows = enrichment.shaped(records)
    again = rows.where(reextractable()).withColumns({"exclusion_status": F.lit("CLEAR"), "exclusion_reason": F.lit(None).cast("string"), "target_tier": F.lit("")})
    done = written(rules.finalized(rules.decided(enrichment.scored(enrichment.signalled(again, responses, defs, "inner"), defs), config)), "reextracted")
    # A written table is packed: by its size, Spark would gather all of its ids on the driver and send them to every task.
    kept = rows.join(done.select("id").hint("merge"), "id", "left_anti")
    return kept.unionByName(done, allowMissingColumns=True), metrics.transitions(records, done.hint("merge"))


def reenriched(records: DataFrame, new: DataFrame) -> DataFrame:
    """Records with the refreshed fields of ``new`` by id, unless that puts a blocked crawl over a good one; the verification goes."""
    fields = [f for f in REFRESHED if f in records.columns and f in new.columns]
    return views.refreshed(records, new, fields).drop("verification")


def pruned_roster(records: DataFrame, ids: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """(records without ``ids``, one row ``removed, remaining``); only a roster that was not enriched yet can be pruned."""
    if status != "ingested":
        raise ValueError("a roster can be pruned before enrichment starts only")
    left = records.join(ids.select("id").distinct(), "id", "left_anti")
    counts = records.agg(F.count("*").alias("n")).join(F.broadcast(left.agg(F.count("*").alias("remaining"))))
    return left, counts.select((F.col("n") - F.col("remaining")).alias("removed"), "remaining")


def brief_stale(reviews: DataFrame, published_at: str | None) -> DataFrame:
    """One row ``stale, newest``: whether a review or a signal override is newer than what was published. Unreadable times don't count."""
    times = F.transform(F.map_values(F.coalesce("signal_overrides", F.create_map().cast("map<string,struct<override_at:string>>"))), lambda o: o.override_at) if "signal_overrides" in reviews.columns else F.array().cast("array<string>")
    every = F.concat(F.array("reviewed_at"), times)
    newest = F.array_max(F.transform(every, lambda t: blank(t).try_cast("timestamp")))
    told = reviews.agg(F.max(newest).alias("newest"))
    return told.select(F.coalesce(F.col("newest") > F.lit(published_at).try_cast("timestamp"), F.lit(False)).alias("stale"), "newest")


def manifest(records: DataFrame, run: dict[str, str | None]) -> DataFrame:
    """One row: what a package says of its run, with the numbers of records screened, approved and excluded."""
    from sieveworks.operators.overlay import approved

    said = [F.lit(run.get(k)).cast("string").alias(k) for k in ("run_id", "generated_at", "client_name", "project_id", "product_name", "target_specialty", "icp_profile_id", "icp_profile_name", "icp_profile_version")]
    counts = (F.count("*").alias("records_screened"), F.count_if(approved()).alias("records_approved"), F.count_if(F.col("exclusion_status") == "EXCLUDED").alias("records_excluded"))
    return records.agg(*counts).select(*said, "records_screened", "records_approved", "records_excluded")


def tier_groups(records: DataFrame) -> DataFrame:
    """Reviewed records with ``tier_group`` (the displayed tier, Manual Review for unknown ones) and their ``place`` by tier, then score."""
    from sieveworks import constants as K
    from sieveworks.operators.graph import placed

    group = F.when(any_of(F.col("displayed_tier"), K.TIERS), F.col("displayed_tier")).otherwise(K.MANUAL)
    order = F.array_position(F.array(*[F.lit(t) for t in K.TIERS]), group)
    return placed(records.withColumn("tier_group", group), [order, F.desc(F.coalesce("bullseye_score", F.lit(0))), F.asc("id")])
