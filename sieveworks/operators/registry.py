"""The registry of known practices: eligibility, upsert with rejection of ambiguous rows, preview, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.functions.text import blank, short_hash
from sieveworks.operators import match
from sieveworks.operators.graph import ONE_TASK, first_come, written

HISTORY = "array<struct<field:string,old:string,new:string,changed_at:string,enrichment_run_id:string>>"
KEYS = ("google_place_id", "website_domain", "phone_digits", "name_normalized", "address_normalized", "npi")
ENTRY = ("entry_id", *KEYS, *K.HISTORY_FIELDS, "first_seen_at", "last_seen_at", "first_discovery_run_id", "last_discovery_run_id", "last_enrichment_run_id")
#: Commercial fields that no entry keeps.
PRUNED = ("last_tier", "last_score", "target_tier", "bullseye_score")


def rejection(include_needs_review: bool = False) -> Column:
    """Why a record can't enter the registry; null if it can."""
    c = lambda x: blank(F.col(x))
    identity = (c("practice_name") != "") & ((c("google_place_id") != "") | (c("website_domain") != "") | (F.length(c("phone_digits")) >= 10) | ((c("name_normalized") != "") & (c("address_normalized") != "")))
    return (
        F.when(c("enrichment_status") == "failed", "enrichment_status is 'failed'")
        .when(c("exclusion_status") == "EXCLUDED", "record is EXCLUDED — excluded records never enter the registry")
        .when((c("enrichment_status") == "needs_review") & F.lit(not include_needs_review), "record is needs_review (set include_needs_review to override)")
        .when(~identity, "missing minimum identity fields (name + a match key)")
    )


def mode_allows(mode: str) -> Column:
    """Whether a record belongs to a selection mode."""
    clear = F.col("exclusion_status") == "CLEAR"
    return {
        "bullseye_only": clear & (F.col("target_tier") == K.BULLSEYE), "clear_only": clear,
        "all_reviewable": clear & ~F.col("enrichment_status").isin("failed", "needs_review"),
    }[mode]


def chosen(records: DataFrame, ids: list[str] | None = None, mode: str | None = None) -> DataFrame:
    """Records by ids, in their order, or by a mode; an unknown id is an error."""
    if (ids is None) == (mode is None):
        raise ValueError("give either ids or a mode")
    if mode is not None:
        return records.where(mode_allows(mode))
    found = records.where(F.col("id").isin(ids))
    missing = set(ids) - {r["id"] for r in found.select("id").collect()}  # no more rows than ids
    if missing:
        raise LookupError(f"unknown record ids: {sorted(missing)}")
    return found.withColumn("ordinal", F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id")))


def upsert(records: DataFrame, entries: DataFrame, run_id: str, now: str, discovery_run_id: str = "", include_needs_review: bool = False, one_task: int = ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """(entries after the run, one log row per record: ``record_id, outcome, reason, entry_id``).

    Records come in order of ``ordinal``. Each meets the entries as they were and those that earlier records of the run made;
    who makes an entry takes its keys, in order (``first_come``). Records whose keys lead to several entries change nothing.
    """
    c = F.col
    rows = records.withColumns(match.fields_from_record()).withColumn("row_idx", c("ordinal").cast("long"))
    rows = written(rows.withColumn("reason", rejection(include_needs_review)), "upsert")
    fit = rows.where("reason is null")
    keys = match.exploded_keys(fit, "row_idx")
    index = match.registry_index(entries)
    hits = written(keys.join(index, ["basis", "value"], "left").select("row_idx", "priority", "basis", "value", "entry_id"), "hits")
    # A row that meets no entry makes one and takes its keys, unless an earlier row of the run took one of them.
    key = F.concat_ws("|", "basis", "value")
    new = hits.groupBy("row_idx").agg(F.max(c("entry_id").isNotNull()).alias("known")).where("not known").select("row_idx")
    owners = first_come(hits.join(new, "row_idx", "left_semi").select(c("row_idx").alias("row"), key.alias("key")), one_task)
    met = hits.select("row_idx", "entry_id", key.alias("key")).join(owners, "key", "left")
    made = F.when(c("owner") < c("row_idx"), F.concat(F.lit("new-"), c("owner").cast("string")))
    found = met.groupBy("row_idx").agg(F.collect_set(F.coalesce(made, "entry_id")).alias("found"))  # a row has four keys at most
    size = F.size("found")
    outcome = F.when(size > 1, "ambiguous").when(size == 1, "updated").otherwise("inserted")
    entry = F.when(size == 1, F.try_element_at("found", F.lit(1))).when(size == 0, F.concat(F.lit("new-"), c("row_idx").cast("string")))
    ruled = written(found.select("row_idx", entry.alias("entry_id"), outcome.alias("outcome")), "ruled")
    new_id = lambda x: F.when(x.startswith("new-"), F.concat(F.lit("R-"), short_hash(F.lit(run_id), x))).otherwise(x)
    ruled = ruled.withColumn("entry_id", new_id(c("entry_id")))
    log = rows.select("row_idx", c("id").alias("record_id"), "reason").join(ruled, "row_idx", "left")
    log = log.select("record_id", F.when(c("reason").isNotNull(), "rejected").otherwise(F.when(c("outcome") == "ambiguous", "needs_manual_merge").otherwise(c("outcome"))).alias("outcome"), F.coalesce("reason", F.when(c("outcome") == "ambiguous", "matches multiple existing registry entries")).alias("reason"), "entry_id")
    # Every entry takes its records in order; a value that changes is added to its history.
    events = fit.join(ruled.where("outcome <> 'ambiguous'"), "row_idx")
    values = F.struct("row_idx", *[c(f).alias(f) for f in (*KEYS, *K.HISTORY_FIELDS)])
    per = events.groupBy("entry_id").agg(F.array_sort(F.collect_list(values)).alias("u"))
    top = entries.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("_top"))
    joined = entries.join(per, "entry_id", "full_outer").join(F.broadcast(top))
    old = c("last_seen_at").isNotNull()
    none = F.array().cast(HISTORY)

    def stepped(f: str) -> Column:
        before = F.when(old, blank(c(f))).otherwise(F.try_element_at("u", F.lit(1))[f])
        start = F.struct(before.alias("v"), none.alias("h"))
        step = lambda acc, u: F.struct(
            F.when(u[f] != "", u[f]).otherwise(acc.v).alias("v"),
            F.when((u[f] != "") & (u[f] != acc.v), F.concat(acc.h, F.array(F.struct(F.lit(f).alias("field"), acc.v.alias("old"), u[f].alias("new"), F.lit(now).alias("changed_at"), F.lit(run_id).alias("enrichment_run_id"))).cast(HISTORY))).otherwise(acc.h).alias("h"),
        )
        return F.aggregate(F.coalesce("u", F.array().cast(per.schema["u"].dataType)), start.cast(f"struct<v:string,h:{HISTORY}>"), lambda acc, u: step(acc, u).cast(f"struct<v:string,h:{HISTORY}>"))

    folded = joined.withColumns({f"_{f}": stepped(f) for f in K.HISTORY_FIELDS})
    latest = lambda f: F.coalesce(F.try_element_at(F.filter(F.transform("u", lambda u: u[f]), lambda x: x != ""), F.lit(-1)), blank(c(f)))
    touched = c("u").isNotNull()
    history = F.concat(F.coalesce("change_history", none), *[c(f"_{f}.h") for f in K.HISTORY_FIELDS])
    out = folded.select(
        "entry_id", *[latest(f).alias(f) for f in KEYS], *[c(f"_{f}.v").alias(f) for f in K.HISTORY_FIELDS],
        F.coalesce("first_seen_at", F.lit(now)).alias("first_seen_at"), F.when(touched, now).otherwise(c("last_seen_at")).alias("last_seen_at"),
        F.coalesce("first_discovery_run_id", F.lit(discovery_run_id)).alias("first_discovery_run_id"),
        F.when(touched & F.lit(bool(discovery_run_id)), discovery_run_id).otherwise(F.coalesce("last_discovery_run_id", F.lit(discovery_run_id))).alias("last_discovery_run_id"),
        F.when(touched, run_id).otherwise(c("last_enrichment_run_id")).alias("last_enrichment_run_id"), history.alias("change_history"),
        F.coalesce(c("ordinal"), c("_top") + 1 + F.try_element_at("u", F.lit(1)).row_idx).alias("ordinal"),
    )
    return out, log


def preview(results: DataFrame, rows: DataFrame, entries: DataFrame, run_id: str) -> DataFrame:
    """``entry_id, status`` and the registry's fields as they would be after a discovery run: new rows added, changed ones replaced."""
    c = F.col
    fields = ("google_place_id", "website_domain", "phone_digits", "name_normalized", "address_normalized", "practice_name", "google_category")
    both = results.join(rows.select("row_idx", *fields), "row_idx")
    new = both.where("classification = 'NEW'").select(F.concat(F.lit("P-"), short_hash(F.lit(run_id), c("row_idx").cast("string"))).alias("entry_id"), F.lit("new").alias("status"), *fields)
    last = both.where("classification = 'CHANGED'").groupBy("entry_id").agg(*[F.max_by(F.nullif(c(f), F.lit("")), F.when(blank(c(f)) != "", c("row_idx"))).alias(f"_{f}") for f in fields if f != "google_place_id"])
    kept = entries.join(last.withColumn("_hit", F.lit(True)), "entry_id", "left")
    kept = kept.select("entry_id", F.when(c("_hit"), "changed").otherwise("kept").alias("status"), "google_place_id", *[F.coalesce(f"_{f}", f).alias(f) for f in fields if f != "google_place_id"])
    return kept.unionByName(new)


def pruned(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries without commercial fields, one row with how many values of each went)."""
    gone = [f for f in PRUNED if f in entries.columns]
    counts = entries.agg(F.count("*").alias("entries"), *[F.count(f).alias(f) for f in gone])
    return entries.drop(*gone), counts
