"""Views of reviewed records: exports, queues, comparisons, handoff accounts, display cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks import constants as K
from sieveworks.functions import urls
from sieveworks.functions.text import any_of, blank, collapse, first_filled, lookup, strip, titled, truncated
from sieveworks.operators.overlay import export_gate

HIDDEN = ("bullseye_score", "fit_signal_score", "confidence_score", "fit_confidence_status", "llm_model_used", "llm_prompt_version", "raw_input")
CLIENT_HIDDEN = ("internal_notes", "practice_name_source")
REVIEW_COLUMNS = ("qc_status", "analyst_note", "override_tier", "override_reason", "reviewed_by", "reviewed_at")


def ranked_by(x: Column, table: dict[str, int], other: int) -> Column:
    """A fixed rank for each value."""
    out = F.lit(other)
    for value, rank in table.items():
        out = F.when(x == value, rank).otherwise(out)
    return out


def territory_order(state: str = "address_state", city: str = "address_city", zip_: str = "address_zip", name: str = "practice_name") -> list[Column]:
    """State (blank ones last), city, ZIP, name."""
    up = lambda x: F.upper(strip(F.col(x)))
    return [up(state) == "", up(state), up(city), strip(F.col(zip_)), up(name)]


def queue_order() -> list[Column]:
    """Tier, confidence, score, each from the highest."""
    return [F.desc(ranked_by(F.col("displayed_tier"), K.QUEUE_RANK, K.QUEUE_RANK_ELSE)), F.desc("confidence_score"), F.desc("bullseye_score")]


def contact_queue(records: DataFrame) -> DataFrame:
    """Records to call, in order; excluded ones and those for manual review are left out."""
    return records.where(~any_of(F.col("displayed_tier"), (K.EXCLUDED, K.MANUAL))).orderBy(*queue_order())


def approved_order() -> list[Column]:
    """Approved records: score from the highest, then their order."""
    return [F.desc(F.coalesce("bullseye_score", F.lit(0))), F.asc("ordinal")]


def humanized(x: Column) -> Column:
    """A label; an id with underscores as words with capitals."""
    return F.when(F.contains(x, F.lit("_")), titled(F.replace(x, F.lit("_"), F.lit(" ")))).otherwise(x)


def exclusion_parts(reason: Column) -> Column:
    """The sentences of an exclusion reason; ids in them become words."""
    parts = F.filter(F.transform(F.split(blank(reason), r" \| "), strip), lambda p: p != "")
    whole = r"(\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b)"
    # Ids and what is between them, in turn.
    def one(p: Column) -> Column:
        ids = F.regexp_extract_all(p, F.lit(whole), F.lit(1))
        return F.array_join(F.transform(F.split(p, whole, -1), lambda x, i: F.concat(x, F.coalesce(humanized(F.get(ids, i)), F.lit("")))), "")

    return F.transform(parts, one)


def metro_label(geography: Column) -> Column:
    """Regions of a run in one cell."""
    return F.when(F.size(geography) > 0, F.array_join(geography, ", ")).otherwise("—")


def city_label(city: Column, state: Column, zip_: Column) -> Column:
    """``City (ZIP), ST`` or what there is of it."""
    c, s, z = strip(city), strip(state), strip(zip_)
    with_zip = F.when(c != "", F.concat(c, F.lit(" ("), z, F.lit("), "), s)).otherwise(F.concat(F.lit("("), z, F.lit("), "), s))
    return F.when((c == "") & (s == ""), "—").when(z != "", with_zip).when(c != "", F.concat(c, F.lit(", "), s)).otherwise(s)


def directions(name: Column, city: Column, state: Column, zip_: Column) -> Column:
    """A link to a map; empty without a name or any place."""
    n, c, s, z = (strip(x) for x in (name, city, state, zip_))
    joined = lambda by, *parts: F.array_join(F.filter(F.array(*parts), lambda p: p != ""), by)
    return F.when((n == "") | ((c == "") & (s == "") & (z == "")), "").otherwise(F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), urls.quoted(joined(", ", n, c, joined(" ", s, z)))))


# Labels of gates.
GATE_LABELS = {
    "practice_closed_or_inactive": "Inactive", "out_of_scope_specialty": "Out of scope", "health_system_affiliated": "Health system",
    "hospital_employed_physician": "Hospital-employed",
}


def gate_badge(gate: Column, signals: Column) -> Column:
    """The label of the gate that excluded a record: a fixed one, else that of its signal, else the id as words."""
    own = F.try_element_at(F.filter(signals, lambda s: s.signal_id == gate), F.lit(1))
    words = titled(F.replace(gate, F.lit("_"), F.lit(" ")))
    return F.when(blank(gate) == "", "").otherwise(F.coalesce(lookup(gate, GATE_LABELS), F.nullif(blank(own.signal_label), F.lit("")), words))


def gate_evidence(gate: Column, signals: Column, reason: Column) -> Column:
    """What speaks for the gate: its signal's quote with the source's domain, or the reason's first sentence."""
    own = F.try_element_at(F.filter(signals, lambda s: s.signal_id == gate), F.lit(1))
    quote, source = strip(own.evidence_text), strip(own.source_url)
    quoted = F.concat(F.lit('"'), quote, F.lit('"'))
    of_signal = F.when((quote != "") & (source != ""), F.concat(quoted, F.lit(" — "), urls.hostname(source))).when(quote != "", quoted).when(source != "", F.concat(F.lit("Identified via "), urls.hostname(source), F.lit("."))).otherwise("")
    first = F.try_element_at(F.split(blank(reason), r" \| "), F.lit(1))
    other = F.when(blank(reason) != "", first).otherwise("Identified via practice classification data.")
    return F.when(blank(gate) == "", "").when(~any_of(gate, tuple(GATE_LABELS)) & own.isNotNull(), of_signal).otherwise(other)


def motion(signals: Column) -> Column:
    """Whether a confirmed signal with a floor tells of a relation that is there already."""
    return F.when(F.exists(signals, lambda s: (s.signal_state == "yes") & (blank(s.floor_tier) != "")), "EXPAND").otherwise("NEW LOGO")


def next_step(signals: Column) -> Column:
    """The first wanted signal that was not found, as a step; null for none."""
    open_ = F.filter(signals, lambda s: (s.signal_state == "not_found") & (s.positive_weight > 0) & (blank(s.signal_label) != ""))
    return F.concat(F.lit("Confirm: "), humanized(F.try_element_at(open_, F.lit(1)).signal_label))


def evidence_slots(signals: Column, captured: Column, slots: int = K.EVIDENCE_SLOTS) -> dict[str, Column]:
    """Columns for the strongest observed signals with a quote and a source; unused ones are empty."""
    good = F.filter(signals, lambda s: (s.signal_state == "yes") & ~s.state_inferred & (strip(s.evidence_text) != "") & F.lower(strip(s.source_url)).rlike("^https?://") & (first_filled(s.signal_label, s.signal_id) != ""))
    order = F.array_sort(F.transform(good, lambda s, i: F.struct((-F.coalesce(s.positive_weight, F.lit(0.0))).alias("w"), blank(s.signal_id).alias("k"), i.alias("i"), s.alias("s"))))
    out = {}
    for n in range(1, slots + 1):
        s = F.try_element_at(order, F.lit(n)).s
        cells = {"id": s.signal_id, "claim": s.signal_label, "quote": truncated(s.evidence_text), "source_url": s.source_url, "captured": blank(captured)}
        out |= {f"signal_{n}_{k}": F.when(s.isNotNull(), blank(v)).otherwise("") for k, v in cells.items()}
    return out


def provider_cell(providers: Column) -> Column:
    """Providers with their credentials in one cell."""
    named = F.filter(providers, lambda p: strip(p["name"]) != "")
    return F.array_join(F.transform(named, lambda p: F.when(F.size(p["credentials"]) > 0, F.concat(strip(p["name"]), F.lit(", "), F.array_join(p["credentials"], ", "))).otherwise(strip(p["name"]))), " | ")


def location_label(group: Column, index: Column, count: Column) -> Column:
    """``Location 2 of 3`` for members of a group."""
    return F.when((blank(group) != "") & (count > 1) & (index > 0), F.format_string("Location %d of %d", index, count)).otherwise("")


def export(records: DataFrame, kind: str, client: bool = False) -> DataFrame:
    """The rows of an export in territory order: scalar columns that aren't hidden, evidence, providers, the review."""
    hidden = {*HIDDEN, "displayed_tier", *(CLIENT_HIDDEN if client else ())}
    scalar = [f.name for f in records.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and f.name not in hidden and not f.name.startswith("_")]
    columns = [F.col(x) for x in scalar]
    columns += [v.alias(k) for k, v in evidence_slots(F.col("signals"), F.col("date_enriched") if "date_enriched" in records.columns else F.lit("")).items()]
    if "providers" in records.columns:
        columns += [provider_cell(F.col("providers")).alias("providers_flat"), location_label(F.col("group_id"), F.col("location_index"), F.col("location_count")).alias("location_label")]
    columns.append(F.col("displayed_tier"))
    if not client:
        columns += [F.col(f"review.{x}").alias(f"review_{x}" if x in scalar else x) for x in REVIEW_COLUMNS]
    return records.where(export_gate(kind)).orderBy(*territory_order()).select(*columns)


def compared(a: DataFrame, b: DataFrame, name: str = "practice_name", city: str = "address_city") -> DataFrame:
    """Two runs side by side by name and city (of equal keys the last row): tiers, scores, what changed, and a sort key."""
    key = [F.lower(strip(F.col(name))).alias("k1"), F.lower(strip(F.col(city))).alias("k2")]
    side = lambda df, s: df.select(*key, F.col("ordinal"), F.struct(F.col(name).alias("name"), F.col(city).alias("city"), F.col("displayed_tier").alias("tier"), F.col("bullseye_score").alias("score")).alias("r")).groupBy("k1", "k2").agg(F.max_by("r", "ordinal").alias(s))
    both = side(a, "a").join(side(b, "b"), ["k1", "k2"], "full_outer")
    only = F.when(F.col("b").isNull(), "a").when(F.col("a").isNull(), "b")
    tier_a, tier_b = F.coalesce("a.tier", F.lit("—")), F.coalesce("b.tier", F.lit("—"))
    ra, rb = ranked_by(tier_a, K.COMPARE_RANK, 0), ranked_by(tier_b, K.COMPARE_RANK, 0)
    group = F.when(only.isNotNull(), 2).when(ra == rb, 1).otherwise(0)
    within = F.when(only == "a", 0).when(only == "b", 1).when(ra == rb, 0).when(rb > ra, -rb).otherwise(ra)
    return both.select(
        F.coalesce("a.name", "b.name").alias("practice_name"), F.coalesce("a.city", "b.city").alias("address_city"), tier_a.alias("tier_a"), F.col("a.score").alias("score_a"),
        tier_b.alias("tier_b"), F.col("b.score").alias("score_b"), only.alias("only_in"), (only.isNull() & (tier_a != tier_b)).alias("changed"),
        group.alias("sort_group"), within.alias("sort_within"),
    )


def profile_diff(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """``signal_id, status, fields``: definitions added, removed, changed or the same; an absent field differs from any value.

    Both sides have signal_id and ``given``, a map of the fields that a definition sets.
    """
    both = a.select("signal_id", F.col("given").alias("x")).join(b.select("signal_id", F.col("given").alias("y")), "signal_id", "full_outer")
    x, y = F.col("x"), F.col("y")
    pick = lambda m, f: F.when(F.map_contains_key(m, f), F.struct(F.try_element_at(m, F.lit(f)).alias("v")))
    differ = F.array_compact(F.array(*[F.when(~pick(x, f).eqNullSafe(pick(y, f)), F.struct(F.lit(f).alias("field"), F.try_element_at(x, F.lit(f)).alias("old"), F.try_element_at(y, F.lit(f)).alias("new"))) for f in fields]))
    status = F.when(x.isNull(), "added").when(y.isNull(), "removed").when(F.size(differ) > 0, "changed").otherwise("unchanged")
    return both.select("signal_id", status.alias("status"), F.when(status == "changed", differ).alias("fields"))


def link_report(links: DataFrame, results: DataFrame) -> DataFrame:
    """Occurrences of links with their verdicts; what was not checked is DEAD."""
    return links.join(results.select("url", "verdict"), "url", "left").withColumn("verdict", F.coalesce("verdict", F.lit("DEAD")))


def evidence_links(records: DataFrame) -> DataFrame:
    """``id, signal_id, url``: sources of confirmed signals in the two tiers that are called.

    What is not told is taken out of the list before it is dealt: a condition on rows would be moved down and judge every record's tier
    again from its response, for each place where the tier looks at signals.
    """
    called = any_of(F.col("displayed_tier"), (K.BULLSEYE, K.CONTENDER))
    told = F.filter(F.when(called, F.col("signals")), lambda s: (s.signal_state == "yes") & (s.source_url != ""))
    return records.select("id", F.explode(told).alias("s")).select("id", "s.signal_id", F.col("s.source_url").alias("url"))


def refreshed(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """``old`` with some fields from ``new`` by id, unless that would put a blocked crawl over a good one."""
    blocked = lambda x: any_of(x, ("limited", "failed"))
    both = old.join(new.select("id", F.struct("source_confidence", *[f for f in fields if f != "source_confidence"]).alias("_n")), "id", "left")
    take = F.col("_n").isNotNull() & ~(blocked(F.col("_n.source_confidence")) & ~blocked(F.col("source_confidence")))
    return both.withColumns({f: F.when(take, F.col(f"_n.{f}")).otherwise(F.col(f)) for f in fields}).drop("_n")


def resumed(records: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records still to do, finished ones): failed rows of a checkpoint are done again."""
    finished = done.where("enrichment_status <> 'failed'")
    return records.join(finished.select("id"), "id", "left_anti"), finished


def account(run_date: str) -> dict[str, Column]:
    """Columns of a handoff account from a reviewed record."""
    c = F.col
    tier = c("displayed_tier")
    city = F.array_join(F.filter(F.array(strip(c("address_city")), strip(c("address_state"))), lambda x: x != ""), ", ")
    place = F.array_join(F.filter(F.array(strip(c("address_street")), strip(c("address_city")), strip(c("address_state")), strip(c("address_zip"))), lambda x: x != ""), ", ")
    coverage = F.coalesce(F.try_divide(F.size(F.filter("signals", lambda s: s.signal_state == "yes")) * 100, F.size("signals")).cast("int"), F.lit(0))
    risks = F.size("call_brief.disqualifier_risk")
    objection = strip(c("call_brief.likely_objection"))
    landmine = F.array_join(F.concat(c("call_brief.disqualifier_risk"), F.when(objection != "", F.array(F.concat(F.lit("Likely objection: "), objection))).otherwise(F.array().cast("array<string>"))), " · ")
    return {
        "city": city, "domain": urls.two_labels(c("website_url")), "directions_url": F.when(place != "", F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), urls.quoted(place))).otherwise(""),
        "motion": F.when(tier == K.BULLSEYE, "Call now").when(tier == K.CONTENDER, "Qualify").when(tier == K.VERIFY, "Verify first").otherwise("Hold"),
        "ready": (tier == K.BULLSEYE) & (c("review.qc_status") == "approved"), "signal_coverage": coverage,
        "risk": F.when(risks == 0, "Low").when(risks == 1, "Moderate").otherwise("Elevated"), "landmine": landmine,
        "run_label": F.date_format(F.to_date(F.lit(run_date)), "MMMM dd, yyyy"), "expires": F.date_add(F.to_date(F.lit(run_date)), 30),
    }


def handoff(records: DataFrame, run_date: str) -> DataFrame:
    """Accounts in the order of the handoff: ready ones first, then by confidence and score."""
    cells = account(run_date)
    out = records.where(export_gate("handoff")).select("id", "practice_name", "displayed_tier", "confidence_score", "bullseye_score", *[v.alias(k) for k, v in cells.items()])
    return out.orderBy(F.desc("ready"), F.desc("confidence_score"), F.desc("bullseye_score"), "id")


def sections(records: DataFrame) -> DataFrame:
    """The internal view: reviewed records by section (the displayed tier), with cells for phone, signals, brief and review."""
    from sieveworks.functions.phones import displayed
    from sieveworks.operators.passes import tier_groups

    c = F.col
    confirmed = F.transform(F.filter("signals", lambda s: s.signal_state == "yes"), lambda s: humanized(F.when(blank(s.signal_label) != "", s.signal_label).otherwise(s.signal_id)))
    dash = lambda x: F.when(blank(c(x)) != "", c(x)).otherwise("—")
    out = tier_groups(records)
    return out.select(
        "place", c("tier_group").alias("section"), "id", dash("practice_name").alias("name"), dash("specialty").alias("specialty"), city_label(c("address_city"), c("address_state"), F.lit("")).alias("location"),
        displayed(c("phone")).alias("phone"), confirmed.alias("confirmed_signals"), F.filter("sales_angle", lambda a: ~first_person(a)).alias("sales_angles"), blank(c("tier_cap_reason")).alias("tier_cap_reason"),
        blank(c("exclusion_reason")).alias("exclusion_reason"), c("review.analyst_note").alias("analyst_note"), c("review.qc_status").alias("qc_status"),
    )


def discovery_handoff(told: DataFrame, rows: DataFrame, run_id: str) -> DataFrame:
    """The fifteen columns by which a discovery run hands its rows to an enrichment; ``told`` are classified rows with their reasons."""
    from sieveworks.operators.match import change_text

    c = F.col
    raw = {
        "name": "practice_name", "site": "website_url", "phone": "phone", "full_address": "address_full", "city": "address_city", "state": "address_state",
        "postal_code": "address_zip", "type": "google_category", "place_id": "google_place_id", "npi": "npi",
    }
    both = told.join(rows.select("row_idx", *[blank(c(v)).alias(f"_{k}") for k, v in raw.items()]), "row_idx")
    return both.select(
        *[c(f"_{k}").alias(k) for k in raw], F.lit(run_id).alias("discovery_run_id"), c("classification").alias("discovery_status"), c("reason").alias("discovery_reason"),
        blank(c("entry_id")).alias("matched_existing_record_id"), change_text(c("changed_fields")).alias("changed_fields"),
    )


def brief_of(records: DataFrame, ids: list[str]) -> DataFrame:
    """The records of a brief of three accounts; all must be there."""
    if len(set(ids)) != 3:
        raise ValueError("a brief has three accounts")
    found = records.where(F.col("id").isin(ids))
    if found.count() != 3:
        raise LookupError("not all accounts of the brief are there")
    return found


def client_reason(x: Column) -> Column:
    """A cap reason without internal scores."""
    out = F.regexp_replace(blank(x), r"Score \d+ is below the \d+-point evidence floor", "Evidence on the site is limited")
    return collapse(F.regexp_replace(out, r"Score is below the Bullseye threshold\.", "Further qualification recommended."))


def first_person(x: Column) -> Column:
    """Whether a sales angle speaks as the seller."""
    return x.rlike(r"(?i)\b(we|our|us|i|my|i'm|we're|we'd|i'd)\b")
