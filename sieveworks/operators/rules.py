"""Exclusion rules, tiers, the canary and the final shape of a record. All but the canary are expressions over one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.functions import names
from sieveworks.functions.text import any_of, blank, lookup, strip
from sieveworks.operators import signals as S

RULES = "array<struct<rule:string,rationale:string>>"


@dataclass(frozen=True)
class RunConfig:
    """What a run is asked to look for."""

    target_specialty: str = ""
    target_geography: tuple[str, ...] = ()
    active_exclusion_rules: tuple[str, ...] = ()
    bullseye_min_score: int = K.BULLSEYE_MIN
    taxonomy_exclusion_rules: Mapping[str, str] = field(default_factory=dict)
    max_structural_exclusion_share: float = K.CANARY_SHARE


def _fired(*rules: tuple[str | Column, Column, str | Column]) -> Column:
    """(rule, condition, rationale) as the array of those that hold, in order."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(as_column(r).alias("rule"), as_column(t).alias("rationale"))) for r, c, t in rules])).cast(RULES)


def outside(state: Column, geography: Sequence[str]) -> Column:
    """Whether a state is known and none of those asked for."""
    wanted = [g.strip().upper() for g in geography]
    return (F.upper(strip(state)) != "") & ~any_of(F.upper(strip(state)), wanted) if wanted else F.lit(False)


def taxonomy_rules(codes: Column, rules: Mapping[str, str]) -> Column:
    """Names of the rules whose taxonomy code a record has, in the rules' order."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.array_contains(codes, code), F.lit(name)) for code, name in rules.items()]))


def structural(config: RunConfig, specialty: Column, url: Column, state: Column, taxonomy: Column) -> Column:
    """Exclusions that the source row alone decides, in order. Unknown and missing values never exclude."""
    kind = strip(specialty)
    known = (kind != "") & (F.lower(kind) != "unknown") & F.lit(bool(config.target_specialty.strip()))
    first = _fired(
        ("wrong_specialty", known & ~names.specialty_fits(kind, config.target_specialty), F.concat(F.lit("Practice specialty '"), kind, F.lit(f"' does not match target specialty '{config.target_specialty}'."))),
        ("no_web_presence", F.lit("no_web_presence" in config.active_exclusion_rules) & (strip(url) == ""), "No website URL on the source row — the practice cannot be screened, so it was excluded before any crawl or LLM spend."),
        ("outside_geography", outside(state, config.target_geography), F.concat(F.lit("Practice is in "), blank(state), F.lit(f", outside target geography ({', '.join(config.target_geography)})."))),
    )
    coded = F.filter(F.coalesce(taxonomy, F.array().cast("array<string>")), lambda r: any_of(r, config.active_exclusion_rules))
    return F.concat(first, F.transform(coded, lambda r: F.struct(r.alias("rule"), F.concat(F.lit("Excluded via NPI taxonomy structural gate (rule: '"), r, F.lit("') — excluded before crawl.")).alias("rationale"))).cast(RULES))


def exclusions(config: RunConfig, structural_rules: Column, signals: Column, triggers: Column, rationale: Column, url: Column, context: Column) -> Column:
    """``struct<rules, reason, gate>`` after enrichment: structural rules, a model's triggers, no web presence, signals."""
    none = F.array().cast("array<string>")
    have = F.transform(structural_rules, lambda r: r.rule)
    said = F.array_sort(F.array_distinct(F.coalesce(triggers, none)))
    hard = F.filter(said, lambda t: any_of(t, K.HARD_RULES[2:]))
    soft = F.filter(said, lambda t: any_of(t, set(K.CONFIGURABLE_RULES) & set(config.active_exclusion_rules)))
    rules = F.array_union(F.array_union(have, hard), soft)
    why = strip(rationale)
    reasons = F.filter(F.transform(structural_rules, lambda r: r.rationale), lambda r: r.isNotNull())
    from_model = (why != "") & ((F.size(hard) > 0) | ((F.size(soft) > 0) & ~F.array_contains(reasons, why)))
    reasons = F.when(from_model, F.concat(reasons, F.array(why))).otherwise(reasons)
    absent = F.lit("no_web_presence" in config.active_exclusion_rules) & ~F.array_contains(rules, "no_web_presence") & (strip(url) == "") & (strip(context) == "")
    reasons = F.when(absent, F.concat(reasons, F.array(F.lit("No valid website URL and no public web presence detected.")))).otherwise(reasons)
    rules = F.when(absent, F.concat(rules, F.array(F.lit("no_web_presence")))).otherwise(rules)
    yes = F.transform(F.filter(signals, lambda s: s.signal_state == "yes"), lambda s: s.signal_id)
    against = F.filter(signals, lambda s: s.exclude_if_yes & (s.signal_state == "yes") & ~F.coalesce(F.array_contains(yes, s.inhibited_by), F.lit(False)))
    against = F.filter(against, lambda s: ~F.array_contains(rules, s.signal_id))
    own = F.array_distinct(F.transform(against, lambda s: s.signal_id))
    labels = F.transform(against, lambda s: F.concat(F.when(blank(s.signal_label) != "", s.signal_label).otherwise(s.signal_id), F.lit(" confirmed present (immediate exclusion).")))
    every, reasons = F.concat(rules, own), F.concat(reasons, labels)
    reason = F.when(F.size(reasons) > 0, F.array_join(reasons, " | ")).otherwise(F.concat(F.lit("Exclusion rules triggered: "), F.array_join(every, ", ")))
    return F.struct(every.alias("rules"), F.when(F.size(every) > 0, reason).alias("reason"), primary_gate(every).alias("gate"))


def primary_gate(rules: Column) -> Column:
    """The gate of highest priority among the rules that fired; empty for none."""
    hit = lambda raw: F.arrays_overlap(rules, F.array(*[F.lit(r) for r in raw]))
    out = F.when(hit(K.GATES[0][1]), K.GATES[0][0]).when(hit(K.GATES[1][1]), K.GATES[1][0])
    own = F.array_min(F.filter(rules, lambda r: ~any_of(r, K.HARD_RULES + K.CONFIGURABLE_RULES)))
    out = out.when(own.isNotNull(), own)
    for gate, raw in K.GATES[2:]:
        out = out.when(hit(raw), gate)
    return out.otherwise(F.coalesce(F.try_element_at(rules, F.lit(1)), F.lit("")))


def current_tier(x: Column) -> Column:
    """A tier under its current name."""
    return F.coalesce(lookup(x, K.LEGACY_TIERS), x)


def _rank(x: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in K.TIER_RANK.items():
        out = F.when(current_tier(x) == name, rank).otherwise(out)
    return out


def tier(signals: Column, score: Column, enrichment: Column, source_confidence: Column, least: int = K.BULLSEYE_MIN) -> Column:
    """``struct<tier, reason>`` of a record that nothing excludes.

    Order of decisions: too little evidence; thin source; an unconfirmed qualifier; then the lower of the rank reached
    (must-haves or score, lifted by floors) and all caps. A record that cannot be judged, for want of a score or because a
    comparison has no result, goes to manual review; missing signals count as none.
    """
    signals = F.coalesce(signals, F.array().cast(f"array<{S.SIGNAL}>"))
    name = lambda s: F.when(blank(s.signal_label) != "", s.signal_label).when(blank(s.signal_id) != "", s.signal_id).otherwise("a required signal")
    enriched = ~F.coalesce(enrichment == "not_enriched", F.lit(False))
    yes = lambda s: s.signal_state == "yes"
    floor = F.when(enriched, F.coalesce(F.array_max(F.transform(F.filter(signals, yes), lambda s: _rank(s.floor_tier))), F.lit(-1))).otherwise(-1)
    evidence = F.exists(signals, lambda s: yes(s) | s.state_inferred)
    thin = enriched & (~evidence | (score < K.EVIDENCE_FLOOR)) & (floor < 0)
    must = F.filter(signals, lambda s: s.required_for_bullseye)
    promoted = (F.size(must) > 0) & F.forall(must, yes) & (score >= K.EVIDENCE_FLOOR)
    rank = F.greatest(F.when(promoted | (score >= least), K.TIER_RANK[K.BULLSEYE]).otherwise(K.TIER_RANK[K.CONTENDER]), floor)
    unread = enriched & any_of(source_confidence, K.SOURCE_CONFIDENCES[2:])
    missing = F.filter(signals, lambda s: s.required_for_contender & ~yes(s) & ~s.state_inferred)
    first = F.try_element_at(missing, F.lit(1))
    cap = lambda keep, rank_of, why: F.transform(F.filter(signals, keep), lambda s: F.struct(rank_of(s).alias("rank"), why(s).alias("why")))
    verify, contender = K.TIER_RANK[K.VERIFY], K.TIER_RANK[K.CONTENDER]
    quoted = lambda s: F.concat(F.lit("'"), name(s), F.lit("'"))
    caps = F.concat(
        cap(lambda s: yes(s) & _rank(s.cap_tier).isNotNull(), lambda s: _rank(s.cap_tier), lambda s: F.concat(name(s), F.lit(" confirmed → capped at "), current_tier(s.cap_tier), F.lit("."))),
        cap(
            lambda s: s.required_for_bullseye & ~s.state_inferred & ~yes(s),
            lambda s: F.when(s.signal_state == "no", contender).otherwise(verify),
            lambda s: F.concat(F.lit("Must-have "), quoted(s), F.when(s.signal_state == "no", " confirmed absent → capped at Contender.").otherwise(" not found on the site → needs verification.")),
        ),
        cap(lambda s: s.verification_required & (s.signal_state == "not_found") & ~s.state_inferred, lambda s: F.lit(verify), lambda s: F.concat(quoted(s), F.lit(" needs verification before Bullseye."))),
    )
    final = F.least(rank, F.coalesce(F.array_min(F.transform(caps, lambda c: c["rank"])), F.lit(3)))
    ordered = F.array_sort(F.transform(caps, lambda c, i: F.struct(c["rank"].alias("rank"), i.alias("i"), c.why.alias("why"))))
    short = F.when((score < least) & ~promoted, F.array(F.lit("Score is below the Bullseye threshold."))).otherwise(F.array().cast("array<string>"))
    reasons = F.array_join(F.concat(F.transform(ordered, lambda c: c.why), short), " ")
    by_rank = F.lit(None).cast("string")
    for label, number in K.TIER_RANK.items():
        by_rank = F.when(final == number, label).otherwise(by_rank)
    manual = F.coalesce(thin | unread | (F.size(missing) > 0), F.lit(True)) | score.isNull() | by_rank.isNull()
    reason = (
        F.when(thin & ~evidence, "No confirmed signals on the site — manual review required before calling.")
        .when(score.isNull(), "")
        .when(thin, F.concat(F.lit("Score "), score.cast("string"), F.lit(f" is below the {K.EVIDENCE_FLOOR}-point evidence floor — too thin to call without review.")))
        .when(unread, "Website could not be reliably crawled — re-crawl with browser or paste page content before calling.")
        .when(F.size(missing) > 0, F.concat(name(first), F.lit(" not confirmed (required to qualify) — manual review required before calling.")))
        .when(final < K.TIER_RANK[K.BULLSEYE], reasons)
        .otherwise("")
    )
    return F.struct(F.when(manual, K.MANUAL).otherwise(by_rank).alias("tier"), reason.alias("reason"))


def decided(records: DataFrame, config: RunConfig) -> DataFrame:
    """Records with exclusion_status, exclusion_reason, exclusion_primary_gate, target_tier, tier_cap_reason and the capped score.

    Needs the columns specialty, website_url, address_state, taxonomy_exclusions, signals, bullseye_score, enrichment_status,
    source_confidence, exclusion_triggers, exclusion_rationale, context_text, customer_suppressed and suppression_reason.
    It fails closed: a decision that cannot be made is Manual Review and never excludes; ``undecided`` lists these records.
    """
    c = F.col
    found = exclusions(config, structural(config, c("specialty"), c("website_url"), c("address_state"), c("taxonomy_exclusions")), c("signals"), c("exclusion_triggers"), c("exclusion_rationale"), c("website_url"), c("context_text"))
    out = records.withColumn("_found", found).withColumn("_suppressed", F.coalesce(c("customer_suppressed"), F.lit(False)))
    out = out.withColumn("_excluded", c("_suppressed") | F.coalesce(F.size("_found.rules") > 0, F.lit(False)))
    out = out.withColumn("_tier", tier(c("signals"), c("bullseye_score"), c("enrichment_status"), c("source_confidence"), config.bullseye_min_score))
    reason = F.when(c("_suppressed"), F.when(blank(c("suppression_reason")) != "", c("suppression_reason")).otherwise("Existing customer")).otherwise(c("_found.reason"))
    return out.withColumns(
        {
            "exclusion_status": F.when(c("_excluded"), "EXCLUDED").otherwise("CLEAR"),
            "exclusion_reason": F.when(c("_excluded"), reason),
            "exclusion_primary_gate": F.when(c("_excluded") & ~c("_suppressed"), c("_found.gate")).otherwise(""),
            "target_tier": F.when(c("_excluded"), K.EXCLUDED).otherwise(F.coalesce("_tier.tier", F.lit(K.MANUAL))),
            "tier_cap_reason": F.when(c("_excluded"), "").otherwise(blank(c("_tier.reason"))),
            "bullseye_score": F.when(c("_excluded"), F.least(c("bullseye_score"), F.lit(K.EXCLUDED_CAP))).otherwise(c("bullseye_score")),
        }
    ).drop("_found", "_suppressed", "_excluded", "_tier")


def undecided(records: DataFrame) -> DataFrame:
    """``record_id, step, error, resolution``: a log row for each record that ``decided`` sends to manual review unjudged."""
    message = F.when(F.col("bullseye_score").isNull(), "no score").otherwise("no signals")
    open_ = records.where("(bullseye_score is null or signals is null) and not coalesce(customer_suppressed, false)")
    return open_.select(F.coalesce("id", F.lit("unknown")).alias("record_id"), F.lit("exclusion_check").alias("step"), message.alias("error"), F.lit("Exclusion check failed; routed to Manual Review (fail-closed)").alias("resolution"))


def ingested(records: DataFrame, config: RunConfig) -> DataFrame:
    """Records of a roster that nothing was crawled for: structural exclusions and the final shape; open ones are contenders."""
    zero = {x: F.lit(0) for x in ("bullseye_score", "fit_signal_score", "confidence_score")}
    rows = prescreened(records, config).withColumns(zero | {"signals": F.array().cast(f"array<{S.SIGNAL}>")})
    return finalized(rows.withColumn("target_tier", F.when(F.size("rules") > 0, K.EXCLUDED).otherwise(K.CONTENDER)))


def canary_block(told: DataFrame, acknowledged: bool = False) -> DataFrame:
    """Rows of ``canary`` with ``blocked`` and ``message``: a tripped canary keeps a run from clients until it is acknowledged."""
    c = F.col
    by_name = F.array_sort("rules", lambda x, y: F.when(x["n"] != y["n"], F.when(x["n"] > y["n"], -1).otherwise(1)).otherwise(F.when(x["rule"] < y["rule"], -1).when(x["rule"] > y["rule"], 1).otherwise(0)))
    named = F.array_join(F.transform(by_name, lambda x: F.concat(x["rule"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
    named = F.when(F.size("rules") > 0, named).otherwise("no rule recorded")
    # The words of the message.
    said = F.concat(
        F.lit("Exclusion canary: "), c("excluded").cast("string"), F.lit(" of "), c("total").cast("string"), F.lit(" records ("), F.format_string("%.1f", c("share") * 100), F.lit("%) were excluded by "), named,
        F.lit(". A run that excludes almost everything is a configuration defect until proven otherwise, so client delivery is blocked. Acknowledge it on the run page, with a reason, to release it."),
    )
    blocked = c("tripped") & F.lit(not acknowledged)
    return told.withColumns({"blocked": blocked, "message": F.when(blocked, said).otherwise("")})


def awaiting_verification() -> Column:
    """Whether a record is to get a second reading: it needs one, is complete and has none yet (``verified_at``)."""
    return (F.col("target_tier") == K.VERIFY) & (F.col("enrichment_status") == "complete") & (blank(F.col("verified_at")) == "")


def prescreened(records: DataFrame, config: RunConfig) -> DataFrame:
    """Records before enrichment, with ``rules`` that the source row fires and the status that follows."""
    c = F.col
    rules = structural(config, c("specialty"), c("website_url"), c("address_state"), c("taxonomy_exclusions"))
    out = records.withColumn("rules", rules)
    return out.withColumns({"exclusion_status": F.when(F.size("rules") > 0, "EXCLUDED").otherwise("CLEAR"), "exclusion_reason": F.when(F.size("rules") > 0, F.array_join(F.transform("rules", lambda r: r.rationale), " ")), "enrichment_status": F.lit("not_enriched")})


def canary(screened: DataFrame, config: RunConfig) -> DataFrame:
    """One row: total, excluded, share (4 places), threshold, tripped, and rules with their counts, the most frequent first."""
    share = config.max_structural_exclusion_share
    totals = screened.agg(F.count("*").alias("total"), F.count_if(F.size("rules") > 0).alias("excluded"))
    by_rule = screened.select(F.explode("rules").alias("r")).groupBy("r.rule").agg(F.count("*").alias("n"))
    listed = by_rule.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "rule", "n"))).alias("l"))  # a row for each rule
    rules = F.transform("l", lambda x: F.struct(x["rule"].alias("rule"), x["n"].alias("n")))
    observed = F.coalesce(F.try_divide(F.col("excluded"), F.col("total")), F.lit(0.0))
    tripped = (F.col("excluded") > 0) & F.lit(share < 1.0) & (observed > share)
    return totals.join(F.broadcast(listed.select(rules.alias("rules")))).select("total", "excluded", F.round(observed, 4).alias("share"), F.lit(share).alias("threshold"), tripped.alias("tripped"), "rules")


def finalized(records: DataFrame) -> DataFrame:
    """Every field valid: scores clamped, states and enums repaired, the tier and the status in agreement; notes say what was repaired."""
    c = F.col
    score = lambda name: F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(c(name).try_cast("int"), F.lit(0))))
    wrong = {name: c(name).isNull() for name in ("bullseye_score", "fit_signal_score", "confidence_score")}
    status_ok = any_of(c("exclusion_status"), ("CLEAR", "EXCLUDED"))
    status = F.when(status_ok, c("exclusion_status")).otherwise("CLEAR")
    known = current_tier(c("target_tier"))
    excluded = status == "EXCLUDED"
    capped = F.when(excluded, F.least(c("bullseye_score"), F.lit(K.EXCLUDED_CAP))).otherwise(c("bullseye_score"))
    by_score = F.when(capped >= K.BULLSEYE_MIN, K.BULLSEYE).otherwise(K.CONTENDER)
    clash, hidden, unknown = ~excluded & (known == K.EXCLUDED), excluded & ~F.coalesce(known == K.EXCLUDED, F.lit(False)), ~any_of(known, K.TIERS)
    final = F.when(clash, by_score).when(excluded, K.EXCLUDED).when(unknown, by_score).otherwise(known)
    bad_states = F.filter("signals", lambda s: ~any_of(s.signal_state, K.STATES))
    errors = F.concat(
        F.array_compact(F.array(*[F.when(w, F.lit(f"Missing {name}, defaulted to 0")) for name, w in wrong.items()])),
        F.transform(bad_states, lambda s: F.concat(F.lit("Signal "), F.coalesce(s.signal_id, F.lit("?")), F.lit(": invalid state '"), F.coalesce(s.signal_state, F.lit("None")), F.lit("', set to 'not_found'"))),
        F.array_compact(
            F.array(
                F.when(~status_ok, F.concat(F.lit("Invalid exclusion_status '"), F.coalesce(c("exclusion_status"), F.lit("None")), F.lit("', defaulted to CLEAR"))),
                F.when(clash, F.concat(F.lit("Invariant violation: exclusion_status=CLEAR but target_tier=Excluded; repaired to "), by_score))
                .when(hidden, F.concat(F.lit("Invariant violation: exclusion_status=EXCLUDED but target_tier='"), F.coalesce(known, F.lit("None")), F.lit("'; repaired to Excluded")))
                .when(unknown, F.concat(F.lit("Invalid target_tier '"), F.coalesce(known, F.lit("None")), F.lit("', inferred from score"))),
            )
        ),
    )
    notes = strip(F.concat_ws(" ", blank(c("internal_notes")), F.when(F.size("_errors") > 0, F.concat(F.lit("[Validation warnings: "), F.array_join("_errors", "; "), F.lit("]")))))
    tidy = F.transform("signals", lambda s: s.withField("signal_state", F.when(any_of(s.signal_state, K.STATES), s.signal_state).otherwise("not_found")).withField("analyst_note", blank(s.analyst_note)))
    reason = F.when(status == "CLEAR", F.lit(None)).otherwise(F.when(blank(c("exclusion_reason")) != "", c("exclusion_reason")).otherwise("Excluded by pipeline rules"))
    # Errors look at the scores as they came, so they are taken before the scores are repaired.
    out = records.withColumn("_errors", errors).withColumns({name: score(name) for name in wrong})
    out = out.withColumns(
        {
            "_status": status, "_final": final, "_score": capped, "exclusion_reason": reason, "signals": tidy, "internal_notes": notes,
            "source_confidence": F.when(any_of(c("source_confidence"), K.SOURCE_CONFIDENCES), c("source_confidence")).otherwise("partial"),
            "enrichment_status": F.when(any_of(c("enrichment_status"), K.ENRICHMENT_STATUSES), c("enrichment_status")).otherwise("partial"),
            "qc_status": F.lit("pending"), "confidence_band": S.band(c("confidence_score")), "tier_cap_reason": blank(c("tier_cap_reason")),
        }
    )
    return out.withColumns({"exclusion_status": c("_status"), "target_tier": c("_final"), "bullseye_score": c("_score")}).drop("_errors", "_status", "_final", "_score")


def verified(signals: Column, context: Column, definitions: Sequence[S.SignalDef], verdicts: Column) -> Column:
    """``struct<action, anchor_failures, gating, method>``: what a second reading does with a record that needs verification.

    An unanchored quote, or no gating signal, holds; a second yes to an excluding signal disqualifies; a second yes to all
    gating signals promotes; anything else holds. ``verdicts`` is a map of signal id to the second state.
    """
    from sieveworks.functions.text import anchored

    failed = F.transform(F.filter(signals, lambda s: (s.signal_state == "yes") & ~anchored(s.evidence_text, context)), lambda s: s.signal_id)
    wanted = [d.signal_id for d in definitions if d.required_for_bullseye or d.verification_required]
    gating = F.transform(F.filter(signals, lambda s: any_of(s.signal_id, wanted) & (s.signal_state == "not_found") & ~s.state_inferred), lambda s: s.signal_id)
    against = F.lit(False)
    for d in definitions:
        if d.exclude_if_yes:
            against = against | F.coalesce(F.try_element_at(verdicts, F.lit(d.signal_id)) == "yes", F.lit(False))
    all_yes = F.forall(gating, lambda g: F.coalesce(F.try_element_at(verdicts, g) == "yes", F.lit(False)))
    asked = (F.size(failed) == 0) & (F.size(gating) > 0)
    action = F.when(~asked, "hold").when(against, "disqualify").when(all_yes, "promote").otherwise("hold")
    return F.struct(action.alias("action"), failed.alias("anchor_failures"), gating.alias("gating"), F.when(asked, "anchor+second").otherwise("anchor").alias("method"))
