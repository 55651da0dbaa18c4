"""Signals of a record: cleaning against definitions, gates, inference, scores and the call brief.

Definitions are configuration, tens of entries at most, so they become literals of the plan: every operator here is one
expression over a record's own array and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.functions import names
from sieveworks.functions.mending import mended_json
from sieveworks.functions.text import WHITE, any_of, blank, strip

SIGNAL = (
    "struct<signal_id:string,signal_label:string,signal_state:string,evidence_text:string,source_url:string,source_type:string,"
    "confidence:string,positive_weight:double,verification_required:boolean,required_for_bullseye:boolean,"
    "required_for_contender:boolean,cap_tier:string,floor_tier:string,exclude_if_yes:boolean,inhibited_by:string,"
    "state_inferred:boolean,inferred_from:string,not_found_reason:string,analyst_note:string>"
)
RESPONSE = "array<struct<signal_id:string,signal_state:string,evidence_text:string,source_url:string,confidence:string,attribution:string>>"


@dataclass(frozen=True)
class SignalDef:
    """One configured signal."""

    signal_id: str
    signal_label: str
    positive_weight: float = 0.0
    prompt_instruction: str = ""
    not_found_weight: float = 0.0
    no_weight: float = 0.0
    verification_required: bool = False
    required_for_bullseye: bool = False
    required_for_contender: bool = False
    exclude_if_yes: bool = False
    cap_tier: str = ""
    floor_tier: str = ""
    reinforces: str | None = None
    inhibited_by: str | None = None


def _text(x: str | None) -> str:
    return "cast(null as string)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values: Sequence[str]) -> str:
    return "array(" + ", ".join(map(_text, values)) + ")"


def literal(defs: Sequence[SignalDef]) -> str:
    """Definitions as SQL: one array that is folded into a constant, so that no plan grows with their number."""
    one = lambda d: "named_struct(" + ", ".join(
        [f"'{f}', {_text(getattr(d, f))}" for f in ("signal_id", "signal_label", "cap_tier", "floor_tier", "reinforces", "inhibited_by")]
        + [f"'{f}', {float(getattr(d, f))!r}D" for f in ("positive_weight", "not_found_weight", "no_weight")]
        + [f"'{f}', {str(getattr(d, f)).lower()}" for f in ("verification_required", "required_for_bullseye", "required_for_contender", "exclude_if_yes")]
    ) + ")"
    return "array(" + ", ".join(map(one, defs)) + ")"


_STRIP = f"trim(BOTH '{WHITE}' FROM coalesce({{0}}, ''))"
_MADE = """named_struct('signal_id', d.signal_id, 'signal_label', d.signal_label, 'signal_state', {state}, 'evidence_text', {evidence},
    'source_url', {url}, 'source_type', 'practice_website', 'confidence', {confidence}, 'positive_weight', d.positive_weight,
    'verification_required', d.verification_required, 'required_for_bullseye', d.required_for_bullseye,
    'required_for_contender', d.required_for_contender, 'cap_tier', d.cap_tier, 'floor_tier', d.floor_tier,
    'exclude_if_yes', d.exclude_if_yes, 'inhibited_by', d.inhibited_by, 'state_inferred', false, 'inferred_from', '',
    'not_found_reason', {reason}, 'analyst_note', '')"""


def empty(defs: Sequence[SignalDef]) -> Column:
    """Every signal unknown for want of text."""
    made = _MADE.format(state="'not_found'", evidence="''", url="''", confidence="'low'", reason="'no_context'")
    return F.expr(f"transform({literal(defs)}, d -> {made})").cast(f"array<{SIGNAL}>")


def cleaned(response: str, defs: Sequence[SignalDef]) -> Column:
    """One signal for each definition, in their order, from the entries of a column: unknown ids go, the last of equal ids counts.

    A yes needs a service attribution (where one is given), a quote that is no placeholder and an http source.
    """
    strip = _STRIP.format
    fails = "g <> ''"
    made = _MADE.format(
        state=f"if({fails}, 'not_found', p.state)", evidence=f"if({fails}, '', p.evidence)", url=f"if({fails}, '', p.url)",
        confidence=f"if({fails} or not array_contains({_listed(K.CONFIDENCES)}, p.confidence), 'low', p.confidence)", reason="g",
    )
    # Arrays of one element bind what is used more than once, and the column itself: the optimizer would else put the expression
    # that makes it inside the loop over definitions.
    sql = f"""transform(array({response}), listed -> transform({literal(defs)}, d -> transform(array(try_element_at(filter(listed, r -> r.signal_id = d.signal_id), -1)), r ->
        transform(array(named_struct('state', lower({strip("r.signal_state")}), 'confidence', lower({strip("r.confidence")}), 'evidence', {strip("r.evidence_text")},
            'url', {strip("r.source_url")}, 'attribution', lower({strip("r.attribution")}))), q ->
        transform(array(named_struct('state', if(array_contains({_listed(K.STATES)}, q.state), q.state, 'not_found'), 'confidence', q.confidence, 'evidence', q.evidence, 'url', q.url, 'attribution', q.attribution)), p ->
        transform(array(case when p.state <> 'yes' then '' when p.attribution <> '' and not array_contains({_listed(K.SERVICE_ATTRIBUTIONS)}, p.attribution) then 'attribution_gate'
            when array_contains({_listed(K.MISSING_VALUES)}, lower(p.evidence)) or not lower(p.url) rlike '^https?://' then 'evidence_gate' else '' end), g -> {made})[0])[0])[0])[0]))[0]"""
    return F.expr(sql).cast(f"array<{SIGNAL}>")


def reinforced(signals: str, defs: Sequence[SignalDef]) -> Column:
    """Unknown signals of a column that a confirmed one implies, marked as inferred; of several the last definition names itself."""
    implied = [d for d in defs if d.reinforces]
    by = f"""if(s.signal_state = 'not_found', try_element_at(filter({literal(implied)}, d -> d.reinforces = s.signal_id and exists(every, x -> x.signal_id = d.signal_id and x.signal_state = 'yes')), -1).signal_id, cast(null as string))""" if implied else "cast(null as string)"
    kept = [f for f in (x.split(":")[0] for x in SIGNAL[7:-1].split(",")) if f not in ("state_inferred", "inferred_from", "not_found_reason", "analyst_note")]
    made = ", ".join(f"'{f}', s.{f}" for f in kept)
    one = f"transform(array({by}), b -> named_struct({made}, 'state_inferred', b is not null, 'inferred_from', coalesce(b, ''), 'not_found_reason', s.not_found_reason, 'analyst_note', s.analyst_note))[0]"
    return F.expr(f"transform(array({signals}), every -> transform(every, s -> {one}))[0]")


def _graded(table: dict[str, float], kind: str = "D") -> str:
    return f"case s.confidence when 'high' then {float(table['high'])}{kind} when 'medium' then {float(table['medium'])}{kind} else {float(table['low'])}{kind} end"


def scores(signals: str, defs: Sequence[SignalDef]) -> Column:
    """``struct<bullseye_score, fit_signal_score, confidence_score int>``; sums go in the definitions' order, rounding is half to even."""
    w, yes, inferred = "d.positive_weight", "s.signal_state = 'yes'", "s.signal_state = 'not_found' and s.state_inferred"
    gain = f"""case when {yes} then {w} * {_graded(K.CONFIDENCE_CREDIT)} when {w} < 0 then 0D when {inferred} then {w} * {K.INFERENCE_CREDIT}D
        when s.signal_state = 'no' then d.no_weight else d.not_found_weight end"""
    points = f"case when {yes} then {_graded(K.CONFIDENCE_POINTS)} when {w} >= 0 and {inferred} then {float(K.INFERENCE_POINTS)}D end"
    fold = f"""aggregate({literal(defs)}, named_struct('most', 0D, 'got', 0D, 'points', 0D, 'n', 0D), (a, d) ->
        transform(array(try_element_at(filter(every, x -> x.signal_id = d.signal_id), -1)), s -> transform(array({points}), p -> named_struct(
            'most', a.most + if({w} >= 0, {w}, 0D), 'got', a.got + {gain}, 'points', a.points + coalesce(p, 0D), 'n', a.n + if(p is null, 0D, 1D)))[0])[0],
        a -> named_struct('fit', if(a.most > 0, rint(a.got / nullif(a.most, 0D) * 100), {K.NEUTRAL_FIT}D), 'confidence', if(a.n > 0, rint(a.points / nullif(a.n, 0D)), {K.NO_SIGNAL_CONFIDENCE}D)))"""
    fold = f"transform(array({signals}), every -> {fold})[0]"
    final = f"""transform(array({fold}), x -> transform(array(cast(greatest(0D, least(100D, x.fit)) as int)), f -> named_struct(
        'bullseye_score', cast(greatest(0D, least(100D, rint({K.FIT_WEIGHT}D * f + {K.CONFIDENCE_WEIGHT}D * x.confidence))) as int), 'fit_signal_score', f, 'confidence_score', cast(x.confidence as int)))[0])[0]"""
    return F.expr(final)


def band(confidence: Column) -> Column:
    """High, Moderate or Low."""
    return F.when(confidence >= K.HIGH_CONFIDENCE, "High").when(confidence >= K.LOW_CONFIDENCE, "Moderate").otherwise("Low")


def quadrant(fit: Column, confidence: Column) -> Column:
    """Fit and evidence, each high or low."""
    return F.concat(F.when(fit >= K.HIGH_FIT, "HIGH").otherwise("LOW"), F.lit(" FIT / "), F.when(confidence >= K.HIGH_CONFIDENCE, "HIGH").otherwise("LOW"), F.lit(" EVIDENCE"))


def no_context(url: Column, error: Column, context: Column) -> Column:
    """Why a record came without usable text."""
    n = F.length(strip(context))
    return (
        F.when(strip(url) == "", "No website URL provided — nothing to crawl.")
        .when(strip(error) != "", F.concat(F.lit("Website could not be reached: "), strip(error), F.lit(". Try 'Re-crawl with Browser' or paste the page content manually.")))
        .when(n == 0, "Website returned no readable text — likely a bot/security wall or a script-rendered page. Try 'Re-crawl with Browser' or paste the page content manually.")
        .otherwise(F.concat(F.lit("Website returned only "), n.cast("string"), F.lit(" characters of text (under the minimum needed to evaluate). Paste fuller page content manually to enrich.")))
    )


def ranked(signals: Column, keep) -> Column:
    """Signals that ``keep`` takes, by weight from the highest, equal ones in their order."""
    numbered = F.filter(F.transform(signals, lambda s, i: F.struct((-s.positive_weight).alias("w"), i.alias("i"), s.alias("s"))), lambda x: keep(x.s))
    return F.transform(F.array_sort(numbered), lambda x: x.s)


def providers(raw: Column) -> Column:
    """The first eight entries of array<struct<name, title>>, those with a name."""
    tidy = F.transform(F.slice(F.coalesce(raw, F.array().cast("array<struct<name:string,title:string>>")), 1, 8), lambda p: F.struct(strip(p["name"]).alias("name"), strip(p["title"]).alias("title")))
    return F.filter(tidy, lambda p: p["name"] != "")


def primary_contact(raw: Column, people: Column) -> Column:
    """The chosen contact if a provider's name holds it, else the first provider; null without providers."""
    name = strip(raw["name"])
    known = (name != "") & F.exists(people, lambda p: F.contains(F.lower(p["name"]), F.lower(name)))
    first = F.try_element_at(people, F.lit(1))
    chosen = F.struct(name.alias("name"), strip(raw["title"]).alias("title"), strip(raw["reason"]).alias("reason"))
    return F.when(F.size(people) > 0, F.when(known, chosen).otherwise(F.struct(first["name"].alias("name"), first["title"].alias("title"), F.lit("").alias("reason"))))


def key_contact(contact: Column) -> Column:
    """Whom to ask for, and why."""
    shown = F.concat(F.lit("Ask for "), names.with_prefix(contact["name"], contact["title"]))
    reason = blank(contact["reason"])
    return F.when(blank(contact["name"]) == "", "").otherwise(F.when(reason != "", F.concat(shown, F.lit(" — "), reason)).otherwise(shown))


def call_brief(signals: Column, fit: Column, specialty: Column, generated: Column, contact: Column) -> Column:
    """The nine fields of the brief; claims of ``generated`` go where no confirmed signal has a quote."""
    good = ranked(signals, lambda s: (s.signal_state == "yes") & (s.positive_weight > 0))
    quoted = F.filter(good, lambda s: s.evidence_text != "")
    top = F.transform(F.slice(quoted, 1, K.TOP_EVIDENCE), lambda s: F.struct(s.signal_label.alias("point"), s.evidence_text.alias("evidence"), s.source_url.alias("source_url")))
    claim = lambda name: F.when(F.size(quoted) > 0, strip(generated[name])).otherwise("")
    missing = F.filter(signals, lambda s: (s.verification_required | s.required_for_bullseye) & (s.signal_state == "not_found") & ~s.state_inferred)
    risky = F.filter(signals, lambda s: (s.signal_state == "yes") & ((s.positive_weight < 0) | (blank(s.cap_tier) != "")))
    risk = F.transform(risky, lambda s: F.when(s.positive_weight < 0, F.concat(s.signal_label, F.lit(" (friction signal present)"))).otherwise(F.concat(s.signal_label, F.lit(" (caps tier at "), s.cap_tier, F.lit(")"))))
    kind = F.when(strip(specialty) != "", F.concat(strip(specialty), F.lit(" "))).otherwise("")
    lead = F.array_join(F.transform(F.slice(good, 1, 2), lambda s: s.signal_label), " + ")
    said = F.when(lead != "", F.concat(F.lit("practice: "), lead)).otherwise("practice, no confirmed positive signals yet")
    return F.struct(
        F.concat(kind, said, F.lit(" (fit "), fit.cast("string"), F.lit(").")).alias("why_contact"), key_contact(contact).alias("key_contact"),
        claim("opening_line").alias("opening_line"), claim("likely_objection").alias("likely_objection"), claim("discovery_question").alias("discovery_question"),
        strip(generated["hours_of_operation"]).alias("hours_of_operation"), top.alias("top_evidence"),
        F.transform(missing, lambda s: s.signal_label).alias("missing_to_verify"), risk.alias("disqualifier_risk"),
    )


def empty_brief() -> Column:
    """A brief with its shape and nothing in it."""
    texts = ("why_contact", "key_contact", "opening_line", "likely_objection", "discovery_question", "hours_of_operation")
    none = F.array().cast("array<string>")
    return F.struct(*[F.lit("").alias(t) for t in texts], F.array().cast("array<struct<point:string,evidence:string,source_url:string>>").alias("top_evidence"), none.alias("missing_to_verify"), none.alias("disqualifier_risk"))


def parsed_response(raw: Column) -> Column:
    """A model's JSON, fences taken off, repaired where it does not parse; null unless it is an object with ``signals`` and ``sales_angle``."""
    body = F.regexp_replace(F.regexp_replace(strip(raw), r"(?s)^```[^\n]*\n", ""), r"(?s)\n?```\s*$", "")
    shape = f"struct<signals:{RESPONSE},sales_angle:array<string>,exclusion_triggers:array<string>,exclusion_rationale:string,providers:array<struct<name:string,title:string>>>"
    parsed = F.from_json(body, shape, {"mode": "PERMISSIVE"})
    whole = lambda p: p.signals.isNotNull() & p.sales_angle.isNotNull()
    # Only what does not parse goes to the tolerant reader.
    mended = F.from_json(mended_json(F.when(~F.coalesce(whole(parsed), F.lit(False)), body), "signals", "sales_angle"), shape, {"mode": "PERMISSIVE"})
    return F.when(whole(parsed), parsed).when(whole(mended), mended)


def column_state(signals: Column, ids: Sequence[str]) -> Column:
    """The strongest of yes, inferred, no and not_found among some signals; empty if the record has none of them."""
    ranks = F.transform(F.filter(signals, lambda s: any_of(s.signal_id, ids)), lambda s: F.when(s.signal_state == "yes", 3).when(s.state_inferred, 2).when(s.signal_state == "no", 1).otherwise(0))
    top = F.array_max(ranks)
    return F.when(top == 3, "yes").when(top == 2, "inferred").when(top == 1, "no").when(top == 0, "not_found").otherwise("")
