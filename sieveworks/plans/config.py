"""Configuration: signal definitions, runs and projects, read from plain mappings and checked. Errors are listed, not raised one by one."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping

from sieveworks import constants as K
from sieveworks.operators.rules import RunConfig
from sieveworks.operators.signals import SignalDef

_NUMBERS, _FLAGS = ("positive_weight", "not_found_weight", "no_weight"), ("verification_required", "required_for_bullseye", "required_for_contender", "exclude_if_yes")
CAPS = (K.CONTENDER, K.VERIFY, K.BULLSEYE, "Watchlist", "")


def signal_errors(profile: Mapping) -> list[str]:
    """What is wrong with a profile's signals."""
    listed, out, seen = profile.get("signals"), [], set()
    if not isinstance(listed, list) or not listed:
        return ["signals: a list with entries is needed"]
    for at, s in enumerate(listed):
        where = f"signals[{at}]"
        if not isinstance(s, Mapping):
            out.append(f"{where}: not an object")
            continue
        for name in ("signal_id", "signal_label", "prompt_instruction"):
            if not isinstance(s.get(name), str) or not s[name].strip():
                out.append(f"{where}.{name}: text is needed")
        if s.get("signal_id") in seen:
            out.append(f"{where}.signal_id: {s['signal_id']} is there twice")
        seen.add(s.get("signal_id"))
        for name in _NUMBERS:
            if (name in s or name == "positive_weight") and (isinstance(s.get(name), bool) or not isinstance(s.get(name), (int, float))):
                out.append(f"{where}.{name}: a number is needed")
        out += [f"{where}.{name}: true or false is needed" for name in _FLAGS if name in s and not isinstance(s[name], bool)]
        out += [f"{where}.{name}: not a tier" for name in ("cap_tier", "floor_tier") if s.get(name, "") not in CAPS]
        if len(s.get("column_label") or "") > 24:
            out.append(f"{where}.column_label: more than 24 characters")
    for at, s in enumerate(x for x in listed if isinstance(x, Mapping)):
        for name in ("reinforces", "inhibited_by"):
            if s.get(name) and (s[name] not in seen or s[name] == s.get("signal_id")):
                out.append(f"signals[{at}].{name}: no other signal of that id")
    if len(profile.get("product_context") or "") > 700:
        out.append("product_context: more than 700 characters")
    return out


# What tells a signal that says the inverse of how a practice bills.
INVERSE_BILLING = ("insurance only", "insurance based only", "only accepts insurance", "insurance exclusive")
BILLING_WORDS = ("billing", "model", "payer", "payor", "insurance")


def without_inverse_billing(listed: list[Mapping]) -> list[Mapping]:
    """Drafted signals without those that repeat, the other way round, how a practice is paid."""

    def says(s: Mapping) -> str:
        fields = ("signal_label", "prompt_instruction", "notes", "note")
        return re.sub("[-_/]+", " ", " ".join(str(s[f]) for f in fields if s.get(f) is not None).lower())

    return [s for s in listed if not (any(t in says(s) for t in INVERSE_BILLING) and any(w in says(s) for w in BILLING_WORDS))]


def definitions(profile: Mapping) -> list[SignalDef]:
    """The checked signals of a profile."""
    if errors := signal_errors(profile):
        raise ValueError("; ".join(errors))
    fields = SignalDef.__dataclass_fields__
    return [SignalDef(**{k: v for k, v in s.items() if k in fields}) for s in profile["signals"]]


def run_errors(config: Mapping) -> list[str]:
    """What is wrong with a run's configuration."""
    out = []
    for name in ("target_geography", "active_exclusion_rules"):
        if not isinstance(config.get(name, []), list) or not all(isinstance(x, str) for x in config.get(name, [])):
            out.append(f"{name}: a list of texts is needed")
    unknown = {x for x in config.get("active_exclusion_rules", []) if isinstance(x, str)} - {*K.HARD_RULES, *K.CONFIGURABLE_RULES, *(r.get("rule_name") for r in config.get("taxonomy_exclusion_rules", []))}
    out += [f"active_exclusion_rules: {x} is not known" for x in sorted(unknown)]
    score = config.get("bullseye_min_score", K.BULLSEYE_MIN)
    if isinstance(score, bool) or not isinstance(score, int) or not 0 <= score <= 100:
        out.append("bullseye_min_score: a whole number from 0 to 100 is needed")
    return out


def run_config(config: Mapping) -> RunConfig:
    """A checked run configuration."""
    if errors := run_errors(config):
        raise ValueError("; ".join(errors))
    share = config.get("max_structural_exclusion_share")
    try:
        share = K.CANARY_SHARE if share is None else float(share)
    except (TypeError, ValueError):
        share = K.CANARY_SHARE
    rules = {r["taxonomy_code"]: r["rule_name"] for r in config.get("taxonomy_exclusion_rules", []) if r.get("taxonomy_code") and r.get("rule_name")}
    return RunConfig(config.get("target_specialty") or "", tuple(config.get("target_geography", [])), tuple(config.get("active_exclusion_rules", [])), config.get("bullseye_min_score", K.BULLSEYE_MIN), rules, share)


def project_errors(project: Mapping) -> list[str]:
    """What a project lacks."""
    return [f"{name}: text is needed" for name in ("project_id", "client_name", "icp_profile_id") if not isinstance(project.get(name), str) or not project[name].strip()]


def projects_using(projects: list[Mapping], profile_id: str) -> list[str]:
    """Projects of a profile, sorted."""
    return sorted(p["project_id"] for p in projects if p.get("icp_profile_id") == profile_id)


def fingerprint(*parts: Mapping | str) -> str:
    """A digest of configurations and names, for the partition of a resumable run."""
    return hashlib.sha256("\n".join(p if isinstance(p, str) else json.dumps(p, sort_keys=True) for p in parts).encode()).hexdigest()


def json_without_doubles(text: str) -> dict:
    """JSON whose objects have no key twice."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        keys = [k for k, _ in items]
        if len(set(keys)) < len(keys):
            raise ValueError(f"keys are there twice: {sorted({k for k in keys if keys.count(k) > 1})}")
        return dict(items)

    return json.loads(text, object_pairs_hook=pairs)
