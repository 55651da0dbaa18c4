"""The checks of ``plans.config`` over tables of configurations, for a service that keeps many profiles and projects.

Messages are those that the checks of a single configuration give. Values come as text, as they stand in a stored document; a null
is a missing field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.text import blank, strip
from sieveworks.plans.config import BILLING_WORDS, CAPS, INVERSE_BILLING


def signal_faults(drafts: DataFrame) -> DataFrame:
    """``profile_id, at, message`` for drafts ``profile_id, at, signal_id, signal_label, prompt_instruction, positive_weight, cap_tier, column_label, reinforces``.

    An id that very many drafts of a profile share is summed to its first place, not listed.
    """
    c = F.col
    first = drafts.where("signal_id is not null").groupBy("profile_id", "signal_id").agg(F.min("at").alias("_first"))
    known = drafts.join(first, ["profile_id", "signal_id"], "left")
    known = known.join(first.select("profile_id", c("signal_id").alias("reinforces"), F.lit(True).alias("_known")), ["profile_id", "reinforces"], "left")
    where = F.concat(F.lit("signals["), c("at").cast("string"), F.lit("]"))
    told = lambda bad, text: F.when(bad, F.concat(where, text if isinstance(text, Column) else F.lit(text)))
    faults = [told(strip(c(f)) == "", f".{f}: text is needed") for f in ("signal_id", "signal_label", "prompt_instruction")]
    faults += [
        told(c("at") > c("_first"), F.concat(F.lit(".signal_id: "), c("signal_id"), F.lit(" is there twice"))),
        told(c("positive_weight").try_cast("double").isNull(), ".positive_weight: a number is needed"),
        told(~blank(c("cap_tier")).isin(*CAPS), ".cap_tier: not a tier"),
        told(F.length(blank(c("column_label"))) > 24, ".column_label: more than 24 characters"),
        told((blank(c("reinforces")) != "") & (c("_known").isNull() | (c("reinforces") == blank(c("signal_id")))), ".reinforces: no other signal of that id"),
    ]
    return known.select("profile_id", "at", F.explode(F.array_compact(F.array(*faults))).alias("message"))


def without_inverse_billing(drafts: DataFrame) -> DataFrame:
    """Drafts without those that repeat, the other way round, how a practice is paid."""
    said = F.regexp_replace(F.lower(F.concat_ws(" ", "signal_label", "prompt_instruction")), "[-_/]+", " ")
    any_in = lambda parts: said.rlike("|".join(parts))
    return drafts.where(~(any_in(INVERSE_BILLING) & any_in(BILLING_WORDS)))


def project_faults(projects: DataFrame) -> DataFrame:
    """``project, message`` of projects that lack a field."""
    lacking = F.array_compact(F.array(*[F.when(strip(F.col(f)) == "", F.lit(f"{f}: text is needed")) for f in ("project_id", "client_name", "icp_profile_id")]))
    return projects.select(F.col("project_id").alias("project"), F.explode(lacking).alias("message"))


def profile_usage(projects: DataFrame) -> DataFrame:
    """``icp_profile_id, n, first, last``: how many projects use a profile, and the ends of their sorted list."""
    return projects.where(strip(F.col("icp_profile_id")) != "").groupBy("icp_profile_id").agg(F.countDistinct("project_id").alias("n"), F.min("project_id").alias("first"), F.max("project_id").alias("last"))


def fingerprint(config: Column, *names: Column) -> Column:
    """The digest of a flat configuration (map<string,string>) and of names, whatever the order of its keys."""
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
    entries = F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.sha2(F.concat_ws("\n", F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")), *names), 256)
