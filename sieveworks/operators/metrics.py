"""Counts of a run, costs, evaluation against labels, and gates on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.functions.text import any_of
from sieveworks.operators.graph import numbered


def run_log(records: DataFrame, records_in: int) -> DataFrame:
    """One row: records in, out and skipped, by status, exclusion and tier."""
    c = F.col
    blocked = any_of(c("source_confidence"), ("limited", "failed")) & (c("exclusion_status") != "EXCLUDED")
    out = records.agg(
        F.count("*").alias("records_output"), *[F.count_if(c("enrichment_status") == s).alias(f"status_{s}") for s in K.ENRICHMENT_STATUSES],
        F.count_if(c("exclusion_status") == "EXCLUDED").alias("excluded"), F.count_if(blocked).alias("blocked"),
        *[F.count_if((c("target_tier") == t) & ~blocked).alias("tier_" + t.lower().replace(" ", "_")) for t in K.TIERS],
    )
    return out.withColumns({"records_input": F.lit(records_in), "records_skipped": F.greatest(F.lit(0), F.lit(records_in) - c("records_output"))})


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars for tokens."""
    return tokens_in / 1e6 * K.INPUT_USD + tokens_out / 1e6 * K.OUTPUT_USD


def estimate(runs: DataFrame, records: int) -> DataFrame:
    """One row: tokens and cost of a run, from the mean per-record use of the newest complete runs, or from defaults."""
    c = F.col
    used = runs.where((c("status") == "complete") & (F.coalesce(c("run_type"), F.lit("")) != "discovery") & c("consolidation_practice_locations").isNotNull() & (c("records_output") > 0) & (c("llm_input_tokens") > 0) & (c("llm_output_tokens") > 0))
    newest = used.orderBy(F.desc("run_id")).limit(K.HISTORY_RUNS)
    mean = newest.agg(F.avg(c("llm_input_tokens") / c("records_output")).alias("i"), F.avg(c("llm_output_tokens") / c("records_output")).alias("o"), F.count("*").alias("history_run_count"))
    i, o = F.coalesce("i", F.lit(float(K.TOKENS_IN))), F.coalesce("o", F.lit(float(K.TOKENS_OUT)))
    ti, to = (i * records).cast("long"), (o * records).cast("long")
    return mean.select(F.lit(records).alias("record_count"), ti.alias("estimated_input_tokens"), to.alias("estimated_output_tokens"), F.round(cost(ti, to), 4).alias("estimated_cost_usd"), "history_run_count", (c("history_run_count") == 0).alias("using_defaults"))


def cost_summary(runs: DataFrame) -> DataFrame:
    """Per run with captured use: calls, tokens, cost, and cost for each location."""
    c = F.col
    total = cost(F.coalesce("llm_input_tokens", F.lit(0)), F.coalesce("llm_output_tokens", F.lit(0)))
    places = F.coalesce(F.nullif("consolidation_practice_locations", F.lit(0)), F.nullif("records_output", F.lit(0)))
    return runs.where(c("llm_call_count").isNotNull()).select("run_id", "llm_call_count", F.round(total, 4).alias("estimated_cost_usd"), places.alias("practice_locations"), F.round(F.try_divide(total, places), 4).alias("cost_per_record_usd"))


def usage(log: DataFrame) -> DataFrame:
    """Calls and tokens of a run: sums over entries with calls; null where nothing was ever captured."""
    real = F.when(F.col("calls") > 0, True)
    return log.groupBy("run_id").agg(*[F.sum(F.when(real, F.col(x))).alias(f"llm_{x}") for x in ("calls", "input_tokens", "output_tokens")])


def newest(runs: DataFrame, most: int = 50) -> DataFrame:
    """The newest runs that aren't archived."""
    return runs.where(~F.coalesce("archived", F.lit(False))).orderBy(F.desc("created_at"), "run_id").limit(most)


def reconciled(runs: DataFrame) -> DataFrame:
    """Runs that nothing works on any more are failed."""
    return runs.withColumn("status", F.when(any_of(F.col("status"), ("pending", "running")), "failed").otherwise(F.col("status")))


def stale(status: Column, started: Column, heartbeat: Column, now: Column, minutes: int = 30) -> Column:
    """The status of a job, failed if it runs without a sign for too long."""
    last = F.greatest(started, heartbeat)
    return F.when((status == "running") & (F.unix_timestamp(now) - F.unix_timestamp(last) > 60 * minutes), "failed").otherwise(status)


def collapse_rate(locations: Column, entries: Column) -> Column:
    """Share of entries that consolidation took away, to 4 places."""
    return F.round(1 - F.try_divide(locations, entries), 4)


def evaluated(labels: DataFrame, got: DataFrame) -> DataFrame:
    """``case_id, signal_id, grp, expected, got, ok, anchored`` for every label of reviewed cases; a missing answer is not_found."""
    both = labels.where("reviewed").join(got.select("case_id", "signal_id", F.col("signal_state").alias("got"), "anchored"), ["case_id", "signal_id"], "left")
    state = F.coalesce("got", F.lit("not_found"))
    return both.select("case_id", "signal_id", "grp", "expected", state.alias("got"), (state == F.col("expected")).alias("ok"), F.when(state == "yes", F.coalesce("anchored", F.lit(False))).alias("anchored"))


def quality(rows: DataFrame) -> DataFrame:
    """One row of rates, 4 places, null where nothing was to be measured."""
    c = F.col
    rate = lambda hit, of: F.round(F.try_divide(F.count_if(hit & of), F.nullif(F.count_if(of), F.lit(0))), 4)
    want, said = c("expected") == "yes", c("got") == "yes"
    group = lambda g: rate(said, want & (c("grp") == g))
    return rows.agg(
        F.countDistinct("case_id").alias("cases"), F.count("*").alias("signals_compared"), rate(c("ok"), F.lit(True)).alias("state_accuracy"), rate(said, want).alias("yes_recall"),
        group("must_have").alias("must_have_recall"), group("negative").alias("exclusion_recall"), group("other").alias("other_recall"), rate(want, said).alias("yes_precision"),
        rate(F.coalesce("anchored", F.lit(False)), said).alias("anchor_rate"), F.count_if(want).alias("yes_labeled"),
    )


def gates(measured: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """``metric, value, floor, verdict``: n/a where nothing was measured, UNPROTECTED where a measured metric has no floor."""
    floors = K.GATE_FLOORS if floors is None else floors
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(floors.get(m)).cast("double").alias("floor")) for m in K.GATE_FLOORS])
    v, f = F.col("value"), F.col("floor")
    verdict = F.when(v.isNull(), "n/a").when(f.isNull(), "UNPROTECTED").when(v >= f, "PASS").otherwise("FAIL")
    return measured.select(F.explode(listed).alias("g")).select("g.*").withColumn("verdict", verdict)


def golden_violations(cases: DataFrame, least_cases: int = 20, least_yes: int = 4) -> DataFrame:
    """``rule, subject``: what keeps a labelled set from use.

    ``cases`` has case_id, rubric_version, page_sha256, page_text, expected and anchors (maps by signal).
    """
    from sieveworks.functions.text import anchor

    c = F.col
    few = cases.agg(F.count("*").alias("n"), F.countDistinct("rubric_version").alias("r"))
    out = few.where(c("n") < least_cases).select(F.lit("too_few_cases").alias("rule"), c("n").cast("string").alias("subject"))
    out = out.union(few.where(c("r") > 1).select(F.lit("several_rubrics"), c("r").cast("string")))
    long = cases.select("case_id", F.explode("expected").alias("signal_id", "state"))
    rare = long.groupBy("signal_id").agg(F.count_if(c("state") == "yes").alias("n")).where(c("n") < least_yes)
    out = out.union(rare.select(F.lit("too_few_yes"), "signal_id"))
    out = out.union(cases.where(F.sha2("page_text", 256) != c("page_sha256")).select(F.lit("page_changed"), "case_id"))
    quotes = cases.select("case_id", "page_text", F.explode("anchors").alias("signal_id", "quote"))
    lost = quotes.where(~F.contains(anchor(c("page_text")), anchor(c("quote"))))
    return out.union(lost.select(F.lit("anchor_missing"), F.concat_ws("/", "case_id", "signal_id")))


def scaffold(records: DataFrame) -> DataFrame:
    """Unreviewed cases from records: a slug of the name, equal ones numbered from the second on."""
    from sieveworks.functions.text import slug

    named = numbered(records.select("id", slug(F.col("practice_name")).alias("_slug")), "_slug", ["id"], "_n")
    return named.select("id", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("_", "_slug", F.col("_n").cast("string"))).alias("case_id"), F.lit(False).alias("reviewed"))


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """``old_tier, new_tier, score_changed, n``: what a rescore does to tiers and scores."""
    both = before.select("id", F.col("target_tier").alias("old_tier"), F.col("bullseye_score").alias("s")).join(after.select("id", F.col("target_tier").alias("new_tier"), F.col("bullseye_score").alias("t")), "id")
    return both.groupBy("old_tier", "new_tier", (F.col("s") != F.col("t")).alias("score_changed")).agg(F.count("*").alias("n"))


def reextract_counts(records: DataFrame) -> DataFrame:
    """One row of exclusive counts: not enriched, excluded, without context, eligible."""
    c = F.col
    fresh, out = c("enrichment_status") == "not_enriched", c("exclusion_status") == "EXCLUDED"
    bare = F.length(F.coalesce("context_text", F.lit(""))) == 0
    return records.agg(F.count_if(fresh).alias("not_enriched"), F.count_if(~fresh & out).alias("excluded"), F.count_if(~fresh & ~out & bare).alias("no_context"), F.count_if(~fresh & ~out & ~bare).alias("eligible"))
