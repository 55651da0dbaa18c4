"""Registered queries of runs: lists read and written, tiering that fails closed, passes, reviews, handoffs, the registry.

They extend ``queries``; customers, parts and suppliers stand for practices, orders for records, events for analysts' edits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.catalog import query, quoted, table
from sieveworks.functions import names, phones, urls
from sieveworks.functions.text import duration, progress
from sieveworks.operators import evidence, match, metrics, overlay, passes, registry, resolve, rules, views
from sieveworks.operators import signals as S
from sieveworks.operators.graph import numbered, placed, shared_folder, written
from sieveworks.plans import config, config_tables, enrichment
from sieveworks.queries import _BARE, _REVIEWED, _SCORES, _STATES, _TIER, DEFS, _doubtful, _orders, _reviewed
from sieveworks.sources import readers, writers

NOW = "2026-01-02T03:04:05+00:00"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- lists -----------------------------------------------------------------------------------------------------------


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an export of listings, written as CSV and read back."""
    c = F.col
    k = c("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("key"), F.when(k % 11 == 0, "").otherwise(c("c_name")).alias(" Name "), F.concat(F.lit("12 Elm St, Springfield, IL "), F.lpad((k % 90000 + 10000).cast("string"), 5, "0")).alias("full_address"),
        F.when(k % 3 == 0, "CA").otherwise("").alias("state"), F.when(k % 3 == 0, "Oakland").otherwise("").alias("city"), F.concat(F.lit("415-555-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
        F.when(k % 4 == 0, F.concat(F.lit("https://p"), k.cast("string"), F.lit(".example.com/"))).otherwise("n/a").alias("site"), F.when(k % 2 == 0, "Cardiology clinic").otherwise("=Dermatologist").alias("type"),
        F.when(k % 5 == 0, (1000000000 + k).cast("string")).otherwise("").alias("npi"), F.concat(F.lit("pl-"), k.cast("string")).alias("place_id"),
    )
    path = scratch(spark, "listing")
    writers.to_csv(rows, path)
    return readers.read_csv(spark, path)


_LISTED = """SELECT c_custkey AS k, lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') AS z, CASE WHEN c_custkey % 3 = 0 THEN 'CA' ELSE 'IL' END AS st,
      CASE WHEN c_custkey % 5 = 0 THEN (1000000000 + c_custkey)::VARCHAR ELSE '' END AS npi, c_name FROM customer WHERE c_custkey % 11 > 0"""


@query(
    f"""
    SELECT 'T-' || CASE WHEN npi <> '' THEN npi ELSE left(sha256(lower(c_name) || '|' || lower(st) || '|' || z), 8) END AS id, c_name AS practice_name, nullif(npi, '') AS npi_optional, 'pl-' || k AS google_place_id,
      CASE WHEN k % 2 = 0 THEN 'Cardiology' ELSE 'Dermatology' END AS specialty, CASE WHEN k % 4 = 0 THEN 'https://p' || k || '.example.com' ELSE '' END AS website_url,
      CASE WHEN k % 3 = 0 THEN 'Oakland' ELSE 'Springfield' END AS address_city, st AS address_state, z AS address_zip, '12 Elm St' AS address_street, 'listing' AS source_type FROM ({_LISTED})"""
)
def csv_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of listings through a flat CSV to canonical rows (A1, A2, B2, C4)."""
    rows, _ = readers.listings(_listing(spark, sf_dir))
    return rows.select("id", "practice_name", "npi_optional", "google_place_id", "specialty", "website_url", "address_city", "address_state", "address_zip", "address_street", "source_type")


@query("SELECT count(*) AS rows, count(DISTINCT c_custkey) AS numbers, min(c_custkey) - min(c_custkey) AS first, count(*) - 1 AS last, count(*) FILTER (c_custkey % 11 = 0) AS rejected FROM customer")
def csv_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a CSV of several files have the numbers from 0 on, each once; rows without a name are told."""
    listed = written(_listing(spark, sf_dir), "listed")
    _, missing = readers.listings(listed)
    told = listed.agg(F.count("*").alias("rows"), F.countDistinct("row_idx").alias("numbers"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))
    return told.join(F.broadcast(missing.agg(F.count("*").alias("rejected"))))


@query(f"SELECT 'pl-' || k AS google_place_id, c_name AS practice_name, CASE WHEN k % 3 = 0 THEN 'Oakland' ELSE 'Springfield' END AS address_city FROM ({_LISTED}) WHERE k % 2 = 0")
def places_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A places export: closed places go, fields under their other names (A3)."""
    c = F.col
    raw = _listing(spark, sf_dir)
    places = raw.select("row_idx", c("name").alias("title"), c("place_id").alias("placeid"), F.coalesce(F.nullif("city", F.lit("")), F.lit("Springfield")).alias("city"), c("state"), F.when(c("type") == "Cardiology clinic", "false").otherwise("TRUE").alias("permanentlyclosed"))
    rows, _ = readers.listings(places, kind="places")
    return rows.select("google_place_id", "practice_name", "address_city")


@query(
    """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Ann Lee, MD|Bo Ray' ELSE 'Ann Lee, MD|Bo Ray|Cy Fox, DDS, PhD' END AS provider_names, 'TX' AS address_state, c_custkey::VARCHAR AS id, 'manual' AS source_type
    FROM customer"""
)
def manual_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list in the canonical schema: its own ids stay, provider cells are parted (A4, A5)."""
    c = F.col
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("row_idx"), c("c_custkey").cast("string").alias("id"), c("c_name").alias("practice_name"), F.lit("texas").alias("address_state"), F.when(c("c_custkey") % 2 == 0, "Ann Lee, MD | Bo Ray").otherwise("Ann Lee, MD, Bo Ray, Cy Fox, DDS, PhD").alias("provider_names"))
    out, _ = readers.manual(rows)
    return out.select(c("id").cast("long").alias("c_custkey"), F.array_join("provider_names", "|").alias("provider_names"), "address_state", "id", "source_type")


@query(
    """
    SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 4 = 0 THEN 'p' || c_custkey || '.example.com' ELSE '' END AS website_domain, '415555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone_digits, 'pl-' || c_custkey AS google_place_id,
      CASE WHEN c_custkey % 2 = 0 THEN 'Cardiology clinic' ELSE '''=Dermatologist' END AS google_category FROM customer"""
)
def discovery_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload with its match fields (A6, A7); a cell that looked like a formula stays marked."""
    c = F.col
    rows = readers.uploads(_listing(spark, sf_dir).withColumns({"row_idx": c("key").cast("long"), "site": F.when(c("site") != "n/a", c("site"))}))
    return rows.select("row_idx", "website_domain", "phone_digits", "google_place_id", "google_category")


@query("SELECT s_suppkey AS ordinal, (1000000000 + s_suppkey)::VARCHAR AS npi, s_name AS name, lpad(s_suppkey::VARCHAR, 5, '0') AS zip, '' AS state FROM supplier")
def customer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer list whose columns have other names, parted by semicolons."""
    c = F.col
    rows = table(spark, sf_dir, "supplier").select((1000000000 + c("s_suppkey")).cast("string").alias("Provider_NPI"), c("s_name").alias("Account_Name"), F.lpad(c("s_suppkey").cast("string"), 5, "0").alias("ZIP5"), c("s_suppkey").cast("string").alias("key"))
    path = scratch(spark, "customers")
    rows.write.option("header", True).option("sep", ";").csv(path)
    read = readers.read_csv(spark, path)
    return readers.customers(read.withColumn("row_idx", c("key").cast("long")).drop("key"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN n_name ELSE 'Given' END AS address_city, CASE WHEN c_custkey % 7 = 0 THEN 'NV' ELSE 'CA' END AS address_state FROM customer JOIN nation ON c_nationkey = n_nationkey")
def zip_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City and state that only the ZIP gives."""
    c = F.col
    zips = table(spark, sf_dir, "nation").select((c("n_nationkey") + 10000).cast("string").alias("zip"), c("n_name").alias("city"), F.lit("NV").alias("state"))
    bare = c("c_custkey") % 7 == 0
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("row_idx"), c("c_name").alias("name"), F.when(bare, "").otherwise("Given").alias("city"), F.when(bare, "").otherwise("CA").alias("state"), (c("c_nationkey") + 10000).cast("string").alias("zip"), c("c_custkey").cast("string").alias("place_id"))
    out, _ = readers.listings(rows, zips)
    return out.select(c("google_place_id").cast("long").alias("c_custkey"), "address_city", "address_state")


@query("SELECT n_nationkey, n_name, row_number() OVER (PARTITION BY wrapped ORDER BY n_nationkey) - 1 AS ordinal, wrapped FROM nation, (VALUES (true), (false)) t(wrapped)")
def run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's records from one JSON text, in a wrapper or as a bare list (A10). Nations are 25 rows."""
    c = F.col
    listed = table(spark, sf_dir, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("bare"))
    out = []
    for wrapped, text in ((False, c("bare")), (True, F.concat(F.lit('{"run_id": "r", "records": '), c("bare"), F.lit("}")))):
        path = scratch(spark, "run")
        listed.select(text.alias("value")).coalesce(1).write.text(path)
        out.append(readers.run_records(spark, path, "n_nationkey:int,n_name:string").withColumn("wrapped", F.lit(wrapped)))
    return readers.unioned(*out).select(c("n_nationkey"), "n_name", c("ordinal").cast("long").alias("ordinal"), "wrapped")


@query("SELECT c_custkey::VARCHAR AS entry_id, c_name AS practice_name, c_mktsegment AS phone, 'r1' AS run_id, count(*) OVER () AS record_count FROM customer")
def registry_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines with a manifest, read as a registry; one that is missing is empty."""
    c = F.col
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").cast("string").alias("entry_id"), c("c_name").alias("practice_name"), c("c_mktsegment").alias("phone"))
    path = scratch(spark, "registry")
    writers.to_json(rows, path, "r1", NOW)
    schema = "entry_id string, practice_name string, phone string"
    read = readers.registry(spark, f"{path}/records", schema).union(readers.registry(spark, f"{path}/none", schema))
    return read.join(F.broadcast(spark.read.json(f"{path}/manifest").select("run_id", "record_count")))


@query("SELECT event_id::VARCHAR AS record_id, CASE WHEN event_type = 'purchase' THEN 'approved' ELSE 'pending' END AS qc_status, false AS damaged FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id::VARCHAR, NULL, true FROM events WHERE event_type = 'error'")
def review_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews from JSON lines, damaged ones set aside."""
    c = F.col
    line = F.to_json(F.struct(c("event_id").cast("string").alias("record_id"), F.when(c("event_type") == "purchase", "approved").otherwise("pending").alias("qc_status")))
    path = scratch(spark, "reviews")
    table(spark, sf_dir, "events").select(F.when(c("event_type") == "error", F.concat(F.lit("#"), c("event_id").cast("string"), F.lit("{broken"))).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.reviews(spark, path, strict=False)
    return good.select("record_id", "qc_status", F.lit(False).alias("damaged")).unionByName(bad.select(F.regexp_extract("damaged", "#([0-9]+)", 1).alias("record_id"), F.lit(None).cast("string").alias("qc_status"), F.lit(True).alias("damaged")))


@query("SELECT s_suppkey::VARCHAR AS run_id, CASE WHEN s_suppkey % 4 = 1 THEN 'failed' WHEN s_suppkey % 4 = 2 THEN 'complete' ELSE 'failed' END AS status FROM supplier WHERE s_suppkey % 4 > 0")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every run that can be read; orphans are failed."""
    c = F.col
    state = F.when(c("s_suppkey") % 4 == 1, "running").when(c("s_suppkey") % 4 == 2, "complete").otherwise("pending")
    line = F.when(c("s_suppkey") % 4 == 0, "{broken").otherwise(F.to_json(F.struct(c("s_suppkey").cast("string").alias("run_id"), state.alias("status"))))
    path = scratch(spark, "runs")
    table(spark, sf_dir, "supplier").select(line.alias("value"), c("s_suppkey").alias("run")).repartition("run").write.partitionBy("run").text(path)
    return metrics.reconciled(readers.runs(spark, f"{path}/run=*/*", "run_id string, status string")).select("run_id", "status")


@query(
    """
    WITH p AS (SELECT *, page_id % 50 AS rec FROM pages WHERE trim(html) <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY page_id) AS no FROM p),
    w AS (SELECT rec, string_agg('[Source: ' || url || ']' || chr(10) || html, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY no) AS t FROM n GROUP BY 1)
    SELECT rec::VARCHAR AS folder, md5(CASE WHEN length(t) > 25000 THEN left(t, 25000) || chr(10) || chr(10) || '[... content trimmed for token budget ...]' ELSE t END) AS context_md5 FROM w"""
)
def page_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to a store by record, read back, and joined under the budget."""
    c = F.col
    rows = evidence.indexed(table(spark, sf_dir, "pages").select((c("page_id") % 50).alias("record_id"), c("page_id").alias("page_no"), "url", c("html").alias("text")))
    path = scratch(spark, "pages")
    writers.to_pages(rows.select("folder", "page_no", "url", "text"), path)
    pages = spark.read.parquet(path).withColumn("folder", c("folder").cast("string"))
    return evidence.context(pages, "folder").select("folder", F.md5("context_text").alias("context_md5"))


@query("SELECT n.version, c_mktsegment, count(*) AS n FROM customer, (VALUES (1), (2)) n(version) WHERE n.version = 1 OR c_acctbal > 0 GROUP BY 1, 2")
def versioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table; a third writer of the second is refused and leaves it whole."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    path = scratch(spark, "versions")
    writers.to_version(rows, path, 1, 0)
    writers.to_version(rows.where("c_acctbal > 0"), path, 2, 1)
    try:
        writers.to_version(rows.limit(0), path, 2, 1)
    except RuntimeError:
        return spark.read.parquet(path).groupBy("version", "c_mktsegment").agg(F.count("*").alias("n"))
    raise AssertionError("a version was written twice")


# --- tiering that fails closed, exclusions, briefs -------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records before a decision: those in state O have no score, those in state P are customers."""
    c = F.col
    rows = enrichment.scored(_orders(spark, sf_dir), DEFS)
    return enrichment.shaped(rows.withColumns({
        "id": c("o_orderkey").cast("string"), "bullseye_score": F.when(c("st") != "O", c("bullseye_score")), "enrichment_status": F.lit("complete"), "source_confidence": F.lit("complete"),
        "customer_suppressed": c("st") == "P", "suppression_reason": F.when(c("price") > 100000, "Existing customer: big").otherwise(""),
    }))


_PLAIN_TIER = _TIER.replace("WHEN st = 'P' THEN 'Manual Review'", "")


@query(
    f"""
    SELECT o_orderkey, CASE WHEN st = 'P' THEN 'Excluded' WHEN st = 'O' THEN 'Manual Review' ELSE tier END AS target_tier, CASE WHEN st = 'P' THEN 'EXCLUDED' ELSE 'CLEAR' END AS exclusion_status,
      CASE WHEN st = 'P' THEN CASE WHEN price > 100000 THEN 'Existing customer: big' ELSE 'Existing customer' END END AS exclusion_reason, CASE WHEN st = 'P' THEN least(fit, 40) WHEN st = 'O' THEN NULL ELSE fit END AS bullseye_score
    FROM ({_PLAIN_TIER})"""
)
def fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on whole records: customers are excluded, records that cannot be judged go to manual review."""
    return rules.decided(_judged(spark, sf_dir), rules.RunConfig()).select("o_orderkey", "target_tier", "exclusion_status", "exclusion_reason", "bullseye_score")


@query("SELECT o_orderkey::VARCHAR AS record_id, 'exclusion_check' AS step, 'no score' AS error FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'")
def fail_closed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of records that could not be judged (I4)."""
    return rules.undecided(_judged(spark, sf_dir)).select("record_id", "step", "error")


@query(
    f"""
    SELECT o_orderkey, CASE WHEN st = 'P' THEN 'Excluded' WHEN st = 'O' THEN 'Manual Review' ELSE tier END AS target_tier, CASE WHEN st = 'P' THEN least(fit, 40) WHEN st = 'O' THEN 0 ELSE fit END AS bullseye_score,
      st = 'O' AS warned, 'pending' AS qc_status FROM ({_PLAIN_TIER})"""
)
def final_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in their final shape: a missing score is 0 and noted, the tier stays what was decided."""
    out = rules.finalized(rules.decided(_judged(spark, sf_dir), rules.RunConfig()))
    return out.select("o_orderkey", "target_tier", "bullseye_score", F.contains("internal_notes", F.lit("Missing bullseye_score")).alias("warned"), "qc_status")


_EXCLUDE = """SELECT s_suppkey, s_suppkey % 5 = 0 AS spec, s_suppkey % 7 = 0 AS noweb, r_name NOT IN ('AMERICA', 'EUROPE') AS away, s_suppkey % 3 = 0 AS closed, s_suppkey % 4 = 0 AS hosp FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(
    f"""
    SELECT s_suppkey, array_to_string(list_filter([CASE WHEN spec THEN 'wrong_specialty' END, CASE WHEN noweb THEN 'no_web_presence' END, CASE WHEN away THEN 'outside_geography' END, CASE WHEN closed THEN 'practice_closed' END, CASE WHEN hosp THEN 'hospital_owned' END], lambda x: x IS NOT NULL), ',') AS rules,
      CASE WHEN closed THEN 'practice_closed_or_inactive' WHEN spec OR away THEN 'out_of_scope_specialty' WHEN hosp THEN 'hospital_employed_physician' WHEN noweb THEN 'no_web_presence' ELSE '' END AS gate FROM ({_EXCLUDE})"""
)
def exclusion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that fire on a record, a model's triggers among them, and the gate of highest priority."""
    from sieveworks.queries import _CONFIG, _suppliers

    c = F.col
    run = rules.RunConfig(_CONFIG.target_specialty, _CONFIG.target_geography, ("no_web_presence", "hospital_owned"))
    rows = enrichment.shaped(_suppliers(spark, sf_dir).withColumn("exclusion_triggers", F.array_compact(F.array(F.when(c("s_suppkey") % 4 == 0, "hospital_owned"), F.when(c("s_suppkey") % 3 == 0, "practice_closed"), F.lit("competitor_conflict")))))
    found = rules.exclusions(run, rules.structural(run, c("specialty"), c("website_url"), c("address_state"), c("taxonomy_exclusions")), c("signals"), c("exclusion_triggers"), F.lit(""), c("website_url"), F.lit(""))
    return rows.withColumn("f", found).select("s_suppkey", F.array_join("f.rules", ",").alias("rules"), c("f.gate").alias("gate"))


@query(f"SELECT s_suppkey, CASE WHEN spec OR noweb OR away THEN 'Excluded' ELSE 'Contender' END AS target_tier, 0 AS bullseye_score, 'not_enriched' AS enrichment_status FROM ({_EXCLUDE})")
def ingest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roster before anything is crawled."""
    from sieveworks.queries import _CONFIG, _suppliers

    rows = enrichment.shaped(_suppliers(spark, sf_dir))
    return rules.ingested(rows, _CONFIG).select("s_suppkey", "target_tier", "bullseye_score", "enrichment_status")


@query("SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'dentists' END, CASE WHEN s_suppkey % 3 = 0 THEN 'vets' END], lambda x: x IS NOT NULL), ',') AS fired FROM supplier")
def taxonomy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose taxonomy code a record has."""
    c = F.col
    codes = F.array_compact(F.array(F.when(c("s_suppkey") % 3 == 0, "174M"), F.lit("0"), F.when(c("s_suppkey") % 2 == 0, "122D")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(rules.taxonomy_rules(codes, {"122D": "dentists", "174M": "vets", "9": "none"}), ",").alias("fired"))


@query(
    f"""
    SELECT o_orderkey, 'Cardiology practice' || CASE WHEN big OR disc OR bulk THEN ': ' || array_to_string(list_slice(list_filter([CASE WHEN big THEN 'Big order' END, CASE WHEN bulk THEN 'Bulk' END, CASE WHEN disc THEN 'Discounted' END], lambda x: x IS NOT NULL), 1, 2), ' + ')
        ELSE ', no confirmed positive signals yet' END || ' (fit ' || fit || ').' AS why_contact,
      big::INT + bulk::INT + disc::INT AS n_evidence, array_to_string(list_filter([CASE WHEN NOT big AND NOT small THEN 'Big order' END, CASE WHEN NOT bulk AND NOT disc THEN 'Bulk' END], lambda x: x IS NOT NULL), ',') AS missing,
      array_to_string(list_filter([CASE WHEN ret THEN 'Returned lines (friction signal present)' END, CASE WHEN bulk THEN 'Bulk (caps tier at Needs Verification)' END], lambda x: x IS NOT NULL), ',') AS risk,
      CASE WHEN big OR bulk OR disc THEN 'Hello' ELSE '' END AS opening_line, 'Ask for Dr. Ann Lee — owner' AS key_contact FROM ({_SCORES})"""
)
def call_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief of each record from its signals and a response."""
    c = F.col
    said = F.struct(F.lit(" Hello ").alias("opening_line"), F.lit("").alias("likely_objection"), F.lit("").alias("discovery_question"), F.lit("").alias("hours_of_operation"))
    people = S.providers(F.array(F.struct(F.lit(" Ann Lee").alias("name"), F.lit("MD").alias("title")), F.struct(F.lit("").alias("name"), F.lit("x").alias("title"))))
    contact = S.primary_contact(F.struct(F.lit("Ann Lee").alias("name"), F.lit("MD").alias("title"), F.lit("owner").alias("reason")), people)
    rows = enrichment.scored(_orders(spark, sf_dir), DEFS).withColumn("b", S.call_brief(c("signals"), c("fit_signal_score"), F.lit("Cardiology"), said, contact))
    return rows.select("o_orderkey", c("b.why_contact").alias("why_contact"), F.size("b.top_evidence").alias("n_evidence"), F.array_join("b.missing_to_verify", ",").alias("missing"), F.array_join("b.disqualifier_risk", ",").alias("risk"), c("b.opening_line").alias("opening_line"), c("b.key_contact").alias("key_contact"))


@query(
    f"""
    WITH g AS (SELECT *, NOT big AND NOT small AS open_big, NOT bulk AND NOT disc AS open_bulk, o_orderkey % 2 = 0 AS good FROM ({_STATES}))
    SELECT o_orderkey, CASE WHEN NOT good AND (big OR ret OR disc OR bulk) THEN 'hold' WHEN NOT open_big AND NOT open_bulk THEN 'hold'
        WHEN (NOT open_big OR o_orderkey % 3 = 0) AND (NOT open_bulk OR o_orderkey % 5 = 0) THEN 'promote' ELSE 'hold' END AS action,
      array_to_string(list_filter([CASE WHEN open_big THEN 'big' END, CASE WHEN open_bulk THEN 'bulk' END], lambda x: x IS NOT NULL), ',') AS gating, CASE WHEN good THEN 0 ELSE big::INT + ret::INT + disc::INT + bulk::INT END AS unanchored FROM g"""
)
def second_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second reading does with a record: anchors first, then the gating signals."""
    c = F.col
    rows = enrichment.scored(_orders(spark, sf_dir), DEFS)
    said = F.create_map(F.lit("big"), F.when(c("o_orderkey") % 3 == 0, "yes").otherwise("no"), F.lit("bulk"), F.when(c("o_orderkey") % 5 == 0, "yes").otherwise("no"))
    text = F.when(c("o_orderkey") % 2 == 0, "We have SEEN it.").otherwise("nothing")
    rows = rows.withColumn("v", rules.verified(c("signals"), text, DEFS, said))
    return rows.select("o_orderkey", c("v.action").alias("action"), F.array_join("v.gating", ",").alias("gating"), F.size("v.anchor_failures").alias("unanchored"))


_NEW_DEFS = (
    S.SignalDef("big", "Big order", 30, no_weight=-5, required_for_bullseye=True),
    S.SignalDef("returned", "Returned lines", -10),
    S.SignalDef("discount", "Discounted", 35, not_found_weight=-5, reinforces="bulk"),
    S.SignalDef("bulk", "Bulk", 35, verification_required=True, cap_tier=K.VERIFY),
)
_NEW_SCORES = _SCORES.replace("THEN 40.0", "THEN 30.0").replace("THEN -20.0", "THEN -10.0").replace("THEN 25.0", "THEN 35.0")
_NEW_TIER = _PLAIN_TIER.replace(_SCORES, _NEW_SCORES)


@query(
    f"""
    SELECT o.tier AS old_tier, CASE WHEN o.st = 'P' THEN o.tier ELSE n.tier END AS new_tier, CASE WHEN o.st = 'P' THEN false ELSE o.fit <> n.fit END AS score_changed, count(*) AS n
    FROM (SELECT o_orderkey, st, CASE WHEN st = 'P' THEN 'Excluded' ELSE tier END AS tier, CASE WHEN st = 'P' THEN least(fit, 40) ELSE fit END AS fit FROM ({_PLAIN_TIER})) o JOIN (SELECT o_orderkey, tier, fit FROM ({_NEW_TIER})) n USING (o_orderkey) GROUP BY 1, 2, 3"""
)
def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records under new weights, and what moves; excluded ones stay."""
    c = F.col
    rows = enrichment.scored(_orders(spark, sf_dir), DEFS).withColumns({"id": c("o_orderkey").cast("string"), "enrichment_status": F.lit("complete"), "source_confidence": F.lit("complete"), "customer_suppressed": c("st") == "P"})
    done = written(rules.finalized(rules.decided(enrichment.shaped(rows), rules.RunConfig())).drop("customer_suppressed"), "done")
    return metrics.transitions(done, enrichment.rescored(done, _NEW_DEFS, rules.RunConfig()))


# --- passes over a finished run --------------------------------------------------------------------------------------


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(customers as records with numbers, suppliers as the customer list)."""
    c = F.col
    none = F.array().cast("array<struct<name:string,npi:string>>")
    rows = table(spark, sf_dir, "customer").select(
        c("c_custkey").cast("string").alias("id"), c("c_name").alias("practice_name"), F.lit("").alias("address_zip"), F.lit("").alias("address_state"), c("c_custkey").cast("string").alias("npi_number"), F.lit("").alias("npi_optional"), none.alias("providers"),
        (c("c_custkey") % 10 == 9).alias("customer_suppressed"), F.when(c("c_acctbal") < 0, "EXCLUDED").otherwise("CLEAR").alias("exclusion_status"), F.when(c("c_acctbal") < 0, K.EXCLUDED).otherwise(K.CONTENDER).alias("target_tier"), F.lit(70).alias("bullseye_score"), F.lit("complete").alias("enrichment_status"),
    )
    listed = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("ordinal"), c("s_suppkey").cast("string").alias("npi"), c("s_name").alias("name"), F.lit("").alias("zip"), F.lit("").alias("state"))
    return rows, listed


_CHECKED = """SELECT c_custkey, c_acctbal < 0 AS out, c_custkey % 10 = 9 AS mark, s_suppkey IS NOT NULL AS hit FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"""


@query(
    f"""
    SELECT c_custkey::VARCHAR AS id, CASE WHEN out OR (hit AND NOT mark) THEN 'EXCLUDED' ELSE 'CLEAR' END AS exclusion_status, CASE WHEN hit AND NOT mark AND NOT out THEN 'Excluded' WHEN out THEN 'Excluded' ELSE 'Contender' END AS target_tier,
      CASE WHEN hit AND NOT mark AND NOT out THEN 40 ELSE 70 END AS bullseye_score FROM ({_CHECKED})"""
)
def suppression_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished run checked against customers: newly matched records are excluded, the others stay."""
    rows, listed = _named(spark, sf_dir)
    out, _ = passes.suppressed(enrichment.shaped(rows), listed, rules.RunConfig())
    return out.select("id", "exclusion_status", "target_tier", "bullseye_score")


@query(f"SELECT count(*) FILTER (hit AND NOT mark AND NOT out) AS newly_suppressed, count(*) FILTER (mark OR (hit AND out)) AS already_suppressed, count(*) AS total FROM ({_CHECKED})")
def suppression_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pass would do."""
    rows, listed = _named(spark, sf_dir)
    return passes.suppression_counts(passes.rechecked(rows, listed))


@query(
    f"""
    SELECT o_orderkey, CASE WHEN st = 'P' THEN 'Excluded' WHEN st = 'O' OR o_orderkey % 3 = 0 THEN 'Contender' ELSE tier END AS target_tier, CASE WHEN st = 'P' OR st = 'O' OR o_orderkey % 3 = 0 THEN 5 ELSE fit END AS bullseye_score FROM ({_PLAIN_TIER})"""
)
def reextraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals read again from stored text: eligible records with a response change."""
    c = F.col
    fresh = _orders(spark, sf_dir)
    rows = fresh.select("o_orderkey", c("o_orderkey").cast("string").alias("id"), F.when(c("st") == "P", "EXCLUDED").otherwise("CLEAR").alias("exclusion_status"), F.when(c("st") == "P", K.EXCLUDED).otherwise(K.CONTENDER).alias("target_tier"), F.lit(5).alias("bullseye_score"), F.lit("complete").alias("source_confidence"), F.lit("complete").alias("enrichment_status"), F.when(c("st") == "O", " ").otherwise(F.repeat(F.lit("text "), 40)).alias("context_text"))
    entry = F.transform("signals", lambda s: F.struct(s.signal_id.alias("signal_id"), s.signal_state.alias("signal_state"), s.evidence_text.alias("evidence_text"), s.source_url.alias("source_url"), s.confidence.alias("confidence"), F.lit("").alias("attribution")))
    said = fresh.where("o_orderkey % 3 > 0").select(c("o_orderkey").cast("string").alias("id"), entry.alias("response"))
    out, _ = passes.reextracted(rows, said, DEFS, rules.RunConfig())
    return out.select(c("id").cast("long").alias("o_orderkey"), "target_tier", "bullseye_score")


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS not_enriched, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '5-LOW') AS excluded, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 2 = 0 OR o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND o_orderkey % 2 = 0) AS no_context, count(*) FILTER (o_orderstatus <> 'P' AND NOT (o_orderstatus = 'O' AND o_orderpriority = '5-LOW') AND o_orderkey % 2 = 1) AS eligible FROM orders")
def reextraction_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records a pass would read again, and why not the others."""
    c = F.col
    rows = table(spark, sf_dir, "orders").select(F.when(c("o_orderstatus") == "P", "not_enriched").otherwise("complete").alias("enrichment_status"), F.when((c("o_orderstatus") == "O") & (c("o_orderpriority") == "5-LOW"), "EXCLUDED").otherwise("CLEAR").alias("exclusion_status"), F.when(c("o_orderkey") % 2 == 1, "text").otherwise("").alias("context_text"))
    return metrics.reextract_counts(rows)


@query(
    """
    SELECT c_custkey, c_custkey % 2 = 0 AND NOT (c_custkey % 3 = 0 AND c_custkey % 5 > 0) AS fresh, CASE WHEN c_custkey % 2 = 0 AND NOT (c_custkey % 3 = 0 AND c_custkey % 5 > 0) THEN 'Bullseye' ELSE 'Contender' END AS target_tier,
      3 AS provider_count, false AS has_verification FROM customer"""
)
def reenrichment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset that was enriched again is merged by id: only its own fields change, no blocked crawl replaces a good one."""
    c = F.col
    k = c("c_custkey")
    old = table(spark, sf_dir, "customer").select(k, k.cast("string").alias("id"), F.lit(K.CONTENDER).alias("target_tier"), F.lit(3).alias("provider_count"), F.lit("v").alias("verification"), F.when(k % 5 > 0, "complete").otherwise("limited").alias("source_confidence"), F.lit("old").alias("date_enriched"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(k.cast("string").alias("id"), F.lit(K.BULLSEYE).alias("target_tier"), F.lit(1).alias("provider_count"), F.when(k % 3 == 0, "failed").otherwise("complete").alias("source_confidence"), F.lit("new").alias("date_enriched"))
    out = passes.reenriched(old, new)
    return out.select("c_custkey", (c("date_enriched") == "new").alias("fresh"), "target_tier", "provider_count", F.lit("verification" in out.columns).alias("has_verification"))


@query("SELECT (SELECT count(*) FROM customer SEMI JOIN supplier ON s_suppkey = c_custkey) AS removed, (SELECT count(*) FROM customer ANTI JOIN supplier ON s_suppkey = c_custkey) AS remaining")
def roster_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records taken off a roster before it is enriched."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return passes.pruned_roster(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), ids, "ingested")[1]


@query("SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 3 > 0 AS again FROM customer WHERE c_custkey % 4 > 0 OR c_custkey % 2 = 0")
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a checkpoint leaves to do: rows that it lacks and rows that failed."""
    c = F.col
    every = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"))
    done = every.where("not (id % 2 = 0 and id % 3 > 0)").select("id", F.lit("complete").alias("enrichment_status")).union(every.where("id % 2 = 0 and id % 3 > 0").select("id", F.lit("failed")))
    todo, finished = views.resumed(every, done)
    return todo.select(c("id").alias("c_custkey"), F.lit(True).alias("again")).union(finished.select("id", F.lit(False)))


# --- reviews ---------------------------------------------------------------------------------------------------------


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review for each user, by the last event."""
    c = F.col
    log = overlay.latest(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), ["event_type", "value"])
    return log.select(c("user_id").cast("string").alias("record_id"), F.when(c("event_type") == "purchase", "approved").otherwise("pending").alias("qc_status"), c("event_type").alias("analyst_note"), F.lit("old").alias("reviewed_by"), F.lit("2025").alias("reviewed_at"), F.array(F.lit("angle")).alias("extra_sales_angles"))


_USERS = """SELECT user_id, last(event_type ORDER BY ts, event_id) AS e FROM events GROUP BY 1"""


@query(
    f"""
    SELECT coalesce(user_id, c_custkey)::VARCHAR AS record_id, CASE WHEN c_custkey IS NULL OR c_custkey % 3 = 0 THEN coalesce(CASE WHEN e = 'purchase' THEN 'approved' ELSE 'pending' END, 'pending') WHEN c_custkey % 3 = 1 THEN 'rejected' ELSE 'approved' END AS qc_status,
      CASE WHEN c_custkey % 3 = 1 THEN 'Bullseye' END AS override_tier, CASE WHEN c_custkey % 3 = 1 OR c_custkey % 3 = 2 THEN 'ann' WHEN user_id IS NOT NULL THEN 'old' END AS reviewed_by, CASE WHEN c_custkey % 3 > 0 THEN 'note' ELSE coalesce(e, '') END AS analyst_note, user_id IS NOT NULL AS has_angles
    FROM ({_USERS}) FULL JOIN customer ON c_custkey = user_id WHERE user_id IS NOT NULL OR c_custkey % 3 > 0"""
)
def review_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits saved over reviews: a tier without a reason is refused, angles stay."""
    c = F.col
    k = c("c_custkey")
    edits = table(spark, sf_dir, "customer").select(k.cast("string").alias("record_id"), F.lit(" note ").alias("analyst_note"), F.when(k % 3 < 2, K.BULLSEYE).alias("override_tier"), F.when(k % 3 == 1, "why").otherwise(" ").alias("override_reason"), F.when(k % 3 == 1, "rejected").otherwise("approved").alias("qc_status"))
    out = overlay.saved(_reviews(spark, sf_dir), edits, "ann", NOW)
    return out.select("record_id", "qc_status", "override_tier", "reviewed_by", "analyst_note", (F.size("extra_sales_angles") > 0).alias("has_angles"))


@query(f"SELECT coalesce(user_id, c_custkey)::VARCHAR AS record_id, CASE WHEN c_custkey IS NOT NULL OR e = 'purchase' THEN 'approved' ELSE 'pending' END AS qc_status, CASE WHEN c_custkey IS NOT NULL AND coalesce(e, '') <> 'purchase' THEN 'ann' ELSE 'old' END AS reviewed_by FROM ({_USERS}) FULL JOIN customer ON c_custkey = user_id")
def bulk_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of records approved; those that are already keep who approved them."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"))
    return overlay.with_status(_reviews(spark, sf_dir), ids, "approved", "ann", NOW).select("record_id", "qc_status", "reviewed_by")


@query(
    f"""
    SELECT coalesce(user_id, c_custkey)::VARCHAR AS record_id, CASE WHEN c_custkey IS NULL THEN e WHEN coalesce(e, '') = '' THEN 'Re-enriched on 2026-01-02 (manual content).' ELSE e || chr(10) || 'Re-enriched on 2026-01-02 (manual content).' END AS analyst_note,
      CASE WHEN c_custkey % 4 = 0 THEN 'separate' WHEN c_custkey % 4 = 1 THEN 'merge' END AS decision FROM ({_USERS}) FULL JOIN customer ON c_custkey = user_id"""
)
def review_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a re-enrichment adds to notes, and rulings on pairs, of which those without a reason are refused."""
    c = F.col
    k = c("c_custkey")
    ids = table(spark, sf_dir, "customer").select(k.cast("string").alias("record_id"), F.when(k % 4 == 0, "separate").when(k % 4 == 1, "merge").when(k % 4 == 2, "perhaps").otherwise("merge").alias("decision"), F.when(k % 4 == 3, " ").otherwise("why").alias("reason"))
    reviews = _reviews(spark, sf_dir)
    ruled = overlay.ruled(reviews, ids, "ann", NOW).select("record_id", "consolidation_decision.decision")
    return overlay.stamped(reviews, ids, "manual content", NOW).select("record_id", "analyst_note").join(ruled, "record_id", "left")


@query(
    f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'no' WHEN big THEN 'yes' WHEN small THEN 'no' ELSE 'not_found' END AS big, CASE WHEN o_orderkey % 2 = 0 THEN 'checked' WHEN big OR small THEN 'seen' ELSE 'seen' END AS note, o_orderkey % 2 = 0 AS marked, CASE WHEN o_orderkey % 2 = 0 AND big THEN 1 ELSE 0 END AS withdrawn,
      CASE WHEN o_orderkey % 2 = 0 AND big THEN '' ELSE 'Hello' END AS opening_line, CASE WHEN o_orderkey % 2 = 0 AND big THEN 0 ELSE 1 END AS n_angles, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN big THEN 'yes' WHEN small THEN 'no' ELSE 'not_found' END END AS original_state FROM ({_STATES})"""
)
def signal_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysts' states over signals, saved and applied; prose that rests on a withdrawn signal goes."""
    c = F.col
    rows = _orders(spark, sf_dir).withColumn("id", c("o_orderkey").cast("string")).withColumn("target_tier", F.lit(K.CONTENDER))
    state = F.filter("signals", lambda s: s.signal_id == "big")[0].signal_state
    edits = rows.where("o_orderkey % 2 = 0").select(c("id").alias("record_id"), F.lit("big").alias("signal_id"), F.lit("no").alias("override_state"), F.lit("").alias("source_url"), F.lit("checked").alias("override_note"), F.lit("ann").alias("override_by"), state.alias("engine_state"))
    once = overlay.with_override(spark.createDataFrame([], overlay.REVIEW), edits, NOW)
    twice = written(overlay.with_override(once, edits.withColumn("engine_state", F.lit("lost")), NOW), "overrides")
    brief = F.struct(*[F.lit("Hello").alias(x) for x in overlay.PROSE], F.array(F.struct(F.lit("Big order").alias("point"))).alias("top_evidence"))
    shown = overlay.reviewed(rows.withColumns({"call_brief": brief, "sales_angle": F.array(F.lit("x"))}), twice)
    out = overlay.with_overrides(shown).withColumn("s", F.filter("signals", lambda s: s.signal_id == "big")[0])
    gone = F.size(overlay.retracted(c("signals"), c("review.signal_overrides")))
    before = shown.select("o_orderkey", gone.alias("withdrawn"))
    return out.select("o_orderkey", c("s.signal_state").alias("big"), c("s.evidence_text").alias("note"), c("s.is_override").alias("marked"), c("call_brief.opening_line").alias("opening_line"), F.size("sales_angle").alias("n_angles"), F.try_element_at("review.signal_overrides", F.lit("big")).original_state.alias("original_state")).join(before, "o_orderkey")


@query("SELECT max(ts) > TIMESTAMP '2024-01-01 12:00:00' AS stale, max(ts) AS newest FROM events WHERE event_type <> 'error'")
def brief_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a review is newer than what was published; unreadable times don't count."""
    c = F.col
    rows = table(spark, sf_dir, "events").select(F.when(c("event_type") == "error", "soon").otherwise(c("ts").cast("string")).alias("reviewed_at"))
    return passes.brief_stale(rows, "2024-01-01 12:00:00")


# --- orders, exports, handoffs ---------------------------------------------------------------------------------------


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment = 'MACHINERY', CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END, c_name) AS place FROM customer")
def territory_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in territory order, numbered over ranges of it."""
    c = F.col
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(c("c_mktsegment") == "MACHINERY", "").otherwise(c("c_mktsegment")).alias("address_state"), F.lit("").alias("address_city"), F.lit("").alias("address_zip"), c("c_name").alias("practice_name"))
    return placed(rows, views.territory_order()).select("c_custkey", "place")


@query(f"SELECT id, row_number() OVER (ORDER BY CASE displayed WHEN 'Bullseye' THEN 3 ELSE 1 END DESC, score DESC, id) AS place FROM ({_REVIEWED}) WHERE displayed NOT IN ('Excluded', 'Manual Review')")
def contact_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole queue of records to call, numbered."""
    rows = views.contact_queue(_reviewed(spark, sf_dir).withColumn("confidence_score", F.lit(0)))
    return placed(rows, [*views.queue_order(), F.asc("id")]).select("id", "place")


@query(f"SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM ({_REVIEWED}) WHERE displayed <> 'Excluded' AND qc = 'approved' AND (coalesce(over, false) OR (NOT excl AND displayed NOT IN ('Needs Verification', 'Manual Review')))")
def approved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved records by score."""
    rows = _reviewed(spark, sf_dir).where(overlay.approved()).withColumn("ordinal", F.col("id"))
    return placed(rows, views.approved_order()).select("id", "place")


@query(f"SELECT id, displayed AS tier_group, row_number() OVER (ORDER BY CASE displayed WHEN 'Bullseye' THEN 1 WHEN 'Contender' THEN 3 WHEN 'Manual Review' THEN 4 ELSE 5 END, score DESC, id) AS place FROM ({_REVIEWED})")
def tier_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records grouped by displayed tier, by score in each; overrides count."""
    return passes.tier_groups(_reviewed(spark, sf_dir)).select("id", "tier_group", "place")


@query(f"SELECT 'r1' AS run_id, 'Acme' AS client_name, count(*) AS records_screened, count(*) FILTER (displayed <> 'Excluded' AND qc = 'approved' AND (coalesce(over, false) OR (NOT excl AND displayed NOT IN ('Needs Verification', 'Manual Review')))) AS records_approved, count(*) FILTER (excl) AS records_excluded FROM ({_REVIEWED})")
def package_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a package says of its run."""
    return passes.manifest(_reviewed(spark, sf_dir), {"run_id": "r1", "client_name": "Acme"}).select("run_id", "client_name", "records_screened", "records_approved", "records_excluded")


@query(
    f"""
    WITH n AS (SELECT count(*) AS total, count(*) FILTER (spec) AS w, count(*) FILTER (away) AS o, count(*) FILTER (noweb) AS b, count(*) FILTER (spec OR noweb OR away) AS x FROM ({_EXCLUDE})), r AS (SELECT UNNEST([{{'r': 'wrong_specialty', 'n': w}}, {{'r': 'outside_geography', 'n': o}}, {{'r': 'no_web_presence', 'n': b}}], recursive := true) FROM n)
    SELECT x > 0 AND x / total > 0.1 AS blocked, CASE WHEN x > 0 AND x / total > 0.1 THEN 'Exclusion canary: ' || x || ' of ' || total || ' records (' || printf('%.1f', round(x / total, 4) * 100) || '%) were excluded by ' || (SELECT string_agg(r || ' (' || n || ')', ', ' ORDER BY n DESC, r) FROM r WHERE n > 0)
      || '. A run that excludes almost everything is a configuration defect until proven otherwise, so client delivery is blocked. Acknowledge it on the run page, with a reason, to release it.' ELSE '' END AS message FROM n"""
)
def delivery_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a run may not reach a client."""
    from sieveworks.queries import _CONFIG, _suppliers

    run = rules.RunConfig(_CONFIG.target_specialty, _CONFIG.target_geography, _CONFIG.active_exclusion_rules, max_structural_exclusion_share=0.1)
    return rules.canary_block(rules.canary(rules.prescreened(_suppliers(spark, sf_dir), run), run)).select("blocked", "message")


@query(
    f"""
    WITH s AS (SELECT *, list_filter([CASE WHEN big THEN 'big' END, CASE WHEN bulk THEN 'bulk' END, CASE WHEN disc THEN 'discount' END, CASE WHEN ret THEN 'returned' END], lambda x: x IS NOT NULL) AS l FROM ({_STATES}))
    SELECT o_orderkey, coalesce(l[1], '') AS signal_1_id, coalesce(l[2], '') AS signal_2_id, coalesce(l[3], '') AS signal_3_id, CASE WHEN len(l) > 0 THEN 'seen' ELSE '' END AS signal_1_quote, CASE WHEN len(l) > 2 THEN '2026' ELSE '' END AS signal_3_captured FROM s"""
)
def evidence_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest quotes of a record as columns."""
    c = F.col
    slots = views.evidence_slots(c("signals"), F.lit("2026"))
    names_ = ("signal_1_id", "signal_2_id", "signal_3_id", "signal_1_quote", "signal_3_captured")
    return _orders(spark, sf_dir).select("o_orderkey", *[slots[n].alias(n) for n in names_])


@query(f"SELECT id, c_name AS practice_name, c_mktsegment AS address_city, displayed AS displayed_tier, qc AS qc_status, '' AS signal_1_id, false AS leaks FROM ({_REVIEWED}) WHERE displayed = 'Contender' AND qc <> 'rejected'")
def contender_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows and columns of an export; scores and internal fields stay inside."""
    c = F.col
    rows = _reviewed(spark, sf_dir).withColumns({"signals": F.array().cast(f"array<{S.SIGNAL}>"), "address_state": F.lit(""), "address_zip": F.lit(""), "_internal": F.lit("x"), "internal_notes": F.lit("n"), "confidence_score": F.lit(1)})
    out = views.export(rows, "contender")
    leaks = bool({"bullseye_score", "confidence_score", "_internal"} & set(out.columns))
    return out.select(c("id"), "practice_name", "address_city", "displayed_tier", "qc_status", "signal_1_id", F.lit(leaks).alias("leaks"))


@query(
    """
    WITH c AS (SELECT *, c_custkey % 2 = 0 AS z, c_custkey % 3 = 0 AS y FROM customer)
    SELECT c_custkey, CASE WHEN z AND y THEN c_mktsegment || ' (00501), NY' WHEN z THEN '(00501), NY' WHEN y THEN c_mktsegment || ', NY' ELSE 'NY' END AS city_label, 'https://www.google.com/maps/dir/?api=1&destination=Bay%20Clinic%2C%20' || CASE WHEN y THEN c_mktsegment || '%2C%20' ELSE '' END || 'NY' || CASE WHEN z THEN '%2000501' ELSE '' END AS directions,
      CASE WHEN z THEN 'Cash Pay Only' ELSE 'Cash pay' END AS label, 'Cash Pay confirmed present.|Out of area' AS parts, CASE WHEN z THEN 'Health system' ELSE 'Has Lab' END AS badge, CASE WHEN z THEN 'Owned by X' ELSE '"we own a lab" — lab.example.com' END AS evidence, CASE WHEN y THEN 'EXPAND' ELSE 'NEW LOGO' END AS motion, 'Confirm: Cash Pay' AS step, 'CA, NY' AS metro FROM c"""
)
def handoff_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a handoff: place, map link, labels, badge and evidence of a gate, motion, next step."""
    c = F.col
    k = c("c_custkey")
    one = lambda i, label, state, quote, floor: F.struct(F.lit(i).alias("signal_id"), F.lit(label).alias("signal_label"), F.lit(state).alias("signal_state"), F.lit(quote).alias("evidence_text"), F.lit("https://www.lab.example.com/x").alias("source_url"), F.lit(5.0).alias("positive_weight"), floor.alias("floor_tier"))
    signals = F.array(one("has_lab", "", "yes", "we own a lab", F.when(k % 3 == 0, K.CONTENDER).otherwise("")), one("cash", "cash_pay", "not_found", "", F.lit("")))
    city, zip_ = F.when(k % 3 == 0, c("c_mktsegment")).otherwise(""), F.when(k % 2 == 0, "00501").otherwise("")
    gate = F.when(k % 2 == 0, "health_system_affiliated").otherwise("has_lab")
    rows = table(spark, sf_dir, "customer").withColumns({"signals": signals, "gate": gate})
    return rows.select(
        "c_custkey", views.city_label(city, F.lit("NY"), zip_).alias("city_label"), views.directions(F.lit("Bay Clinic"), city, F.lit("NY"), zip_).alias("directions"), views.humanized(F.when(k % 2 == 0, "cash_pay_only").otherwise("Cash pay")).alias("label"),
        F.array_join(views.exclusion_parts(F.lit("cash_pay confirmed present. | Out of area")), "|").alias("parts"), views.gate_badge(c("gate"), c("signals")).alias("badge"), views.gate_evidence(c("gate"), c("signals"), F.lit("Owned by X | more")).alias("evidence"),
        views.motion(c("signals")).alias("motion"), views.next_step(c("signals")).alias("step"), views.metro_label(F.array(F.lit("CA"), F.lit("NY"))).alias("metro"),
    )


@query(
    f"""
    SELECT id, row_number() OVER (ORDER BY (displayed = 'Bullseye' AND qc = 'approved') DESC, score DESC, id) AS place, displayed = 'Bullseye' AND qc = 'approved' AS ready, CASE WHEN displayed = 'Bullseye' THEN 'Call now' ELSE 'Qualify' END AS motion, 'January 02, 2026' AS run_label, DATE '2026-02-01' AS expires, 'Moderate' AS risk, 'r · Likely objection: o' AS landmine
    FROM ({_REVIEWED}) WHERE CASE WHEN displayed = 'Bullseye' THEN qc = 'approved' ELSE displayed = 'Contender' AND qc <> 'rejected' END"""
)
def handoff_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of a handoff in its order."""
    brief = F.struct(F.array(F.lit("r")).alias("disqualifier_risk"), F.lit("o").alias("likely_objection"))
    rows = _reviewed(spark, sf_dir).withColumns({"confidence_score": F.lit(1), "signals": F.array().cast(f"array<{S.SIGNAL}>"), "call_brief": brief, "address_state": F.lit("NY"), "address_zip": F.lit(""), "address_street": F.lit("1 Elm"), "website_url": F.lit("")})
    out = views.handoff(rows, "2026-01-02")
    return placed(out, [F.desc("ready"), F.desc("confidence_score"), F.desc("bullseye_score"), F.asc("id")]).select("id", "place", "ready", "motion", "run_label", "expires", "risk", "landmine")


@query(f"SELECT id, displayed AS section, c_mktsegment || ', NY' AS location, '(415) 555-0001' AS phone, 'Fit' AS sales_angles, '—' AS specialty FROM ({_REVIEWED})")
def internal_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The internal view of all records by section."""
    none = F.array().cast(f"array<{S.SIGNAL}>")
    rows = _reviewed(spark, sf_dir).withColumns({"signals": none, "address_state": F.lit("NY"), "phone": F.lit("4155550001"), "specialty": F.lit(""), "sales_angle": F.array(F.lit("Fit"), F.lit("We help you")), "tier_cap_reason": F.lit(""), "exclusion_reason": F.lit("")})
    return views.sections(rows).select("id", "section", "location", "phone", F.array_join("sales_angles", "|").alias("sales_angles"), "specialty")


# --- matching, registry, resolution ----------------------------------------------------------------------------------


@query(
    """
    WITH r AS (SELECT p_partkey, lpad(regexp_extract(p_brand, '([0-9]+)', 1), 5, '0') AS zip, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part),
    l AS (SELECT p_partkey AS other, lpad((p_size % 5 + 1) || '' || (p_partkey % 5 + 1), 5, '0') AS zip, unnest(list_distinct(string_split(p_name, ' ')[1:2])) AS w, len(list_distinct(string_split(p_name, ' ')[1:2])) AS k FROM part),
    s AS (SELECT p_partkey, len(list_distinct(string_split(p_name, ' '))) AS j FROM part),
    n AS (SELECT r.p_partkey, other, count(*) >= CASE WHEN least(any_value(j), any_value(k)) <= 1 THEN 1 ELSE 2 END AS ok FROM r JOIN l USING (zip, w) JOIN s ON s.p_partkey = r.p_partkey GROUP BY 1, 2),
    f AS (SELECT p_partkey, min(other % 2 * 1000000000 + other) FILTER (ok) % 1000000000 AS best, count(*) AS c FROM n GROUP BY 1)
    SELECT p.p_partkey, CASE WHEN p_partkey % 9 = 0 OR best IS NOT NULL THEN 'confident' WHEN c > 0 THEN 'ambiguous' ELSE 'none' END AS npi_match_confidence,
      CASE WHEN p_partkey % 9 = 0 THEN lpad(p_partkey::VARCHAR, 10, '0') WHEN best IS NOT NULL THEN lpad(best::VARCHAR, 10, '0') END AS npi_number, (CASE WHEN p_partkey % 9 = 0 THEN 1 WHEN best IS NOT NULL THEN c END)::INT AS npi_provider_count FROM part p LEFT JOIN f USING (p_partkey)"""
)
def npi_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against a snapshot of the number registry: their own number, else the first candidate that agrees.

    The snapshot is made of all parts under the first two words of their names, in places of their own.
    """
    c = F.col
    part = table(spark, sf_dir, "part")
    number = F.lpad(c("p_partkey").cast("string"), 10, "0")
    place = F.lpad(F.concat((c("p_size") % 5 + 1).cast("string"), (c("p_partkey") % 5 + 1).cast("string")), 5, "0")
    rows = part.select("p_partkey", c("p_name").alias("practice_name"), F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 5, "0").alias("address_zip"), F.lit("").alias("phone"), F.when(c("p_partkey") % 9 == 0, number).otherwise("").alias("npi_optional"))
    listed = part.select(number.alias("number"), F.when(c("p_partkey") % 2 == 0, "NPI-2").otherwise("NPI-1").alias("enumeration_type"), F.substring_index("p_name", " ", 2).alias("organization_name"), F.lit("").alias("telephone_number"), place.alias("postal_code"), F.array(F.lit("1")).alias("taxonomy_codes"))
    return match.npi_lookup(rows.repartition(8), listed).select("p_partkey", "npi_match_confidence", "npi_number", "npi_provider_count")


@query(f"SELECT page_id AS row_idx, min(page_id) OVER (PARTITION BY u) AS first_row, 'url' AS basis FROM (SELECT *, regexp_replace(regexp_extract(url, '^(https?://[^/?#]+[^?#]*)', 1), '/+$', '') AS u FROM pages WHERE page_id % 2 = 0) WHERE u <> '' QUALIFY page_id > first_row UNION ALL SELECT page_id, min(page_id) OVER (PARTITION BY h), 'name_state' FROM (SELECT page_id, {_BARE} AS h FROM pages WHERE page_id % 2 = 1) WHERE h <> '' QUALIFY page_id > min(page_id) OVER (PARTITION BY h)")
def upload_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an upload that an earlier row has, by url or by name and state."""
    c = F.col
    even = c("page_id") % 2 == 0
    rows = table(spark, sf_dir, "pages").select(c("page_id").alias("row_idx"), F.when(even, c("url")).otherwise("").alias("website_url"), F.when(even, "").otherwise(urls.hostname(c("url"))).alias("practice_name"), F.lit("ny").alias("address_state"))
    return match.upload_duplicates(rows)


#: Nations as the registry: each has the domain of the page of its number; of equal domains the last one is found.
_ENTRIES = f"""SELECT n_nationkey, n_name, {_BARE} AS d FROM nation JOIN pages ON page_id = n_nationkey"""
_INDEX = f"""SELECT d, max(n_nationkey) AS nk, max_by(n_name, n_nationkey) AS n_name FROM ({_ENTRIES}) GROUP BY 1"""


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    page = table(spark, sf_dir, "pages").select(c("page_id").alias("n_nationkey"), urls.hostname(c("url")).alias("website_domain"))
    return table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("n_nationkey"), "n_name").join(page, "n_nationkey").select(F.concat(F.lit("N-"), c("n_nationkey").cast("string")).alias("entry_id"), c("n_nationkey").alias("ordinal"), "website_domain", c("n_name").alias("practice_name"))


@query(f"SELECT row_idx, CASE WHEN row_idx % 4 = 0 THEN 'rejected' WHEN known OR row_idx > first THEN 'updated' ELSE 'inserted' END AS outcome, CASE WHEN row_idx % 4 = 0 THEN 'enrichment_status is ''failed''' END AS reason FROM (SELECT page_id AS row_idx, min(page_id) FILTER (page_id % 4 > 0) OVER (PARTITION BY {_BARE}) AS first, {_BARE} IN (SELECT d FROM ({_INDEX})) AS known FROM pages)")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records into the registry: new entries, updates of these and of known ones, rejections."""
    out, log = _upserted(spark, sf_dir)
    return log.select(F.col("record_id").cast("long").alias("row_idx"), "outcome", "reason")


@query(f"SELECT d AS website_domain, max(page_id) FILTER (true)::VARCHAR AS last_name, count(*) - 1 + known::INT AS n_changes FROM (SELECT page_id, {_BARE} AS d, {_BARE} IN (SELECT d FROM ({_INDEX})) AS known FROM pages WHERE page_id % 4 > 0) GROUP BY d, known")
def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries after a run: the last name counts, each change is in the history (I16)."""
    c = F.col
    out, _ = _upserted(spark, sf_dir)
    changes = F.size(F.filter("change_history", lambda h: h.field == "practice_name"))
    return out.where("last_enrichment_run_id = 'run'").select("website_domain", F.regexp_extract("practice_name", r"(\d+)$", 1).alias("last_name"), changes.cast("long").alias("n_changes"))


def _upserted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    blank_ = {f: F.lit("") for f in ("google_place_id", "phone_digits", "name_normalized", "address_normalized", "npi", "website_url", "phone", "address_full", "address_city", "address_state", "address_zip", "specialty")}
    entries = _nations(spark, sf_dir).select("*", *[F.lit("old").alias(x) for x in ("first_seen_at", "last_seen_at", "first_discovery_run_id", "last_discovery_run_id", "last_enrichment_run_id")], F.array().cast(registry.HISTORY).alias("change_history")).withColumns(blank_)
    rows = table(spark, sf_dir, "pages").select(
        c("page_id").cast("string").alias("id"), c("page_id").alias("ordinal"), F.concat(F.lit("Name "), c("page_id").cast("string")).alias("practice_name"), F.concat(F.lit("https://"), urls.hostname(c("url"))).alias("website_url"), F.lit("CLEAR").alias("exclusion_status"),
        F.when(c("page_id") % 4 == 0, "failed").otherwise("complete").alias("enrichment_status"), *[F.lit("").alias(x) for x in ("google_place_id", "phone", "address_city", "address_state", "address_zip", "specialty", "npi_optional", "npi")],
    )
    return registry.upsert(rows, entries, "run", NOW)


@query("SELECT count(*) AS entries, count(*) AS last_tier, count(*) FILTER (c_acctbal > 0) AS last_score FROM customer")
def registry_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commercial fields taken off entries, and how many values went."""
    c = F.col
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("entry_id"), F.lit("x").alias("last_tier"), F.when(c("c_acctbal") > 0, 1).alias("last_score"))
    left, counts = registry.pruned(rows)
    if left.columns != ["entry_id"]:
        raise AssertionError(left.columns)
    return counts


@query(f"WITH r AS (SELECT page_id, {_BARE} AS d FROM pages), n AS (SELECT page_id, d, row_number() OVER (PARTITION BY d ORDER BY page_id) AS i, d IN (SELECT d FROM ({_INDEX})) AS known FROM r), k AS (SELECT CASE WHEN known THEN 'CHANGED' WHEN i > 1 THEN 'POSSIBLE_DUPLICATE' ELSE 'NEW' END AS classification FROM n) SELECT c AS classification, (SELECT count(*) FROM k WHERE k.classification = c) AS n, (SELECT count(*) FROM k WHERE k.classification = c AND c IN ('NEW', 'CHANGED')) AS selected FROM (VALUES ('NEW'), ('CHANGED'), ('KNOWN'), ('POSSIBLE_DUPLICATE'), ('INSUFFICIENT_DATA')) t(c)")
def discovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a discovery run by class, and those to go on with."""
    told, counts, _, _ = _discovered(spark, sf_dir)
    chosen = match.selected(told, "new_and_changed").groupBy("classification").agg(F.count("*").alias("selected"))
    return counts.join(chosen, "classification", "left").select("classification", "n", F.coalesce("selected", F.lit(0)).alias("selected"))


def _discovered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(told, counts, preview, rows) of pages against nations as the registry."""
    c = F.col
    fields = ("google_place_id", "phone_digits", "name_normalized", "address_normalized", "google_category")
    none = {f: F.lit("") for f in fields}
    raw = {f: F.lit("") for f in ("website_url", "phone", "address_full", "address_city", "address_state", "address_zip", "npi")}
    rows = table(spark, sf_dir, "pages").select(c("page_id").alias("row_idx"), urls.hostname(c("url")).alias("website_domain"), F.concat(F.lit("Name "), c("page_id").cast("string")).alias("practice_name")).withColumns(none | raw)
    entries = _nations(spark, sf_dir).withColumns(none)
    told, counts, preview = enrichment.discovered(rows, entries, "d1")
    return told, counts, preview, rows


@query(f"WITH r AS (SELECT page_id, {_BARE} AS d FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id) AS i, lag(page_id) OVER (PARTITION BY d ORDER BY page_id) AS p FROM r) SELECT 'Name ' || page_id AS name, 'd1' AS discovery_run_id, CASE WHEN n_name IS NOT NULL THEN 'CHANGED' WHEN i > 1 THEN 'POSSIBLE_DUPLICATE' ELSE 'NEW' END AS discovery_status, CASE WHEN n_name IS NOT NULL THEN 'Changed: Practice name: ''' || n_name || ''' → ''Name ' || page_id || '''' WHEN i > 1 THEN 'Same website_domain as row ' || p ELSE 'No registry match' END AS discovery_reason, CASE WHEN n_name IS NOT NULL THEN 'N-' || nk ELSE '' END AS matched_existing_record_id, CASE WHEN n_name IS NOT NULL THEN 'Practice name: ''' || n_name || ''' → ''Name ' || page_id || '''' ELSE '' END AS changed_fields, 15 AS n_columns FROM n LEFT JOIN ({_INDEX}) x USING (d)")
def discovery_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The handoff of a discovery run."""
    told, _, _, rows = _discovered(spark, sf_dir)
    out = views.discovery_handoff(told, rows, "d1")
    return out.select("name", "discovery_run_id", "discovery_status", "discovery_reason", "matched_existing_record_id", "changed_fields", F.lit(len(out.columns)).alias("n_columns"))


@query(f"WITH r AS (SELECT page_id, {_BARE} AS d FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id) AS i FROM r) SELECT 'P-' || left(sha256('d1|' || page_id), 12) AS entry_id, 'new' AS status, 'Name ' || page_id AS practice_name FROM n WHERE i = 1 AND d NOT IN (SELECT d FROM ({_INDEX})) UNION ALL SELECT 'N-' || e.n_nationkey, CASE WHEN nk IS NULL THEN 'kept' ELSE 'changed' END, CASE WHEN nk IS NULL THEN e.n_name ELSE 'Name ' || p END FROM ({_ENTRIES}) e LEFT JOIN ({_INDEX}) x ON nk = e.n_nationkey LEFT JOIN (SELECT d, max(page_id) AS p FROM r GROUP BY 1) q ON q.d = e.d")
def registry_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as a discovery run would leave it, through its four outputs."""
    told, counts, preview, _ = _discovered(spark, sf_dir)
    path = scratch(spark, "discovery")
    writers.discovery(told, counts, preview, path)
    return spark.read.parquet(f"{path}/registry_preview").select("entry_id", "status", "practice_name")


def _plain_practices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of locations of three: all share street, ZIP, phone and domain; every second location lacks the phone."""
    c = F.col
    k, g = c("c_custkey"), F.floor(c("c_custkey") / 3)
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.concat(F.lit("Bay Clinic "), g.cast("string")).alias("practice_name"), F.concat(g.cast("string"), F.lit(" Main Street")).alias("address_street"), F.lpad((10000 + g % 80000).cast("string"), 5, "0").alias("address_zip"),
        F.when(g % 2 == 0, F.concat(F.lit("415555"), F.lpad((g % 10000).cast("string"), 4, "0"))).otherwise("").alias("phone"), F.concat(F.lit("https://clinic"), g.cast("string"), F.lit(".com")).alias("website_url"), F.when(k % 3 == 1, "Cardiology").otherwise("").alias("specialty"), F.array(F.concat(F.lit("Doc "), k.cast("string"))).alias("provider_names"),
    )


_LOCATIONS = """SELECT g, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey::VARCHAR) AS ids, max(CASE WHEN c_custkey % 3 = 1 THEN 'Cardiology' ELSE '' END) AS specialty FROM (SELECT c_custkey, floor(c_custkey / 3)::BIGINT AS g FROM customer) GROUP BY 1"""


@query(
    f"""
    SELECT 'P-' || left(sha256('addr|' || lpad((10000 + g % 80000)::VARCHAR, 5, '0') || '|' || g || ' main street|'), 12) AS practice_id, 'Bay Clinic ' || g AS practice_name, n::INT AS provider_count, ids AS source_rows, specialty, CASE WHEN n = 1 THEN 0 WHEN g % 2 = 0 THEN 12 ELSE 9 END AS score,
      CASE WHEN n = 1 THEN '' WHEN g % 2 = 0 THEN 'address,domain,name,phone' ELSE 'address,domain,name' END AS matched, CASE WHEN n = 1 THEN 'single' ELSE 'merged' END AS rule_fired, CASE WHEN g % 2 = 0 THEN '415555' || lpad((g % 10000)::VARCHAR, 4, '0') ELSE '' END AS phone FROM ({_LOCATIONS})"""
)
def plain_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that agree on everything, in closed form: blocks, scores, clusters, base row, names, providers, ids."""
    c = F.col
    out, _, _ = resolve.consolidate(_plain_practices(spark, sf_dir))
    return out.select("practice_id", "practice_name", "provider_count", F.array_join("source_row_ids", ",").alias("source_rows"), "specialty", c("consolidation.score").alias("score"), F.array_join(F.array_sort("consolidation.matched_fields"), ",").alias("matched"), c("consolidation.rule_fired").alias("rule_fired"), "phone")


@query(
    f"""
    SELECT (SELECT count(*) FROM customer) AS input_count, count(*) AS output_count, count(*) FILTER (n > 1) AS merged_groups, sum(n)::BIGINT AS distinct_providers, 0::BIGINT AS review_pairs, 0::BIGINT AS cross_address_merges, (SELECT count(*) FROM customer) - count(*) AS rows_merged_away,
      round(1 - count(*) / (SELECT count(*) FROM customer), 4) AS collapse_rate FROM ({_LOCATIONS})"""
)
def consolidation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a consolidation, and the share of entries that it took away."""
    _, _, one = resolve.consolidate(_plain_practices(spark, sf_dir))
    return one.select("input_count", "output_count", "merged_groups", F.col("distinct_providers").cast("long").alias("distinct_providers"), "review_pairs", "cross_address_merges", "rows_merged_away", metrics.collapse_rate(F.col("output_count"), F.col("input_count")).alias("collapse_rate"))


_DOUBT = """SELECT g, g % 3 AS kind, count(*) AS n FROM (SELECT floor(c_custkey / 2)::BIGINT AS g FROM customer) GROUP BY 1 HAVING count(*) = 2"""


@query(f"SELECT CASE kind WHEN 0 THEN 'corroborated' ELSE 'phone_absent' END AS review_reason, 4 AS score, false AS mechanical, CASE WHEN kind = 0 THEN 'merge' END AS decision, count(*) AS n FROM ({_DOUBT}) WHERE kind < 2 GROUP BY kind")
def doubtful_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for an analyst, each once and in order, with rulings; two units of a building are no candidates."""
    c = F.col
    locations, asked, _ = resolve.consolidate(_doubtful(spark, sf_dir))
    ruled = locations.where(F.element_at("source_row_ids", 1).cast("long") % 6 == 0).select(c("practice_id").alias("id"), F.lit("merge").alias("decision"))
    return resolve.review_pairs(asked, ruled).groupBy("review_reason", "score", "mechanical", "decision").agg(F.count("*").alias("n"))


@query(
    """
    WITH g AS (SELECT c_custkey // 4 AS g, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT sum(n)::BIGINT AS off, sum(CASE WHEN g % 3 < 2 THEN 1 ELSE n END)::BIGINT AS on_, sum(CASE WHEN g % 3 < 2 THEN n * (n - 1) // 2 ELSE 0 END)::BIGINT AS crossed FROM g)
    SELECT off AS input_count, on_ AS output_count_on, off AS output_count_off, (off - on_)::INT AS additional_collapse, round((off - on_) * 100 / off, 1) AS collapse_percent, crossed AS cross_address_merges_on, 0::BIGINT AS cross_address_merges_off
    FROM f"""
)
def contact_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offices of one practice at different addresses without and with contact blocks (F22): of every three groups of four, two share a phone and a domain."""
    c = F.col
    k, g = c("c_custkey"), F.floor(c("c_custkey") / 4)
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.concat(F.lit("Office "), F.sha2(k.cast("string"), 256)).alias("practice_name"), F.concat(k.cast("string"), F.lit(" Oak St")).alias("address_street"), F.lpad((10000 + k % 80000).cast("string"), 5, "0").alias("address_zip"),
        F.when(g % 3 < 2, F.concat(F.lit("415555"), F.lpad((g % 10000).cast("string"), 4, "0"))).otherwise("").alias("phone"), F.concat(F.lit("https://o"), g.cast("string"), F.lit(".com")).alias("website_url"),
    )
    out = resolve.contact_comparison(rows)
    return out.select("input_count", "output_count_on", "output_count_off", c("additional_collapse").cast("int").alias("additional_collapse"), "collapse_percent", "cross_address_merges_on", "cross_address_merges_off")


@query("SELECT a.n_nationkey::BIGINT AS left_row, b.n_nationkey::BIGINT AS right_row, CASE WHEN a.n_nationkey // 2 = b.n_nationkey // 2 THEN 'merge' ELSE 'no_shared_block' END AS verdict, CASE WHEN a.n_nationkey // 2 = b.n_nationkey // 2 THEN 'address' ELSE 'none' END AS path FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def pair_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows of one small set merge or don't, all its pairs (M7, E5); the set is the 25 nations."""
    c = F.col
    k, g = c("n_nationkey"), F.floor(c("n_nationkey") / 2)
    rows = table(spark, sf_dir, "nation").select(k.cast("string").alias("id"), F.lit("Bay Clinic").alias("practice_name"), F.concat(g.cast("string"), F.lit(" Oak St")).alias("address_street"), F.lit("10001").alias("address_zip"))
    ident = resolve.identified(resolve.conformed(rows)).withColumn("row", c("id").cast("long"))
    noise, umbrella = resolve.domain_policy()
    out = resolve.explained(ident, noise, sorted({*noise, *umbrella}))
    return out.select(F.least("left", "right").alias("left_row"), F.greatest("left", "right").alias("right_row"), "verdict", "path")


# --- cells, costs, configuration -------------------------------------------------------------------------------------


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Cardiology' WHEN p_partkey % 3 = 1 THEN 'Dermatology' ELSE 'Widget Shop' END AS specialty, lower(p_name) || ' inc' AS loose_name, p_partkey % 4 < 2 AS agree, p_partkey % 2 = 0 AS organization,
      CASE WHEN p_partkey % 2 = 0 THEN 'Dr. Ann Lee' ELSE 'Ann Lee' END AS prefixed, lower(p_name) || '|1 elm' AS name_key, CASE WHEN p_partkey % 2 = 0 THEN 'Ann Lee' ELSE 'Bo' END AS person, CASE WHEN p_partkey % 2 = 0 THEN 'MD,PHD' ELSE '' END AS credentials FROM part"""
)
def name_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specialties, loose names, agreement, organizations, prefixes, credentials."""
    c = F.col
    k, even = c("p_partkey"), c("p_partkey") % 2 == 0
    parts = names.name_and_credentials(F.when(even, "Ann Lee, M.D., PhD").otherwise("Bo"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", names.specialty(F.when(k % 3 == 0, "Heart, CARDIOLOGY").when(k % 3 == 1, "").otherwise("widget shop"), F.when(k % 3 == 1, "Bay Dermatologists").otherwise("x")).alias("specialty"), names.loose(F.concat("p_name", F.lit(", Inc."))).alias("loose_name"),
        names.agree(F.when(k % 4 == 0, "Bay Heart Clinic").when(k % 4 == 1, "Heart").when(k % 4 == 2, "Bay Foot Care").otherwise(""), F.lit("Bay Heart Group")).alias("agree"), names.is_organization(F.when(even, "Bay Heart Clinic,").otherwise("Ann Lee")).alias("organization"),
        names.with_prefix(F.lit("Ann Lee"), F.when(even, "MD, FACC").otherwise("NP")).alias("prefixed"), names.name_address_key(names.loose(c("p_name")), F.lit("1 elm")).alias("name_key"), parts["name"].alias("person"), F.array_join(parts["credentials"], ",").alias("credentials"),
    )


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Bayheart Clinic' ELSE '' END AS from_domain, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS likeness, p_partkey % 2 = 0 AS may, round(2.0 * length(p_name) / (2 * length(p_name) + 1), 6)::DOUBLE AS one_more FROM part"""
)
def name_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read out of domains, and likeness where it has a closed form."""
    c = F.col
    even = c("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select(
        "p_partkey", names.from_domain(F.when(even, "bayheartclinic.com").otherwise("qzx.com")).alias("from_domain"), names.likeness(c("p_name"), F.when(even, c("p_name")).otherwise("")).alias("likeness"), names.may_be_alike(c("p_name"), F.when(even, c("p_name")).otherwise(""), 0.85).alias("may"),
        F.round(names.likeness(c("p_name"), F.concat("p_name", F.lit("~"))), 6).alias("one_more"),
    )


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'No website URL provided — nothing to crawl.' WHEN 1 THEN 'Website could not be reached: timeout. Try ''Re-crawl with Browser'' or paste the page content manually.' WHEN 2 THEN 'Website returned no readable text — likely a bot/security wall or a script-rendered page. Try ''Re-crawl with Browser'' or paste the page content manually.'
        ELSE 'Website returned only 9 characters of text (under the minimum needed to evaluate). Paste fuller page content manually to enrich.' END AS no_context,
      CASE WHEN o_custkey % 3600 >= 60 THEN (o_custkey % 3600 // 60) || 'm ' || lpad((o_custkey % 60)::VARCHAR, 2, '0') || 's' ELSE o_custkey % 3600 || 's' END AS took, o_orderkey % 4 = 2 AS ours, CASE WHEN o_orderkey % 2 = 0 THEN 'Evidence on the site is limited — thin.' ELSE 'Fine.' END AS told,
      CASE WHEN o_totalprice > 200000 THEN 'HIGH' ELSE 'LOW' END || ' FIT / ' || CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END || ' EVIDENCE' AS quadrant, CASE WHEN o_orderkey % 3 = 0 THEN 'limited' ELSE 'complete' END AS recovered, o_orderkey % 3 = 1 AS browser, 60.0::DOUBLE AS rate, 2.0::DOUBLE AS minutes_left FROM orders"""
)
def record_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and marks of a record: why there is no text, durations, voice, safe reasons, quadrant, recovery, browser."""
    c = F.col
    k, even = c("o_orderkey"), c("o_orderkey") % 2 == 0
    rate, left = progress(F.lit(10), F.lit(130), F.lit(10.0))
    confidence = F.when(k % 3 == 0, "limited").otherwise("partial")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.no_context(F.when(k % 4 > 0, "u").otherwise(""), F.when(k % 4 == 1, "timeout").otherwise(""), F.when(k % 4 == 3, " nine char ").otherwise(" ")).alias("no_context"), duration(c("o_custkey") % 3600).alias("took"),
        views.first_person(F.when(k % 4 == 2, "Ask how WE can help").otherwise("They are west of us-less towns".replace("us-less", "useless"))).alias("ours"), views.client_reason(F.when(even, "Score 40 is below the 50-point evidence floor — thin.").otherwise("Fine.")).alias("told"),
        S.quadrant(F.when(c("o_totalprice") > 200000, 70).otherwise(69), F.when(even, 65).otherwise(64)).alias("quadrant"), evidence.recovered(confidence, F.lit(True), F.lit(False), F.lit("complete")).alias("recovered"),
        evidence.needs_browser(F.lit("u"), F.when(k % 3 == 1, "short").otherwise(F.repeat(F.lit("x"), 200)), F.lit("complete")).alias("browser"), rate.alias("rate"), left.alias("minutes_left"),
    )


@query(
    """
    SELECT o_orderkey, o_orderkey % 4 < 3 AS parsed, CASE WHEN o_orderkey % 4 = 1 THEN 'he said "yes" twice' WHEN o_orderkey % 4 = 3 THEN NULL ELSE 'plain' END AS quote FROM orders"""
)
def response_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models' answers: fenced, with quotes and line ends inside texts, and past repair."""
    c = F.col
    k = c("o_orderkey")
    one = lambda text, tail="": '{"signals": [{"signal_id": "a", "signal_state": "yes", "evidence_text": "%s"}%s], "sales_angle": []}' % (text, tail)
    raw = F.when(k % 4 == 0, f"```json\n{one('plain')}\n```").when(k % 4 == 1, one('he said "yes" twice')).when(k % 4 == 2, one("plain", ",").replace('"sales', '\n"sales')).otherwise('{"signals": []}')
    said = S.parsed_response(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", said.isNotNull().alias("parsed"), F.try_element_at(said.signals, F.lit(1)).evidence_text.alias("quote"))


_QUOTE = "substr(translate(coalesce(text, ''), '\"\\' || chr(10) || chr(13) || chr(9), '     '), 1, 120)"


@query(
    f"""
    WITH q AS (SELECT doc_id, {_QUOTE} AS q FROM documents)
    SELECT doc_id, 2 AS n, CASE doc_id % 8 WHEN 1 THEN substr(q, 1, 40) || '"' || substr(q, 41, 20) || '" ' || substr(q, 61) || '.' WHEN 2 THEN q || ' and on' ELSE q END AS first, CASE doc_id % 8 WHEN 5 THEN NULL ELSE doc_id::VARCHAR END AS second FROM q"""
)
def response_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models' answers over all documents, each with one of the usual faults, read by the tolerant reader.

    Inner quotes, raw line ends, a missing comma, prose before the object, a text that the end cuts off, a trailing comma behind
    typographic quotes, an object left open; and none.
    """
    c = F.col
    q = F.substring(F.translate(F.coalesce("text", F.lit("")), '"\\\n\r\t', "     "), 1, 120)
    kind = c("doc_id") % 8
    inner = F.concat(F.substring("q", 1, 40), F.lit('"'), F.substring("q", 41, 20), F.lit('" '), F.expr("substring(q, 61)"), F.lit("."))
    said = F.when(kind == 1, inner).when(kind == 2, F.concat("q", F.lit("\nand on"))).otherwise(c("q"))
    one = lambda name, text, more="": F.concat(F.lit('{"signal_id": "%s", "evidence_text": "' % name), text, F.lit('"' + more))
    comma = F.when(kind == 3, F.lit("} ")).otherwise(F.lit("}, "))
    angle = F.when(kind == 6, F.lit('"sales_angle": [“x”,], ')).otherwise(F.lit('"sales_angle": ["x"], '))
    end = F.when(kind == 5, F.lit("")).when(kind == 7, F.lit('"}')).otherwise(F.lit('"}]}'))
    begin = F.when(kind == 4, F.lit("Here is {the} JSON:\n{")).otherwise(F.lit("{"))
    raw = F.concat(begin, angle, F.lit('"signals": ['), one("a", said), comma, F.lit('{"signal_id": "b", "evidence_text": "'), c("doc_id").cast("string"), end)
    got = table(spark, sf_dir, "documents").select("doc_id", q.alias("q")).select("doc_id", S.parsed_response(raw).signals.alias("s"))
    return got.select("doc_id", F.size("s").alias("n"), c("s")[0].evidence_text.alias("first"), c("s")[1].evidence_text.alias("second"))


@query(
    """
    WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey, (100 * count_yes // n)::INT AS signal_coverage, CASE WHEN risks = 0 THEN 'Low' WHEN risks = 1 THEN 'Moderate' ELSE 'Elevated' END AS risk,
      CASE o_orderstatus WHEN 'F' THEN 'Call now' WHEN 'O' THEN 'Qualify' WHEN 'P' THEN 'Verify first' ELSE 'Hold' END AS motion, o_orderstatus = 'F' AND o_totalprice > 100000 AS ready
    FROM (SELECT *, r AS count_yes, least(r, 2) AS risks FROM orders JOIN l ON l_orderkey = o_orderkey)"""
)
def account_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of signals, risk, motion and readiness of every account (F24): lines are signals, returned ones are confirmed and risky."""
    c = F.col
    state = F.when(c("l_returnflag") == "R", "yes").otherwise("no")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(state.alias("signal_state"))).alias("signals"))
    rows = table(spark, sf_dir, "orders").join(lines, c("o_orderkey") == c("l_orderkey"))
    risks = F.transform(F.slice(F.filter("signals", lambda s: s.signal_state == "yes"), 1, 2), lambda s: F.lit("Returned"))
    rows = rows.select(
        "o_orderkey", "signals", F.when(c("o_orderstatus") == "F", K.BULLSEYE).when(c("o_orderstatus") == "O", K.CONTENDER).when(c("o_orderstatus") == "P", K.VERIFY).otherwise(K.MANUAL).alias("displayed_tier"),
        F.struct(risks.alias("disqualifier_risk"), F.lit("").alias("likely_objection")).alias("call_brief"), F.struct(F.when(c("o_totalprice") > 100000, "approved").otherwise("pending").alias("qc_status")).alias("review"),
        *[F.lit("").alias(f) for f in ("address_street", "address_city", "address_state", "address_zip", "website_url")],
    )
    cells = views.account("2026-01-02")
    return rows.select("o_orderkey", *[cells[f].alias(f) for f in ("signal_coverage", "risk", "motion", "ready")])


@query()
def upload_likenesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names alike in one state among all suppliers (E23); by its rule an upload of more than 500 rows is not compared."""
    state = F.concat(F.lit("S"), (F.col("s_nationkey") % 5).cast("string"))
    return match.fuzzy_names(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_idx"), F.col("s_name").alias("practice_name"), state.alias("address_state")))


_DRAFTS = """SELECT p_size AS profile_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS place, p_name AS signal_id, CASE WHEN p_type = 'ECONOMY' THEN ' ' ELSE p_type END AS signal_label, CASE WHEN p_type = 'PROMO' THEN 'insurance-only payer' ELSE p_name END AS prompt_instruction,
      CASE WHEN p_brand = 'Brand#1' THEN 'n/a' ELSE p_retailprice::VARCHAR END AS positive_weight, CASE p_brand WHEN 'Brand#2' THEN 'Gold' WHEN 'Brand#3' THEN 'Contender' ELSE '' END AS cap_tier, p_name || ' ' || p_type || ' ' || p_brand AS column_label, CASE p_brand WHEN 'Brand#4' THEN 'none' WHEN 'Brand#5' THEN p_name ELSE '' END AS reinforces FROM part"""


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as drafted signals of the profiles that their sizes stand for."""
    c = F.col
    brand = lambda n: c("p_brand") == f"Brand#{n}"
    part = numbered(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], "n")
    return part.select(
        c("p_size").alias("profile_id"), (c("n") - 1).cast("long").alias("at"), c("p_name").alias("signal_id"), F.when(c("p_type") == "ECONOMY", " ").otherwise(c("p_type")).alias("signal_label"),
        F.when(c("p_type") == "PROMO", "insurance-only payer").otherwise(c("p_name")).alias("prompt_instruction"), F.when(brand(1), "n/a").otherwise(c("p_retailprice").cast("string")).alias("positive_weight"),
        F.when(brand(2), "Gold").when(brand(3), "Contender").otherwise("").alias("cap_tier"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("column_label"), F.when(brand(4), "none").when(brand(5), c("p_name")).otherwise("").alias("reinforces"),
    )


@query(
    f"""
    WITH d AS ({_DRAFTS}), f AS (SELECT *, min(place) OVER (PARTITION BY profile_id, signal_id) AS first FROM d)
    SELECT profile_id, place, 'signals[' || place || ']' || m AS message FROM (SELECT profile_id, place, unnest(list_filter([CASE WHEN trim(signal_label) = '' THEN '.signal_label: text is needed' END, CASE WHEN place > first THEN '.signal_id: ' || signal_id || ' is there twice' END,
      CASE WHEN positive_weight = 'n/a' THEN '.positive_weight: a number is needed' END, CASE WHEN cap_tier = 'Gold' THEN '.cap_tier: not a tier' END, CASE WHEN length(column_label) > 24 THEN '.column_label: more than 24 characters' END,
      CASE WHEN reinforces <> '' THEN '.reinforces: no other signal of that id' END], lambda x: x IS NOT NULL)) AS m FROM f)"""
)
def profile_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the drafted signals of every profile."""
    return config_tables.signal_faults(_drafts(spark, sf_dir)).withColumnRenamed("at", "place")


@query(f"SELECT profile_id, place, signal_id FROM ({_DRAFTS}) WHERE prompt_instruction <> 'insurance-only payer'")
def inverse_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts without those that say the inverse of how a practice is paid."""
    return config_tables.without_inverse_billing(_drafts(spark, sf_dir)).select("profile_id", F.col("at").alias("place"), "signal_id")


_PROJECTS = "SELECT c_name AS project_id, CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END AS client_name, CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 5000 THEN '' ELSE c_nationkey::VARCHAR END AS icp_profile_id FROM customer"


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects, nations as their profiles."""
    c = F.col
    client = F.when(c("c_acctbal") < 0, " ").otherwise(c("c_mktsegment"))
    profile = F.when((c("c_mktsegment") == "MACHINERY") & (c("c_acctbal") > 5000), "").otherwise(c("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select(c("c_name").alias("project_id"), client.alias("client_name"), profile.alias("icp_profile_id"))


@query(f"SELECT project_id AS project, unnest(list_filter([CASE WHEN trim(client_name) = '' THEN 'client_name: text is needed' END, CASE WHEN icp_profile_id = '' THEN 'icp_profile_id: text is needed' END], lambda x: x IS NOT NULL)) AS message FROM ({_PROJECTS})")
def project_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every project lacks."""
    return config_tables.project_faults(_projects(spark, sf_dir))


@query(f"SELECT icp_profile_id, count(*) AS n, min(project_id) AS first, max(project_id) AS last FROM ({_PROJECTS}) WHERE icp_profile_id <> '' GROUP BY 1")
def profile_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many projects use each profile."""
    return config_tables.profile_usage(_projects(spark, sf_dir))


@query("""SELECT o_orderkey, sha256('{"a\\"b": "' || o_orderstatus || '", "key": "' || o_custkey || '", "priority": "' || o_orderpriority || '"}' || chr(10) || 'run ' || o_orderkey) AS fingerprint FROM orders""")
def run_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every run's configuration, whatever the order of its keys."""
    c = F.col
    put = F.create_map(F.lit("priority"), c("o_orderpriority"), F.lit("key"), c("o_custkey").cast("string"), F.lit('a"b'), c("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", config_tables.fingerprint(put, F.concat(F.lit("run "), c("o_orderkey").cast("string"))).alias("fingerprint"))


@query("SELECT c_mktsegment AS run, c_nationkey, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS n_open FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2")
def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs out of a store of runs, of which only their folders are read (A13); customers are records, segments are runs."""
    c = F.col
    path = scratch(spark, "store")
    table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", c("c_mktsegment").alias("run")).write.partitionBy("run").json(path)
    rows = readers.run_store(spark, path, "c_custkey long, c_nationkey int, c_acctbal double").where(c("run").isin("BUILDING", "MACHINERY"))
    return rows.groupBy("run", "c_nationkey").agg(F.count("*").alias("n"), F.count_if(c("c_acctbal") > 0).alias("n_open"))


@query(
    """
    SELECT s_suppkey, 'Ann Lee, MD, PHD | Bo' AS cell, CASE WHEN s_suppkey % 2 = 0 THEN 'Location 2 of 3' ELSE '' END AS label, '1 main street' AS street, 'suite 4' AS unit, '4155550001' AS phone, 'bay.com' AS domain, '94110|1 main street|suite 4|4155550001|bay.com|bay heart clinic|' || s_suppkey AS signature, s_suppkey % 2 = 0 AS conflict FROM supplier"""
)
def location_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and signature of a row, unit conflicts, provider and location cells."""
    c = F.col
    even = c("s_suppkey") % 2 == 0
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", c("s_suppkey").cast("string").alias("id"), F.lit("Bay Heart Clinic, LLC").alias("practice_name"), F.lit("1 Main St. Ste #4").alias("address_street"), F.lit("94110-1234").alias("address_zip"), F.lit("+1 (415) 555-0001").alias("phone"), F.lit("https://www.bay.com/x").alias("website_url"))
    out = resolve.identified(resolve.conformed(rows))
    i = c("ident")
    other = F.struct(i.street.alias("street"), F.when(even, "suite 9").otherwise("suite 4").alias("unit"), F.lit("").alias("zip5"))
    people = F.array(F.struct(F.lit("Ann Lee").alias("name"), F.array(F.lit("MD"), F.lit("PHD")).alias("credentials")), F.struct(F.lit("Bo").alias("name"), F.array().cast("array<string>").alias("credentials")))
    return out.select("s_suppkey", views.provider_cell(people).alias("cell"), views.location_label(F.lit("G-1"), F.lit(2), F.when(even, 3).otherwise(1)).alias("label"), i.street.alias("street"), i.unit.alias("unit"), i.phone.alias("phone"), i.domain.alias("domain"), "signature", resolve.units_conflict(i, other).alias("conflict"))


@query(
    """
    WITH v AS (SELECT *, (floor(o_totalprice) * 3 + o_custkey * 15) / 1e4 AS usd FROM orders WHERE o_orderstatus <> 'O')
    SELECT o_orderkey::VARCHAR AS run_id, o_custkey AS llm_call_count, round(usd, 4) AS estimated_cost_usd, nullif(o_custkey % 2 * 5, 0) AS practice_locations, round(usd / nullif(o_custkey % 2 * 5, 0), 4) AS cost_per_record_usd FROM v"""
)
def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, cost and cost for each location of runs with captured use."""
    c = F.col
    rows = table(spark, sf_dir, "orders").select(c("o_orderkey").cast("string").alias("run_id"), F.when(c("o_orderstatus") != "O", c("o_custkey")).alias("llm_call_count"), (F.floor("o_totalprice") * 100).alias("llm_input_tokens"), (c("o_custkey") * 100).alias("llm_output_tokens"), (c("o_custkey") % 2 * 5).alias("consolidation_practice_locations"), F.lit(0).cast("long").alias("records_output"))
    return metrics.cost_summary(rows)


@query("SELECT l_orderkey AS run_id, sum(l_linenumber) FILTER (l_linenumber % 2 = 1)::BIGINT AS llm_calls, sum(floor(l_quantity)) FILTER (l_linenumber % 2 = 1)::BIGINT AS llm_input_tokens FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_discount, l_returnflag) AS l_linenumber FROM (SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem)) GROUP BY 1")
def run_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens summed over a run's log."""
    from pyspark.sql import Window

    c = F.col
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))
    log = table(spark, sf_dir, "lineitem").withColumn("n", n).select(c("l_orderkey").alias("run_id"), F.when(c("n") % 2 == 1, c("n")).otherwise(0).cast("long").alias("calls"), F.floor("l_quantity").cast("long").alias("input_tokens"), F.lit(1).alias("output_tokens"))
    return metrics.usage(log).select("run_id", "llm_calls", "llm_input_tokens")


@query("SELECT event_id AS run_id, CASE WHEN event_type = 'purchase' AND date_diff('second', ts, TIMESTAMP '2030-01-01') > 1800 THEN 'failed' WHEN event_type = 'purchase' THEN 'running' ELSE 'complete' END AS status FROM events")
def job_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without a sign for too long are failed."""
    c = F.col
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select(c("event_id").alias("run_id"), metrics.stale(F.when(c("event_type") == "purchase", "running").otherwise("complete"), c("ts"), F.lit(None).cast("timestamp"), now).alias("status"))


@query("SELECT event_id AS run_id FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 50")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest runs that are not archived: a top-k."""
    c = F.col
    return metrics.newest(table(spark, sf_dir, "events").select(c("event_id").alias("run_id"), c("ts").alias("created_at"), (c("event_type") == "error").alias("archived"))).select("run_id")


@query("SELECT p_partkey AS id, CASE WHEN n = 1 THEN s ELSE s || '_' || n END AS case_id, false AS reviewed FROM (SELECT p_partkey, replace(lower(p_name), ' ', '_') AS s, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def golden_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreviewed cases with ids from names (M8)."""
    return metrics.scaffold(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("practice_name")))


@query("WITH c AS (SELECT doc_id, text, doc_id % 5 = 0 AS broken, contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'tion') AS hit FROM documents WHERE text IS NOT NULL) SELECT 'page_changed' AS rule, doc_id::VARCHAR AS subject FROM c WHERE broken UNION ALL SELECT 'anchor_missing', doc_id || '/s' FROM c WHERE NOT hit UNION ALL SELECT 'several_rubrics', '2'")
def golden_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a labelled set from use."""
    c = F.col
    cases = table(spark, sf_dir, "documents").where("text is not null").select(c("doc_id").cast("string").alias("case_id"), F.when(c("doc_id") % 2 == 0, "v1").otherwise("v2").alias("rubric_version"), F.when(c("doc_id") % 5 == 0, "0").otherwise(F.sha2("text", 256)).alias("page_sha256"), c("text").alias("page_text"), F.create_map(F.lit("s"), F.lit("yes")).alias("expected"), F.create_map(F.lit("s"), F.lit("TION")).alias("anchors"))
    return metrics.golden_violations(cases)


@query(
    """
    SELECT coalesce(p_partkey, s_suppkey)::VARCHAR AS signal_id, CASE WHEN p_partkey IS NULL THEN 'added' WHEN s_suppkey IS NULL THEN 'removed' WHEN p_partkey % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN p_partkey IS NOT NULL AND s_suppkey IS NOT NULL AND p_partkey % 2 = 0 THEN 'weight:1>2' END AS fields
    FROM part FULL JOIN supplier ON p_partkey = s_suppkey"""
)
def profile_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of two profiles side by side."""
    c = F.col
    given = lambda k, other: F.create_map(F.lit("weight"), F.when(k % 2 == 0, other).otherwise("0"), F.lit("label"), F.lit("x"))
    a = table(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("signal_id"), given(c("p_partkey"), "1").alias("given"))
    b = table(spark, sf_dir, "supplier").select(c("s_suppkey").cast("string").alias("signal_id"), given(c("s_suppkey"), "2").alias("given"))
    out = views.profile_diff(a, b, ["weight", "label"])
    return out.select("signal_id", "status", F.array_join(F.transform("fields", lambda f: F.concat(f["field"], F.lit(":"), f["old"], F.lit(">"), f["new"])), ",").alias("fields"))


@query(
    f"""
    SELECT o_orderkey::VARCHAR AS id, s AS signal_id, 'https://example.com/a' AS url, 'FLAG' AS verdict FROM (SELECT o_orderkey, tier, unnest(list_filter([CASE WHEN big THEN 'big' END, CASE WHEN ret THEN 'returned' END, CASE WHEN disc THEN 'discount' END, CASE WHEN bulk THEN 'bulk' END], lambda x: x IS NOT NULL)) AS s FROM ({_TIER})) WHERE tier IN ('Bullseye', 'Contender')"""
)
def link_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links behind confirmed signals of records that are called, with their verdicts."""
    from sieveworks.queries import _tiered

    c = F.col
    rows = _tiered(spark, sf_dir).select(c("o_orderkey").cast("string").alias("id"), "signals", c("t.tier").alias("displayed_tier"))
    # Made by Spark, so that its size is known: all records share a link, which a shuffle would deal to one task.
    checked = spark.sql("VALUES ('https://example.com/a', 'FLAG'), ('https://example.com/b', 'OK') AS t(url, verdict)")
    return views.link_report(views.evidence_links(rows), checked).select("id", "signal_id", "url", "verdict")


@query(f"SELECT displayed AS target_tier, count(*) AS n FROM ({_REVIEWED}) WHERE displayed = 'Needs Verification' OR (displayed = 'Contender' AND qc = 'pending') GROUP BY 1")
def verification_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are to get a second reading."""
    c = F.col
    rows = _reviewed(spark, sf_dir).select(F.when(c("displayed_tier") == K.CONTENDER, K.VERIFY).otherwise(c("displayed_tier")).alias("target_tier"), F.lit("complete").alias("enrichment_status"), F.when(c("review.qc_status") == "pending", "").otherwise(NOW).alias("verified_at"))
    return rows.where(rules.awaiting_verification()).groupBy(F.lit(K.CONTENDER).alias("target_tier")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('signals', 'signals[1].signal_id: a is there twice'), ('signals', 'signals[1].positive_weight: a number is needed'), ('run', 'bullseye_min_score: a whole number from 0 to 100 is needed'), ('project', 'client_name: text is needed'), ('kept', 'cash'), ('using', 'p1,p2'), ('same', 'true'), ('doubles', 'refused')) t(part, message)")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of profiles, runs and projects; a redundant signal goes; fingerprints (I19, D17, M20, M21, M25). Configuration, no table."""
    one = {"signal_id": "a", "signal_label": "A", "prompt_instruction": "p", "positive_weight": 1}
    out = [("signals", e) for e in config.signal_errors({"signals": [one, one | {"positive_weight": "1"}]})]
    out += [("run", e) for e in config.run_errors({"bullseye_min_score": 101})]
    out += [("project", e) for e in config.project_errors({"project_id": "p", "icp_profile_id": "i"})]
    out += [("kept", s["signal_id"]) for s in config.without_inverse_billing([{"signal_id": "cash", "signal_label": "Cash pay"}, {"signal_id": "ins", "signal_label": "Insurance-only model"}])]
    out += [("using", ",".join(config.projects_using([{"project_id": "p2", "icp_profile_id": "i"}, {"project_id": "p1", "icp_profile_id": "i"}, {"project_id": "p3", "icp_profile_id": "j"}], "i")))]
    out += [("same", str(config.fingerprint({"a": 1, "b": 2}, "x") == config.fingerprint({"b": 2, "a": 1}, "x")).lower())]
    try:
        config.json_without_doubles('{"a": 1, "a": 2}')
    except ValueError:
        out.append(("doubles", "refused"))
    return spark.createDataFrame(out, "part string, message string")


@query("SELECT o_orderkey, lower(strip_) AS word, len(shared) AS shared, len(rest) AS rest FROM (SELECT o_orderkey, o_orderpriority AS strip_, list_intersect(list_distinct(string_split(trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')), ' ')), ['1', '2', 'high', 'low']) AS shared, list_filter(list_distinct(string_split(trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: NOT list_contains(['1', '2', 'high', 'low'], x)) AS rest FROM orders)")
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference of names' words (H3, H4)."""
    c = F.col
    mine = names.tokens(c("o_orderpriority"), noise=("",))
    some = F.array(*[F.lit(x) for x in ("1", "2", "high", "low")])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("word"), names.overlap(mine, some).cast("long").alias("shared"), F.size(F.array_except(mine, some)).cast("long").alias("rest"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1 ORDER BY o_orderkey LIMIT 1000")
def first_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of a run, after its duplicates are gone (D2): a limit that is the feature."""
    rows = enrichment.first_wins(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return enrichment.limited(rows, 1000, "o_orderkey").select("o_orderkey")


@query("SELECT count(*) FILTER (c_custkey % 3 > 0 AND c_custkey % 5 > 0) AS kept, count(*) FILTER (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS dropped FROM customer")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a name or an id are dropped and told."""
    c = F.col
    ok, bad = enrichment.required(table(spark, sf_dir, "customer").select(F.when(c("c_custkey") % 3 > 0, c("c_name")).alias("practice_name"), F.when(c("c_custkey") % 5 > 0, c("c_custkey").cast("string")).otherwise("").alias("id")))
    return ok.agg(F.count("*").alias("kept")).join(F.broadcast(bad.agg(F.count("*").alias("dropped"))))


@query("SELECT n_name AS practice_name, n_nationkey % 5 AS k, 'a' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'b' AS context_text, 'partial' AS source_confidence FROM nation")
def manual_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that an operator pasted as the text of records."""
    pasted = spark.createDataFrame([(2, "b"), (1, "a")], "position int, text string")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("practice_name"), (F.col("n_nationkey") % 5).alias("k"))
    return evidence.with_manual_content(rows, pasted)


@query(f"SELECT o_orderkey, 4 AS n, 0 AS n_known, 'no_context' AS reason, '' AS why FROM ({_STATES})")
def empty_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and briefs of records with too little text."""
    c = F.col
    rows = _orders(spark, sf_dir).select("o_orderkey", S.empty(DEFS).alias("s"), S.empty_brief().alias("b"))
    return rows.select("o_orderkey", F.size("s").alias("n"), F.size(F.filter("s", lambda s: s.signal_state != "not_found")).alias("n_known"), c("s")[0].not_found_reason.alias("reason"), c("b.why_contact").alias("why"))


@query(
    """
    SELECT c_custkey, 'p' || c_custkey || '.example.com' AS website_domain, '415555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone_digits, 'Oakland, CA 94601' AS address_full, CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '2' END AS npi FROM customer"""
)
def registry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry fields of an enriched record."""
    c = F.col
    rows = table(spark, sf_dir, "customer").select("c_custkey", c("c_name").alias("practice_name"), F.concat(F.lit("https://www.p"), c("c_custkey").cast("string"), F.lit(".example.com/a")).alias("website_url"), F.concat(F.lit("(415) 555-"), F.lpad((c("c_custkey") % 10000).cast("string"), 4, "0")).alias("phone"), F.lit("").alias("google_place_id"), F.lit("Oakland").alias("address_city"), F.lit("CA").alias("address_state"), F.lit("94601").alias("address_zip"), F.lit("x").alias("specialty"), F.when(c("c_custkey") % 2 == 0, "1").otherwise("").alias("npi_optional"), F.lit("2").alias("npi"))
    fields = match.fields_from_record()
    return rows.select("c_custkey", *[fields[f].alias(f) for f in ("website_domain", "phone_digits", "address_full", "npi")])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'Bullseye' ELSE 'Contender' END AS target_tier FROM customer WHERE c_acctbal > 5000")
def registry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a selection mode takes into the registry."""
    c = F.col
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(c("c_acctbal") > 5000, K.BULLSEYE).otherwise(K.CONTENDER).alias("target_tier"), F.lit("CLEAR").alias("exclusion_status"), F.lit("complete").alias("enrichment_status"))
    return registry.chosen(rows, mode="bullseye_only").select("c_custkey", "target_tier")


@query("SELECT n_nationkey::VARCHAR AS id, n_name FROM nation WHERE n_nationkey IN (1, 3, 5)")
def three_account_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three accounts that a brief names (M12): a choice of three is the feature."""
    return views.brief_of(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), "n_name"), ["1", "3", "5"])
