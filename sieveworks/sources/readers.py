"""Reading listings, runs, registries, reviews and pages. Every CSV is read as text; ordinals are taken at the read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveworks.functions import addresses, names, urls
from sieveworks.functions.text import blank, first_filled, strip
from sieveworks.operators import match
from sieveworks.operators.graph import written
from sieveworks.operators.overlay import REVIEW

# Columns that sources use for a field, the first filled one counts.
LISTING = {
    "name": ("name",), "full": ("full_address", "address"), "state": ("state", "region", "address_state", "state_code", "state_name"),
    "city": ("city", "locality", "address_city", "city_name"), "zip": ("postal_code", "zip", "zip_code"), "phone": ("phone",),
    "url": ("site", "website", "website_url", "url", "web", "web_url", "website_address"), "type": ("type", "category", "business_type"),
    "npi": ("npi",), "place": ("place_id", "google_place_id"), "street": ("street", "address_street", "address_line_1", "address1"),
    "unit": ("unit", "suite", "address_unit"),
}
PLACES = {
    "name": ("title",), "url": ("website",), "phone": ("phone", "phoneunformatted"), "street": ("street",), "unit": ("unit",), "city": ("city",),
    "state": ("state",), "zip": ("postalcode",), "type": ("categoryname", "categories/0"), "place": ("placeid",),
}
CUSTOMERS = {
    "npi": ("npi_number", "npi", "provider_npi"), "name": ("practice_name", "name", "account_name", "organization_name", "practice"),
    "zip": ("address_zip", "zip", "zip_code", "postal_code", "zip5"), "state": ("address_state", "state", "state_code"),
}
CANONICAL = (
    "id", "practice_name", "provider_names", "specialty", "npi_optional", "google_place_id", "website_url", "phone", "address_street", "address_unit",
    "address_city", "address_state", "address_zip", "metro_region_tag", "state_mandate_status", "raw_input_source", "source_type", "row_num",
)


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A CSV as text columns with trimmed lower-case names and ``row_idx``, its order; quotes may hold line ends.

    Without ``sep`` the header decides: semicolons or tabs where it has no comma. A file is read by one task, as a quote may hold
    line ends; rows of several files are numbered on.
    """
    if sep is None:
        head = spark.read.text(path).limit(1).collect()
        line = head[0][0] if head else ""
        sep = "," if "," in line else ";" if ";" in line else "\t" if "\t" in line else ","
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    tidy = df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])
    numbered = written(tidy.withColumn("_at", F.monotonically_increasing_id()), "csv")
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each file or more
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = numbered.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select(*[F.col(f"`{c}`") for c in tidy.columns], (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("row_idx"))


def pick(df: DataFrame, table: dict[str, tuple[str, ...]], field: str) -> Column:
    """The first filled column of a field, as it is."""
    have = [F.col(f"`{c}`") for c in table.get(field, ()) if c in df.columns]
    return first_filled(*have) if have else F.lit("")


def listings(df: DataFrame, zips: DataFrame | None = None, kind: str = "listing") -> tuple[DataFrame, DataFrame]:
    """(canonical rows, rejected rows) of a listing or places export. ``zips`` (zip, city, state) fills what only a ZIP gives."""
    table = PLACES if kind == "places" else LISTING
    c, get = F.col, lambda f: strip(pick(df, table, f))
    out = df.withColumns({f"_{f}": get(f) for f in LISTING}).withColumn("_parsed", addresses.parsed(c("_full")))
    if kind == "places" and "permanentlyclosed" in df.columns:
        out = out.where(F.lower(strip(c("permanentlyclosed"))) != "true")
    out = out.withColumns(
        {
            "_state": first_filled(addresses.state_code(c("_state")), addresses.state_code(c("_parsed.state"))), "_city": first_filled(c("_city"), c("_parsed.city")),
            "_zip": first_filled(c("_zip"), c("_parsed.zip")), "_street": first_filled(c("_street"), c("_parsed.street")),
        }
    )
    if zips is not None:
        known = zips.select(addresses.zip5(c("zip")).alias("_z"), c("city").alias("_zc"), c("state").alias("_zs")).dropDuplicates(["_z"])
        out = out.withColumn("_z", addresses.zip5(c("_zip"))).join(known, "_z", "left").withColumns({"_city": first_filled(c("_city"), c("_zc")), "_state": first_filled(c("_state"), c("_zs"))})
    npi = F.nullif(c("_npi"), F.lit(""))
    rows = out.select(
        names.record_id(c("_npi"), c("_name"), c("_state"), c("_zip")).alias("id"), c("_name").alias("practice_name"), F.array().cast("array<string>").alias("provider_names"),
        names.specialty(c("_type"), c("_name")).alias("specialty"), npi.alias("npi_optional"), c("_place").alias("google_place_id"), urls.canonical(c("_url")).alias("website_url"),
        c("_phone").alias("phone"), c("_street").alias("address_street"), c("_unit").alias("address_unit"), c("_city").alias("address_city"), c("_state").alias("address_state"),
        c("_zip").alias("address_zip"), c("_city").alias("metro_region_tag"), F.lit("").alias("state_mandate_status"), F.lit("").alias("raw_input_source"),
        F.lit(kind).alias("source_type"), (c("row_idx") + 2).alias("row_num"),
    )
    missing = rows.where("practice_name = ''").select("row_num", F.lit("missing practice name").alias("reason"))
    return rows.where("practice_name <> ''"), missing


def manual(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, rejected rows) of a list in the canonical schema; an id of its own stays."""
    get = lambda *fields: strip(pick(df, {"f": fields}, "f"))
    name, state, zip_, npi = get("practice_name"), addresses.state_code(get("address_state")), get("address_zip"), get("npi_optional")
    rows = df.select(
        first_filled(get("id"), names.record_id(npi, name, state, zip_)).alias("id"), name.alias("practice_name"), names.provider_list(get("provider_names")).alias("provider_names"),
        get("specialty").alias("specialty"), F.nullif(npi, F.lit("")).alias("npi_optional"), get("google_place_id").alias("google_place_id"),
        urls.canonical(get("website_url", "website", "site", "url")).alias("website_url"), get("phone").alias("phone"), get("address_street", "address").alias("address_street"),
        get("address_unit", "suite").alias("address_unit"), get("address_city").alias("address_city"), state.alias("address_state"), zip_.alias("address_zip"),
        get("metro_region_tag").alias("metro_region_tag"), get("state_mandate_status").alias("state_mandate_status"), F.lit("").alias("raw_input_source"),
        F.lit("manual").alias("source_type"), (F.col("row_idx") + 2).alias("row_num"),
    )
    missing = rows.where("practice_name = ''").select("row_num", F.lit("missing practice name").alias("reason"))
    return rows.where("practice_name <> ''"), missing


def uploads(df: DataFrame) -> DataFrame:
    """Rows of a discovery upload: row_idx, raw fields and the normalized ones by which they are matched."""
    get = lambda f: strip(pick(df, LISTING, f))
    raw = {
        "practice_name": get("name"), "website_url": get("url"), "phone": get("phone"), "google_place_id": get("place"), "address_full": get("full"),
        "address_city": get("city"), "address_state": get("state"), "address_zip": get("zip"), "google_category": get("type"), "npi": get("npi"),
    }
    rows = df.select("row_idx", *[v.alias(k) for k, v in raw.items()])
    c = F.col
    return rows.withColumns(match.match_fields(c("practice_name"), c("website_url"), c("phone"), c("google_place_id"), c("address_full"), c("address_city"), c("address_state"), c("address_zip")))


def customers(df: DataFrame) -> DataFrame:
    """``ordinal, npi, name, zip, state`` of a customer list; columns that it lacks are empty."""
    first = lambda f: next((x for x in df.columns if x in CUSTOMERS[f]), None)
    return df.select(F.col("row_idx").alias("ordinal"), *[(strip(F.col(f"`{first(f)}`")) if first(f) else F.lit("")).alias(f) for f in CUSTOMERS])


def run_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a run's JSON, in a wrapper or as a bare list; ``schema`` is that of a record."""
    texts = spark.read.option("wholetext", True).text(path)
    wrapped = F.from_json("value", f"struct<records:array<struct<{schema}>>>")
    bare = F.from_json("value", f"array<struct<{schema}>>")
    records = F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped.records)
    return texts.select(F.posexplode(records).alias("ordinal", "r")).select("ordinal", "r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry table; a missing one is empty, a corrupt one is an error."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def reviews(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(reviews, damaged lines): damage is an error where ``strict``, else it is set aside."""
    if not _exists(spark, path):
        return spark.createDataFrame([], REVIEW), spark.createDataFrame([], "damaged string")
    if strict:
        return spark.read.schema(REVIEW).option("mode", "FAILFAST").json(path), spark.createDataFrame([], "damaged string")
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", f"struct<{', '.join(x.replace(' ', ':', 1) for x in _fields(REVIEW))},_corrupt_record:string>", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = F.col("r._corrupt_record").isNull() & F.col("r.record_id").isNotNull()
    return parsed.where(good).select("r.*").drop("_corrupt_record"), parsed.where(~good).select(F.col("value").alias("damaged"))


def _fields(ddl: str) -> list[str]:
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def runs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The status of every run that can be read."""
    found = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(pattern)
    return found.where("_corrupt_record is null and run_id is not null").drop("_corrupt_record")


def run_store(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of a folder of runs, ``root/run=<id>/*.json`` as lines, with ``run``; lines that can't be read go.

    The folder is the partition: a condition on ``run`` is a condition on folders, so no file of another run is opened. Folders
    whose name is no number stay text.
    """
    lines = spark.read.schema("value string, run string").option("basePath", root).text(root)
    read = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select("run", read.alias("r")).where("r._corrupt_record is null and r is not null").select("r.*", "run").drop("_corrupt_record")


def unioned(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def preflight(df: DataFrame, required: tuple[str, ...]) -> tuple[list[str], DataFrame]:
    """(required columns that are missing, one row of counts of blank cells of the others)."""
    missing = [c for c in required if c not in df.columns]
    return missing, df.agg(F.count("*").alias("rows"), *[F.count_if(strip(blank(F.col(c))) == "").alias(f"blank_{c}") for c in required if c in df.columns])
