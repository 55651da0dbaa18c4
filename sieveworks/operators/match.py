"""Matching rows against reference lists: customers, a registry of known practices, a registry snapshot; classes of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.functions import addresses, names, phones, urls
from sieveworks.functions.text import blank, first_filled, strip
from sieveworks.operators import overlap
from sieveworks.operators.graph import ONE_TASK, first_come, written
from sieveworks.operators.rules import taxonomy_rules

KEYS = ("google_place_id", "website_domain", "phone", "name_address")
SNAPSHOT = "number string, enumeration_type string, organization_name string, telephone_number string, postal_code string, taxonomy_codes array<string>"


# --- customers -------------------------------------------------------------------------------------------------------


def suppression(records: DataFrame, customers: DataFrame) -> DataFrame:
    """``records`` with ``customer_suppressed`` and ``suppression_reason``.

    ``customers`` has ordinal, npi, name, zip and state. In this order: the record's own numbers, a provider's number, two
    shared words and the ZIP, three shared words and the state; of several customers the first in the list decides. Names meet
    by the combinations of their words, so a word that a whole state shares pairs no rows. Rows are numbered once and written,
    as each branch would else number them anew, and customers with their words, as each place would else split names anew.
    """
    c = F.col
    rows = records.drop("customer_suppressed", "suppression_reason").withColumns({"_row": F.monotonically_increasing_id(), "_words": names.tokens(c("practice_name"))})
    rows = written(rows, "suppression")
    listed = written(customers.select("ordinal", strip(c("npi")).alias("npi"), strip(c("name")).alias("said"), names.tokens(c("name")).alias("words"), addresses.zip5(c("zip")).alias("zip"), addresses.state2(c("state")).alias("state")), "customers")
    npis = listed.where("npi <> ''").select("npi").distinct()
    numbers = F.array(strip(c("npi_number")), strip(c("npi_optional")))
    own = F.transform(numbers, lambda n, i: F.struct(i.alias("at"), n.alias("npi"), F.concat(F.lit("Existing customer — NPI match: "), n).alias("why")))

    def person(p: Column, i: Column) -> Column:
        npi, who = strip(p["npi"]), strip(p["name"])
        shown = F.when(who != "", F.concat(who, F.lit(" (NPI "), npi, F.lit(")"))).otherwise(F.concat(F.lit("NPI "), npi))
        return F.struct((i + 2).alias("at"), npi.alias("npi"), F.concat(F.lit("Existing customer — provider at this location is a current customer: "), shown).alias("why"))

    people = F.coalesce(F.transform("providers", person), F.array().cast("array<struct<at:int,npi:string,why:string>>"))
    found = rows.select("_row", F.explode(F.concat(own, people)).alias("n")).select("_row", "n.*").where("npi <> ''").join(npis, "npi").select("_row", "at", "why")
    places = [("zip", addresses.zip5(c("address_zip")), K.ZIP_TOKENS, 1_000_000, "name+ZIP"), ("state", addresses.state2(c("address_state")), K.STATE_TOKENS, 2_000_000, "name+state")]
    for place, own_place, least, rank, label in places:
        mine = rows.select(c("_row").alias("row"), own_place.alias("place"), c("_words").alias("words"))
        first = overlap.first_sharing(mine, listed.select("ordinal", c(place).alias("place"), "words"), least)
        why = F.concat(F.lit(f"Existing customer — {label} match: "), c("said"))
        found = found.unionByName(first.join(listed.select("ordinal", "said"), "ordinal").select(c("row").alias("_row"), F.lit(rank).alias("at"), why.alias("why")))
    reason = found.groupBy("_row").agg(F.min_by("why", "at").alias("suppression_reason"))
    out = rows.join(reason, "_row", "left").drop("_row", "_words")
    return out.withColumn("customer_suppressed", c("suppression_reason").isNotNull()).withColumn("suppression_reason", blank(c("suppression_reason")))


# --- registry --------------------------------------------------------------------------------------------------------


def match_fields(name: Column, url: Column, phone: Column, place_id: Column, full: Column, city: Column, state: Column, zip_: Column) -> dict[str, Column]:
    """The normalized fields by which rows and registry entries meet."""
    return {
        "google_place_id": strip(place_id), "website_domain": urls.hostname(strip(url)), "phone_digits": phones.loose(phone),
        "name_normalized": names.loose(name), "address_normalized": addresses.loose_address(full, city, state, zip_),
    }


def sufficient() -> Column:
    """Whether a row has an identifier: a place id, a domain, ten digits, or both a name and an address."""
    c = lambda x: blank(F.col(x))
    return (c("google_place_id") != "") | (c("website_domain") != "") | (F.length(c("phone_digits")) >= 10) | ((c("name_normalized") != "") & (c("address_normalized") != ""))


def _key_values() -> dict[str, Column]:
    c = F.col
    digits = blank(c("phone_digits"))
    return {
        "google_place_id": blank(c("google_place_id")), "website_domain": blank(c("website_domain")),
        "phone": F.when(F.length(digits) >= 10, digits).otherwise(""), "name_address": names.name_address_key(c("name_normalized"), c("address_normalized")),
    }


def exploded_keys(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``priority``, ``basis``, ``value``: the keys that a row has."""
    listed = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(name).alias("basis"), value.alias("value")) for i, (name, value) in enumerate(_key_values().items())])
    return rows.select(*keep, F.explode(listed).alias("k")).select(*keep, "k.*").where("value <> ''")


def registry_index(entries: DataFrame) -> DataFrame:
    """``basis, value, entry_id``: of entries that share a key the last one, by ``ordinal``."""
    keys = exploded_keys(entries, "entry_id", "ordinal")
    return keys.groupBy("basis", "value").agg(F.max_by("entry_id", "ordinal").alias("entry_id"))


def registry_matches(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``row_idx, entry_id, match_basis, hits``: the entry of the first key that hits, and all entries that any key hits.

    One join on (basis, value) stands for the four lookups.
    """
    hit = exploded_keys(rows, "row_idx").join(registry_index(entries), ["basis", "value"])
    first = F.struct("priority")
    return hit.groupBy("row_idx").agg(F.min_by("entry_id", first).alias("entry_id"), F.min_by("basis", first).alias("match_basis"), F.array_sort(F.collect_set("entry_id")).alias("hits"))


def with_ambiguity(matches: DataFrame) -> DataFrame:
    """Matches with ``ambiguous``: keys that lead to more than one entry are no match."""
    many = F.size("hits") > 1
    return matches.withColumn("ambiguous", many).withColumn("entry_id", F.when(many, None).otherwise(F.col("entry_id")))


def changes(row: str, entry: str) -> Column:
    """Fields that both sides have and in which they differ: array<struct<field, label, old, new>>."""
    new = lambda f: strip(F.col(f"{row}.{f}"))
    old = lambda f: strip(F.col(f"{entry}.{f}"))
    return F.array_compact(F.array(*[F.when((new(f) != "") & (old(f) != "") & (new(f) != old(f)), F.struct(F.lit(f).alias("field"), F.lit(label).alias("label"), old(f).alias("old"), new(f).alias("new"))) for f, label in K.CHANGE_FIELDS]))


def with_earlier(keys: DataFrame, span: int = 1 << 16) -> DataFrame:
    """``keys`` with ``dup``: the latest earlier row of the same (basis, value).

    A key is dealt by spans of ``row_idx``: inside one the row before counts, and the first row of a span gets the last one of
    the spans before it, so a key that most rows share is sorted in many tasks.
    """
    at = ("basis", "value", "_span")
    parted = keys.withColumn("_span", F.floor(F.col("row_idx") / span))
    last = parted.groupBy(*at).agg(F.max("row_idx").alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy("basis", "value").orderBy("_span"))).where("_before is not null").select(*at, "_before")
    inside = F.lag("row_idx").over(Window.partitionBy(*at).orderBy("row_idx"))
    return parted.withColumn("_inside", inside).join(last, list(at), "left").withColumn("dup", F.coalesce("_inside", "_before")).drop("_span", "_inside", "_before")


def classified(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``row_idx, classification, match_basis, entry_id, changed_fields, duplicate_of_row_idx`` for each uploaded row.

    Insufficient; known or changed by the registry; else a duplicate of the latest earlier row with the same key; else new.
    """
    c = F.col
    fit = rows.where(sufficient())
    found = registry_matches(fit, entries).drop("hits")
    fields = F.struct(*[blank(c(f)).alias(f) for f, _ in K.CHANGE_FIELDS])
    known = found.join(fit.select("row_idx", fields.alias("new")), "row_idx").join(entries.select("entry_id", fields.alias("old")), "entry_id")
    known = known.select("row_idx", "entry_id", "match_basis", changes("new", "old").alias("changed_fields"))
    seen = with_earlier(exploded_keys(fit, "row_idx")).where("dup is not null")
    double = seen.groupBy("row_idx").agg(F.min_by("dup", "priority").alias("dup"), F.min_by("basis", "priority").alias("dup_basis"))
    out = rows.select("row_idx", sufficient().alias("ok")).join(known, "row_idx", "left").join(double, "row_idx", "left")
    hit = c("entry_id").isNotNull()
    kind = F.when(~c("ok"), "INSUFFICIENT_DATA").when(hit & (F.size("changed_fields") > 0), "CHANGED").when(hit, "KNOWN").when(c("dup").isNotNull(), "POSSIBLE_DUPLICATE").otherwise("NEW")
    none = F.array().cast("array<struct<field:string,label:string,old:string,new:string>>")
    return out.select(
        "row_idx", kind.alias("classification"), F.when(c("ok"), F.coalesce("match_basis", "dup_basis")).alias("match_basis"), "entry_id",
        F.coalesce("changed_fields", none).alias("changed_fields"), F.when(c("ok") & ~hit, c("dup")).alias("duplicate_of_row_idx"),
    )


def change_text(changed: Column) -> Column:
    """``label: 'old' → 'new'`` joined by semicolons."""
    return F.array_join(F.transform(changed, lambda x: F.concat(x.label, F.lit(": '"), x.old, F.lit("' → '"), x.new, F.lit("'"))), "; ")


def reason_text(kind: Column, basis: Column, changed: Column, duplicate: Column) -> Column:
    """Why a row has its class."""
    return (
        F.when(kind == "NEW", "No registry match").when(kind == "CHANGED", F.concat(F.lit("Changed: "), change_text(changed)))
        .when(kind == "KNOWN", F.concat(F.lit("Matched by "), basis)).when(kind == "POSSIBLE_DUPLICATE", F.concat(F.lit("Same "), basis, F.lit(" as row "), duplicate.cast("string")))
        .otherwise("No reliable identifier")
    )


def class_counts(results: DataFrame) -> DataFrame:
    """``classification, n`` with a row for every class."""
    every = results.sparkSession.createDataFrame([(i, k) for i, k in enumerate(K.CLASSES)], "place int, classification string")
    return F.broadcast(every).join(results.groupBy("classification").agg(F.count("*").alias("n")), "classification", "left").select("classification", F.coalesce("n", F.lit(0)).alias("n"))


def selected(results: DataFrame, mode: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """Rows to go on with: by a mode (new, changed, new_and_changed) or by ids; known and insufficient rows never are."""
    modes = {"new": ("NEW",), "changed": ("CHANGED",), "new_and_changed": ("NEW", "CHANGED")}
    if (mode is None) == (ids is None):
        raise ValueError("give either a mode or ids")
    if mode is not None:
        return results.where(F.col("classification").isin(*modes[mode]))
    return results.where(F.col("row_idx").isin(ids) & ~F.col("classification").isin("KNOWN", "INSUFFICIENT_DATA"))


# --- registry snapshot -----------------------------------------------------------------------------------------------


def npi_lookup(records: DataFrame, snapshot: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """``records`` with number, confidence, entity type, codes, name and count from a snapshot of the number registry.

    A row's own number wins. Else, in its ZIP, organizations ahead of persons, the first candidate (by number) whose name or
    phone agrees; candidates without agreement are ambiguous. Candidates share a ZIP and a word of the name, or the phone. The
    phone counts as one more word; the candidate that agrees is found by words or pairs of words, and candidates are counted
    without being paired. Rows are numbered once and written, and the snapshot with its words and its order.
    """
    c = F.col
    rows = written(records.withColumn("_row", F.monotonically_increasing_id()), "lookup")
    org = F.when(c("enumeration_type") == "NPI-2", "organization").otherwise("individual")
    card = F.struct(c("number").alias("npi_number"), org.alias("npi_entity_type"), F.coalesce("taxonomy_codes", F.array().cast("array<string>")).alias("codes"), F.nullif(strip(c("organization_name")), F.lit("")).alias("npi_practice_name"))
    phone = lambda tel: F.when(tel != "", F.concat(F.lit("tel:"), tel))
    listed = snapshot.select(
        card.alias("card"), c("number").alias("num"), (~F.coalesce(c("enumeration_type") == "NPI-2", F.lit(False))).alias("person"), addresses.zip5(c("postal_code")).alias("place"),
        phone(phones.exact(c("telephone_number"))).alias("tel"), names.tokens(c("organization_name")).alias("said"),
    ).where("num is not null")
    listed = written(listed, "snapshot")
    direct = rows.select("_row", strip(c("npi_optional")).alias("num")).where("num <> ''").join(listed.dropDuplicates(["num"]), "num").select("_row", c("card").alias("direct"))
    mine = rows.select(c("_row").alias("row"), addresses.zip5(c("address_zip")).alias("place"), phone(phones.exact(c("phone"))).alias("tel"), strip(c("practice_name")).alias("name")).where("place <> '' and name <> ''").withColumn("said", names.tokens(c("name")))

    def keyed(side: DataFrame, one: str, *keep: str) -> DataFrame:
        """By what a name can agree: pairs of words, a word where either name has no other, the phone."""
        sorted_ = side.withColumn("w", F.array_sort("said"))
        keys = F.concat(F.expr(overlap.combinations("w", 2)), F.expr(one), F.array_compact(F.array("tel")))
        return sorted_.select(*keep, "place", F.explode(keys).alias("key"))

    # A listed word stands as "any:" for names of one word, and a listed name of one word as "one:" for all others.
    order = F.struct("person", "num")
    best = keyed(listed, "concat(transform(w, x -> concat('any:', x)), if(size(w) = 1, transform(w, x -> concat('one:', x)), array()))", "card", "person", "num").groupBy("place", "key").agg(F.min(order).alias("order"), F.min_by("card", order).alias("card"))
    asked = keyed(mine, "concat(if(size(w) = 1, transform(w, x -> concat('any:', x)), array()), if(size(w) > 1, transform(w, x -> concat('one:', x)), array()))", "row")
    agreed = asked.join(best, ["place", "key"]).groupBy("row").agg(F.min_by("card", "order").alias("found"))
    numbered = listed.dropDuplicates(["num", "place", "said", "tel"]).withColumn("ordinal", F.monotonically_increasing_id())
    words = F.concat("said", F.array_compact(F.array("tel"))).alias("words")
    counted = overlap.count_sharing(mine.select("row", "place", words), numbered.select("ordinal", "place", words))
    found = counted.join(agreed, "row", "left").select(c("row").alias("_row"), "found", c("n").alias("_n"))
    out = rows.join(direct, "_row", "left").join(found, "_row", "left").withColumn("_card", F.coalesce("direct", "found"))
    codes = F.coalesce("_card.codes", F.array().cast("array<string>"))
    return out.withColumns(
        {
            "npi_number": c("_card.npi_number"), "npi_match_confidence": F.when(c("_card").isNotNull(), "confident").when(c("_n") > 0, "ambiguous").otherwise("none"),
            "npi_entity_type": c("_card.npi_entity_type"), "provider_taxonomy_codes": codes, "taxonomy_exclusions": taxonomy_rules(codes, rules or {}),
            "npi_provider_count": F.when(c("direct").isNotNull(), 1).otherwise(F.when(c("found").isNotNull(), c("_n"))).cast("int"), "npi_practice_name": c("_card.npi_practice_name"),
        }
    ).drop("_row", "direct", "found", "_n", "_card")


# --- duplicates in an upload -----------------------------------------------------------------------------------------


def upload_duplicates(rows: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``row_idx, first_row, basis`` for rows whose url, or else name and state, an earlier kept row has.

    A row is judged by kept rows only, which chains a decision to earlier ones: rows take their keys in order, all or none.
    """
    c = F.col
    tidy = rows.select("row_idx", urls.canonical(c("website_url")).alias("url"), F.lower(strip(c("practice_name"))).alias("name"), F.upper(strip(c("address_state"))).alias("state"))
    listed = F.array(F.when(c("url") != "", F.concat(F.lit("u:"), "url")), F.when((c("name") != "") & (c("state") != ""), F.concat_ws("|", F.lit("n"), "name", "state")))
    keys = written(tidy.select(c("row_idx").cast("long").alias("row"), F.posexplode(listed).alias("at", "key")).where("key is not null"), "keys")
    hit = keys.join(first_come(keys, one_task), "key").where("owner < row")
    found = hit.groupBy("row").agg(F.min(F.struct("at", "owner")).alias("x"))
    return found.select(c("row").alias("row_idx"), c("x.owner").alias("first_row"), F.when(c("x.at") == 0, "url").otherwise("name_state").alias("basis"))


def fuzzy_names(rows: DataFrame, least: float = 0.82, most_rows: int = 500) -> DataFrame:
    """``left, right, ratio`` of names alike in one state, for small uploads only: larger ones give no rows, as specified."""
    named = rows.select("row_idx", F.lower(strip(F.col("practice_name"))).alias("name"), F.upper(strip(F.col("address_state"))).alias("state")).where("name <> ''")
    small = F.broadcast(rows.agg((F.count("*") <= most_rows).alias("small"))).where("small")
    a, b = named.select("state", F.struct("row_idx", "name").alias("a")), named.select("state", F.struct("row_idx", "name").alias("b"))
    pairs = a.join(small).join(b, "state").where("a.row_idx < b.row_idx").where(names.may_be_alike(F.col("a.name"), F.col("b.name"), least))
    return pairs.withColumn("ratio", names.likeness(F.col("a.name"), F.col("b.name"))).where((F.col("ratio") >= least) & (F.col("ratio") < 1)).select(F.col("a.row_idx").alias("left"), F.col("b.row_idx").alias("right"), "ratio")


def fields_from_record() -> dict[str, Column]:
    """Registry fields of an enriched record; the address is always made of city, state and ZIP."""
    c = lambda x: blank(F.col(x))
    full = F.array_join(F.filter(F.array(c("address_city"), c("address_state")), lambda p: p != ""), ", ")
    full = F.when(c("address_zip") != "", strip(F.concat(full, F.lit(" "), c("address_zip")))).otherwise(full)
    return match_fields(c("practice_name"), c("website_url"), c("phone"), c("google_place_id"), F.lit(""), c("address_city"), c("address_state"), c("address_zip")) | {
        "practice_name": c("practice_name"), "website_url": c("website_url"), "phone": c("phone"), "address_full": full, "address_city": c("address_city"),
        "address_state": c("address_state"), "address_zip": c("address_zip"), "specialty": c("specialty"), "npi": first_filled(c("npi_optional"), c("npi")),
    }
