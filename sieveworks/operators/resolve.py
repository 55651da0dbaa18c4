"""Entity resolution: rows of listings to locations, and locations to groups.

Candidates come from two equi-joins, one on (ZIP, street) and one on (phone, domain) with small blocks only. Pairs are scored by
column expressions; name likeness is computed only for pairs whose lengths allow it. Merge edges split into components, and only
inside a component that names two units of a street does the order of edges matter: there they are applied strongest first, and
refused where they would put two units of one building in one cluster (``clusters``).
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.functions import addresses, names, phones, urls
from sieveworks.functions.text import any_of, blank, first_filled, short_hash, strip
from sieveworks.operators import clusters
from sieveworks.operators.graph import ONE_TASK, components, numbered, placed, written

FIELDS = (
    "id", "practice_name", "specialty", "npi_optional", "npi_number", "npi_entity_type", "npi_practice_name", "google_place_id",
    "website_url", "phone", "address_street", "address_unit", "address_city", "address_state", "address_zip", "metro_region_tag",
    "state_mandate_status",
)
ADDRESS = ("address_street", "address_unit", "address_city", "address_state", "address_zip")
FILLED = ("website_url", "phone", "google_place_id", "npi_optional", "specialty", "metro_region_tag", "state_mandate_status")


def domain_policy(noise: Iterable[str] | None = None, more_noise: Iterable[str] = (), umbrella: Iterable[str] | None = None, more_umbrella: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """The two domain lists, each replaced and extended as asked."""
    tidy = lambda xs: [x.strip().lower() for x in xs if x]
    return (
        sorted({*tidy(K.NOISE_DOMAINS if noise is None else noise), *tidy(more_noise)}),
        sorted({*tidy(K.UMBRELLA_DOMAINS if umbrella is None else umbrella), *tidy(more_umbrella)}),
    )


def conformed(records: DataFrame) -> DataFrame:
    """Records with every column that resolution reads; missing ones are empty."""
    have = set(records.columns)
    texts = {f: blank(F.col(f)) if f in have else F.lit("") for f in FIELDS}
    lists = {f: F.coalesce(F.col(f), F.array().cast("array<string>")) if f in have else F.array().cast("array<string>") for f in ("provider_names", "provider_taxonomy_codes")}
    return records.withColumns(texts | lists)


def identified(records: DataFrame) -> DataFrame:
    """Records with ``ident struct<street, unit, zip5, phone, domain, name>`` and ``signature``, built from normalized values."""
    c = F.col
    have = set(records.columns)
    line = first_filled(*[c(x) for x in ("address_street", "address_line1", "address_full") if x in have])
    out = records.withColumn("_parts", addresses.split_street(line)).withColumn("_unit", addresses.unit(blank(c("address_unit"))))
    ident = F.struct(
        c("_parts.street").alias("street"), first_filled(c("_unit"), c("_parts.unit")).alias("unit"), addresses.zip5(c("address_zip")).alias("zip5"),
        phones.strict(c("phone")).alias("phone"), urls.registrable(c("website_url")).alias("domain"), names.practice(c("practice_name")).alias("name"),
    )
    out = out.withColumn("ident", ident).drop("_parts", "_unit")
    return out.withColumn("signature", F.concat_ws("|", "ident.zip5", "ident.street", "ident.unit", "ident.phone", "ident.domain", "ident.name", blank(c("id"))))


def zips_disagree(a: Column, b: Column) -> Column:
    """Whether both ZIPs are there and differ."""
    return (a != "") & (b != "") & (a != b)


def units_conflict(a: Column, b: Column) -> Column:
    """Whether two rows name different units of one building; a missing ZIP does not lift this."""
    return (a.unit != "") & (b.unit != "") & (a.unit != b.unit) & (a.street != "") & (a.street == b.street) & ~zips_disagree(a.zip5, b.zip5)


def pair_score(a: Column, b: Column, alike: Column, noise: list[str]) -> tuple[Column, Column]:
    """Score and matched fields of a pair."""
    address = (a.street != "") & (a.zip5 != "") & (a.street == b.street) & (a.zip5 == b.zip5)
    unit = address & (a.unit != "") & (a.unit == b.unit)
    phone = (a.phone != "") & (a.phone == b.phone)
    own = (a.domain != "") & (b.domain != "") & ~any_of(a.domain, noise) & ~any_of(b.domain, noise)
    terms = (
        ("address", address, K.ADDRESS_SCORE), ("unit", unit, K.UNIT_SCORE), ("phone", phone, K.PHONE_SCORE),
        ("domain", own & (a.domain == b.domain), K.DOMAIN_SCORE), ("domain_conflict", own & (a.domain != b.domain), K.DOMAIN_CONFLICT_SCORE),
        ("name", alike >= K.NAME_LIKENESS, K.NAME_SCORE),
    )
    score = sum((F.when(hit, points).otherwise(0) for _, hit, points in terms), F.lit(0))
    return score, F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit, _ in terms]))


#: Rows of an address from which on only pairs are made that something besides the address may join.
LARGE_BLOCK = 256
#: From this length on names meet by three characters in a row, below by two.
LONG_NAME = 20


def _grams(name: str, size: int) -> Column:
    """A name's stretches of ``size`` characters, each with how often it occurred up to there; the name itself if it is shorter."""
    every = f"transform(sequence(1, greatest(length({name}) - {size - 1}, 1)), i -> substring({name}, i, {size}))"
    return F.expr(f"transform(array({every}), g -> transform(g, (x, i) -> concat(x, size(filter(slice(g, 1, i + 1), y -> y = x)))))[0]")


def _alike(rows: DataFrame, least: float = K.NAME_LIKENESS) -> DataFrame:
    """``a, b``: pairs of one address whose names may be alike.

    Likeness is 2 M / (|a| + |b|) for M characters in matched stretches. What is not matched, at most (1 - least) (|a| + |b|)
    characters, parts the stretches, so there are at most one more of them, and each loses ``size - 1`` of its pieces of ``size``
    characters. As |b| is at least least / (2 - least) of |a|, this bounds from below the pieces that a name shares with any name
    like it; two such names then share one among the first of each in any order, but for so many (a prefix filter).
    """
    part = 2 / (2 - least)
    named = rows.where("ident.name <> ''").withColumns({"_l": F.length("ident.name"), "_c": _grams("ident.name", 1)})
    side = F.struct("signature", "row", "ident")

    def prefixes(size: int, frame: DataFrame) -> DataFrame:
        shared = F.ceil(F.col("_l") * F.lit(part * (least / 2 - (size - 1) * (1 - least))) - (size - 1) - 1e-9)
        pieces = F.array_sort(F.transform(_grams("ident.name", size), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
        first = F.slice(pieces, F.lit(1), (F.greatest(F.size(pieces), F.lit(1)) - F.greatest(shared, F.lit(1)) + 1).cast("int"))
        return frame.select("k1", "k2", "_l", "_c", side.alias("x"), F.explode(first).alias("p")).select("k1", "k2", "_l", "_c", "x", F.col("p.g").alias("_key"))

    short, reach = F.col("_l") < LONG_NAME, F.col("_l") <= LONG_NAME * (2 - least) / least + 1
    pairs = [(prefixes(3, named.where(~short)), prefixes(3, named.where(~short))), (prefixes(2, named.where(short)), prefixes(2, named.where(reach)))]
    found = None
    for x, y in pairs:
        met = x.select("k1", "k2", "_key", F.col("x").alias("m"), F.col("_c").alias("_m")).join(y.select("k1", "k2", "_key", F.col("x").alias("o"), F.col("_c").alias("_o")), ["k1", "k2", "_key"])
        met = met.where((F.col("m.row") != F.col("o.row")) & names.may_be_alike(F.col("m.ident.name"), F.col("o.ident.name"), least))
        met = met.where(2 * F.size(F.array_intersect("_m", "_o")) >= least * (F.size("_m") + F.size("_o")) - 1e-9)
        turned = _before("o", "m")
        met = met.select(F.when(turned, F.col("o")).otherwise(F.col("m")).alias("a"), F.when(turned, F.col("m")).otherwise(F.col("o")).alias("b"))
        found = met if found is None else found.unionByName(met)
    return found


def _before(a: str, b: str) -> Column:
    return (F.col(f"{a}.signature") < F.col(f"{b}.signature")) | ((F.col(f"{a}.signature") == F.col(f"{b}.signature")) & (F.col(f"{a}.row") < F.col(f"{b}.row")))


def candidates(rows: DataFrame, shared: list[str], contact_blocking: bool = True, most_contacts: int = K.MOST_CONTACTS, noise: Iterable[str] = (), large: int = LARGE_BLOCK) -> DataFrame:
    """``a, b``: pairs of (row, ident, signature) that share a block, each once, in signature order, without unit conflicts.

    ``rows`` has ``row`` (a unique number), ``ident`` and ``signature``. At an address of more than ``large`` rows, pairs that
    agree on nothing but the address are left out, as they neither merge nor are shown to anybody: pairs are made by phone,
    domain, unit, names that may be alike, and a missing phone (which an analyst should see). What is left is output: rows that
    agree on one of these, or lack a phone, still pair with one another.
    """
    keyed = rows.select("row", "ident", "signature")
    side = F.struct("signature", "row", "ident")

    def joined(frame: DataFrame, *key: str, other: DataFrame | None = None) -> DataFrame:
        a, b = (f.select(*key, side.alias(name)) for name, f in (("a", frame), ("b", frame if other is None else other)))
        both = a.join(b, list(key))
        if other is None:
            return both.where(_before("a", "b")).select("a", "b")
        turned = ~_before("a", "b")
        return both.where(F.col("a.row") != F.col("b.row")).select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))

    at = keyed.select("*", F.col("ident.zip5").alias("k1"), F.col("ident.street").alias("k2")).where("k1 <> '' and k2 <> ''")
    crowded = at.groupBy("k1", "k2").count().where(F.col("count") > large).select("k1", "k2")
    if crowded.isEmpty():
        pairs = joined(at, "k1", "k2")
    else:
        crowded = written(crowded, "crowded")
        pairs = joined(at.join(crowded, ["k1", "k2"], "left_anti"), "k1", "k2")
        big = at.join(crowded, ["k1", "k2"], "left_semi").withColumns({f: F.col(f"ident.{f}") for f in ("phone", "domain", "unit")})
        big = written(big, "big")
        own = (F.col("domain") != "") & ~any_of(F.col("domain"), noise)
        for f, has in (("phone", F.col("phone") != ""), ("domain", own), ("unit", F.col("unit") != "")):
            pairs = pairs.union(joined(big.where(has), "k1", "k2", f))
        x, y = F.col("a.ident.domain"), F.col("b.ident.domain")
        parted = (x != "") & (y != "") & (x != y) & ~any_of(x, noise) & ~any_of(y, noise)
        pairs = pairs.union(joined(big.where("phone = ''"), "k1", "k2", other=big).where(~parted)).union(_alike(big))
    if contact_blocking:
        by = keyed.select("*", F.col("ident.phone").alias("k1"), F.col("ident.domain").alias("k2")).where((F.col("k1") != "") & (F.col("k2") != "") & ~any_of(F.col("k2"), shared))
        small = by.groupBy("k1", "k2").count().where(F.col("count").between(2, most_contacts)).select("k1", "k2")
        pairs = pairs.union(joined(by.join(small, ["k1", "k2"], "left_semi"), "k1", "k2"))
    pairs = pairs.where(~units_conflict(F.col("a.ident"), F.col("b.ident")))
    return pairs.withColumns({"_a": F.col("a.row"), "_b": F.col("b.row")}).dropDuplicates(["_a", "_b"]).drop("_a", "_b")


def scored(pairs: DataFrame, noise: list[str]) -> DataFrame:
    """``a, b, score, matched``; likeness is computed only where lengths allow it to count."""
    x, y = F.col("a.ident.name"), F.col("b.ident.name")
    may = names.may_be_alike(x, y, K.NAME_LIKENESS)
    # Names that can't count reach the function as empty texts, for which it does nothing.
    alike = names.likeness(F.when(may, x).otherwise(""), F.when(may, y).otherwise(""))
    out = pairs.withColumn("_alike", alike)
    score, matched = pair_score(F.col("a.ident"), F.col("b.ident"), F.col("_alike"), noise)
    return out.select("a", "b", score.alias("score"), matched.alias("matched"))


def _unions(edges: pd.DataFrame) -> pd.DataFrame:
    """One component's edges, strongest first; ``applied`` tells which ones the unit rule let through."""
    edges = edges.sort_values(["score", "sig_a", "sig_b", "a", "b"], ascending=[False, True, True, True, True])
    units: dict[int, clusters.Units] = {}
    for e in edges.itertuples():
        for row, zip5, street, unit in ((e.a, e.zip_a, e.street_a, e.unit_a), (e.b, e.zip_b, e.street_b, e.unit_b)):
            if unit and street:
                units[row] = {street: {(zip5, unit)}}
    of = clusters.sequential(list(zip(edges["a"], edges["b"], strict=True)), units)
    out = edges[["a", "b"]].assign(cluster_a=[of[x] for x in edges["a"]], cluster_b=[of[x] for x in edges["b"]])
    return out.assign(applied=out["cluster_a"] == out["cluster_b"])[["a", "b", "applied", "cluster_a", "cluster_b"]]


def clustered(rows: DataFrame, pairs: DataFrame, one_task: int = ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """Rows with ``cluster`` (a row number), and the pairs with ``applied`` (null where no merge was due).

    A component with units that may collide is gone through in one task up to ``one_task`` edges and in rounds beyond.
    """
    strong = pairs.where(F.col("score") >= K.MERGE_AT)
    flat = strong.select(
        F.col("a.row").alias("a"), F.col("b.row").alias("b"), "score", F.col("a.signature").alias("sig_a"), F.col("b.signature").alias("sig_b"),
        *[F.col(f"{s}.ident.{f}").alias(f"{n}_{s}") for s in "ab" for f, n in (("zip5", "zip"), ("street", "street"), ("unit", "unit"))],
    )
    roots = components(flat.select("a", "b"))
    held = flat.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    held = written(held, "strong")
    # Only where a component names two units of one street can the order of its edges matter; elsewhere all of them apply.
    ends = F.explode(F.array(*[F.struct(F.col(f"street_{s}").alias("street"), F.col(f"unit_{s}").alias("unit")) for s in "ab"])).alias("e")
    units = held.select("root", ends).select("root", "e.*").where("street <> '' and unit <> ''").groupBy("root", "street").agg(F.min("unit").alias("x"), F.max("unit").alias("y"))
    contested = units.where("x <> y").select("root", "street")
    risky = held.join(contested.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.count("*").alias("n"))
    risky = written(risky, "risky")
    large = risky.where(F.col("n") > one_task).select("root")
    plain = held.join(risky, "root", "left_anti").select("a", "b", F.lit(True).alias("applied"), F.col("root").alias("cluster_a"), F.col("root").alias("cluster_b"))
    small = risky.where(F.col("n") <= one_task)
    done = plain.unionByName(held.join(small, "root", "left_semi").groupBy("root").applyInPandas(lambda x: _unions(x), "a long, b long, applied boolean, cluster_a long, cluster_b long"))
    if not large.isEmpty():
        mine = held.join(large, "root", "left_semi")
        ranked = placed(mine.select("a", "b", "score", "sig_a", "sig_b"), [F.desc("score"), F.asc("sig_a"), F.asc("sig_b"), F.asc("a"), F.asc("b")], "rank").select("a", "b", "rank")
        named = F.explode(F.array(*[F.struct(F.col(s).alias("node"), *[F.col(f"{f}_{s}").alias(f) for f in ("street", "zip", "unit")]) for s in "ab"])).alias("e")
        keys = mine.select("root", named).select("root", "e.*").where("unit <> ''").join(contested, ["root", "street"], "left_semi").select("node", "street", "zip", "unit")
        of = clusters.constrained(ranked, keys, one_task)
        sides = [of.select(F.col("node").alias(s), F.col("cluster").alias(f"cluster_{s}")) for s in "ab"]
        joined = ranked.select("a", "b").join(sides[0], "a").join(sides[1], "b")
        done = done.unionByName(joined.withColumn("applied", F.col("cluster_a") == F.col("cluster_b")))
    done = written(done, "unions")
    of_row = done.select(F.explode(F.array(F.struct(F.col("a").alias("row"), F.col("cluster_a").alias("cluster")), F.struct(F.col("b").alias("row"), F.col("cluster_b").alias("cluster")))).alias("x")).select("x.*").distinct()
    out = rows.join(of_row, "row", "left").withColumn("cluster", F.coalesce("cluster", "row"))
    marked = pairs.withColumns({"_x": F.col("a.row"), "_y": F.col("b.row")}).join(done.select(F.col("a").alias("_x"), F.col("b").alias("_y"), "applied"), ["_x", "_y"], "left").drop("_x", "_y")
    return out, marked


def most_common(values: Column) -> Column:
    """The most frequent value that isn't blank, the least of equals; empty for none."""
    tidy = F.filter(F.transform(values, strip), lambda x: x != "")
    counted = F.transform(F.array_distinct(tidy), lambda v: F.struct((-F.size(F.filter(tidy, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.coalesce(F.array_min(counted).v, F.lit(""))


def most_common_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, most_common``: ``most_common`` of a column, summed before it is dealt instead of listed."""
    counted = rows.select(key, strip(F.col(value)).alias("_v")).where("_v <> ''").groupBy(key, "_v").agg(F.count("*").alias("_c"))
    found = counted.groupBy(key).agg(F.min_by("_v", F.struct((-F.col("_c")).alias("n"), "_v")).alias("most_common"))
    return rows.select(key).distinct().join(found, key, "left").select(key, F.coalesce("most_common", F.lit("")).alias("most_common"))


def _first(members: Column, field: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.transform(members, lambda m: m[field]), lambda x: x != ""), F.lit(1)), F.lit(""))


def _providers(m: Column) -> Column:
    """Provider entries of a row: its number and codes belong to the first name."""
    listed = F.filter(m.provider_names, lambda n: strip(n) != "")
    listed = F.when(F.size(listed) > 0, listed).otherwise(F.array(m.practice_name))
    npi = first_filled(m.npi_number, m.npi_optional)

    def one(raw: Column, i: Column) -> Column:
        parts = names.name_and_credentials(raw)
        return F.struct(
            strip(parts["name"]).alias("name"), parts["credentials"].alias("credentials"), F.when(i == 0, npi).otherwise("").alias("npi"),
            F.when(i == 0, m.provider_taxonomy_codes).otherwise(F.array().cast("array<string>")).alias("taxonomy_codes"),
            m.specialty.alias("specialty"), m.id.alias("source_record_id"),
        )

    return F.filter(F.transform(listed, one), lambda p: p["name"] != "")


def merged(rows: DataFrame, applied: DataFrame) -> DataFrame:
    """One location for each cluster: the base row, gaps filled from its siblings, the address taken as one fact."""
    fields = F.struct("signature", "row", "ident", "provider_names", "provider_taxonomy_codes", *FIELDS)
    per = rows.groupBy("cluster").agg(F.array_sort(F.collect_list(fields)).alias("m"))
    edges = applied.where("applied").select(F.col("a.row").alias("row"), "score", "matched").join(rows.select("row", "cluster"), "row")
    best = edges.groupBy("cluster").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched_fields"))
    complete = lambda m: sum(((m[f] != "").cast("int") for f in ("website_url", "phone", "address_street", "address_zip", "address_city", "specialty")), F.lit(0))
    rank = F.transform("m", lambda m, i: F.struct(F.when(m.npi_entity_type == "organization", 0).otherwise(1).alias("o"), (-complete(m)).alias("c"), m.signature.alias("s"), i.alias("i")))
    out = per.join(best, "cluster", "left").withColumn("base", F.element_at("m", F.array_min(rank).i + 1)).withColumn("n", F.size("m"))
    b = F.col("base")
    near = F.filter("m", lambda m: (m.row != b.row) & (m.ident.street == b.ident.street) & ~zips_disagree(m.ident.zip5, b.ident.zip5))
    placed = F.filter("m", lambda m: m.ident.street != "")
    keyed = F.filter(placed, lambda m: m.ident.zip5 != "")
    donor = F.coalesce(F.try_element_at(keyed, F.lit(1)), F.try_element_at(placed, F.lit(1)))
    single = F.col("n") == 1
    address = {
        f: F.when(single | (b[f] != "") & (b.ident.street != ""), b[f]).when(b.ident.street != "", _first(near, f)).when(donor.isNotNull(), donor[f]).otherwise(b[f])
        for f in ADDRESS
    }
    out = out.withColumns({f: F.when(single | (b[f] != ""), b[f]).otherwise(_first(F.col("m"), f)) for f in FILLED} | address)
    people = F.flatten(F.transform("m", _providers))
    out = out.withColumn("_p", F.transform(people, lambda p: p.withField("k", F.concat_ws("\n", F.lower(p["name"]), p.npi))))
    keys = F.transform("_p", lambda p: p.k)
    unique = F.filter("_p", lambda p, i: F.array_position(keys, p.k) == i + 1)
    ordered = F.array_sort(F.transform(unique, lambda p: F.struct(F.lower(p["name"]).alias("l"), p.npi.alias("k"), p.dropFields("k").alias("p"))))
    out = out.withColumn("providers", F.transform(ordered, lambda x: x.p)).withColumn("provider_count", F.size("providers"))
    out = out.withColumn("_address", addresses.split_street(F.col("address_street"))).withColumn("_unit", addresses.unit(F.col("address_unit")))
    out = out.withColumn("address_unit_normalized", first_filled(F.col("_unit"), F.col("_address.unit"))).withColumn("address_street_normalized", F.col("_address.street"))
    out = out.withColumn("address_unit", F.when(strip(F.col("address_unit")) == "", F.col("address_unit_normalized")).otherwise(F.col("address_unit")))
    domain = urls.registrable(F.col("website_url"))
    observed = F.transform("m", lambda m: m.practice_name)
    registry = most_common(F.transform(F.filter("m", lambda m: m.npi_entity_type == "organization"), lambda m: m.npi_practice_name))
    organized = most_common(F.filter(observed, lambda x: (x != "") & names.is_organization(x)))
    person, read = most_common(observed), names.from_domain(domain)
    out = out.withColumns({"_registry": registry, "_organized": organized, "_person": F.when(F.col("provider_count") <= 1, person).otherwise(""), "_read": read})
    where = F.when(strip(F.col("address_street")) != "", strip(F.col("address_street"))).otherwise("an unlisted address")
    chain = (("_registry", "npi_organization"), ("_organized", "source_row_organization"), ("_person", "source_row"), ("_read", "domain_derived"))
    name, source = F.when(single, b.practice_name), F.when(single, "source_row")
    for column, label in chain:
        name, source = name.when(F.col(column) != "", F.col(column)), source.when(F.col(column) != "", label)
    name = name.otherwise(F.concat(F.col("provider_count").cast("string"), F.lit(" providers at "), where))
    distinct = lambda x: F.array_sort(F.array_distinct(F.filter(x, lambda v: v != "")))
    return out.select(
        "cluster", b.ident.alias("ident"), name.alias("practice_name"), source.otherwise("placeholder").alias("practice_name_source"), *FILLED, *ADDRESS,
        *[b[f].alias(f) for f in ("npi_number", "npi_entity_type", "npi_practice_name")], "address_street_normalized", "address_unit_normalized", "providers", "provider_count",
        distinct(F.transform("m", lambda m: strip(m.specialty))).alias("specialties"), distinct(F.flatten(F.transform("m", lambda m: m.provider_taxonomy_codes))).alias("provider_taxonomy_codes"),
        F.array_sort(F.transform("m", lambda m: m.id)).alias("source_row_ids"), F.array_join(F.array_sort(F.transform("m", lambda m: m.signature)), "|").alias("cluster_signature"),
        _first(F.transform("m", lambda m: m.ident), "phone").alias("any_phone"),
        F.struct(F.when(single, "single").otherwise("merged").alias("rule_fired"), F.coalesce("matched_fields", F.array().cast("array<string>")).alias("matched_fields"), F.coalesce("score", F.lit(0)).alias("score"), F.col("n").alias("merged_count"), F.lit("").alias("reviewed_by")).alias("consolidation"),
    )


def with_ids(locations: DataFrame, shared: list[str]) -> DataFrame:
    """Locations with ``practice_id``: a hash of the strongest normalized key; of equal keys all but the first add their signature."""
    i = F.col("ident")
    own = (i.domain != "") & ~any_of(i.domain, shared)
    kind = F.when((i.zip5 != "") & (i.street != ""), "addr").when(own, "domain").when(i.phone != "", "phone").when((i["name"] != "") & (i.zip5 != ""), "namezip").otherwise("name")
    key = F.when(kind == "addr", F.concat_ws("|", i.zip5, i.street, i.unit)).when(kind == "domain", i.domain).when(kind == "phone", i.phone).when(kind == "namezip", F.concat_ws("|", i["name"], i.zip5)).otherwise(i["name"])
    out = locations.withColumn("_kind", kind).withColumn("_key", key)
    # The first of equal keys comes from a summed minimum: a key that many share is never sorted in one task.
    first = out.groupBy("_kind", "_key").agg(F.min(F.struct("cluster_signature", "cluster")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = out.join(first, ["_kind", "_key"], "left")
    later = F.struct("cluster_signature", "cluster") > F.col("_first")
    base = short_hash(F.col("_kind"), F.col("_key"))
    return out.withColumn("practice_id", F.concat(F.lit("P-"), F.when(F.coalesce(later, F.lit(False)), short_hash(F.col("_kind"), F.col("_key"), F.col("cluster_signature"))).otherwise(base))).drop("_kind", "_key", "_first")


def admission(score: Column, matched: Column, phone_a: Column, phone_b: Column) -> Column:
    """Why a pair that was not merged goes to an analyst; empty if it does not."""
    other = F.size(F.filter(matched, lambda f: f != "address")) > 0
    return F.when(score >= K.MERGE_AT, "unit_gate_block").when(score < K.REVIEW_AT, "").when(other, "corroborated").when((phone_a == "") | (phone_b == ""), "phone_absent").otherwise("")


def reviews(locations: DataFrame, rows: DataFrame, marked: DataFrame, noise: list[str]) -> DataFrame:
    """``left_id, right_id, score, matched, review_reason, evidence``: different locations that an analyst should compare."""
    open_ = marked.where((F.col("score") < K.MERGE_AT) | ~F.coalesce(F.col("applied"), F.lit(False)))
    of = rows.select("row", "cluster").join(locations.select("cluster", "practice_id", "practice_name", "any_phone", F.col("address_unit_normalized").alias("unit"), F.size("source_row_ids").alias("rows"), "provider_count"), "cluster")
    side = F.struct("practice_id", "practice_name", "any_phone", "unit", "rows", "provider_count", "cluster")
    both = open_.withColumns({"_a": F.col("a.row"), "_b": F.col("b.row")}).join(of.select(F.col("row").alias("_a"), side.alias("l")), "_a").join(of.select(F.col("row").alias("_b"), side.alias("r")), "_b")
    both = both.where("l.cluster <> r.cluster").withColumn("review_reason", admission(F.col("score"), F.col("matched"), F.col("l.any_phone"), F.col("r.any_phone"))).where("review_reason <> ''")
    l, r = F.col("l"), F.col("r")
    own = lambda d: F.when(any_of(d, noise), "").otherwise(d)
    da, db = own(F.col("a.ident.domain")), own(F.col("b.ident.domain"))
    org_l, org_r = names.is_organization(l.practice_name), names.is_organization(r.practice_name)
    evidence = F.struct(
        ((l.unit != "") & (l.unit == r.unit)).alias("same_unit"), l.unit.alias("unit_left"), r.unit.alias("unit_right"),
        ((da != "") & (db != "") & (da != db)).alias("domains_conflict"), da.alias("domain_left"), db.alias("domain_right"),
        ((l.any_phone != "") & (r.any_phone != "") & (l.any_phone != r.any_phone)).alias("phones_differ"), ((l.any_phone == "") | (r.any_phone == "")).alias("phone_absent"),
        (org_l & org_r).alias("both_organizational"), (~org_l & ~org_r).alias("both_personal"), l.rows.alias("rows_left"), r.rows.alias("rows_right"),
        l.provider_count.alias("providers_left"), r.provider_count.alias("providers_right"),
    )
    return both.select(l.practice_id.alias("left_id"), r.practice_id.alias("right_id"), "score", "matched", "review_reason", evidence.alias("evidence"))


def grouped(locations: DataFrame, shared: list[str], url: str = "website_url", domain: Column | None = None) -> DataFrame:
    """Locations with group_id, group_name, location_index and location_count: those that share a domain of their own.

    The domain is the registrable one of ``url``, unless another is given.
    """
    out = locations.withColumn("_domain", urls.registrable(F.col(url)) if domain is None else domain).withColumn("_own", (F.col("_domain") != "") & ~any_of(F.col("_domain"), shared))
    # Locations without a domain of their own have keys of their own.
    out = out.withColumn("_of", F.when(F.col("_own"), F.concat(F.lit("d:"), "_domain")).otherwise(F.concat(F.lit("p:"), F.coalesce("practice_id", F.lit("")))))
    out = numbered(out, "_of", ["address_zip", "address_street", "address_unit", "practice_id"], "_index")
    named = out.where("_own and trim(practice_name) <> ''").groupBy("_domain", F.trim("practice_name").alias("nm")).count()
    name = named.groupBy("_domain").agg(F.min_by("nm", F.struct(-F.col("count"), "nm")).alias("_name"))
    size = out.where("_own").groupBy("_domain").agg(F.count("*").alias("_n")).where("_n > 1")
    out = out.join(size, "_domain", "left").join(name, "_domain", "left")
    many = F.col("_n").isNotNull() & F.col("_own")
    return out.withColumns(
        {
            "group_id": F.when(many, F.concat(F.lit("G-"), short_hash(F.lit("domain"), F.col("_domain")))).otherwise(""),
            "group_name": F.when(many, F.coalesce(F.nullif("_name", F.lit("")), "_domain")).otherwise(""),
            "location_index": F.when(many, F.col("_index")).otherwise(1),
            "location_count": F.when(many, F.col("_n")).otherwise(1).cast("int"),
        }
    ).drop("_domain", "_own", "_n", "_name", "_of", "_index")


def consolidate(records: DataFrame, noise: list[str] | None = None, umbrella: list[str] | None = None, contact_blocking: bool = True, most_contacts: int = K.MOST_CONTACTS, large: int = LARGE_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(locations, review pairs, one summary row) of canonical records."""
    noise, umbrella = domain_policy(noise, (), umbrella)
    shared = sorted({*noise, *umbrella})
    rows = written(identified(conformed(records)).withColumn("row", F.monotonically_increasing_id()), "identified")
    pairs = written(scored(candidates(rows, shared, contact_blocking, most_contacts, noise, large), noise), "pairs")
    members, marked = clustered(rows, pairs)
    members = written(members, "members")
    locations = written(with_ids(merged(members, marked), shared), "locations")
    asked = written(reviews(locations, members, marked, noise), "reviews")
    final = grouped(locations, shared).withColumn("id", F.col("practice_id"))
    i = F.col("ident")
    blocked = rows.agg(F.count("*").alias("input_count"), F.count_if((i.zip5 == "") | (i.street == "")).alias("unblocked_count"), F.sum(F.greatest(F.size(F.filter("provider_names", lambda n: strip(n) != "")), F.lit(1))).alias("raw_provider_entries"))
    out = final.agg(F.count("*").alias("output_count"), F.count_if(F.col("consolidation.merged_count") > 1).alias("merged_groups"), F.sum("provider_count").alias("distinct_providers"), F.countDistinct(F.nullif("group_id", F.lit(""))).alias("multi_location_groups"))
    questions = asked.select(F.least("left_id", "right_id").alias("x"), F.greatest("left_id", "right_id").alias("y"), "review_reason").dropDuplicates(["x", "y"]).agg(F.count("*").alias("review_pairs"), *[F.count_if(F.col("review_reason") == x).alias(f"review_{x}") for x in ("corroborated", "phone_absent", "unit_gate_block")])
    apart = (F.col("a.ident.zip5") != F.col("b.ident.zip5")) | (F.col("a.ident.street") != F.col("b.ident.street")) | (F.col("a.ident.zip5") == "")
    crossed = marked.where("applied").agg(F.count_if(apart).alias("cross_address_merges"))
    keyed = rows.where((i.phone != "") & (i.domain != "") & ~any_of(i.domain, shared)).groupBy(i.phone, i.domain).agg(F.count("*").alias("n"))
    over = keyed.agg(F.count_if((F.col("n") > most_contacts) & F.lit(contact_blocking)).alias("contact_blocks_skipped"))
    one = blocked
    for part in (out, questions, crossed, over):  # one row each
        one = one.join(F.broadcast(part))
    return final, asked, one.withColumn("rows_merged_away", F.col("input_count") - F.col("output_count"))


def contact_comparison(records: DataFrame, **options) -> DataFrame:
    """One row: locations, cross-address merges and review pairs without and with contact blocks, and what these take away."""
    off, on = (consolidate(records, contact_blocking=x, **options)[2] for x in (False, True))
    figures = ("output_count", "cross_address_merges", "review_pairs")
    both = off.select("input_count", *[F.col(x).alias(f"{x}_off") for x in figures]).join(F.broadcast(on.select(*[F.col(x).alias(f"{x}_on") for x in figures], "contact_blocks_skipped")))
    gone = F.col("output_count_off") - F.col("output_count_on")
    return both.withColumns({"additional_collapse": gone, "collapse_percent": F.coalesce(F.round(F.try_divide(gone * 100, "output_count_off"), 1), F.lit(0.0))})


def review_pairs(asked: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Pairs for an analyst, each once, with ``mechanical`` (a unit veto and no judgement), ``decision``, and their ``place``.

    Order: score from the highest, then the lesser id. ``decisions`` has id and decision; a ruling on either side counts, the
    left one first. The number comes from ranges of the order, so no task sorts all pairs.
    """
    c = F.col
    once = asked.withColumns({"_x": F.least("left_id", "right_id"), "_y": F.greatest("left_id", "right_id")})
    fields = [x for x in asked.columns if x not in ("left_id", "right_id")]
    once = once.groupBy("_x", "_y").agg(F.max_by(F.struct("left_id", "right_id", *fields), F.struct("score", "left_id")).alias("r")).select("r.*")
    if decisions is not None:
        ruled = decisions.select(c("id").alias("_i"), "decision")
        for side in ("left_id", "right_id"):
            once = once.join(ruled.select(c("_i").alias(side), c("decision").alias(f"_{side}")), side, "left")
        once = once.withColumn("decision", F.coalesce("_left_id", "_right_id")).drop("_left_id", "_right_id")
    return placed(once.withColumn("mechanical", c("review_reason") == "unit_gate_block"), [F.desc("score"), F.asc("left_id"), F.asc("right_id")])


def block_sizes(rows: DataFrame) -> DataFrame:
    """``path, size, blocks``: how many blocks of each size the two paths make."""
    i = F.col("ident")
    at = rows.where((i.zip5 != "") & (i.street != "")).groupBy(i.zip5, i.street).count().select(F.lit("address").alias("path"), F.col("count").alias("size"))
    by = rows.where((i.phone != "") & (i.domain != "")).groupBy(i.phone, i.domain).count().select(F.lit("contact").alias("path"), F.col("count").alias("size"))
    return at.union(by).groupBy("path", "size").agg(F.count("*").alias("blocks"))


def explained(rows: DataFrame, noise: list[str], shared: list[str], most: int = 5000) -> DataFrame:
    """For all pairs of a small set of rows (one domain's, say): veto, no shared block, or score, path and verdict.

    All pairs are the answer here, so more than ``most`` rows are an error; ``candidates`` is for tables.
    """
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"pairs are explained for up to {most} rows")
    side = lambda name: rows.select(F.struct("signature", "row", "ident").alias(name))
    pairs = scored(side("a").join(side("b"), F.col("a.row") < F.col("b.row")), noise)
    a, b = F.col("a.ident"), F.col("b.ident")
    address = (a.zip5 != "") & (a.street != "") & (a.zip5 == b.zip5) & (a.street == b.street)
    contact = (a.phone != "") & (a.phone == b.phone) & (a.domain != "") & (a.domain == b.domain) & ~any_of(a.domain, shared)
    path = F.when(address, "address").when(contact, "contact").otherwise("none")
    verdict = F.when(units_conflict(a, b), "unit_veto").when(path == "none", "no_shared_block").when(F.col("score") >= K.MERGE_AT, "merge").when(F.col("score") >= K.REVIEW_AT, "review").otherwise("apart")
    return pairs.select(F.col("a.row").alias("left"), F.col("b.row").alias("right"), "score", "matched", path.alias("path"), verdict.alias("verdict"))
