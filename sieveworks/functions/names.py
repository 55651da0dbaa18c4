"""Name columns: organizations, persons, specialties."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.constants import CREDENTIALS, MATCH_NOISE, NAME_NOISE, ORGANIZATION_WORDS, PHYSICIAN_TITLES, SPECIALTY_WORDS
from sieveworks.functions.text import any_of, blank, collapse, contains_any, strip, titled, words


def _but(tokens: Column, noise: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(list(noise)))


def practice(x: Column) -> Column:
    """A name without legal forms and credentials."""
    text = F.regexp_replace(F.lower(blank(x)), r"(?U)[^\w\s]", " ")
    return F.array_join(_but(F.split(collapse(text), " "), NAME_NOISE), " ")


def loose(x: Column) -> Column:
    """A name in lower case, marks as spaces, single spaces."""
    return collapse(F.regexp_replace(F.lower(blank(x)), r"(?U)[^\w\s]", " "))


def tokens(x: Column, noise: tuple[str, ...] = MATCH_NOISE) -> Column:
    """The different words of a name that say something."""
    return F.array_distinct(_but(words(x), noise))


def overlap(a: Column, b: Column) -> Column:
    """How many words two names share."""
    return F.size(F.array_intersect(a, b))


def agree(a: Column, b: Column) -> Column:
    """Whether two names share enough words: one if either has only one, else two."""
    x, y = tokens(a), tokens(b)
    least = F.when(F.least(F.size(x), F.size(y)) <= 1, 1).otherwise(2)
    return (F.size(x) > 0) & (F.size(y) > 0) & (overlap(x, y) >= least)


def name_address_key(name: Column, address: Column) -> Column:
    """``name|address``; empty only if both are."""
    return F.when((blank(name) == "") & (blank(address) == ""), "").otherwise(F.concat(blank(name), F.lit("|"), blank(address)))


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness of two texts in the given order; 0 if either is empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def may_be_alike(a: Column, b: Column, least: float) -> Column:
    """Whether lengths allow that likeness: a cheap test ahead of it."""
    x, y = F.length(a), F.length(b)
    return (x > 0) & (y > 0) & (2 * F.least(x, y) >= least * (x + y))


def is_organization(x: Column) -> Column:
    """Whether a name has a word that organizations use."""
    parts = F.transform(F.split(collapse(x), " "), lambda t: F.regexp_replace(F.lower(t), r"^[.,]+|[.,]+$", ""))
    return F.arrays_overlap(parts, F.array(*[F.lit(w) for w in ORGANIZATION_WORDS]))


def segments(label: str) -> list[str]:
    """A host label cut at the organization words in it, the earliest first and the longest of these."""
    out, at = [], 0
    while at < len(label):
        hits = [(i, -len(w), w) for w in ORGANIZATION_WORDS if (i := label.find(w, at)) >= 0]
        if not hits:
            return [*out, label[at:]]
        i, _, word = min(hits)
        out += [label[at:i]] * (i > at) + [word]
        at = i + len(word)
    return out


@F.pandas_udf(T.StringType())
def from_domain(domain: pd.Series) -> pd.Series:
    """A name read out of a domain; empty where it would not be legible."""

    def one(x: str | None) -> str:
        label = (x or "").split(".")[0].strip()
        parts = segments(label)
        return " ".join(p.title() for p in parts) if len(parts) >= 2 or len(label) >= 8 else ""

    return domain.map(one)


def specialty(kind: Column, name: Column) -> Column:
    """The first specialty whose words are in the type, else in the name; else the type in title case; else Unknown."""
    out = None
    for text in (kind, name):
        for label, parts in SPECIALTY_WORDS:
            hit = contains_any(F.lower(blank(text)), parts)
            out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.when(strip(kind) != "", titled(kind)).otherwise("Unknown")


def _begins(prefix: str):
    return lambda m: F.left(m, F.lit(len(prefix))) == prefix


def specialty_fits(own: Column, target: str) -> Column:
    """Whether all words of one comma-separated target are among the own words, or share their first seven letters."""
    mine = words(own)
    fits = F.lit(False)
    for part in target.split(","):
        wanted = sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in part.lower()).split()})
        if wanted:
            one = F.lit(True)
            for w in wanted:
                hit = F.array_contains(mine, w)
                if len(w) >= 7:
                    hit = hit | F.exists(mine, _begins(w[:7]))
                one = one & hit
            fits = fits | one
    return (F.size(mine) > 0) & fits


def is_credential(x: Column) -> Column:
    """Whether a text is nothing but credentials."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(blank(x), "[.]", "")), r"[\s,]+"), lambda p: p != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: any_of(p, CREDENTIALS))


def name_and_credentials(x: Column) -> Column:
    """``struct<name, credentials>``: trailing comma-separated credentials taken off a name."""
    parts = F.filter(F.transform(F.split(blank(x), ","), strip), lambda p: p != "")
    letters = F.filter(parts, is_credential)
    return F.struct(F.array_join(F.filter(parts, lambda p: ~is_credential(p)), ", ").alias("name"), F.transform(letters, lambda p: F.upper(F.regexp_replace(p, "[.]", ""))).alias("credentials"))


def provider_list(x: Column) -> Column:
    """Names of a cell: parted by bars if it has any, else by commas, where credentials stay with the name before them."""
    by_bar = F.filter(F.transform(F.split(blank(x), r"\|"), strip), lambda p: p != "")
    parts = F.filter(F.transform(F.split(blank(x), ","), strip), lambda p: p != "")
    joined = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(is_credential(p) & (F.size(acc) > 0), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(", "), p)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(F.contains(blank(x), F.lit("|")), by_bar).otherwise(joined)


def with_prefix(name: Column, title: Column) -> Column:
    """``Dr.`` before a name whose title is a physician's, unless it has it."""
    parts = F.transform(F.split(F.lower(blank(title)), r"(?U)\s+"), lambda t: F.regexp_replace(t, r"^[.,]+|[.,]+$", ""))
    doctor = F.arrays_overlap(parts, F.array(*[F.lit(t) for t in PHYSICIAN_TITLES]))
    n = strip(name)
    return F.when((n != "") & ~F.lower(n).startswith("dr") & doctor, F.concat(F.lit("Dr. "), n)).otherwise(n)


def record_id(npi: Column, name: Column, state: Column, zip_: Column) -> Column:
    """``T-`` and the registry number, or a hash of name, state and ZIP."""
    raw = F.concat_ws("|", F.lower(strip(name)), F.lower(strip(state)), strip(zip_))
    return F.concat(F.lit("T-"), F.when(strip(npi) != "", strip(npi)).otherwise(F.substring(F.sha2(raw, 256), 1, 8)))
