"""Text columns. White space is Unicode's, as in ``(?U)\\s``; a missing value is the empty string."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.constants import QUOTE_CHARS


#: White space as Python's strip() sees it.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def blank(x: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(x.cast("string"), F.lit(""))


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(blank(x), F.lit(WHITE))


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(blank(x), r"(?U)\s+", " "))


def first_filled(*xs: Column) -> Column:
    """The first value that is neither null nor empty; else the empty string."""
    return F.coalesce(*[F.nullif(blank(x), F.lit("")) for x in xs], F.lit(""))


def words(x: Column) -> Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(blank(x)), F.lit("([a-z0-9]+)"), F.lit(1))


def lookup(x: Column, table: Mapping[str, str]) -> Column:
    """The entry of a small fixed table; null without one."""
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x]


def any_of(x: Column, values: Iterable[str]) -> Column:
    """Whether a value is in a fixed list; false for none."""
    values = list(values)
    return F.coalesce(x.isin(values), F.lit(False)) if values else F.lit(False)


def contains_any(x: Column, parts: Iterable[str]) -> Column:
    """Whether a text holds one of several strings."""
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(x, F.lit(part))
    return out


def short_hash(*parts: Column, size: int = 12) -> Column:
    """The first hex digits of SHA-256 over the parts with bars between them."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)


def anchor(x: Column) -> Column:
    """Lower case with single spaces, as quotes are compared."""
    return collapse(F.lower(blank(x)))


def anchored(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text; false if either is empty."""
    q, t = anchor(quote), anchor(text)
    return (blank(quote) != "") & (blank(text) != "") & F.contains(t, q)


def truncated(x: Column, size: int = QUOTE_CHARS) -> Column:
    """A quote of at most ``size`` characters, cut at a word with an ellipsis."""
    text = collapse(x)
    cut = F.substring(text, 1, size)
    spaced = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r"(?s) [^ ]*$", "")).otherwise(cut)
    kept = F.when(spaced == "", cut).otherwise(spaced)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(kept, "[,;:.]+$", ""), F.lit("…")))


def csv_safe(x: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def safe_id(x: Column) -> Column:
    """An id for use in a path."""
    return F.substring(F.regexp_replace(blank(x), "[^A-Za-z0-9_-]", "_"), 1, 80)


def slug(x: Column, by: str = "_") -> Column:
    """Lower-case words joined by a mark."""
    return F.regexp_replace(F.regexp_replace(F.lower(blank(x)), "[^a-z0-9]+", by), f"^{by}+|{by}+$", "")


def titled(x: Column) -> Column:
    """Every run of letters with a capital first letter, also after apostrophes and hyphens."""
    runs = F.regexp_extract_all(blank(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def excerpt(text: Column, quote: Column, around: int = 200) -> Column:
    """The text around a quote; empty if it isn't there."""
    at = F.position(F.lower(quote), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    return F.when((at > 0) & (blank(quote) != ""), F.substring(text, start, at - start + F.length(quote) + around)).otherwise("")


def duration(seconds: Column) -> Column:
    """Seconds as ``1h 02m``, ``3m 04s`` or ``5s``."""
    s = seconds.cast("long")
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def progress(done: Column, total: Column, elapsed: Column) -> tuple[Column, Column]:
    """Rows a minute, and minutes left at that rate; null where nothing is done yet."""
    rate = F.when((elapsed > 0) & (done > 0), done / elapsed * 60)
    return rate, F.when(rate > 0, (total - done) / rate)
