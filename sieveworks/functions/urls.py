"""URL and host columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.constants import PUBLIC_SUFFIXES, URL_PLACEHOLDERS
from sieveworks.functions.text import any_of, blank, collapse, strip

_LONGEST_SUFFIX = max(s.count(".") for s in PUBLIC_SUFFIXES) + 1


def decoded(x: Column) -> Column:
    """Percent escapes resolved; a plus stays one, and a broken escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(blank(x), F.lit("+"), F.lit("%2B"))), blank(x))


def quoted(x: Column) -> Column:
    """Percent-escaped for a query, a space as ``%20``."""
    return F.replace(F.url_encode(blank(x)), F.lit("+"), F.lit("%20"))


def canonical(x: Column, placeholders: bool = True) -> Column:
    """A url with a scheme, without query, fragment and trailing slashes; empty for placeholders and urls without a host."""
    url = decoded(strip(x))
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    kept = F.regexp_replace(F.regexp_extract(full, r"(?s)^(https?://[^/?#]+[^?#]*)", 1), "/+$", "")
    nothing = (url == "") | (any_of(F.lower(url), URL_PLACEHOLDERS) if placeholders else F.lit(False))
    return F.when(nothing, "").otherwise(kept)


def netloc(x: Column) -> Column:
    """What stands between the scheme and the path."""
    url = blank(x)
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.when(url == "", "").otherwise(F.lower(F.regexp_extract(full, r"^https?://([^/?#]*)", 1)))


def hostname(x: Column) -> Column:
    """The host without port and ``www.``."""
    return F.regexp_replace(F.regexp_replace(netloc(x), r"(?s):.*$", ""), r"^www\.", "")


def two_labels(x: Column) -> Column:
    """The last two labels of the host."""
    labels = F.split(hostname(x), r"\.")
    return F.array_join(F.when(F.size(labels) > 2, F.slice(labels, -2, 2)).otherwise(labels), ".")


def path(x: Column) -> Column:
    """The path of a url."""
    return F.regexp_extract(blank(x), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def registrable(x: Column) -> Column:
    """The registrable domain: a public suffix and one label; empty for a bare suffix or no host."""
    text = F.lower(strip(x))
    full = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.regexp_extract(full, r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), r"(?s)^.*@", "")
    host = F.regexp_replace(collapse(F.regexp_replace(host, r"(?s):.*$", "")), r"^\.+|\.+$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    labels = F.filter(F.split(host, r"\."), lambda p: p != "")
    tail = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    size = F.size(labels)
    out = F.when((text == "") | (size < 2), "")
    for n in range(_LONGEST_SUFFIX, 1, -1):
        suffix = (size >= n) & any_of(F.when(size >= n, tail(n)), [s for s in PUBLIC_SUFFIXES if s.count(".") == n - 1])
        out = out.when(suffix & (size == n), "").when(suffix, tail(n + 1))
    return out.otherwise(tail(2))


def link_verdict(status: Column, asked: Column, reached: Column) -> Column:
    """DEAD unless the status is 2xx; FLAG if the domain changed or the path fell back to the root; else OK."""
    fell = (F.regexp_replace(path(asked), "/+$", "") != "") & (F.regexp_replace(path(reached), "/+$", "") == "")
    return F.when(~F.coalesce(status.between(200, 299), F.lit(False)), "DEAD").when((two_labels(asked) != two_labels(reached)) | fell, "FLAG").otherwise("OK")
