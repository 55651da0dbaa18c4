"""Phone columns: three ways to normalize that differ on purpose, and the display form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions.text import blank, strip

_EXTENSION = r"(?i)(?:\b(?:ext|extension|xt)\b\.?|\bx|#)\s*\.?\s*\d+\s*$"
_DIALABLE = r"^[2-9](?!11)\d{2}[2-9](?!11)\d{2}\d{4}$"


def digits(x: Column) -> Column:
    """The digits of a text."""
    return F.regexp_replace(blank(x), r"\D", "")


def without_extension(x: Column) -> Column:
    """A phone without a trailing extension."""
    return F.regexp_replace(F.regexp_replace(strip(x), _EXTENSION, ""), r"^[ \-.,;:]+|[ \-.,;:]+$", "")


def _national(d: Column) -> Column:
    return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)


def strict(x: Column) -> Column:
    """Ten digits that can be dialled; else empty."""
    d = F.right(_national(digits(without_extension(x))), F.lit(10))
    return F.when(d.rlike(_DIALABLE), d).otherwise("")


def loose(x: Column) -> Column:
    """The last ten digits, or all where there are fewer."""
    return F.right(digits(x), F.lit(10))


def exact(x: Column) -> Column:
    """Ten digits, but for a leading 1; else empty."""
    d = _national(digits(x))
    return F.when(F.length(d) == 10, d).otherwise("")


def displayed(x: Column) -> Column:
    """``(NXX) NXX-XXXX``; another number as it is; a dash for none."""
    d = digits(x)
    ten = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    form = F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))
    return F.when(F.length(d) == 10, form).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+1 "), form)).when(strip(x) == "", "—").otherwise(strip(x))
