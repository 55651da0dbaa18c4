"""Captured pages: index, context under a budget, anchor audit, subpage ranking, crawl outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks import constants as K
from sieveworks.functions import html as H
from sieveworks.functions import urls
from sieveworks.functions.text import any_of, anchored, blank, safe_id, strip


def indexed(pages: DataFrame, key: str = "record_id", order: str = "page_no", text: str = "text") -> DataFrame:
    """Pages that aren't blank with their number, file name, digest and length."""
    kept = pages.where(strip(F.col(text)) != "")
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return kept.withColumn("page_no", n).withColumns({"file": F.format_string("page-%02d.txt", "page_no"), "folder": safe_id(F.col(key)), "sha256": F.sha2(F.col(text), 256), "chars": F.length(text)})


def budgeted(pages: DataFrame, key: str, order: str, size: Column, most: int = K.CONTEXT_CHARS, most_pages: int = K.MOST_PAGES) -> DataFrame:
    """The first pages of a record: each one that starts before the budget is full, up to a number of pages."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumns({"chars_before": before, "place": F.row_number().over(w)}).where((F.col("chars_before") < most) & (F.col("place") <= most_pages))


def context(pages: DataFrame, key: str = "record_id", order: str = "page_no", url: str = "url", text: str = "text", most: int = K.CONTEXT_CHARS) -> DataFrame:
    """``key, context_text``: a record's pages in order with their sources, cut at the budget with a mark.

    Pages that begin beyond the budget go before pages are gathered, so a record's row is bounded.
    """
    part = F.concat(F.lit("[Source: "), F.col(url), F.lit("]\n"), F.col(text))
    parts = pages.select(key, F.col(order).alias("o"), part.alias("p"))
    near = budgeted(parts, key, "o", F.length("p"), most + 1, 1 << 30)
    joined = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "p"))).alias("l"))
    whole = F.array_join(F.transform("l", lambda x: x["p"]), "\n\n---\n\n")
    cut = F.concat(F.substring(whole, 1, most), F.lit("\n\n[... content trimmed for token budget ...]"))
    return joined.select(key, F.when(F.length(whole) > most, cut).otherwise(whole).alias("context_text"))


def audit(signals: DataFrame, pages: DataFrame) -> DataFrame:
    """``record_id, signal_id, status, page_no``: the first page of the record that holds a confirmed signal's quote.

    ``signals`` has record_id, signal_id and evidence_text of confirmed signals; ``pages`` record_id, page_no and text.
    """
    both = signals.join(pages.select("record_id", "page_no", "text"), "record_id", "left")
    found = both.groupBy("record_id", "signal_id", "evidence_text").agg(F.min(F.when(anchored(F.col("evidence_text"), F.col("text")), F.col("page_no"))).alias("page_no"), F.count("page_no").alias("n"))
    status = F.when(F.col("n") == 0, "no_pages").when(blank(F.col("evidence_text")) == "", "no_quote").when(F.col("page_no").isNull(), "missing").otherwise("anchored")
    return found.select("record_id", "signal_id", status.alias("status"), "page_no")


def subpages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", keywords: tuple[str, ...] = (), most: int = K.MOST_PAGES) -> DataFrame:
    """``key, link, top, total, place``: a page's links on its own host, those with the strongest words first."""
    c = F.col
    words = K.LINK_WORDS | {k: K.EXTRA_LINK_WORD for k in keywords if k not in K.LINK_WORDS}
    base = F.regexp_replace(c(url), "/+$", "")
    links = pages.select(key, c(url).alias("_base"), base.alias("_own"), F.posexplode(H.links(c(html))).alias("at", "a"))
    href = c("a.href")
    links = links.where((href != "") & ~href.rlike("^(#|mailto:|tel:|javascript:)"))
    scheme, host = F.regexp_extract("_base", r"^([a-zA-Z]+://)", 1), urls.netloc(c("_base"))
    folder = F.regexp_replace(F.regexp_extract("_base", r"^([^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "/")
    absolute = F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), href)).when(href.startswith("/"), F.concat(scheme, host, href)).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), href))
    links = links.withColumn("link", F.regexp_replace(F.regexp_replace(absolute, "#.*$", ""), "/+$", ""))
    segments = F.split(F.lower(urls.path(c("link"))), "/")
    links = links.where((urls.netloc(c("link")) == host) & (c("link") != c("_own")) & ~F.arrays_overlap(segments, F.array(*[F.lit(s) for s in K.SKIPPED_SEGMENTS])))
    said = F.concat(F.lower(urls.path(c("link"))), F.lit(" "), c("a.text"))
    hits = [F.when(F.contains(said, F.lit(w)), F.lit(n)).otherwise(0) for w, n in words.items()]
    scored = links.select(key, "link", "at", F.greatest(*hits).alias("top"), sum(hits, F.lit(0)).alias("total"))
    once = scored.groupBy(key, "link").agg(F.min("at").alias("at"), F.min_by("top", "at").alias("top"), F.min_by("total", "at").alias("total"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("top"), F.desc("total"), "at"))
    return once.withColumn("place", place).where(c("place") < most).select(key, "link", "top", "total", "place")


def source_confidence(pages: Column, chars: Column) -> Column:
    """complete, limited or partial, by pages and characters."""
    return F.when((pages >= 2) & (chars > K.FULL_CRAWL), "complete").when(chars < K.THIN_CRAWL, "limited").otherwise("partial")


def recovered(before: Column, ok: Column, by_browser: Column, now: Column) -> Column:
    """The confidence after another crawl: only a browser lifts a limited or failed one; a failure never lowers."""
    stuck = any_of(before, ("limited", "failed")) & ~by_browser
    return F.when(~ok | stuck, before).otherwise(now)


def needs_browser(url: Column, text: Column, confidence: Column) -> Column:
    """Whether a record's site should be read again with a browser."""
    return (strip(url) != "") & ((F.length(strip(text)) < K.LEAST_CONTEXT) | any_of(confidence, ("limited", "failed")))


#: Characters that one paste may hold, as it is sent to all tasks.
PASTED_MOST = 16_000_000


def with_manual_content(records: DataFrame, contents: DataFrame, most: int = PASTED_MOST) -> DataFrame:
    """Records with pasted pages as their context; ``contents`` (position, text) is what one operator pasted.

    Every record gets the whole paste, so one of more than ``most`` characters is an error. Null texts are left out.
    """
    size = contents.agg(F.sum(F.length("text") + 7)).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} characters were pasted, more than {most}")
    whole = contents.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("_all"))
    return records.join(F.broadcast(whole)).withColumns({"context_text": F.col("_all"), "source_confidence": F.lit("partial")}).drop("_all")
