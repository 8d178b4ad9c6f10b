"""Page texts: titles, content hashes, excerpts, times for people to read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import js, urls

MAIN_CHARS, EXCERPT_CHARS = 6000, 800


def title_from_url(url: Column) -> Column:
    """The last part of the path, in words that begin with capitals; the host where there is none."""
    last = F.try_element_at(F.filter(F.split(urls.path(url), "/"), lambda x: x != ""), F.lit(-1))
    plain = F.regexp_replace(F.regexp_replace(last, "[-_]+", " "), r"\.[A-Za-z0-9_]+\z", "")
    marked = F.regexp_replace(plain, "(?<![A-Za-z0-9_])([A-Za-z0-9_])", "\u0001$1")
    parts = F.split(marked, "\u0001")
    risen = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20)))), "")
    return F.when(urls.host(url) == "", url).otherwise(F.coalesce(F.when(last.isNotNull(), risen), urls.host(url)))


def hashable(c: Column | str) -> Column:
    return js.clean(F.lower(js.text(c)))


def content_hash(title: Column, description: Column, main: Column) -> Column:
    return F.sha2(F.concat_ws("\n---\n", hashable(title), hashable(description), hashable(main)), 256)


def excerpt(main: Column) -> Column:
    return js.cut(main, EXCERPT_CHARS)


def empty_shell(word_count: Column, html_chars: Column) -> Column:
    """Much HTML and hardly a word: the page is probably made by scripts."""
    return (word_count < 40) & (html_chars > 1500)


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1e6)


def relative_time(t: Column, now: Column) -> Column:
    sec = js.rounded(_seconds(now, t))
    minutes = js.rounded(sec / F.lit(60.0))
    hours = js.rounded(minutes / F.lit(60.0))
    days = js.rounded(hours / F.lit(24.0))
    return (
        F.when(t.isNull(), "never")
        .when(sec < 5, "just now")
        .when(sec < 60, F.concat(sec.cast("string"), F.lit("s ago")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(t, "MMM d, yyyy"))
    )


def future_time(t: Column, now: Column) -> Column:
    left = _seconds(t, now)
    hours = js.rounded(left / F.lit(3600.0))
    return F.when(t.isNull(), "—").when(left <= 0, "due now").when(hours < 24, F.concat(F.lit("in "), hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.lit("in "), js.rounded(hours / F.lit(24.0)).cast("string"), F.lit("d")))


def next_run(frequency: Column, since: Column) -> Column:
    """Null for manual; a day or a week of 24-hour days later."""
    return F.when(frequency == "daily", since + F.expr("INTERVAL 24 HOURS")).when(frequency == "weekly", since + F.expr("INTERVAL 168 HOURS"))


#: The stages of a crawl, in their order.
STAGES = ("queued", "discovering", "crawling", "extracting", "analyzing", "organizing", "generating", "done")


def stage_index(stage: Column) -> Column:
    """Place of a stage among those shown, from 0; -1 for others."""
    return F.array_position(F.array(*[F.lit(s) for s in STAGES[1:]]), stage) - 1


#: Reasons for which a page is left out, as people read them.
EXCLUSION_LABELS = {
    "duplicate": "duplicate pages",
    "auth": "login/authentication pages",
    "thin-content": "low-content pages",
    "navigation": "navigation pages",
    "tracking": "tracking URLs",
    "pagination": "repetitive pagination pages",
    "search-results": "search result pages",
    "low-priority-utility": "utility pages (cart, legal, etc.)",
    "excluded-by-robots": "blocked by robots.txt",
    "llm-excluded": "flagged as low-value by analysis",
    "below-curation-threshold": "lower-priority pages trimmed to keep the file concise",
    "removed-by-user": "removed manually in the editor",
}


def exclusion_label(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXCLUSION_LABELS.items() for x in pair])
    return F.coalesce(table[reason], reason)
