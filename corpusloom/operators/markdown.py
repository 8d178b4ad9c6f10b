"""Markdown alternates of the pages that are listed: looked up after curation, so that only those pay for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import js, urls

# Fixed value: bytes that are looked at.
MOST_BYTES = 2048


def is_markdown(ok: Column, content_type: Column, body: Column, content_length: Column) -> Column:
    """Whether a response is Markdown: not HTML, and said to be Markdown or plain text, or beginning like it. A declared length over the limit fails."""
    kind, start = js.text(content_type), js.trim(js.cut(js.text(body), MOST_BYTES))
    fits = ok & ~F.coalesce(content_length > MOST_BYTES, F.lit(False)) & ~kind.contains("text/html")
    return fits & (kind.contains("markdown") | kind.contains("text/plain") | start.startswith("#") | start.startswith("---"))


def candidates(pages: DataFrame) -> DataFrame:
    """(site_id, url, place, candidate): the declared alternate, then the usual places."""
    declared = F.nullif(F.col("declared_markdown_alternate"), F.lit(""))
    usual = F.concat(F.array_compact(F.array(declared)), urls.markdown_candidates(F.col("url")))
    return pages.select("site_id", "url", F.posexplode(usual).alias("place", "candidate"))


def verified(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """(site_id, url, markdown_url): the first candidate of each page that is Markdown. responses (url, ok, content_type, body, content_length)."""
    good = responses.where(is_markdown(F.col("ok"), F.col("content_type"), F.col("body"), F.col("content_length"))).select(F.col("url").alias("candidate")).distinct()
    return candidates(pages).join(good, "candidate").groupBy("site_id", "url").agg(F.min_by("candidate", "place").alias("markdown_url"))


def with_alternates(links: DataFrame, working: DataFrame, responses: DataFrame) -> DataFrame:
    """links (of sections.links) with url replaced where a fresh page's alternate is found; pages with known content, edited ones and those resolved before are not looked up."""
    fresh = working.where("not reused and not manual_edit and markdown_url is null").select("site_id", "url", "declared_markdown_alternate")
    wanted = fresh.join(links.select("site_id", F.col("page_url").alias("url")).distinct(), ["site_id", "url"], "left_semi")
    found = verified(wanted, responses).select("site_id", F.col("url").alias("page_url"), F.col("markdown_url").alias("__md"))
    return links.join(found, ["site_id", "page_url"], "left").withColumn("url", F.coalesce("__md", "url")).drop("__md")
