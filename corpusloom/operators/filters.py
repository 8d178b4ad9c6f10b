"""Which fetched pages carry too little: copies, thin pages, pages of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import js
from corpusloom.plans.shared import stored

# Fixed values.
THIN_WORDS, NAVIGATION_WORDS = 50, 150
NAVIGATION_TITLE = js.any_word("sitemap|site ?map|table of contents|all (?:articles|pages|posts)|archive index")


def duplicate_urls(pages: DataFrame) -> DataFrame:
    """(site_id, url): of pages with one content hash all but the most important, at equal scores with the shortest URL, then the first.

    The best of each hash is found by an aggregate with map-side combine, not by ordering the copies, so a text that a site has a
    million times is no hot window. What the aggregate and the join back need is written once, so texts are read and hashed once."""
    order = F.struct((-F.col("importance_score")).alias("s"), F.length("url").alias("l"), F.col("ord").alias("o"))
    hashed = stored(pages.where("content_hash <> ''").select("site_id", "content_hash", "url", order.alias("place")), "hashed")
    best = hashed.groupBy("site_id", "content_hash").agg(F.min("place").alias("__best"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return hashed.join(best, ["site_id", "content_hash"]).where("place <> __best").select("site_id", "url").distinct()


def content_reasons(pages: DataFrame) -> DataFrame:
    """pages with reason: duplicate, else (but never for the home page) thin-content, else navigation, else null. Rows of one URL share a duplicate's fate."""
    dup = duplicate_urls(pages).select(F.col("site_id").alias("__site"), F.col("url").alias("__url"), F.lit(True).alias("__dup"))
    joined = pages.join(dup, (F.col("site_id") == F.col("__site")) & (F.col("url") == F.col("__url")), "left")
    page = ~F.coalesce("is_home", F.lit(False))
    reason = (
        F.when(F.col("__dup"), "duplicate")
        .when(page & (F.col("word_count") < THIN_WORDS), "thin-content")
        .when(page & F.col("title").rlike(NAVIGATION_TITLE) & (F.col("word_count") < NAVIGATION_WORDS), "navigation")
    )
    return joined.withColumn("reason", reason).drop("__site", "__url", "__dup")


def with_reasons(working: DataFrame) -> DataFrame:
    """Working pages after the filters; only pages that are still included are looked at."""
    found = content_reasons(working.where("included")).where("reason is not null").groupBy("site_id", "url").agg(F.min("reason").alias("__reason"))
    return exclude(working, found.withColumnRenamed("__reason", "reason"))


def exclude(working: DataFrame, reasons: DataFrame) -> DataFrame:
    """working with all rows of the URLs in reasons (site_id, url, reason) taken out."""
    r = reasons.select(F.col("site_id").alias("__site"), F.col("url").alias("__url"), F.col("reason").alias("__reason"))
    out = working.join(r, (F.col("site_id") == F.col("__site")) & (F.col("url") == F.col("__url")), "left")
    return out.withColumns({"included": F.when(F.col("__reason").isNotNull(), False).otherwise(F.col("included")), "exclude_reason": F.coalesce("__reason", "exclude_reason")}).drop("__site", "__url", "__reason")
