"""The link graph of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.plans.shared import stored


def edges(pages: DataFrame) -> DataFrame:
    """(site_id, source, at, base, href): a row for each link of a page. at: the origin of the page; base: what the link is seen from, which
    is the root of the origin where the link says the same from every page there."""
    p = pages.where("url is not null").select("site_id", F.col("url").alias("source"), urls.origin(F.col("url")).alias("at"), "internal_links")
    raw = p.select("site_id", "source", "at", F.explode("internal_links").alias("href"))
    base = F.when(F.col("href").rlike(urls.FIXED) & F.col("at").isNotNull(), F.concat("at", F.lit("/"))).otherwise(F.col("source"))
    return raw.withColumn("base", base)


def inbound_counts(pages: DataFrame, odd: bool = True) -> DataFrame:
    """(site_id, url, inbound_links) of pages that another page of the crawl links to; repeated links count again.

    Links are counted before they are parsed, so what all pages of a site link to is parsed once for the site. A page's links to itself
    are taken off the sums of known targets; they are found by a join on source and link, so no hot target is dealt out."""
    links = edges(pages)
    counted = links.groupBy("site_id", "at", "base", "href").agg(F.count(F.lit(1)).alias("n")).withColumn("ref", urls.absolute(F.col("href"), F.col("at")))
    # written once: conditions on the target would be copied with what parses it
    parsed = stored(counted.select("site_id", "base", "href", urls.normalized(F.col("href"), F.col("base"), odd, F.col("ref")).alias("target"), "n"), "targets")
    known = pages.select("site_id", F.col("url").alias("target")).distinct()
    hits = parsed.join(known, ["site_id", "target"], "left_semi")
    own = links.withColumnRenamed("source", "target").join(hits, ["site_id", "base", "href", "target"]).groupBy("site_id", "target").agg(F.count(F.lit(1)).alias("own"))
    sums = hits.groupBy("site_id", "target").agg(F.sum("n").alias("n")).join(own, ["site_id", "target"], "left")
    return sums.select("site_id", F.col("target").alias("url"), (F.col("n") - F.coalesce("own", F.lit(0))).alias("inbound_links")).where("inbound_links > 0")
