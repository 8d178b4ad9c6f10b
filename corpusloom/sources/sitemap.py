"""Sitemaps: entries of urlset files, found from robots.txt and two usual places through indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
COMMON = ("/sitemap.xml", "/sitemap_index.xml")
MOST_SITEMAPS, MOST_URLS = 10, 2000


def parsed(files: DataFrame) -> DataFrame:
    """files (…, body) with is_index and is_urlset, locs (of an index) and entries (loc, lastmod, priority of a urlset).

    Entries are read by pattern, one at a time: a damaged entry loses itself, not the file."""
    body = F.coalesce("body", F.lit(""))
    root = F.regexp_extract(body, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[A-Za-z0-9]+:)?(sitemapindex|urlset)[\s>]", 1)
    inner = lambda x, tag: F.regexp_extract(x, rf"(?s)<(?:[A-Za-z0-9]+:)?{tag}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:[A-Za-z0-9]+:)?{tag}>", 1)
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    blocks = lambda tag: F.regexp_extract_all(body, F.lit(rf"(?s)<(?:[A-Za-z0-9]+:)?{tag}(?:\s[^>]*)?>.*?</(?:[A-Za-z0-9]+:)?{tag}>"), F.lit(0))
    entry = lambda x: F.struct(plain(inner(x, "loc")).alias("loc"), F.nullif(inner(x, "lastmod"), F.lit("")).alias("lastmod"), F.nullif(inner(x, "priority"), F.lit("")).try_cast("double").alias("priority"))
    entries = F.filter(F.transform(blocks("url"), entry), lambda e: e["loc"] != "")
    return files.withColumns(
        {
            "is_index": root == "sitemapindex",
            "is_urlset": root == "urlset",
            "locs": F.when(root == "sitemapindex", F.filter(F.transform(blocks("sitemap"), lambda x: plain(inner(x, "loc"))), lambda x: x != "")).otherwise(F.array().cast("array<string>")),
            "entries": F.when(root == "urlset", F.transform(entries, lambda e: F.struct(e["loc"].alias("loc"), e["lastmod"].alias("lastmod"), e["priority"].alias("priority")))).otherwise(F.expr("cast(array() as array<struct<loc: string, lastmod: string, priority: double>>)")),
        }
    )


def discovered(sites: DataFrame, robots: DataFrame, files: DataFrame) -> DataFrame:
    """(site_id, seq, loc, lastmod, priority): of every site, its sitemaps' entries in the order in which a first-in-first-out walk meets them.

    sites (site_id, origin), robots (site_id, sitemaps), files (site_id, sitemap_url, ok, body). At most MOST_SITEMAPS files that are
    there are followed, MOST_URLS entries kept. The walk goes by levels, at most MOST_SITEMAPS, for each level needs a file of its own."""
    usual = F.array(*[F.concat(F.col("origin"), F.lit(p)) for p in COMMON])
    start = sites.join(robots.select("site_id", "sitemaps"), "site_id", "left").select("site_id", F.posexplode(F.array_distinct(F.concat(F.coalesce("sitemaps", F.expr("cast(array() as array<string>)")), usual))).alias("i", "sitemap_url"))
    level = start.select("site_id", "sitemap_url", F.array("i").alias("place"))
    there = parsed(files.where("ok and body <> ''"))
    seen = None
    for _ in range(MOST_SITEMAPS):
        found = level.join(there, ["site_id", "sitemap_url"]).select("site_id", "sitemap_url", "place", "locs", "entries")
        seen = found if seen is None else seen.unionByName(found)
        level = found.select("site_id", "place", F.posexplode("locs").alias("j", "sitemap_url")).select("site_id", "sitemap_url", F.concat("place", F.array("j")).alias("place"))
        level = level.groupBy("site_id", "sitemap_url").agg(F.min(F.struct(F.size("place").alias("n"), "place"))["place"].alias("place"))
        level = level.join(seen.select("site_id", "sitemap_url").distinct(), ["site_id", "sitemap_url"], "left_anti")
        if level.isEmpty():
            break
    by_walk = Window.partitionBy("site_id").orderBy(F.size("place"), "place")
    followed = seen.withColumn("rank", F.row_number().over(by_walk)).where(F.col("rank") <= MOST_SITEMAPS)
    rows = followed.select("site_id", "rank", F.posexplode("entries").alias("k", "e"))
    numbered = rows.withColumn("seq", F.row_number().over(Window.partitionBy("site_id").orderBy("rank", "k"))).where(F.col("seq") <= MOST_URLS)
    return numbered.select("site_id", "seq", "e.loc", "e.lastmod", "e.priority")
