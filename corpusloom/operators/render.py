"""The index file of a site: lines in their order, joined by an ordered string aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import js, urls
from corpusloom.operators.sections import section_order


# Fixed value: what is said of a site that says nothing of itself.
DEFAULT_SUMMARY = "A curated map of the most useful pages on %s for AI agents."


def site_metadata(sites: DataFrame, home: DataFrame | None = None) -> DataFrame:
    """(site_id, site_name, summary): what is stored of a site wins, then the home page's site name, title and description, then the host.

    sites (site_id, origin, site_name, site_description), home (site_id, site_name, title, description)."""
    s = sites.select("site_id", "origin", F.col("site_name").alias("__name"), F.col("site_description").alias("__said"))
    if home is None:
        s = s.withColumns({k: F.lit(None).cast("string") for k in ("__h", "__t", "__d")})
    else:
        s = s.join(home.select("site_id", F.col("site_name").alias("__h"), F.col("title").alias("__t"), F.col("description").alias("__d")), "site_id", "left")
    host = urls.display_host(F.col("origin"))
    default = F.format_string(DEFAULT_SUMMARY, host)
    return s.select("site_id", js.or_else(F.col("__name"), F.col("__h"), F.col("__t"), host).alias("site_name"), js.or_else(F.col("__said"), F.col("__d"), default).alias("summary"))


def rendered(meta: DataFrame, links: DataFrame) -> DataFrame:
    """(site_id, content). meta (site_id, site_name, summary, and details if there are any), links as sections.links() gives them."""
    details = js.trim("details") if "details" in meta.columns else F.lit("")
    said = js.trim("summary")
    head = F.concat(
        F.lit("# "), js.trim("site_name"), F.lit("\n\n"),
        F.when(said != "", F.concat(F.lit("> "), said, F.lit("\n\n"))).otherwise(""),
        F.when(details != "", F.concat(details, F.lit("\n\n"))).otherwise(""),
    )
    said_of = js.trim("description")
    line = F.concat(F.lit("- ["), js.trim("title"), F.lit("]("), F.col("url"), F.lit(")"), F.when(said_of != "", F.concat(F.lit(": "), said_of)).otherwise(""))
    lines = links.select("site_id", "section", "place", line.alias("line"))
    in_order = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["text"]), "\n")
    blocks = lines.groupBy("site_id", "section").agg(in_order(F.struct("place", F.col("line").alias("text"))).alias("links"))
    n = F.row_number().over(Window.partitionBy("site_id").orderBy(*section_order(F.col("section"))))
    block = F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("links"), F.lit("\n"))
    bodies = blocks.withColumn("n", n).groupBy("site_id").agg(in_order(F.struct("n", block.alias("text"))).alias("__body"))
    content = js.trim(F.regexp_replace(F.concat(head, js.text("__body")), "\n{3,}", "\n\n"))
    return meta.join(bodies, "site_id", "left").select("site_id", F.concat(content, F.lit("\n")).alias("content"))


def documents(meta: DataFrame, links: DataFrame) -> DataFrame:
    """(site_id, site_name, summary, sections): the same as a nested document."""
    pages = links.groupBy("site_id", "section", "section_rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "title", "url", "description"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["description"].alias("description"))).alias("pages"))
    sections = pages.groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("section_rank", F.col("section").alias("name"), "pages"))), lambda x: F.struct(x["name"].alias("name"), x["pages"].alias("pages"))).alias("sections"))
    return meta.join(sections, "site_id", "left")
