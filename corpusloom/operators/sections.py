"""Curation: which of a site's pages its index lists, in which section, in which order.

Of each section only the first pages can be listed, there or among the optional ones, so two bounded rankings come first (Spark
keeps only these rows on each side of the shuffle); what orders a whole site sees at most some 200 rows of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import js, urls
from corpusloom.operators import classify
from corpusloom.operators.classify import OPTIONAL

# Fixed values.
MOST_IN_SECTION, MOST_OPTIONAL, MOST_IN_ALL = 8, 12, 60
BELOW = "below-curation-threshold"


def _override() -> Column:
    return F.nullif(js.trim("section_override"), F.lit(""))


def curated(candidates: DataFrame) -> DataFrame:
    """candidates (site_id, ord, category, importance_score, is_home, section_override, …) with section (null: not listed) and curated_out.

    Home pages are never listed. Pages that a person has put into a section stay there and count towards no limit. Of the rest,
    those of low importance are optional; the first of each known category are listed up to the limits, what is over moves to
    the optional ones. A page of an unknown category that is not optional is neither listed nor curated out."""
    c = candidates.withColumn("__manual", F.when(~F.col("is_home"), _override()))
    auto = c.where(~F.col("is_home") & _override().isNull())
    low = F.col("importance_score") < classify.MEDIUM
    auto = auto.select("site_id", "ord", F.col("importance_score").alias("score"), F.when(low, OPTIONAL).otherwise(F.col("category")).alias("sec"))
    auto = auto.withColumn("sr", F.when(F.col("sec") == OPTIONAL, 0).otherwise(classify.rank(F.col("sec"))))

    by_score = [F.col("score").desc(), F.col("ord")]
    near = auto.withColumn("rn", F.row_number().over(Window.partitionBy("site_id", "sec").orderBy(*by_score))).where((F.col("rn") <= MOST_IN_SECTION + MOST_OPTIONAL) & F.col("sr").isNotNull())
    near = near.withColumn("first", (F.col("sr") > 0) & (F.col("rn") <= MOST_IN_SECTION))
    in_all = F.row_number().over(Window.partitionBy("site_id", "first").orderBy("sr", *by_score))
    spare = F.row_number().over(Window.partitionBy("site_id", "first").orderBy(F.col("score").desc(), "sr", "ord"))
    taken = F.least(F.lit(MOST_IN_ALL), F.count_if("first").over(Window.partitionBy("site_id")))
    near = near.withColumns({"gp": in_all, "op": spare, "room": F.least(F.lit(MOST_OPTIONAL), F.lit(MOST_IN_ALL) - taken)})
    listed = near.where(F.when(F.col("first"), F.col("gp") <= MOST_IN_ALL).otherwise(F.col("op") <= F.col("room")))
    listed = listed.select(F.col("site_id").alias("__site"), F.col("ord").alias("__ord"), F.when(F.col("first"), F.col("sec")).otherwise(OPTIONAL).alias("__sec"))

    out = c.join(listed, (F.col("site_id") == F.col("__site")) & (F.col("ord") == F.col("__ord")), "left")
    known = F.when(low, True).otherwise(classify.rank(F.col("category")).isNotNull())
    gone = ~F.col("is_home") & F.col("__manual").isNull() & _override().isNull() & F.col("__sec").isNull() & F.coalesce(known, F.lit(False))
    return out.withColumns({"section": F.coalesce("__manual", "__sec"), "curated_out": gone, "is_manual": F.col("__manual").isNotNull()}).drop("__manual", "__site", "__ord", "__sec")


def section_rank(name: Column) -> Column:
    """Known sections by their rank, then others, optional pages last."""
    return F.when(name == OPTIONAL, F.lit(1000)).otherwise(F.coalesce(classify.rank(name), F.lit(100)))


def section_order(name: Column) -> list[Column]:
    return [section_rank(name), F.collate(F.when(section_rank(name) == 100, name).otherwise(""), "UNICODE"), name]


def links(listed: DataFrame) -> DataFrame:
    """(site_id, section, section_rank, place, title, url, description): the links of curated pages; place counts within a section.
    The Markdown address is linked where it is known; pages placed by rule come before those placed by hand at equal scores."""
    rows = listed.where("section is not null")
    place = F.row_number().over(Window.partitionBy("site_id", "section").orderBy(F.col("importance_score").desc(), "is_manual", "ord"))
    return rows.select(
        "site_id",
        "section",
        section_rank(F.col("section")).alias("section_rank"),
        place.alias("place"),
        "title",
        F.coalesce("markdown_url", "url").alias("url"),
        F.nullif(F.col("description"), F.lit("")).alias("description"),
        F.col("url").alias("page_url"),
    )


def ordered_names(names: DataFrame, column: str = "section") -> DataFrame:
    """Distinct section names of each site with their place."""
    n = F.row_number().over(Window.partitionBy("site_id").orderBy(*section_order(F.col(column))))
    return names.select("site_id", column).distinct().withColumn("place", n)


def from_stored(pages: DataFrame, origin: Column) -> DataFrame:
    """Stored pages as candidates: without a title the URL, without a category Resources. Their order is that of their URLs."""
    return pages.select(
        "site_id",
        "url",
        "markdown_url",
        js.or_else(F.col("title"), F.col("url")).alias("title"),
        js.text("description").alias("description"),
        js.or_else(F.col("category"), F.lit("Resources")).alias("category"),
        "importance_score",
        urls.is_home(F.col("url"), origin).alias("is_home"),
        "section_override",
        F.col("url").alias("ord"),
    )
