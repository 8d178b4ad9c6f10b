"""Validation of index files: an ordered scan of each file's lines, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import js, urls
from corpusloom.plans.shared import stored

# What a line may be. White space is that of the web platform.
H1 = rf"^#{js.WS}+(.+)\z"
H2 = rf"^##{js.WS}+(.+)\z"
LINK = rf"^-{js.WS}+\[([^\]]+)\]\(([^){js.WS[1:-1]}]+)\)(?::{js.WS}*(.*))?\z"
LOOSE = rf"^[-*]{js.WS}+"
SHOWN_DUPLICATES, SHOWN_CHARS = 5, 80
# The messages.
NO_LINKS, BEFORE_TITLE, INVALID_URL = 'Section "%s" has no links', 'Section "%s" appears before the H1 title', 'Invalid link URL: "%s"'
ODD_ITEM = 'List item doesn\'t match "- [Title](url): description": "%s"'
DUPLICATES, NO_TITLE, MANY_TITLES = "Duplicate URLs: %s%s", "Missing the required H1 site/project title", "Found %s H1 headings — exactly one is allowed"


def lines(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, line, kind, …) of lines that are not blank; kind: h1, h2, link, loose or other."""
    split = files.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), "\r?\n")).alias("pos", "raw"))
    x = split.select("key", "pos", js.trim("raw").alias("line")).where("line <> ''")
    line = F.col("line")
    kind = F.when(line.rlike(H1), "h1").when(line.rlike(H2), "h2").when(line.rlike(LINK), "link").when(line.rlike(LOOSE), "loose").otherwise("other")
    return x.withColumns({"kind": kind, "heading": F.regexp_extract("line", H2, 1), "url": F.regexp_extract("line", LINK, 2)})


def validated(files: DataFrame, key: str = "site_id", content: str = "content") -> DataFrame:
    """(key, valid, issues, link_count, section_count): issues are structs of level and message, in the order of the file, then
    those of its title, then duplicates."""
    x = stored(lines(files, key, content), "lines")  # several branches read them
    so_far = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"section": F.count_if(F.col("kind") == "h2").over(so_far), "titled": F.count_if(F.col("kind") == "h1").over(so_far) > 0})
    is_ = lambda k: F.col("kind") == k
    issue = lambda level, message, *values: F.struct(F.lit(level).alias("level"), F.format_string(message, *values).alias("message"))
    at = lambda place, sub, i: F.struct(place.cast("long").alias("place"), F.lit(sub).alias("sub"), i.alias("issue"))

    # A section without links is found where the next one begins, or after the last line.
    sections = x.where("section > 0").groupBy("key", "section").agg(F.count_if(is_("link")).alias("links"), F.max_by("heading", is_("h2")).alias("heading"))
    begins = x.where(is_("h2")).select("key", (F.col("section") - 1).alias("section"), F.col("pos").alias("ends"))
    empty = sections.where("links = 0").join(begins, ["key", "section"], "left")
    late = F.lit(1 << 40)
    empty = empty.select("key", at(F.coalesce("ends", late), 0, issue("error", NO_LINKS, js.trim("heading"))).alias("i"))
    found = F.array_compact(
        F.array(
            F.when(is_("h2") & ~F.col("titled"), at(F.col("pos"), 1, issue("error", BEFORE_TITLE, F.col("heading")))),
            F.when(is_("link") & ~urls.is_absolute(F.col("url")), at(F.col("pos"), 1, issue("error", INVALID_URL, F.col("url")))),
            F.when(is_("loose") & (F.col("section") > 0), at(F.col("pos"), 1, issue("warning", ODD_ITEM, js.cut(F.col("line"), SHOWN_CHARS)))),
        )
    )
    by_line = x.select("key", F.explode(found).alias("i"))

    again = x.where(is_("link")).groupBy("key", "url").agg(F.array_sort(F.collect_list("pos")).alias("p")).where(F.size("p") > 1)
    dup = again.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.get("p", F.lit(1)).alias("at"), "url"))), lambda d: d["url"]).alias("u"))
    more = F.when(F.size("u") > SHOWN_DUPLICATES, F.lit("…")).otherwise("")
    dup = dup.select("key", at(late, 3, issue("error", DUPLICATES, F.array_join(F.slice("u", 1, SHOWN_DUPLICATES), ", "), more)).alias("i"))

    totals = files.select(F.col(key).alias("key")).distinct().join(x.groupBy("key").agg(F.count_if(is_("h1")).alias("h1"), F.count_if(is_("h2")).alias("h2"), F.count_if(is_("link")).alias("links")), "key", "left").fillna(0, ["h1", "h2", "links"])
    title = F.when(F.col("h1") == 0, at(late, 2, issue("error", NO_TITLE))).when(F.col("h1") > 1, at(late, 2, issue("error", MANY_TITLES, F.col("h1").cast("string"))))
    titles = totals.select("key", title.alias("i")).where("i is not null")

    every = by_line.unionByName(empty).unionByName(titles).unionByName(dup)
    issues = every.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["issue"]).alias("issues"))
    out = totals.join(issues, "key", "left")
    issues_or_none = F.coalesce("issues", F.expr("cast(array() as array<struct<level: string, message: string>>)"))
    return out.select(
        F.col("key").alias(key),
        (~F.exists(issues_or_none, lambda i: i["level"] == "error")).alias("valid"),
        issues_or_none.alias("issues"),
        F.col("links").cast("long").alias("link_count"),
        F.col("h2").cast("long").alias("section_count"),
    )
