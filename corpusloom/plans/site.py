"""From fetched pages to index files, for all sites in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text, urls
from corpusloom.operators import filters, lifecycle, links, markdown, refine, render, sections, validate
from corpusloom.plans.shared import stored
from corpusloom.sources import html


#: Fixed value: columns of working pages that no index file says anything of, nor what is left out of it.
UNLISTED = ("content_excerpt", "first_paragraph", "headings", "internal_links", "canonical_url", "site_name", "empty_shell", "status_code", "content_type")


def no_state(spark: SparkSession) -> DataFrame:
    """A state without rows, of which the optimizer knows it: joins with it fall away."""
    return spark.createDataFrame([], lifecycle.STATE).limit(0)


def crawled_pages(responses: DataFrame) -> DataFrame:
    """Pages of responses (site_id, ord, url, html, depth, and status_code and content_type if known): those that are HTML, extracted, with is_home, which is
    found from the URLs unless responses have it."""
    p = html.extracted(responses)
    for name, kind in (("status_code", "int"), ("content_type", "string"), ("markdown_url", "string")):
        if name not in p.columns:
            p = p.withColumn(name, F.lit({"status_code": 200, "content_type": "text/html"}.get(name)).cast(kind))
    return p if "is_home" in p.columns else refine.home_flags(p)


def analyzed(crawled: DataFrame, state: DataFrame, inbound: DataFrame, verdicts: DataFrame | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Working pages after classification, descriptions, outside verdicts (as refine.valid_verdicts takes them), scores and content filters. What filters read is written
    first, without the main text, of which only the excerpt is read later: conditions on long expressions would be copied with them down the plan.
    without: columns that are not needed afterwards."""
    w = refine.classified(crawled, state).drop("main_content", *(c for c in without if c != "first_paragraph"))
    w = refine.without_generic_descriptions(stored(w, "classified")).drop(*without)
    if verdicts is not None:
        asked = w.where("may_ask").select("site_id", "url", "ord")
        w = refine.with_verdicts(w, refine.valid_verdicts(verdicts, asked))
    return filters.with_reasons(stored(refine.scored(w, inbound), "scored"))


def organized(working: DataFrame, state: DataFrame) -> DataFrame:
    """Working pages with section, curated_out and, of those curated out, included and exclude_reason set."""
    placed = state.where("removed_at is null").select("site_id", "url", "section_override")
    c = working.join(placed, ["site_id", "url"], "left")
    listed = sections.curated(c.where("included"))
    marks = listed.select(F.col("site_id").alias("__site"), F.col("ord").alias("__ord"), F.col("section").alias("section"), "curated_out", "is_manual")
    out = c.join(marks, (F.col("site_id") == F.col("__site")) & (F.col("ord") == F.col("__ord")), "left").drop("__site", "__ord")
    gone = F.coalesce("curated_out", F.lit(False))
    return out.withColumns({"included": F.col("included") & ~gone, "exclude_reason": F.when(gone, F.lit(sections.BELOW)).otherwise(F.col("exclude_reason")), "curated_out": gone})


@dataclass
class Crawl:
    """What one crawl of many sites comes to. Working pages and files are written to the shared folder, for all else comes from them."""

    working: DataFrame
    links: DataFrame
    files: DataFrame
    events: DataFrame
    state: DataFrame
    stats: DataFrame


def crawl_stats(working: DataFrame, pre_excluded: DataFrame, failed: DataFrame, discovered: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each site: discovered, crawled, included, excluded, failed, not_reached, added, changed, removed, exclusion_breakdown."""
    reasons = working.where("not included and exclude_reason is not null").select("site_id", F.col("exclude_reason").alias("reason")).union(pre_excluded.select("site_id", "reason"))
    tally = exclusion_breakdown(reasons)
    w = working.groupBy("site_id").agg(F.count(F.lit(1)).alias("crawled"), F.count_if("included").alias("included"))
    p = pre_excluded.groupBy("site_id").agg(F.count(F.lit(1)).alias("__x"))
    f = failed.groupBy("site_id").agg(F.count(F.lit(1)).alias("failed"))
    e = events.groupBy("site_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in ("added", "changed", "removed")])
    out = discovered.select("site_id", "discovered")
    for x in (w, p, f, e, tally):
        out = out.join(x, "site_id", "left")
    out = out.fillna(0, ["crawled", "included", "__x", "failed", "added", "changed", "removed", "excluded"])
    missed = F.greatest(F.lit(0), F.col("discovered") - F.col("__x") - F.col("crawled") - F.col("failed"))
    return out.withColumn("not_reached", missed).drop("__x")


def exclusion_breakdown(reasons: DataFrame) -> DataFrame:
    """(site_id, excluded, exclusion_breakdown) of rows (site_id, reason)."""
    n = reasons.groupBy("site_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("site_id").agg(F.sum("n").alias("excluded"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("exclusion_breakdown"))


def crawl(crawled: DataFrame, pre_excluded: DataFrame, failed: DataFrame, discovered: DataFrame, sites: DataFrame, state: DataFrame, now: Column, verdicts: DataFrame | None = None, responses: DataFrame | None = None) -> Crawl:
    """One crawl of the sites in `sites` (site_id, origin, site_name, site_description). responses: for Markdown alternates."""
    working = stored(organized(analyzed(crawled, state, links.inbound_counts(crawled), verdicts), state), "working")
    listed = sections.links(working.where("included"))
    if responses is not None:
        listed = markdown.with_alternates(listed, working, responses)
        known = listed.select("site_id", F.col("page_url").alias("url"), F.when(F.col("url") != F.col("page_url"), F.col("url")).alias("__md")).groupBy("site_id", "url").agg(F.max("__md").alias("__md"))
        working = working.join(known, ["site_id", "url"], "left").withColumn("markdown_url", F.coalesce("markdown_url", "__md")).drop("__md")
    home = crawled.where("is_home").select("site_id", "site_name", "title", "description")
    meta = render.site_metadata(sites, home)
    content = stored(render.rendered(meta, listed), "files")
    checked = validate.validated(content).withColumnRenamed("site_id", "__site")
    files = content.join(checked, F.col("site_id") == F.col("__site")).drop("__site")
    events = lifecycle.change_events(state, working, pre_excluded, now)
    return Crawl(working, listed, files, events, lifecycle.next_state(state, working, pre_excluded, now), crawl_stats(working, pre_excluded, failed, discovered, events))


def pages_to_indexes(pages: DataFrame) -> DataFrame:
    """The flagship: raw web pages (page_id, url, html) to one row for each site: site_id, pages, listed, content, valid, link_count.

    URLs are brought to their normal form, those that are no pages are left out, and the first page of each URL and of each site is found,
    all on short rows that are written once, before any HTML is read."""
    spark = pages.sparkSession
    raw = F.col("url").alias("raw")
    known = stored(pages.select(F.col("page_id").alias("ord"), raw, urls.normalized(F.col("url")).alias("url")), "urls").where("url is not null and ord is not null")
    known = known.where(~urls.is_asset(F.col("url")) & urls.exclusion_reason(F.col("url"), F.lit(True)).isNull())
    first = known.groupBy("url").agg(F.min(F.struct("ord", "raw")).alias("f")).select("url", "f.*")
    first = stored(refine.home_flags(stored(first.withColumns({"site_id": urls.origin(F.col("url")), "depth": F.lit(1)}), "first")), "chosen")
    # HTML is dealt out by page, never read where its file lies: few files would mean few tasks for what takes longest
    responses = pages.select(F.col("page_id").alias("ord"), raw, "html").join(first.hint("merge"), ["ord", "raw"]).drop("raw")
    crawled = stored(crawled_pages(responses).drop("html"), "crawled")  # HTML is read once
    state = no_state(spark)
    found = analyzed(crawled, state, links.inbound_counts(crawled), without=UNLISTED)
    working = stored(organized(found, state), "working")
    listed = sections.links(working.where("included"))
    sites = working.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("section").isNotNull()).alias("listed"))
    none = F.lit(None).cast("string")
    meta = render.site_metadata(sites.select("site_id", F.col("site_id").alias("origin"), none.alias("site_name"), none.alias("site_description")), crawled.where("is_home").select("site_id", "site_name", "title", "description"))
    content = stored(render.rendered(meta, listed), "files")
    checked = validate.validated(content).select("site_id", "valid", "link_count", "section_count")
    return sites.join(content, "site_id").join(checked, "site_id")


def regenerated(state: DataFrame, sites: DataFrame, files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Index files from what is stored, without a crawl, as a new version of each site; and the state with what no longer fits left out.

    Counts of discovered, crawled and failed pages carry over from the last version's stats, where there is one."""
    live = state.where("removed_at is null").join(sites.select("site_id", "origin"), "site_id")
    c = sections.curated(sections.from_stored(live.where("included"), F.col("origin")))
    listed = sections.links(c)
    content = render.rendered(render.site_metadata(sites), listed)
    gone = c.where("curated_out").select("site_id", "url").distinct().withColumn("__gone", F.lit(True))
    columns = {"included": F.when(F.col("__gone"), False).otherwise(F.col("included")), "exclude_reason": F.when(F.col("__gone"), F.lit(sections.BELOW)).otherwise(F.col("exclude_reason"))}
    after = state.join(gone, ["site_id", "url"], "left").select(*[columns.get(k, F.col(k)).alias(k) for k in state.columns])

    reasons = live.where("not included").select("site_id", F.coalesce(F.nullif("exclude_reason", F.lit("")), F.lit("removed-by-user")).alias("reason")).union(gone.select("site_id", F.lit(sections.BELOW)))
    counts = live.groupBy("site_id").agg(F.count(F.lit(1)).alias("__all"))
    shown = c.groupBy("site_id").agg(F.count_if(~F.col("curated_out")).alias("included"))
    last = files.groupBy("site_id").agg(F.max_by("stats", "version").alias("__stats"))
    old = lambda k, otherwise: F.coalesce(F.get_json_object("__stats", f"$.{k}").cast("long"), otherwise)
    s = counts.join(shown, "site_id", "left").join(exclusion_breakdown(reasons), "site_id", "left").join(last, "site_id", "left").fillna(0, ["included", "excluded"])
    stats = F.to_json(
        F.struct(
            old("discovered", F.col("__all")).alias("discovered"), old("crawled", F.col("__all")).alias("crawled"), "included", "excluded", old("failed", F.lit(0)).alias("failed"),
            old("notReachedDueToBudget", F.lit(0)).alias("notReachedDueToBudget"), F.col("exclusion_breakdown").alias("exclusionBreakdown"),
            F.lit(0).alias("added"), F.lit(0).alias("changed"), F.lit(0).alias("removed"), F.lit(True).alias("editedManually"),
        )
    )
    made = content.join(s.select("site_id", stats.alias("stats")), "site_id").withColumn("created_at", now)
    return lifecycle.appended_versions(files, made), after


def crawl_again(sites: DataFrame, now: Column) -> DataFrame:
    """Sites whose next scheduled crawl is due."""
    return sites.where(F.col("monitoring_enabled") & (F.col("next_scheduled_crawl_at") <= now))


def crawl_created(crawls: DataFrame, sites: DataFrame, trigger: str, now: Column) -> DataFrame:
    """crawls with a new one of each site, numbered on from its last."""
    last = crawls.groupBy("site_id").agg(F.max("crawl_id").alias("__last"))
    new = sites.select("site_id").distinct().join(last, "site_id", "left").select("site_id", (F.coalesce("__last", F.lit(0)) + 1).cast("long").alias("crawl_id"), F.lit(trigger).alias("trigger"), F.lit("running").alias("status"), F.lit("queued").alias("stage"), now.alias("started_at"))
    return crawls.unionByName(new, allowMissingColumns=True)


def touched(sites: DataFrame, crawled: DataFrame, now: Column) -> DataFrame:
    """Sites after a crawl: crawled (site_id, site_name, summary) names those that were crawled."""
    c = crawled.select("site_id", F.col("site_name").alias("__name"), F.col("summary").alias("__said"), F.lit(True).alias("__done"))
    j = sites.join(c, "site_id", "left")
    following = F.when(F.col("monitoring_enabled"), text.next_run(F.col("monitoring_frequency"), now))
    columns = {
        "site_name": F.coalesce("__name", "site_name"),
        "site_description": F.coalesce("__said", "site_description"),
        "last_crawled_at": F.when(F.col("__done"), now).otherwise(F.col("last_crawled_at")),
        "next_scheduled_crawl_at": F.when(F.col("__done"), following).otherwise(F.col("next_scheduled_crawl_at")),
        "updated_at": F.when(F.col("__done"), now).otherwise(F.col("updated_at")),
    }
    return j.select(*[columns.get(k, F.col(k)).alias(k) for k in sites.columns])
