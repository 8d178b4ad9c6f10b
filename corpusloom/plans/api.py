"""Read and write queries over the stored tables, one for each thing that a client asks.

websites: site_id, base_url, site_name, site_description, monitoring_enabled, monitoring_frequency, last_crawled_at,
next_scheduled_crawl_at, created_at, updated_at. pages: lifecycle.STATE. generated_files: site_id, version, content, stats, created_at.
crawls: site_id, crawl_id, status, stage, started_at, …. change_events: site_id, url, type, title, created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import js, text, urls
from corpusloom.operators import sections
from corpusloom.plans.shared import numbered

# How many rows lists show, and how often a site may be crawled.
RECENT_SITES, RECENT_FILES, RECENT_EVENTS = 20, 100, 50
FREQUENCIES = ("manual", "daily", "weekly")


def recent_websites(websites: DataFrame, most: int = RECENT_SITES) -> DataFrame:
    return websites.orderBy(F.col("updated_at").desc(), "site_id").limit(most)


def latest(rows: DataFrame, by: str, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """The last row of each key: an aggregate that combines before it shuffles."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), by).alias("__row")).select(*keys, "__row.*")


def files_of_recent_websites(websites: DataFrame, files: DataFrame, most: int = RECENT_FILES) -> DataFrame:
    """The latest file of each of the recent websites; those without one are left out after the limit."""
    last = latest(files, "version").select("site_id", "version", "content", F.col("created_at").alias("file_created_at"))
    return recent_websites(websites, most).join(last, "site_id")


def latest_crawl(crawls: DataFrame) -> DataFrame:
    return latest(crawls, "started_at")


def pages(state: DataFrame, site: str | None = None) -> DataFrame:
    """Pages that are not removed."""
    live = state.where("removed_at is null")
    return live if site is None else live.where(F.col("site_id") == site)


def changes(events: DataFrame, site: str, most: int = RECENT_EVENTS) -> DataFrame:
    return events.where(F.col("site_id") == site).orderBy(F.col("created_at").desc(), "url").limit(most)


def details(websites: DataFrame, files: DataFrame, crawls: DataFrame, state: DataFrame) -> DataFrame:
    """Websites with their latest file and crawl and their numbers of pages."""
    f = latest(files, "version").select("site_id", "version", "content", "stats")
    c = latest_crawl(crawls).select("site_id", "status", "stage", "started_at")
    n = pages(state).groupBy("site_id").agg(F.count(F.lit(1)).alias("page_count"), F.count_if("included").alias("included_count"))
    return websites.join(f, "site_id", "left").join(c, "site_id", "left").join(n, "site_id", "left").fillna(0, ["page_count", "included_count"])


def status(websites: DataFrame, crawls: DataFrame, files: DataFrame) -> DataFrame:
    """Websites with their latest crawl, its stage as a number, and the latest file if that crawl is complete."""
    c = latest_crawl(crawls).select("site_id", "status", "stage")
    f = latest(files, "version").select("site_id", "version", "content")
    done = F.col("status") == "completed"
    return websites.join(c, "site_id", "left").join(f, "site_id", "left").withColumns({"stage_index": text.stage_index(F.col("stage")), "version": F.when(done, F.col("version")), "content": F.when(done, F.col("content"))})


def editor(state: DataFrame, websites: DataFrame) -> DataFrame:
    """What an editor shows: live pages with section and place, or exclude_reason; home pages only where they are included. Rows stand in no order: section_rank, section and place give that of the sections, excluded() that of the others."""
    sites = websites.select("site_id")
    live = pages(state).join(sites, "site_id", "left_semi")
    c = sections.curated(sections.from_stored(live.where("included"), F.col("site_id")))
    shown = sections.links(c).select("site_id", F.col("page_url").alias("url"), "section", "section_rank", "place")
    base = ("title", "description", "category", "importance_score", "section_override")
    kept = c.where("section is not null").select("site_id", "url", *base, F.lit(None).cast("string").alias("exclude_reason"))
    dropped = c.where("curated_out").select("site_id", "url", *base, F.lit(sections.BELOW).alias("exclude_reason"))
    left_out = live.where(~F.col("included") & ~urls.is_home(F.col("url"), F.col("site_id")))
    out = left_out.select("site_id", "url", js.or_else(F.col("title"), F.col("url")).alias("title"), js.text("description").alias("description"), js.or_else(F.col("category"), F.lit("Resources")).alias("category"), "importance_score", "section_override", "exclude_reason")
    return kept.join(shown, ["site_id", "url"]).unionByName(out.unionByName(dropped), allowMissingColumns=True)


def excluded(state: DataFrame, websites: DataFrame) -> DataFrame:
    """(site_id, url, title, importance_score, exclude_reason, place): pages that an editor may bring back, of each site the highest score first; at equal scores those
    that were left out before stand before those that are curated out now, then by URL."""
    out = editor(state, websites).where("exclude_reason is not null").withColumn("__now", F.col("exclude_reason") == sections.BELOW)
    return numbered(out, "site_id", [F.col("importance_score").desc(), "__now", "url"], "place").select("site_id", "url", "title", "importance_score", "exclude_reason", "place")


def breakdown(stats: DataFrame) -> DataFrame:
    """(site_id, reason, label, n): the reasons of a stats table, most frequent first."""
    rows = stats.select("site_id", F.explode("exclusion_breakdown").alias("reason", "n")).where("n > 0")
    return rows.withColumn("label", text.exclusion_label(F.col("reason"))).orderBy("site_id", F.col("n").desc(), "reason")


def frequency(said: Column) -> Column:
    """How often, where that is allowed; else daily."""
    return F.when(said.isin(*FREQUENCIES), said).otherwise("daily")


def monitored(websites: DataFrame, settings: DataFrame, now: Column) -> DataFrame:
    """Websites after new settings (site_id, enabled, frequency): an unknown frequency is daily, and what is off has no next run."""
    s = settings.select("site_id", F.coalesce("enabled", F.lit(False)).alias("__on"), frequency(F.col("frequency")).alias("__often"))
    j = websites.join(s, "site_id", "left")
    set_ = F.col("__on").isNotNull()
    columns = {
        "monitoring_enabled": F.coalesce("__on", "monitoring_enabled"),
        "monitoring_frequency": F.coalesce("__often", "monitoring_frequency"),
        "next_scheduled_crawl_at": F.when(set_, F.when(F.col("__on"), text.next_run(F.col("__often"), now))).otherwise(F.col("next_scheduled_crawl_at")),
    }
    return j.select(*[columns.get(c, F.col(c)).alias(c) for c in websites.columns])


def created(websites: DataFrame, inputs: DataFrame, now: Column) -> DataFrame:
    """Websites with those of inputs (raw) that are valid and new; one for each origin."""
    c = inputs.withColumn("c", urls.checked_input(F.col("raw"))).where("c.ok").groupBy(F.col("c.origin").alias("site_id")).agg(F.min("c.base_url").alias("base_url"))
    new = c.join(websites.select("site_id"), "site_id", "left_anti").select("site_id", "base_url", F.lit(False).alias("monitoring_enabled"), F.lit("daily").alias("monitoring_frequency"), now.alias("created_at"), now.alias("updated_at"))
    return websites.unionByName(new, allowMissingColumns=True)
