"""Pages over many crawls: the stored state, what changes in it, and what is told about it.

Parquet has no MERGE; a new state is a full outer join of the old one with a crawl, written whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import js

STATE = (
    "site_id string, url string, canonical_url string, markdown_url string, title string, description string, headings array<string>, "
    "content_excerpt string, content_hash string, category string, importance_score double, included boolean, exclude_reason string, "
    "section_override string, manual_edit boolean, analysis_source string, word_count int, depth int, status_code int, content_type string, "
    "inbound_links long, first_seen_at timestamp, last_seen_at timestamp, missing_since timestamp, removed_at timestamp"
)
#: What a crawl writes of a page that it fetched; first_seen_at, section_override and manual_edit stay as they are.
FETCHED = "canonical_url markdown_url title description headings content_excerpt content_hash category importance_score included exclude_reason analysis_source word_count depth status_code content_type inbound_links".split()


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(site_id, url, change) of two snapshots (site_id, url, content_hash): added, changed, unchanged or missing. A null hash differs from any."""
    p = previous.select("site_id", "url", F.col("content_hash").alias("__old"), F.lit(True).alias("__was"))
    c = current.select("site_id", "url", F.col("content_hash").alias("__new"), F.lit(True).alias("__is"))
    j = p.join(c, ["site_id", "url"], "full_outer")
    change = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "missing").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return j.select("site_id", "url", change.alias("change"))


def _one_row(working: DataFrame) -> DataFrame:
    """Of several rows with one URL (after redirects) the last one written wins."""
    best = working.groupBy("site_id", "url").agg(F.max("ord").alias("ord"))
    return working.join(best, ["site_id", "url", "ord"], "left_semi").dropDuplicates(["site_id", "url"])


def _timed(rows: DataFrame, now: Column | DataFrame) -> tuple[DataFrame, Column]:
    """rows and the time of each row's site; now: one time, or a table (site_id, now)."""
    if isinstance(now, Column):
        return rows, now
    return rows.join(now.select("site_id", F.col("now").alias("__now")), "site_id", "left"), F.col("__now")


def next_state(state: DataFrame, working: DataFrame, pre_excluded: DataFrame, now: Column | DataFrame) -> DataFrame:
    """The state after a crawl, whose time is one, or each site's own (a table site_id, now). state has the columns of STATE; working: fetched pages; pre_excluded (site_id, url, reason, depth): pages
    left out by their URL. Only sites that the crawl names are changed; a page that is missing the first time is only noted, the
    second time it is removed. A removed page that comes back keeps what people did to it."""
    sites = working.select("site_id").union(pre_excluded.select("site_id")).distinct().withColumn("__crawled", F.lit(True))
    w = _one_row(working).select("site_id", "url", *[F.col(c).alias(f"__{c}") for c in FETCHED], F.lit(True).alias("__seen"))
    x = pre_excluded.groupBy("site_id", "url").agg(F.first("reason").alias("__x_reason"), F.min("depth").alias("__x_depth")).withColumn("__out", F.lit(True))
    j = state.withColumn("__stored", F.lit(True)).join(w, ["site_id", "url"], "full_outer").join(x, ["site_id", "url"], "full_outer").join(sites, "site_id", "left")
    j, now = _timed(j, now)
    seen, out = F.coalesce("__seen", F.lit(False)), F.coalesce("__out", F.lit(False))
    here = seen | out
    gone = F.coalesce("__crawled", F.lit(False)) & ~here & F.col("removed_at").isNull()
    again = gone & F.col("missing_since").isNotNull()
    columns: dict[str, Column] = {c: F.when(seen, F.col(f"__{c}")).otherwise(F.col(c)) for c in FETCHED}
    # Where a page was both fetched and left out, the second write wins.
    columns["included"] = F.when(out | again, F.lit(False)).when(seen, F.col("__included")).otherwise(F.col("included"))
    columns["exclude_reason"] = F.when(out, F.col("__x_reason")).when(seen, F.col("__exclude_reason")).otherwise(F.col("exclude_reason"))
    columns["depth"] = F.when(out, F.col("__x_depth")).when(seen, F.col("__depth")).otherwise(F.col("depth")).cast("int")
    columns["importance_score"] = F.coalesce(columns["importance_score"], F.lit(0.0))
    columns["manual_edit"] = F.coalesce("manual_edit", F.lit(False))
    columns["first_seen_at"] = F.coalesce("first_seen_at", now)
    columns["last_seen_at"] = F.when(here, now).otherwise(F.col("last_seen_at"))
    columns["missing_since"] = F.when(here, None).when(gone & ~again, now).otherwise(F.col("missing_since"))
    columns["removed_at"] = F.when(here, None).when(again, now).otherwise(F.col("removed_at"))
    return j.select(*[columns.get(c, F.col(c)).alias(c) for c in state.columns])


def change_events(state: DataFrame, working: DataFrame, pre_excluded: DataFrame, now: Column | DataFrame) -> DataFrame:
    """(site_id, url, type, title, created_at): what a crawl adds, changes and, on the second miss, removes; from the state before it."""
    live = state.where("removed_at is null").select("site_id", "url", F.col("content_hash").alias("__hash"), F.col("title").alias("__title"), "missing_since", F.lit(True).alias("__live"))
    fetched = _one_row(working).select("site_id", "url", "title", "content_hash", "reused")
    j = fetched.where("not reused").join(live, ["site_id", "url"], "left")
    kind = F.when(F.col("__live").isNull(), "added").when(~F.col("__hash").eqNullSafe(F.col("content_hash")), "changed")
    new = j.select("site_id", "url", kind.alias("type"), "title").where("type is not null")
    seen = working.select("site_id", "url").union(pre_excluded.select("site_id", "url")).distinct()
    sites = seen.select("site_id").distinct()
    removed = live.where("missing_since is not null").join(seen, ["site_id", "url"], "left_anti").join(sites, "site_id", "left_semi").select("site_id", "url", F.lit("removed").alias("type"), F.col("__title").alias("title"))
    told, now = _timed(new.union(removed), now)
    return told.select("site_id", "url", "type", "title", now.alias("created_at"))


def edited(state: DataFrame, edits: DataFrame) -> DataFrame:
    """The state after people's edits: site_id, url, description, section, clear_section, included; null leaves a field as it is.
    A section is trimmed, and an empty or cleared one gives the page back to the rules. Edits without any field do nothing, and a description that is
    the page's own already is no edit."""
    e = edits.where(valid_edit()).select(
        "site_id", "url", F.substring("description", 1, 400).alias("__description"), js.trim("section").alias("__section"), (F.col("section").isNotNull() | F.coalesce("clear_section", F.lit(False))).alias("__moves"), F.col("included").alias("__included"), F.lit(True).alias("__edit")
    )
    j = state.join(e, ["site_id", "url"], "left")
    own = F.col("__description").eqNullSafe(js.text("description"))
    j = j.withColumn("__edit", F.when(own & ~F.col("__moves") & F.col("__included").isNull(), None).otherwise(F.col("__edit")))
    set_ = F.col("__included").isNotNull()
    columns = {
        "description": F.coalesce("__description", "description"),
        "section_override": F.when(F.col("__moves"), F.nullif("__section", F.lit(""))).otherwise(F.col("section_override")),
        "included": F.coalesce("__included", "included"),
        "exclude_reason": F.when(set_ & F.col("__included"), None).when(set_, F.lit("removed-by-user")).otherwise(F.col("exclude_reason")),
        "manual_edit": F.coalesce("__edit", "manual_edit"),
    }
    return j.select(*[columns.get(c, F.col(c)).alias(c) for c in state.columns])


def valid_edit() -> Column:
    return F.col("description").isNotNull() | F.col("section").isNotNull() | F.coalesce("clear_section", F.lit(False)) | F.col("included").isNotNull()


def renamed_section(state: DataFrame, site: str, old: str, new: str) -> DataFrame:
    """Edits that move all pages of a section, as it is shown, into one of another name."""
    return state.where((F.col("site_id") == site) & (F.col("section") == old)).select("site_id", "url", F.lit(None).cast("string").alias("description"), F.lit(new).alias("section"), F.lit(False).alias("clear_section"), F.lit(None).cast("boolean").alias("included"))


def appended_versions(files: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append: new (site_id, content, stats, created_at), each with the version after its site's last."""
    last = files.groupBy("site_id").agg(F.max("version").alias("__last"))
    return new.join(last, "site_id", "left").withColumn("version", (F.coalesce("__last", F.lit(0)) + 1).cast("int")).drop("__last")
