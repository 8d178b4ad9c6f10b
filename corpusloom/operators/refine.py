"""From crawled pages to working pages: reuse of what is known, categories, descriptions, outside verdicts, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import js, text, urls
from corpusloom.operators import classify
from corpusloom.plans.shared import numbered

# Fixed values.
DESCRIPTION_CHARS = 180
VERDICT_BATCH = 12
PAGE_LABELS = ("### Page %d", "URL: %s", "Title: %s", "Description: %s", "Headings: %s", "Content excerpt:\n%s")
NONE, EMPTY = "(none)", "(empty)"


def classified(crawled: DataFrame, stored: DataFrame) -> DataFrame:
    """Working pages. A stored page that was analyzed keeps its analysis where its content is the same or a person edited it;
    reused says that the content is the same. Others are classified by rules, and may_ask says that no rule was sure."""
    keep = ("markdown_url", "title", "description", "category", "importance_score", "included", "exclude_reason", "analysis_source", "content_hash", "manual_edit")
    old = stored.where("removed_at is null").select(F.col("site_id").alias("__site"), F.col("url").alias("__url"), *[F.col(c).alias(f"__{c}") for c in keep])
    p = crawled.withColumns({"title": js.text("title"), "description": js.text("description"), "main_content": js.text("main_content")})
    # what is read of the main text is made before the join, so that whole texts need not be dealt out
    p = p.withColumns({"content_hash": text.content_hash(F.col("title"), F.col("description"), F.col("main_content")), "content_excerpt": text.excerpt(F.col("main_content"))})
    j = p.join(old, (F.col("site_id") == F.col("__site")) & (F.col("url") == F.col("__url")), "left")
    same = F.coalesce(F.col("__content_hash") == F.col("content_hash"), F.lit(False))
    edited = F.coalesce("__manual_edit", F.lit(False))
    known = js.or_else(F.col("__analysis_source")).isNotNull() & (same | edited)
    j = j.withColumns({"__known": known, "__rule": classify.rule_category(F.col("url"), F.col("title"), F.col("headings"))})
    either = lambda then, other: F.when(F.col("__known"), then).otherwise(other)
    out = {
        "reused": F.col("__known") & same,
        "manual_edit": F.col("__known") & edited,
        "may_ask": ~F.col("__known") & F.col("__rule").isNull(),
        "markdown_url": either(F.col("__markdown_url"), F.col("markdown_url") if "markdown_url" in crawled.columns else F.lit(None).cast("string")),
        "category": either(js.or_else(F.col("__category"), F.lit("Resources")), F.coalesce("__rule", F.lit("Resources"))),
        "importance_score": either(F.col("__importance_score"), F.lit(0.0)),
        "included": either(F.col("__included"), F.lit(True)),
        "exclude_reason": either(F.col("__exclude_reason"), F.lit(None).cast("string")),
        "analysis_source": either(F.col("__analysis_source"), F.lit("deterministic")),
        "title": either(js.or_else(F.col("__title"), F.col("title")), F.col("title")),
        "description": either(js.text(js.or_else(F.col("__description"), F.col("description"))), F.col("description")),
    }
    return j.withColumns(out).drop("__site", "__url", "__known", "__rule", *[f"__{c}" for c in keep])


def without_generic_descriptions(working: DataFrame) -> DataFrame:
    """Where a third of a site's pages (30 %, three at least) share one description, fresh pages other than the home page get
    their first paragraph instead, or none. The share is of all working pages, the count of fresh ones with a description."""
    fresh = ~F.col("reused") & ~F.col("manual_edit")
    sizes = working.groupBy("site_id").agg(F.count(F.lit(1)).alias("__n"))
    counts = working.where(fresh & (F.col("description") != "")).groupBy("site_id", "description").agg(F.count(F.lit(1)).alias("__c"))
    generic = counts.join(sizes, "site_id").where(F.col("__c") >= F.greatest(F.lit(3), F.ceil(F.col("__n") * F.lit(0.3)))).select(F.col("site_id").alias("__site"), F.col("description").alias("__said"))
    j = working.join(generic, (F.col("site_id") == F.col("__site")) & (F.col("description") == F.col("__said")), "left")
    para = js.trim("first_paragraph")
    better = F.when((para != "") & (para != F.col("description")), js.shorten_at_word(para, DESCRIPTION_CHARS)).otherwise("")
    hit = F.col("__said").isNotNull() & fresh & ~F.col("is_home")
    return j.withColumn("description", F.when(hit, better).otherwise(F.col("description"))).drop("__site", "__said")


def valid_verdicts(verdicts: DataFrame, asked: DataFrame) -> DataFrame:
    """Outside verdicts that count. asked (site_id, url, ord) was sent in batches of VERDICT_BATCH; a batch with one bad answer is lost
    whole, and answers about pages that the batch did not hold are dropped. verdicts: site_id, batch, url, category, importance, description, include."""
    batches = numbered(asked, "site_id", ["ord"], "__n").select("site_id", "url", F.floor(F.col("__n") / VERDICT_BATCH).alias("batch"))
    ok = F.col("category").isin(*classify.CATEGORIES) & F.col("importance").isin("high", "medium", "low") & F.length("description").between(1, 240) & F.col("include").isNotNull() & F.col("url").isNotNull()
    bad = verdicts.where(~F.coalesce(ok, F.lit(False))).select("site_id", "batch").distinct()
    return verdicts.join(bad, ["site_id", "batch"], "left_anti").join(batches, ["site_id", "batch", "url"], "left_semi")


def with_verdicts(working: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Working pages after outside verdicts (site_id, url, category, description, include); their importance is not used. Pages with known content keep their analysis."""
    v = verdicts.select(F.col("site_id").alias("__site"), F.col("url").alias("__url"), F.col("category").alias("__category"), F.col("description").alias("__description"), F.col("include").alias("__include"))
    j = working.join(v, (F.col("site_id") == F.col("__site")) & (F.col("url") == F.col("__url")) & ~F.col("reused"), "left")
    hit = F.col("__url").isNotNull()
    out = hit & ~F.col("__include")
    return j.withColumns(
        {
            "category": F.when(hit, F.col("__category")).otherwise(F.col("category")),
            "description": F.when(hit, js.text(js.or_else(F.col("__description"), F.col("description")))).otherwise(F.col("description")),
            "analysis_source": F.when(hit, F.lit("llm")).otherwise(F.col("analysis_source")),
            "included": F.when(out, False).otherwise(F.col("included")),
            "exclude_reason": F.when(out, F.lit("llm-excluded")).otherwise(F.col("exclude_reason")),
        }
    ).drop("__site", "__url", "__category", "__description", "__include")


def scored(working: DataFrame, inbound: DataFrame) -> DataFrame:
    """Working pages with inbound_links, and scores of those whose content is new; a declared alternate counts as Markdown."""
    i = inbound.select(F.col("site_id").alias("__site"), F.col("url").alias("__url"), F.col("inbound_links").alias("__in"))
    j = working.join(i, (F.col("site_id") == F.col("__site")) & (F.col("url") == F.col("__url")), "left").withColumn("inbound_links", F.coalesce("__in", F.lit(0)).cast("long"))
    md = js.or_else(F.col("markdown_url"), F.col("declared_markdown_alternate")).isNotNull()
    fresh = classify.importance(F.col("is_home"), F.col("category"), F.col("depth"), F.col("word_count"), F.col("inbound_links"), md)
    return j.withColumn("importance_score", F.when(F.col("reused"), F.col("importance_score")).otherwise(fresh)).drop("__site", "__url", "__in")


def prompt(pages: DataFrame, site_size: int = VERDICT_BATCH) -> DataFrame:
    """(site_id, batch, request): the text that an outside analyzer gets for each batch of pages that no rule was sure of."""
    rows = numbered(pages, "site_id", ["ord"], "__n").withColumn("batch", F.floor(F.col("__n") / site_size))
    or_none = lambda c, none: js.or_else(c, F.lit(none))
    said = (F.col("__n") % site_size + 1, F.col("url"), or_none(F.col("title"), NONE), or_none(F.col("description"), NONE), or_none(F.array_join(F.slice("headings", 1, 8), ", "), NONE), or_none(js.cut(F.col("content_excerpt"), text.EXCERPT_CHARS), EMPTY))
    entry = F.concat_ws("\n", *[F.format_string(label, x) for label, x in zip(PAGE_LABELS, said, strict=True)])
    return rows.withColumn("__e", F.struct("__n", entry.alias("e"))).groupBy("site_id", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list("__e")), lambda x: x["e"]), "\n\n").alias("request"))


def home_flags(crawled: DataFrame, origin: Column | None = None) -> DataFrame:
    """crawled (site_id = the site's origin, url, ord, …) with is_home: the first page at the root of its origin, else the first page."""
    at_root = urls.is_home(F.col("url"), F.col("site_id") if origin is None else origin)
    first = crawled.groupBy("site_id").agg(F.min(F.struct((~at_root).alias("x"), "ord"))["ord"].alias("__home"))
    return crawled.join(first, "site_id").withColumn("is_home", F.col("ord") == F.col("__home")).drop("__home")
