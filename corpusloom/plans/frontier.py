"""The crawl loop: rounds of fetching the best URLs of every site at once, from a table of responses.

A round takes, of each site, the first URLs by priority, then by the order in which they were found; joins them to their
responses; extracts those that are HTML; and sends their links through normal form, site, asset and seen checks, robots rules and
URL shapes. What a URL was found with first (depth, priority) stays. Each round appends what it found and what it got to tables in the shared
folder; nothing is written twice. What waits is what was found and not yet asked for.

Defined cases: without sites, or where no site has a URL to begin with, the result has no rows; a URL without a response fails; rows of
responses that share a URL should not be (sources.responses.fetched gives one each).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import js, urls
from corpusloom.plans.shared import Appended, stored
from corpusloom.sources import html, robots, sitemap

# The messages of failures.
HTTP_ERROR, NOT_HTML, NO_RESPONSE = "HTTP %d", "Unsupported content type: %s", "no response"


@dataclass(frozen=True)
class Limits:
    """Fixed values, and how many URLs a site may have fetched, how deep links are followed, how many are fetched at once."""

    max_pages: int = 100
    max_depth: int = 5
    concurrency: int = 8


@dataclass
class Result:
    crawled: DataFrame
    failed: DataFrame
    pre_excluded: DataFrame
    seen: DataFrame

    def discovered(self) -> DataFrame:
        return self.seen.groupBy("site_id").agg(F.count(F.lit(1)).alias("discovered"))


def admitted(found: DataFrame, seen: DataFrame, rules: DataFrame) -> DataFrame:
    """Of found (site_id, raw, base, depth, said, seq) the URLs that are new pages of their site: url, depth, priority, seq, reason."""
    u = found.withColumn("url", urls.normalized(F.col("raw"), F.col("base"))).where("url is not null")
    u = u.where(urls.same_site(F.col("url"), F.col("site_id")) & ~urls.is_asset(F.col("url")))
    first = u.groupBy("site_id", "url").agg(F.min(F.struct("seq", "depth", "said")).alias("f")).select("site_id", "url", "f.*")
    new = first.join(seen.select("site_id", "url"), ["site_id", "url"], "left_anti").withColumn("path", urls.path_and_query(F.col("url")))
    judged = robots.decided(new, rules)
    return judged.select("site_id", "url", "depth", urls.discovery_priority(F.col("url"), F.col("depth"), F.col("said")).alias("priority"), "seq", urls.exclusion_reason(F.col("url"), F.col("allowed")).alias("reason"), "path")


def run(sites: DataFrame, rules: DataFrame, sitemaps: DataFrame, responses: DataFrame, limits: Limits | None = None) -> Result:
    """sites (site_id = origin); rules (site_id and parsed robots.txt); sitemaps (site_id, sitemap_url, ok, body); responses (url, status_code,
    content_type, final_url, html, error) by normal form of the URL that is asked for."""
    limits = limits or Limits()
    spark = sites.sparkSession
    start = sites.select("site_id", F.col("site_id").alias("raw"), F.col("site_id").alias("base"), F.lit(0).alias("depth"), F.lit(None).cast("double").alias("said"), F.array(F.lit(0), F.lit(0)).cast("array<long>").alias("seq"))
    listed = sitemap.discovered(sites.select("site_id", F.col("site_id").alias("origin")), rules, sitemaps)
    listed = listed.select("site_id", F.col("loc").alias("raw"), F.col("site_id").alias("base"), F.lit(0).alias("depth"), F.col("priority").alias("said"), F.array(F.lit(0), F.col("seq")).cast("array<long>").alias("seq"))
    found, answers, pages = (Appended(spark, n) for n in ("found", "answers", "pages"))
    found.add(admitted(start.union(listed), spark.createDataFrame([], "site_id string, url string"), rules), 0)
    answers.add(_answers(sites.limit(0).select("site_id", F.lit("").alias("url"), F.lit(0).alias("depth"), F.lit(0).alias("rank")), responses, 0), 0)
    done = 0
    while True:
        taken = answers.read().select("site_id", F.col("asked").alias("url"))
        waiting = found.read().where("reason is null").join(taken, ["site_id", "url"], "left_anti")
        spent = taken.groupBy("site_id").agg(F.count(F.lit(1)).alias("spent"))
        best = ranked(waiting).where(F.col("rank") <= limits.concurrency).join(spent, "site_id", "left")
        done += 1
        got = answers.add(_answers(best.where(F.col("rank") <= limits.max_pages - F.coalesce("spent", F.lit(0))), responses, done), done)
        new = pages.add(html.extracted(got.where("error is null").select("site_id", F.coalesce("final_url", "asked").alias("url"), "asked", "html", "depth", "status_code", "content_type", "ord")).drop("html"), done)
        if got.isEmpty():
            break
        links = new.where(F.col("depth") < limits.max_depth).select("site_id", "asked", "depth", "ord", F.posexplode("internal_links").alias("i", "raw"))
        linked = links.select("site_id", "raw", F.col("asked").alias("base"), (F.col("depth") + 1).alias("depth"), F.lit(None).cast("double").alias("said"), F.array(F.col("ord"), F.col("i")).cast("array<long>").alias("seq"))
        found.add(admitted(linked, found.read().select("site_id", "url"), rules), done)
    failed = answers.read().where("error is not null").select("site_id", F.col("asked").alias("url"), "error", "status_code")
    left_out = found.read().where("reason is not null").select("site_id", "url", "reason", "depth", "path", "seq")
    return Result(pages.read().drop("asked"), failed, left_out, found.read().select("site_id", "url"))


def ranked(waiting: DataFrame) -> DataFrame:
    """waiting (site_id, priority, seq, …) with rank: 1, 2, … in each site by priority, then by the order in which URLs were found."""
    return waiting.withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("priority").desc(), "seq")))


def _answers(batch: DataFrame, responses: DataFrame, done: int) -> DataFrame:
    """A round's URLs (asked) with their responses and, where a page was not got, the error."""
    got = batch.withColumnRenamed("url", "asked").join(responses.withColumnRenamed("url", "asked"), "asked", "left")
    ok = F.coalesce(F.col("status_code").between(200, 299) & F.col("error").isNull(), F.lit(False))
    error = F.when(~ok, F.coalesce("error", F.format_string(HTTP_ERROR, "status_code"), F.lit(NO_RESPONSE))).when(~js.text("content_type").contains("html"), F.format_string(NOT_HTML, js.or_else(F.col("content_type"), F.lit("unknown"))))
    # format_string gives text for a null status too
    error = F.when(~ok & F.col("error").isNull() & F.col("status_code").isNull(), F.lit(NO_RESPONSE)).otherwise(error)
    return got.select("site_id", "asked", "final_url", "html", "depth", "status_code", "content_type", error.alias("error"), (F.lit(done) * F.lit(1000) + F.col("rank")).cast("long").alias("ord"))


def blocked_samples(pre_excluded: DataFrame, most: int = 10) -> DataFrame:
    """(site_id, robots_blocked_samples): the first paths of each site that robots.txt forbids."""
    rows = pre_excluded.where("reason = 'excluded-by-robots'")
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("site_id").orderBy("seq"))).where(F.col("__n") <= most)
    return first.groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "path"))), lambda x: x["path"]).alias("robots_blocked_samples"))
