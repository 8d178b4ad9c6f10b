"""What a fetcher brings back, as tables: redirects followed with a safety check at every hop, bounded bodies, rendered pages,
existing index files.

There is no network here. A fetcher writes one row for each request: url, status_code, location, content_type, content_length, body
(binary), error. Everything that decides about it is in these functions.

Defined cases: a URL without a row has no response; of several rows of one URL the one with the smallest status counts; a null body is
empty; an empty table gives failures only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import js, net, urls
from corpusloom.plans.shared import stored

# Bytes of a body that are read, redirects that are followed, and the messages of failures.
MOST_BYTES, MOST_REDIRECTS = 3 << 20, 5
TOO_LARGE, TOO_MANY, NO_RESPONSE = "Response too large", "Too many redirects", "no response"
UNSAFE, NO_LOCATION = "Blocked for safety: %s", "Redirect (%s) with no Location header"


def bounded(body: Column, most: int = MOST_BYTES) -> Column:
    """A struct of the body's text, cut at so many bytes, and whether it was cut. What a cut leaves of a character is replaced."""
    raw = F.coalesce(body.cast("binary"), F.lit(b""))
    return F.struct(F.make_valid_utf8(F.substring(raw, 1, most).cast("string")).alias("body"), (F.octet_length(raw) > most).alias("truncated"))


def fetched(asked: DataFrame, rows: DataFrame, most_bytes: int = MOST_BYTES, most_redirects: int = MOST_REDIRECTS, addresses: DataFrame | None = None) -> DataFrame:
    """asked (url) with ok, status_code, final_url, content_type, body, truncated, error. Redirects are followed hop by hop, each a join; every
    hop is checked before it is asked for: by its URL, and where addresses (host, ip) are given by what its host resolves to."""
    one = rows.groupBy(F.col("url").alias("__of")).agg(F.min_by(F.struct("status_code", "location", "content_type", "content_length", "body", "error"), F.coalesce("status_code", F.lit(1 << 20))).alias("r"))
    at = asked.select(F.col("url").alias("asked")).distinct().withColumn("url", F.col("asked"))
    done = []

    def failed(df: DataFrame, message: Column) -> None:
        none = F.lit(None).cast("string")
        done.append(df.select(F.col("asked").alias("url"), F.lit(False).alias("ok"), F.lit(0).alias("status_code"), F.col("url").alias("final_url"), none.alias("content_type"), F.lit("").alias("body"), F.lit(False).alias("truncated"), message.alias("error")))

    for _ in range(most_redirects + 1):
        checked = at.withColumn("reason", net.url_problem(F.col("url"))) if addresses is None else net.checked(at, addresses)
        got = stored(checked.join(one, F.col("url") == F.col("__of"), "left").select("asked", "url", "reason", "r.*"), "hop")
        failed(got.where("reason is not null"), F.format_string(UNSAFE, F.col("reason")))
        got = got.where("reason is null")
        failed(got.where("error is not null or status_code is null"), F.coalesce("error", F.lit(NO_RESPONSE)))
        got = got.where("error is null and status_code is not null")
        moved, to = F.col("status_code").between(300, 399), js.or_else(F.col("location"))
        failed(got.where(moved & to.isNull()), F.format_string(NO_LOCATION, F.col("status_code").cast("string")))
        large = F.coalesce(F.col("content_length") > most_bytes, F.lit(False))
        b = bounded(F.col("body"), most_bytes)
        done.append(got.where(~moved).select(F.col("asked").alias("url"), (F.col("status_code").between(200, 299) & ~large).alias("ok"), "status_code", F.col("url").alias("final_url"), "content_type", F.when(large, F.lit("")).otherwise(b["body"]).alias("body"), (large | b["truncated"]).alias("truncated"), F.when(large, F.lit(TOO_LARGE)).alias("error")))
        at = got.where(moved & to.isNotNull()).select("asked", F.coalesce(urls.resolve(F.col("location"), F.col("url")), F.col("location")).alias("url"))
        if at.isEmpty():
            break
    else:
        failed(at, F.lit(TOO_MANY))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def with_rendered(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """pages (url, html, empty_shell) with the HTML that a browser made (rendered: url, html) in place of that of empty shells, where there is any: was_rendered
    tells which, and these must be extracted again."""
    r = rendered.groupBy(F.col("url").alias("__url")).agg(F.max("html").alias("__html"))
    j = pages.join(r, (F.col("url") == F.col("__url")) & F.col("empty_shell"), "left")
    return j.withColumns({"was_rendered": js.or_else(F.col("__html")).isNotNull(), "html": F.coalesce(js.or_else(F.col("__html")), F.col("html"))}).drop("__url", "__html")


def existing_index(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """(site_id, content): the index file that a site (origin) has itself. Not HTML, for many sites answer everything with a page, and with a heading first.
    responses as of fetched()."""
    asked = sites.select("site_id", F.concat("origin", F.lit("/llms.txt")).alias("url"))
    good = responses.where("ok").where(js.text("body") != "").where(~js.text("content_type").contains("text/html") & js.trim("body").startswith("#"))
    return asked.join(good.select("url", F.col("body").alias("content")), "url").select("site_id", "content")


def downloads(files: DataFrame) -> DataFrame:
    """(site_id, file_name, content_type, disposition, content): each site's latest file as it is handed out. files: site_id, version, content."""
    last = files.groupBy("site_id").agg(F.max_by("content", "version").alias("content"))
    return last.select("site_id", F.lit("llms.txt").alias("file_name"), F.lit("text/markdown; charset=utf-8").alias("content_type"), F.lit('attachment; filename="llms.txt"').alias("disposition"), "content")


def write_downloads(files: DataFrame, path: str) -> None:
    """The same as text files that end with a line's end, a folder for each site."""
    d = downloads(files)
    d.select(F.regexp_replace("site_id", "[^A-Za-z0-9.-]+", "_").alias("site"), F.regexp_replace("content", r"\n\z", "").alias("value")).write.partitionBy("site").text(path)
