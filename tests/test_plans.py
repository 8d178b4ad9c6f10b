"""The crawl loop against a plain model, streams, and the catalog against its SQL."""

import os
import time
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lifecycle
from corpusloom.plans import api, catalog, frontier, site
from corpusloom.streaming import monitor

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def page(*hrefs):
    return "<html><title>t</title><body><p>words here</p>" + "".join(f'<a href="{h}">l</a>' for h in hrefs) + "</body></html>"


SITE = {
    "https://e.com/": page("/docs/a", "/z", "/login", "/b.png", "https://other.com/", "/docs/a#x"),
    "https://e.com/docs/a": page("/blog", "/deep", "/private/x"),
    "https://e.com/z": page("/docs/late"),
    "https://e.com/docs/late": page(),
    "https://e.com/blog": None,
    "https://e.com/deep": page("/deeper"),
}


def crawl(spark, **limits):
    rows = [(u, 200 if h else 404, "text/html", None, h, None) for u, h in SITE.items()]
    responses = spark.createDataFrame(rows, "url string, status_code int, content_type string, final_url string, html string, error string")
    sites = spark.createDataFrame([("https://e.com",)], "site_id string")
    rules = spark.createDataFrame([("https://e.com", True, ["/private"], [], [])], "site_id string, fetched boolean, disallow array<string>, allow array<string>, sitemaps array<string>")
    maps = spark.createDataFrame([("https://e.com", "https://e.com/sitemap.xml", True, "<urlset><url><loc>https://e.com/z</loc><priority>0.1</priority></url></urlset>")], "site_id string, sitemap_url string, ok boolean, body string")
    return frontier.run(sites, rules, maps, responses, frontier.Limits(**limits))


def test_crawl_order_and_budget(spark):
    r = crawl(spark, max_pages=4, max_depth=2, concurrency=1)
    assert [x.url for x in r.crawled.orderBy("ord").collect()] == ["https://e.com/", "https://e.com/docs/a", "https://e.com/z"]  # the failed /blog was third
    r = crawl(spark, max_pages=100, max_depth=1, concurrency=2)
    assert {x.url for x in r.crawled.collect()} == {"https://e.com/", "https://e.com/docs/a", "https://e.com/z", "https://e.com/docs/late"}
    r = crawl(spark, max_pages=100, max_depth=5, concurrency=8)
    assert {x.url: x.error for x in r.failed.collect()} == {"https://e.com/blog": "HTTP 404", "https://e.com/deeper": "no response"}
    assert {(x.url, x.reason) for x in r.pre_excluded.collect()} == {("https://e.com/login", "auth"), ("https://e.com/private/x", "excluded-by-robots")}
    assert r.discovered().first().discovered == 9
    assert frontier.blocked_samples(r.pre_excluded).first().robots_blocked_samples == ["/private/x"]


def test_crawl_of_nothing(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    r = frontier.run(none("site_id string"), none("site_id string, fetched boolean, disallow array<string>, allow array<string>, sitemaps array<string>"), none("site_id string, sitemap_url string, ok boolean, body string"), none("url string, status_code int, content_type string, final_url string, html string, error string"))
    assert [x.collect() for x in (r.crawled, r.failed, r.pre_excluded, r.seen)] == [[]] * 4 and "title" in r.crawled.columns


def snapshot(spark, n, pages, site="s"):
    names = [c.strip().split()[0] for c in monitor.SNAPSHOT.split(",") if c.strip()]
    rows = []
    for i, (u, h) in enumerate(pages.items()):
        row = {"site_id": site, "url": u, "ord": i, "content_hash": h, "included": True, "reused": False, "crawled_at": n if isinstance(n, datetime) else datetime(2024, 1, n), "title": u}
        rows.append(tuple(row.get(c) for c in names))
    return spark.createDataFrame(rows, monitor.SNAPSHOT)


def test_stream_of_snapshots(spark, tmp_path):
    table = monitor.StateTable(spark, f"file://{tmp_path}/table")
    for n, pages in ((1, {"a": "1", "b": "1"}), (2, {"a": "2"}), (3, {"a": "2"})):
        snapshot(spark, n, pages).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = monitor.watch_snapshots(spark, f"{tmp_path}/in", table, f"{tmp_path}/cp")
        q.awaitTermination()
    assert table.versions() == [2, 3]  # the last two are kept
    got = sorted((r.url, r.type) for r in table.events().collect())
    assert got == [("a", "added"), ("a", "changed"), ("b", "added"), ("b", "removed")]
    assert {r.url: r.removed_at is not None for r in table.read().collect()} == {"a": False, "b": True}
    table.apply(snapshot(spark, 1, {"x": "1"}), 9)  # older than the state
    assert {r.url for r in table.read().collect()} == {"a", "b"}
    assert table.read().columns == [c.split()[0] for c in lifecycle.STATE.split(", ")]


def test_each_site_has_its_own_time(spark, tmp_path):
    """Sites of one batch, and several snapshots of one site; a site's older snapshot is not newer because another site was later."""
    table = monitor.StateTable(spark, f"file://{tmp_path}/t", buckets=4)
    at = lambda h: datetime(2024, 1, 1, h)
    table.apply(snapshot(spark, at(10), {"a": "1"}, "A").union(snapshot(spark, at(12), {"b": "1"}, "B")), 1)
    seen = {r.site_id: r.last_seen_at for r in table.read().collect()}
    assert seen == {"A": at(10), "B": at(12)}
    table.apply(snapshot(spark, at(11), {"a": "2", "a2": "1"}, "A"), 2)
    assert {(r.site_id, r.url): r.last_seen_at for r in table.read().collect()} == {("A", "a"): at(11), ("A", "a2"): at(11), ("B", "b"): at(12)}
    # a page that two snapshots in a row miss is first noted, then removed; and comes back
    batch = snapshot(spark, at(13), {"a": "2"}, "A").union(snapshot(spark, at(14), {"a": "2"}, "A")).union(snapshot(spark, at(15), {"a": "2", "a2": "1"}, "A")).union(snapshot(spark, at(9), {"x": "1"}, "A"))
    table.apply(batch, 3)
    events = [(r.url, r.type, r.created_at) for r in table.events().where("site_id = 'A'").orderBy("created_at", "url").collect()]
    assert events == [("a", "added", at(10)), ("a", "changed", at(11)), ("a2", "added", at(11)), ("a2", "removed", at(14)), ("a2", "added", at(15))]
    assert {r.url: r.removed_at for r in table.read().where("site_id = 'A'").collect()} == {"a": None, "a2": None}
    table.apply(snapshot(spark, at(16), {}, "A"), 4)  # an empty batch
    table.apply(snapshot(spark, at(20), {"x": "1"}, "A"), 4)  # a version that is there
    assert table.versions() == [3, 4] and table.read().count() == 3
    assert table.listed(4) == table.listed(3)


def test_one_failing_site_takes_no_other_with_it(spark, tmp_path):
    ran = []

    def run(due):
        ids = [r.site_id for r in due.collect()]
        if "s7" in ids:
            raise ValueError("seven")
        ran.extend(ids)

    due = spark.createDataFrame([(f"s{i}",) for i in range(20)], "site_id string")
    assert monitor.run_due(due, run) == [("s7", "seven")] and sorted(ran) == sorted(f"s{i}" for i in range(20) if i != 7)
    assert monitor.run_due(due.limit(0), run) == []
    told, sites = [], spark.createDataFrame([("s7", True, datetime(2024, 1, 1)), ("s1", True, datetime(2024, 1, 1)), ("s2", False, datetime(2024, 1, 1))], "site_id string, monitoring_enabled boolean, next_scheduled_crawl_at timestamp")
    ran.clear()
    q = monitor.poll_due(spark, lambda: sites, run, f"{tmp_path}/cp", seconds=1, failed=told.extend)
    until = time.monotonic() + 60
    while not told and time.monotonic() < until:
        time.sleep(0.2)
    q.stop()
    assert told[0] == ("s7", "seven") and set(ran) == {"s1"}


def test_change_counts(spark):
    rows = [("s", datetime(2024, 1, 1, 5), "added"), ("s", datetime(2024, 1, 1, 9), "added"), ("s", datetime(2024, 1, 2), "changed"), ("t", datetime(2024, 1, 1), "removed")]
    got = monitor.change_counts(spark.createDataFrame(rows, "site_id string, created_at timestamp, type string")).collect()
    assert {(r.site_id, r.window.start.day, r.type): r.n for r in got} == {("s", 1, "added"): 2, ("s", 2, "changed"): 1, ("t", 1, "removed"): 1}


WEB = "site_id string, base_url string, site_name string, site_description string, monitoring_enabled boolean, monitoring_frequency string, last_crawled_at timestamp, next_scheduled_crawl_at timestamp, created_at timestamp, updated_at timestamp"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def websites(spark, *ids):
    return spark.createDataFrame([(i, i, None, None, False, "daily", None, None, T0, datetime(2024, 1, 1, 0, n)) for n, i in enumerate(ids)], WEB)


def test_settings_and_reads(spark):
    w, now = websites(spark, "https://a.com", "https://b.com", "https://c.com"), F.lit(T1)
    s = spark.createDataFrame([("https://a.com", True, "hourly"), ("https://b.com", True, "manual"), ("https://c.com", None, "weekly")], "site_id string, enabled boolean, frequency string")
    got = {r.site_id: (r.monitoring_enabled, r.monitoring_frequency, r.next_scheduled_crawl_at) for r in api.monitored(w, s, now).collect()}
    assert got == {"https://a.com": (True, "daily", datetime(2024, 2, 2)), "https://b.com": (True, "manual", None), "https://c.com": (False, "weekly", None)}
    inputs = spark.createDataFrame([("d.com",), ("https://d.com/x",), ("a.com",), ("not a url",), (None,)], "raw string")
    made = api.created(w, inputs, now).collect()
    assert sorted(r.site_id for r in made) == ["https://a.com", "https://b.com", "https://c.com", "https://d.com"] and {r.created_at for r in made if r.site_id == "https://d.com"} == {T1}
    files = spark.createDataFrame([("https://a.com", 1, "old", "{}", T0), ("https://a.com", 2, "new", "{}", T1), ("https://c.com", 1, "c", "{}", T0)], "site_id string, version int, content string, stats string, created_at timestamp")
    assert [(r.site_id, r.content) for r in api.files_of_recent_websites(w, files, 2).collect()] == [("https://c.com", "c")]
    crawls = spark.createDataFrame([("https://a.com", 1, "completed", "done", T0), ("https://a.com", 2, "running", "crawling", T1), ("https://c.com", 1, "completed", "done", T0)], "site_id string, crawl_id long, status string, stage string, started_at timestamp")
    st = {r.site_id: (r.status, r.content) for r in api.status(w, crawls, files).collect()}
    assert st == {"https://a.com": ("running", None), "https://b.com": (None, None), "https://c.com": ("completed", "c")}
    events = spark.createDataFrame([("s", f"u{i}", "added", None, datetime(2024, 1, 1 + i % 3)) for i in range(9)] + [("t", "x", "added", None, T1)], "site_id string, url string, type string, title string, created_at timestamp")
    assert [r.url for r in api.changes(events, "s", 4).collect()] == ["u2", "u5", "u8", "u1"]
    more = site.crawl_created(crawls, w, "scheduled", now)
    assert {(r.site_id, r.crawl_id) for r in more.where("trigger = 'scheduled'").collect()} == {("https://a.com", 3), ("https://b.com", 1), ("https://c.com", 2)} and more.count() == 6


def test_touched_sites(spark):
    w = websites(spark, "a", "b").withColumns({"monitoring_enabled": F.lit(True), "monitoring_frequency": F.lit("weekly"), "site_description": F.lit("old")})
    done = spark.createDataFrame([("a", "Name", None)], "site_id string, site_name string, summary string")
    got = {r.site_id: (r.site_name, r.site_description, r.last_crawled_at, r.next_scheduled_crawl_at) for r in site.touched(w, done, F.lit(T1)).collect()}
    assert got == {"a": ("Name", "old", T1, datetime(2024, 2, 8)), "b": (None, "old", None, None)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_catalog(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = sorted(map(repr, (tuple(r) for r in df.collect())))
    if name not in catalog.SQL:
        assert rows
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows == sorted(map(repr, c.sql(f"select {', '.join(df.columns)} from ({catalog.SQL[name]})").fetchall()))


CUT_PAGES = [(i, f"https://e.com/{i}", f"<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{t}</p></article></body></html>") for i, t in enumerate(("a&amp;b &amp", "a &lt", "a &#x2", "a &#x27", "a &am", "a &#x27;&quot;&gt;", "a &amp;amp", "&"))]


@pytest.mark.parametrize("name", ["extract_main", "extract_metadata"])
def test_references_cut_short(spark, tmp_path, name):
    spark.createDataFrame(CUT_PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, c.sql(f"select {', '.join(df.columns)} from ({catalog.SQL[name]})").fetchall()))


def test_urls_are_settled_before_html_is_read(spark, tmp_path, monkeypatch):
    """URLs are parsed in one pass over short rows; HTML goes into one write, in which no URL is brought to its normal form again."""
    plans, stored = {}, site.stored
    monkeypatch.setattr(site, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or stored(df, name))
    text = "<title>t{0}</title><main><p>" + "some words of page {0} " * 20 + "</p></main>"
    rows = [(7, "https://e.com/docs/a/"), (3, "https://e.com/docs/a?utm_source=x"), (4, "https://e.com/login"), (5, "https://e.com/b.png"), (2, "https://E.com"), (9, "https://f.com/für"), (8, "https://f.com/z"), (1, None), (None, "https://f.com/")]
    spark.createDataFrame([(i, u, text.format(i)) for i, u in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    (e, f) = sorted(site.pages_to_indexes(spark.read.parquet(f"{tmp_path}/pages")).collect())
    assert (e.site_id, e.pages, e.listed, f.pages) == ("https://e.com", 2, 1, 1) and "](https://e.com/docs/a)" in e.content and "# t2\n" in e.content
    assert [n for n, p in plans.items() if "normalize_odd" in p] == ["urls"] and [n for n, p in plans.items() if "html#" in p] == ["crawled"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["sections_curated_out", "exclusion_breakdown", "section_manual_override", "crawl_stats", "thin_nav_filter", "sections_curated"])
def test_texts_are_read_once(spark, name):
    """Whole texts are read by the write of short rows, and no more by what the query runs."""
    assert not [f for f in catalog.QUERIES[name](spark, SF).inputFiles() if "documents" in f]
