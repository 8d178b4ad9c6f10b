"""Column functions, on literal cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import js, net, text, urls
from corpusloom.operators import classify


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_knows_web_white_space(spark):
    assert apply(spark, ["  a  b﻿\n", None, " ", "a b"], js.clean) == ["a b", "", "", "a b"]


def test_shorten(spark):
    assert apply(spark, ["abcdef", "abc", "ab  cdef"], lambda c: js.shorten(c, 4)) == ["abc…", "abc", "ab…"]
    assert apply(spark, ["aaaa bbbb cccc", "aaaaaaaaaaaaaa"], lambda c: js.shorten_at_word(c, 10)) == ["aaaa bbbb…", "aaaaaaaaaa…"]


CASES = [
    ("https://example.com/docs/?utm_source=x#top", "https://example.com/docs"),
    ("https://EXAMPLE.com:443/page", "https://example.com/page"),
    ("http://example.com:80", "http://example.com/"),
    ("https://example.com/a?b=2&a=1&fbclid=z", "https://example.com/a?a=1&b=2"),
    ("https://example.com/a?trkCampaign=1", "https://example.com/a?trkCampaign=1"),
    ("https://example.com/a//", "https://example.com/a"),
    ("https://example.com/?a", "https://example.com/?a="),
    ("https://example.com/a?", "https://example.com/a"),
    ("/x/../y?q=1#z", "https://base.com/y?q=1"),
    ("page.html", "https://base.com/dir/page.html"),
    ("../up", "https://base.com/up"),
    ("//other.com/z", "https://other.com/z"),
    ("?q=a b", "https://base.com/dir/index.html?q=a+b"),
    ("https://example.com/café?x=é", "https://example.com/caf%C3%A9?x=%C3%A9"),
    ("https://example.com/a b", "https://example.com/a%20b"),
    ("mailto:a@b.c", None),
    ("javascript:void(0)", None),
    ("http://", None),
    ("http://1.2.3/", "http://1.2.0.3/"),
    (None, None),
]


def test_normal_form(spark):
    base = F.lit("https://base.com/dir/index.html")
    assert apply(spark, [a for a, _ in CASES], lambda c: urls.normalized(c, base)) == [b for _, b in CASES]


def test_native_and_odd_paths_agree(spark):
    plain = [a for a, _ in CASES if a and a.startswith("http")]
    native = apply(spark, plain, lambda c: urls.normalized(c, None, odd=False))
    for raw, got in zip(plain, native):
        if got is not None:
            assert got == urls.normal_form(raw, None)


def test_shapes(spark):
    pages = ["https://e.com/login", "https://e.com/loginform", "https://e.com/search?x=1", "https://e.com/a?page=2", "https://e.com/a?page=1", "https://e.com/a?page=x&p=3", "https://e.com/a?p=3", "https://e.com/a?start=0", "https://e.com/page/7/", "https://e.com/cart", "https://e.com/cookie-policy", "https://e.com/"]
    want = ["auth", None, "search-results", "pagination", None, None, "pagination", "pagination", "pagination", "low-priority-utility", "low-priority-utility", None]
    assert apply(spark, pages, lambda c: urls.exclusion_reason(c, F.lit(True))) == want
    assert apply(spark, pages[:1], lambda c: urls.exclusion_reason(c, F.lit(False))) == ["excluded-by-robots"]


def test_assets_sites_origins(spark):
    assert apply(spark, ["https://e.com/a.PDF", "https://e.com/a", "x", "https://e.com/v1.2/a"], urls.is_asset) == [True, False, True, False]
    assert apply(spark, ["https://www.e.com/a", "https://f.com"], lambda c: urls.same_site(c, F.lit("https://e.com"))) == [True, False]
    assert apply(spark, ["HTTPS://WWW.E.com:8080/x", "https://e.com:443/"], urls.origin) == ["https://www.e.com:8080", "https://e.com"]


def test_priority(spark):
    got = apply(spark, ["https://e.com/", "https://e.com/docs/a", "https://e.com/DOCS", "https://e.com/search/page/2"], lambda c: urls.discovery_priority(c, F.lit(2), F.lit(0.5)))
    assert got == [29.0, 21.0, -1.0, -36.0]


def test_markdown_candidates(spark):
    assert apply(spark, ["https://e.com/", "https://e.com/a.html?x#y", "https://e.com/a.md"], urls.markdown_candidates) == [["https://e.com/index.md"], ["https://e.com/a.html.md", "https://e.com/a.md"], ["https://e.com/a.md.md"]]


def test_input(spark):
    got = apply(spark, [" https://E.com/x ", "ftp://e.com", "nonsense"], urls.checked_input)
    assert [(r.ok, r.origin) for r in got] == [(True, "https://e.com"), (False, None), (False, None)]
    assert apply(spark, ["e.com", "http://e.com"], urls.completed) == ["https://e.com", "http://e.com"]


@pytest.mark.parametrize(("ip", "private"), [("10.1.2.3", True), ("8.8.8.8", False), ("172.31.0.1", True), ("172.32.0.1", False), ("::1", True), ("fd00:ec2::254", True), ("2001:4860::8888", False), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False), ("rubbish", True), (None, True), ("1.2.3.256", True)])
def test_private(spark, ip, private):
    assert apply(spark, [ip], net.is_private) == [private]


def test_url_safety(spark):
    c = spark.createDataFrame([(u,) for u in ("https://good.com/", "https://bad.com/", "https://gone.com/", "http://localhost/", "http://127.0.0.1/", "ftp://x.com/", "http://8.8.8.8/")], "url string")
    dns = spark.createDataFrame([("good.com", "8.8.8.8"), ("bad.com", "8.8.8.8"), ("bad.com", "10.0.0.1")], "host string, ip string")
    got = {r.url: r.safe for r in net.checked(c, dns).collect()}
    assert got == {"https://good.com/": True, "https://bad.com/": False, "https://gone.com/": False, "http://localhost/": False, "http://127.0.0.1/": False, "ftp://x.com/": False, "http://8.8.8.8/": True}


def test_titles(spark):
    assert apply(spark, ["https://e.com/a/getting-started_now.html", "https://e.com/", "https://e.com/a.b c/x.y"], text.title_from_url) == ["Getting Started Now", "e.com", "X"]


def test_hash_ignores_case_and_space(spark):
    a, b = apply(spark, ["A  b\n", "a b"], lambda c: text.content_hash(c, F.lit("x"), F.lit("")))
    assert a == b


def test_times(spark):
    now = F.lit(datetime(2024, 6, 1)).cast("timestamp")
    times = [None, datetime(2024, 5, 31, 23, 59, 57), datetime(2024, 5, 31, 23, 59, 20), datetime(2024, 5, 31, 23, 30), datetime(2024, 5, 31, 2), datetime(2024, 5, 29), datetime(2024, 1, 5)]
    assert apply(spark, times, lambda c: text.relative_time(c, now), "timestamp") == ["never", "just now", "40s ago", "30m ago", "22h ago", "3d ago", "Jan 5, 2024"]
    later = [None, datetime(2024, 5, 1), datetime(2024, 6, 1, 5), datetime(2024, 6, 4)]
    assert apply(spark, later, lambda c: text.future_time(c, now), "timestamp") == ["—", "due now", "in 5h", "in 3d"]


def test_categories(spark):
    rows = [("https://e.com/docs/x", "t"), ("https://e.com/Docs/x", "t"), ("https://e.com/x", "A Tutorial"), ("https://e.com/x", "guideé x"), ("https://e.com/news", "t"), ("https://e.com/x", "guides")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, title string")
    got = [(r.c.category, r.c.confident) for r in df.select("i", classify.category(F.col("url"), F.col("title"), F.array()).alias("c")).orderBy("i").collect()]
    assert got == [("Documentation", True), ("Resources", False), ("Guides", True), ("Guides", True), ("Blog", True), ("Resources", False)]


def test_importance(spark):
    df = spark.createDataFrame([(True, "Documentation", 0, 900, 30, True), (False, "Other", 9, 10, 0, False), (False, "Blog", 1, 301, 1, False)], "h boolean, c string, d int, w int, i long, m boolean")
    got = [r.s for r in df.select(classify.importance(*[F.col(x) for x in "hcdwim"]).alias("s")).collect()]
    assert got == [116.0, 0.0, 18.0]
