"""HTML, robots.txt and sitemaps."""

from pyspark.sql import functions as F

from corpusloom.sources import html, responses, robots, sitemap

PAGE = """<!DOCTYPE html><html><head><title> My  Page </title><meta property="og:title" content=""><meta name="description" content="Said so">
<link rel="canonical" href="/canon"><link rel="alternate" type="text/markdown" href="a.md"></head>
<body><nav><a href="/n">N</a><h1>In nav</h1></nav><div class="tooltip"><p>tip</p></div><main><h2>Two</h2><p>First<p>Second <b>bold</p>
<script>var x = "</p>";</script><ul><li>a<li>b</ul><a href="x.html">x</a><a href="">none</a></main><footer>foot</footer></body></html>"""


def test_raw_page():
    p = html.read_page(PAGE)
    assert p["title_tag"] == " My  Page " and p["og_title"] == "" and p["first_h1"] == "In nav"
    assert p["headings"] == ["In nav", "Two"] and p["hrefs"] == ["/n", "x.html"]
    assert p["paragraph"] == "First"
    assert "foot" not in p["main_text"] and "var x" not in p["main_text"] and "ab" in p["main_text"]


def test_body_without_main_and_callouts():
    p = html.read_page('<p class="note-block">skip</p><section class="multiple"><p>skip too</p></section><p>kept</p>')
    assert p["paragraph"] == "kept" and p["main_text"] == "skipskip tookept"
    assert html.read_page("")["main_text"] == ""


def test_extracted(spark):
    df = spark.createDataFrame([("https://e.com/d/page-one.html", PAGE), ("https://e.com/a-b", "<p>" + "x " * 3), ("https://e.com/", None)], "url string, html string")
    a, b, c = html.extracted(df).collect()
    assert (a.title, a.description, a.canonical_url, a.declared_markdown_alternate) == ("My Page", "Said so", "https://e.com/canon", "https://e.com/d/a.md")
    assert (b.title, b.description, b.word_count, b.first_paragraph) == ("A B", "x x x", 3, "x x x")
    assert (c.title, c.description, c.word_count) == ("e.com", "Page from e.com: e.com", 0)


def test_texts_are_cleaned_as_by_built_in_functions(spark):
    from corpusloom.functions import js

    spaces = "".join(map(chr, [*range(1, 33), 0x7F, 0x85, 0xA0, 0x180E, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
    texts = ["", " ", None, spaces, *(f"{c}a{c}{c}b {c}é{c}" for c in spaces), "x" * 7000 + " y", "😀 " * 4000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", js.clean("t").alias("c"), js.word_count("t").alias("n")).collect()
    for r in rows:
        assert (html.cleaned(texts[r.i]) or "") == r.c and len(html._words(texts[r.i] or "")) == r.n
    page = f"<title> a\u00a0 b</title><h1>\ufeffc  d</h1><main>{'😀 ' * 4000}</main>"
    p = html.page_fields(page)
    assert (p["title_tag"], p["first_h1"], p["headings"], p["word_count"], p["html_chars"]) == ("a b", "c d", ["c d"], 4000, len(page))
    assert p["main_content"] == ("😀 " * 3000) and html.page_fields(None)["html_chars"] is None


def test_empty_shells(spark):
    df = spark.createDataFrame([("https://e.com/1", "<p>" + "<b></b>" * 300), ("https://e.com/2", "<p>x"), ("https://e.com/3", None), ("https://e.com/4", "<p>" + "x " * 800)], "url string, html string")
    for bare in (True, False):
        assert [r.empty_shell for r in html.extracted(df, bare=bare).collect()] == [True, False, None, False]


def test_robots_groups():
    r = robots.parse("User-agent: *\nDisallow: /a\n\nUser-agent: CorpusLoomBot\nUser-agent: x\nAllow: /b # c\nDisallow: /c\nSitemap: https://e.com/s.xml\n")
    assert r == {"fetched": True, "disallow": ["/c"], "allow": ["/b"], "sitemaps": ["https://e.com/s.xml"]}
    joined = robots.parse("User-agent: *\nDisallow:\nUser-agent: other\nDisallow: /x")
    assert joined["disallow"] == ["/x"]  # an empty rule opens no group
    assert robots.parse(None) == {"fetched": False, "disallow": [], "allow": [], "sitemaps": []}


def test_robots_decision(spark):
    rules = spark.createDataFrame([("s", True, ["/docs", "/*?print=", "/x$", "?bad", "/foo?bar", "/eq"], ["/docs/public", "/eq"], []), ("t", False, ["/"], [], [])], "site_id string, fetched boolean, disallow array<string>, allow array<string>, sitemaps array<string>")
    paths = ["/docs/a", "/docs/public/page", "/article?print=1", "/x", "/xy", "/fobar", "/eq", "/", "?bad"]
    df = spark.createDataFrame([("s", p) for p in paths] + [("t", "/a"), ("u", "/a")], "site_id string, path string")
    got = {(r.site_id, r.path): r.allowed for r in robots.decided(df, rules).collect()}
    assert [got["s", p] for p in paths] == [False, True, False, False, True, False, False, True, False]
    assert got["t", "/a"] and got["u", "/a"]


def test_sitemaps(spark):
    urlset = '<?xml version="1.0"?><urlset xmlns="x"><url><loc>https://e.com/a?x=1&amp;y=2</loc><priority>0.8</priority></url><url><loc> https://e.com/b </loc><lastmod>2024</lastmod></url><url><priority>1</priority></url></urlset>'
    index = "<sitemapindex><sitemap><loc>https://e.com/s2.xml</loc></sitemap><sitemap><loc>https://e.com/gone.xml</loc></sitemap><sitemap><loc>https://e.com/sitemap.xml</loc></sitemap></sitemapindex>"
    sites = spark.createDataFrame([("e", "https://e.com"), ("f", "https://f.com")], "site_id string, origin string")
    rules = spark.createDataFrame([("e", ["https://e.com/r.xml"])], "site_id string, sitemaps array<string>")
    files = spark.createDataFrame([("e", "https://e.com/sitemap.xml", True, index), ("e", "https://e.com/s2.xml", True, urlset), ("e", "https://e.com/r.xml", True, "<urlset><url><loc>https://e.com/r</loc></url></urlset>"), ("f", "https://f.com/sitemap.xml", False, urlset)], "site_id string, sitemap_url string, ok boolean, body string")
    got = sitemap.discovered(sites, rules, files).orderBy("site_id", "seq").collect()
    assert [(r.site_id, r.loc, r.priority) for r in got] == [("e", "https://e.com/r", None), ("e", "https://e.com/a?x=1&y=2", 0.8), ("e", "https://e.com/b", None)]


def test_agent_is_case_blind(spark):
    df = spark.createDataFrame([("User-Agent: CORPUSLOOMBOT/2\nDisallow: /z",)], "b string")
    assert df.select(robots.parsed(F.col("b")).alias("r")).first().r.disallow == ["/z"]


ROWS = "url string, status_code int, location string, content_type string, content_length long, body binary, error string"


def test_fetched(spark):
    """Redirects, safety at every hop (by name and by address), lengths, bounds, failures."""
    rows = [
        ("https://a.com/", 200, None, "text/html", None, b"\xc3\xa9" * 6, None),
        ("https://b.com/", 301, "/x", None, None, None, None),
        ("https://b.com/x", 302, "https://evil.com/y", None, None, None, None),
        ("https://evil.com/y", 200, None, "text/html", None, b"never read", None),
        ("https://c.com/", 302, None, None, None, None, None),
        ("https://d.com/", 200, None, "text/html", 99, b"said too long", None),
        ("https://e.com/", None, None, None, None, None, "Request timed out"),
        ("https://f.com/", 302, "https://f.com/", None, None, None, None),
        ("https://g.com/", 404, None, "text/html", None, None, None),
    ]
    names = [r[0] for r in rows if "evil" not in r[0] and not r[0].endswith("x")] + ["https://h.com/", "ftp://i.com/", "http://10.0.0.1/"]
    hosts = [(n.split("/")[2], "93.184.216.34") for n in names if n.startswith("https")] + [("evil.com", "10.1.1.1")]
    asked = spark.createDataFrame([(n,) for n in names], "url string")
    got = {r.url: r for r in responses.fetched(asked, spark.createDataFrame(rows, ROWS), 9, 5, spark.createDataFrame(hosts, "host string, ip string")).collect()}
    assert set(got) == set(names) and [n for n in names if got[n].ok] == ["https://a.com/"]
    assert got["https://a.com/"].truncated and got["https://a.com/"].body == "éééé\ufffd"
    assert got["https://b.com/"].final_url == "https://evil.com/y" and "10.1.1.1" in got["https://b.com/"].error and got["https://b.com/"].error.startswith("Blocked for safety")
    assert got["https://c.com/"].error == "Redirect (302) with no Location header" and got["https://d.com/"].error == "Response too large" and got["https://d.com/"].body == ""
    assert got["https://e.com/"].error == "Request timed out" and got["https://f.com/"].error == "Too many redirects"
    assert (got["https://g.com/"].status_code, got["https://g.com/"].error, got["https://h.com/"].error) == (404, None, "no response")
    assert got["ftp://i.com/"].error.startswith("Blocked for safety") and got["http://10.0.0.1/"].status_code == 0
    assert responses.fetched(asked.limit(0), spark.createDataFrame(rows, ROWS)).collect() == []


def test_rendered_pages_take_the_place_of_shells(spark):
    pages = spark.createDataFrame([("a", "<shell>", True), ("b", "<full>", False), ("c", "<shell>", True), ("d", "<shell>", True)], "url string, html string, empty_shell boolean")
    made = spark.createDataFrame([("a", "<made>"), ("b", "<made>"), ("d", "")], "url string, html string")
    got = {r.url: (r.html, r.was_rendered) for r in responses.with_rendered(pages, made).collect()}
    assert got == {"a": ("<made>", True), "b": ("<full>", False), "c": ("<shell>", False), "d": ("<shell>", False)}


def test_downloads(spark, tmp_path):
    files = spark.createDataFrame([("https://a.com", 1, "old"), ("https://a.com", 2, "# New\n\nline\n"), ("b", 1, "# B")], "site_id string, version int, content string")
    got = {r.site_id: (r.content, r.file_name, r.content_type) for r in responses.downloads(files).collect()}
    assert got == {"https://a.com": ("# New\n\nline\n", "llms.txt", "text/markdown; charset=utf-8"), "b": ("# B", "llms.txt", "text/markdown; charset=utf-8")}
    responses.write_downloads(files, f"file://{tmp_path}/out")
    texts = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("site=*/part-*")}
    assert texts == {"site=https_a.com": "# New\n\nline\n", "site=b": "# B\n"}
