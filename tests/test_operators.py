"""Curation, rendering, validation, lifecycle: cases and random inputs against plain models."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from corpusloom.operators import classify, filters, lifecycle, links, refine, render, sections, validate
from corpusloom.plans import site

CANDIDATE = "site_id string, ord long, url string, markdown_url string, title string, description string, category string, importance_score double, is_home boolean, section_override string"


def candidates(spark, rows):
    return spark.createDataFrame([(s, o, f"https://{s}.com/{o}", None, f"t{o}", "d", c, float(x), h, m) for s, o, c, x, h, m in rows], CANDIDATE)


def model(rows):
    """Curation of one site, row by row."""
    auto = [r for r in rows if not (r[5] or "").strip() and not r[4]]
    out, spare, total = {}, [r for r in auto if r[3] < 20], 0
    for name in classify.CATEGORIES:
        bucket = sorted((r for r in auto if r[3] >= 20 and r[2] == name), key=lambda r: -r[3])
        kept = bucket[:8][: max(0, 60 - total)]
        spare += bucket[8:]
        total += len(kept)
        out |= {r[1]: name for r in kept}
    spare.sort(key=lambda r: -r[3])
    out |= {r[1]: "Optional" for r in spare[: min(12, 60 - total)]}
    gone = {r[1] for r in auto if r[1] not in out and (r[3] < 20 or r[2] in classify.CATEGORIES)}
    return out | {r[1]: r[5].strip() for r in rows if (r[5] or "").strip() and not r[4]}, gone


def test_sections_against_model(spark):
    rng = random.Random(4)
    rows = []
    for s in range(40):
        n = rng.choice((0, 3, 30, 120, 260))
        rows += [(f"s{s}", o, rng.choice([*classify.CATEGORIES, "Strange"]), rng.randint(0, 60), rng.random() < 0.02, rng.choice((None, None, None, None, "", " ", "Mine", "Guides"))) for o in range(n)]
    got = sections.curated(candidates(spark, rows)).collect()
    for s in {r[0] for r in rows}:
        want, gone = model([r for r in rows if r[0] == s])
        assert {r.ord: r.section for r in got if r.site_id == s and r.section} == want
        assert {r.ord for r in got if r.site_id == s and r.curated_out} == gone


def test_section_order_and_rendering(spark):
    rows = [("a", 1, "Guides", 50, False, None), ("a", 2, "Guides", 60, False, None), ("a", 3, "Blog", 10, False, None), ("a", 4, "Blog", 50, False, "zeta"), ("a", 5, "Blog", 50, False, "Alpha"), ("a", 6, "Blog", 90, True, None)]
    listed = sections.links(sections.curated(candidates(spark, rows)))
    meta = spark.createDataFrame([("a", " Name ", "Sum", None), ("b", "Empty", "", "Det")], "site_id string, site_name string, summary string, details string")
    got = {r.site_id: r.content for r in render.rendered(meta, listed).collect()}
    heads = [x for x in got["a"].split("\n") if x.startswith("#")]
    assert heads == ["# Name", "## Guides", "## Alpha", "## zeta", "## Optional"]
    assert "- [t2](https://a.com/2): d\n- [t1](https://a.com/1): d" in got["a"]
    assert got["b"] == "# Empty\n\nDet\n"
    v = {r.site_id: r for r in validate.validated(render.rendered(meta, listed)).collect()}
    assert v["a"].valid and v["a"].link_count == 5 and v["a"].section_count == 4 and v["b"].valid
    doc = {r.site_id: r.sections for r in render.documents(meta, listed).collect()}
    assert [x.name for x in doc["a"]] and doc["b"] is None


def issues(spark, content):
    r = validate.validated(spark.createDataFrame([("x", content)], "site_id string, content string")).first()
    return r.valid, [(i.level, i.message) for i in r.issues]


def test_validation(spark):
    assert issues(spark, "# T\n\n## A\n- [x](https://e.com)\n") == (True, [])
    assert issues(spark, "## A\n- [x](https://e.com)\n# T") == (False, [("error", 'Section "A" appears before the H1 title')])
    assert issues(spark, "# T\n## A\n## B\n- [x](u)\n* l\n- [y](https://e.com)\n- [z](https://e.com)") == (
        False,
        [("error", 'Section "A" has no links'), ("error", 'Invalid link URL: "u"'), ("warning", 'List item doesn\'t match "- [Title](url): description": "* l"'), ("error", "Duplicate URLs: https://e.com")],
    )
    assert issues(spark, "") == (False, [("error", "Missing the required H1 site/project title")])
    assert issues(spark, "# T\n# U\n") == (False, [("error", "Found 2 H1 headings — exactly one is allowed")])
    assert issues(spark, None)[0] is False


def test_duplicates_thin_navigation(spark):
    rows = [("s", 1, "u1", "t", 500, "h", 10.0, False), ("s", 2, "u2", "t", 500, "h", 50.0, False), ("s", 3, "u3", "t", 10, "k", 1.0, False), ("s", 4, "u4", "t", 10, "m", 1.0, True), ("s", 5, "u5", "Site Map", 100, "n", 1.0, False), ("s", 6, "u6", "t", 500, "", 1.0, False), ("s", 7, "u7", "t", 500, "", 1.0, False), ("s", 8, "u2", "t", 500, "h", 50.0, False)]
    df = spark.createDataFrame(rows, "site_id string, ord long, url string, title string, word_count int, content_hash string, importance_score double, is_home boolean")
    got = {r.ord: r.reason for r in filters.content_reasons(df).collect()}
    assert got == {1: "duplicate", 2: "duplicate", 3: "thin-content", 4: None, 5: "navigation", 6: None, 7: None, 8: "duplicate"}  # rows of one URL go together


def test_inbound(spark):
    rows = [("s", "https://e.com/a", ["/b", "/b", "/c", "/a", "mailto:x"]), ("s", "https://e.com/b", ["c", "https://f.com/x"]), ("s", "https://e.com/c", [])]
    df = spark.createDataFrame(rows, "site_id string, url string, internal_links array<string>")
    assert {r.url: r.inbound_links for r in links.inbound_counts(df).collect()} == {"https://e.com/b": 2, "https://e.com/c": 2}


ODD_LINKS = ["/b", "/b#x", "/d/c", "c", "../b", "?q=1", "#top", "//e.com/b", "https://e.com/d/c", "HTTP://E.com:80/b/", "http://e.com/b", "http:b", "/\\t/e.com/b", "/\\e.com/b", " /b", "/für", "/a b", "/./b", "mailto:x@e.com", "javascript:;", "", None]
ODD_PAGES = ["https://e.com/", "https://e.com/b", "https://e.com/d/c", "http://e.com/b", "http://e.com/d/c", "https://e.com/f%C3%BCr", "https://e.com/?q=1", "http://[::1]/b", None]


def test_inbound_against_each_link_by_itself(spark, monkeypatch):
    from corpusloom.functions import urls

    rng, rows = random.Random(12), []
    for site in ("s", "t"):
        rows += [(site, u, None if rng.random() < 0.1 else [rng.choice(ODD_LINKS) for _ in range(rng.randrange(25))]) for u in ODD_PAGES for _ in range(2)]
    known, want = {(s, u) for s, u, _ in rows if u}, {}
    for s, u, hrefs in rows:
        for h in hrefs or ():
            t = urls.normal_form(h, u) if u and h is not None else None
            if (s, t) in known and t != u:
                want[s, t] = want.get((s, t), 0) + 1
    df = spark.createDataFrame(rows, "site_id string, url string, internal_links array<string>")
    assert len(want) > 9 and {(r.site_id, r.url): r.inbound_links for r in links.inbound_counts(df).collect()} == want


def test_what_all_pages_link_to_is_parsed_once(spark, monkeypatch):
    parsed = []
    monkeypatch.setattr(links, "stored", lambda df, name: parsed.append(df.count()) or df, raising=False)
    rows = [("s", f"https://e.com/{i}", ["/a", "https://e.com/0", f"/{i}"]) for i in range(40)]
    got = links.inbound_counts(spark.createDataFrame(rows, "site_id string, url string, internal_links array<string>")).collect()
    assert [(r.url, r.inbound_links) for r in got] == [("https://e.com/0", 39)]
    assert parsed == [1 + 1 + 40]


def test_generic_descriptions(spark):
    rows = [("s", i, "same", "para number " + str(i) if i else "same", False, False, False) for i in range(3)] + [("s", 3, "own", "p", False, False, False), ("s", 4, "same", "p", False, False, True)]
    df = spark.createDataFrame(rows, "site_id string, ord long, description string, first_paragraph string, reused boolean, manual_edit boolean, is_home boolean")
    assert {r.ord: r.description for r in refine.without_generic_descriptions(df).collect()} == {0: "", 1: "para number 1", 2: "para number 2", 3: "own", 4: "same"}


def test_verdict_batches(spark):
    asked = spark.createDataFrame([("s", f"u{i}", i) for i in range(14)], "site_id string, url string, ord long")
    v = [("s", 0, "u0", "Guides", "high", "d", True), ("s", 0, "invented", "Guides", "low", "d", True), ("s", 1, "u12", "Guides", "low", "d", True), ("s", 1, "u13", "Nonsense", "low", "d", True)]
    df = spark.createDataFrame(v, "site_id string, batch long, url string, category string, importance string, description string, include boolean")
    assert [r.url for r in refine.valid_verdicts(df, asked).collect()] == ["u0"]


def test_diff(spark):
    a = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", "3"), ("s", "n", None)], "site_id string, url string, content_hash string")
    b = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2x"), ("s", "d", "4"), ("s", "n", "5")], "site_id string, url string, content_hash string")
    assert {r.url: r.change for r in lifecycle.diff(a, b).collect()} == {"a": "unchanged", "b": "changed", "c": "missing", "d": "added", "n": "changed"}


def crawl(spark, pages):
    rows = [("s", i, u, h, False) for i, (u, h) in enumerate(pages.items())]
    df = spark.createDataFrame(rows, "site_id string, ord long, url string, content_hash string, reused boolean")
    kinds = {c.split()[0]: c.split(" ", 1)[1] for c in lifecycle.STATE.split(", ")}
    return df.withColumns({c: F.lit(True if c == "included" else None).cast(kinds[c]) for c in lifecycle.FETCHED if c != "content_hash"})


def test_three_crawls(spark):
    """A page that is gone twice is removed; one that comes back is added anew."""
    state, pre = site.no_state(spark), spark.createDataFrame([], "site_id string, url string, reason string, depth int")
    told = []
    for n, pages in enumerate(({"a": "1", "b": "1"}, {"a": "2"}, {"a": "2"}, {"a": "2", "b": "1"})):
        w, now = crawl(spark, pages), F.lit(datetime(2024, 1, n + 1)).cast("timestamp")
        told.append(sorted((r.url, r.type) for r in lifecycle.change_events(state, w, pre, now).collect()))
        rows = lifecycle.next_state(state, w, pre, now).collect()
        state = spark.createDataFrame(rows, lifecycle.STATE)
        b = next(r for r in rows if r.url == "b")
        assert (b.missing_since is not None, b.removed_at is not None) == ((False, False), (True, False), (True, True), (False, False))[n]
    assert told == [[("a", "added"), ("b", "added")], [("a", "changed")], [("b", "removed")], [("b", "added")]]


def test_pre_excluded_and_edits(spark):
    w, now = crawl(spark, {"a": "1", "b": "1"}), F.lit(datetime(2024, 1, 1)).cast("timestamp")
    pre = spark.createDataFrame([("s", "b", "auth", 1), ("s", "c", "auth", 2)], "site_id string, url string, reason string, depth int")
    state = lifecycle.next_state(site.no_state(spark), w, pre, now)
    assert {r.url: (r.included, r.exclude_reason) for r in state.collect()} == {"a": (True, None), "b": (False, "auth"), "c": (False, "auth")}
    edits = spark.createDataFrame([("s", "a", None, " Mine ", False, None), ("s", "b", "new", None, False, True), ("s", "c", None, None, False, None)], "site_id string, url string, description string, section string, clear_section boolean, included boolean")
    got = {r.url: (r.section_override, r.description, r.included, r.exclude_reason, r.manual_edit) for r in lifecycle.edited(state, edits).collect()}
    assert got == {"a": ("Mine", None, True, None, True), "b": (None, "new", True, None, True), "c": (None, None, False, "auth", False)}


def test_reuse_and_manual_edit(spark):
    """What a person curated stays when the content changes, and is scored anew."""
    page = ("s", 1, "https://e.com/docs/x", "T", "D", "main", [], 300, 1, False, None, None, None, None)
    ddl = "site_id string, ord long, url string, title string, description string, main_content string, headings array<string>, word_count int, depth int, is_home boolean, canonical_url string, declared_markdown_alternate string, markdown_url string, first_paragraph string"
    df = spark.createDataFrame([page], ddl)
    for same, edited, want in ((False, True, ("Guides", False, True)), (False, False, ("Documentation", False, False))):
        old = site.no_state(spark)
        row = {"site_id": "s", "url": page[2], "content_hash": "x" if not same else None, "category": "Guides", "importance_score": 40.0, "included": True, "analysis_source": "deterministic", "manual_edit": edited, "title": "", "description": ""}
        old = spark.createDataFrame([tuple(row.get(c) for c in old.columns)], old.schema)
        r = refine.classified(df, old).first()
        assert (r.category, r.reused, r.manual_edit) == want and r.title == "T"


def test_versions(spark):
    files = spark.createDataFrame([("a", 1), ("a", 4)], "site_id string, version int")
    new = spark.createDataFrame([("a", "x"), ("b", "y")], "site_id string, content string")
    assert {r.site_id: r.version for r in lifecycle.appended_versions(files, new).collect()} == {"a": 5, "b": 1}


def test_prompt(spark):
    rows = [("s", i, f"https://s.com/{i}", f"t{i}" if i else "", None if i else "said", ["h1", "h2"] if i else [], "x" * 900 if i else "") for i in range(14)]
    got = {r.batch: r.request for r in refine.prompt(spark.createDataFrame(rows, "site_id string, ord long, url string, title string, description string, headings array<string>, content_excerpt string")).collect()}
    assert set(got) == {0, 1} and got[0].count("### Page ") == 12 and got[1].startswith("### Page 1\nURL: https://s.com/12\nTitle: t12\nDescription: (none)\nHeadings: h1, h2\nContent excerpt:\n" + "x" * 800 + "\n\n### Page 2")
    assert got[0].startswith("### Page 1\nURL: https://s.com/0\nTitle: (none)\nDescription: said\nHeadings: (none)\nContent excerpt:\n(empty)\n\n### Page 2\n")


def test_renamed_section(spark):
    rows = spark.createDataFrame([("s", "a", "Guides"), ("s", "b", "Docs"), ("t", "c", "Guides")], "site_id string, url string, section string")
    got = lifecycle.renamed_section(rows, "s", "Guides", "How to").collect()
    assert [(r.site_id, r.url, r.section, r.description, r.included) for r in got] == [("s", "a", "How to", None, None)]


def test_an_unchanged_description_is_no_edit(spark):
    names = [c.split() for c in lifecycle.STATE.split(", ")]
    row = {"site_id": "s", "url": "a", "description": "same", "included": True, "manual_edit": False}
    state = spark.createDataFrame([tuple(row.get(n[0]) for n in names)], lifecycle.STATE)
    edit = lambda d, i=None: spark.createDataFrame([("s", "a", d, None, False, i)], "site_id string, url string, description string, section string, clear_section boolean, included boolean")
    assert [lifecycle.edited(state, e).first().manual_edit for e in (edit("same"), edit("other"), edit("same", True))] == [False, True, True]
