"""Compaction, quotation linking, the pipeline's stages, and queries against their SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from corpusloom.llm import quotes, queries, shards
from corpusloom.llm.common import scratch

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def arrivals(spark, lots, size=40):
    return [spark.createDataFrame([(k * size + i, f"text {i} " * 20, "en", None, i) for i in range(size)], DDL).coalesce(2) for k in range(lots)]


def test_compaction(spark):
    store = shards.ShardStore(spark, scratch(spark, "store"), target_bytes=64 << 10, fanout=3)
    for n, a in enumerate(arrivals(spark, 10), 1):
        m = store.append(a)
        tiers = [r["tier"] for r in m["runs"]]
        assert max(map(tiers.count, tiers)) < 3
        assert sum(r["rows"] for r in m["runs"]) == 40 * n
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(400))
    assert len(store.manifest()["runs"]) < 10


def test_merged_files_have_about_the_target_size(spark):
    rows = [(i, os.urandom(400).hex(), "en", "s", 1) for i in range(2000)]
    store = shards.ShardStore(spark, scratch(spark, "store"), target_bytes=256 << 10, fanout=2)
    df = spark.createDataFrame(rows, DDL)
    store.append(df.where("doc_id % 2 = 0").repartition(20))
    m = store.append(df.where("doc_id % 2 = 1").repartition(20))
    (run,) = m["runs"]
    files = [f for f in os.listdir(run["folder"].removeprefix("file:")) if f.startswith("part-")]
    assert len(files) <= -(-run["bytes"] // (256 << 10)) + 1 and run["rows"] == 2000


def test_versions_are_atomic(spark):
    store = shards.ShardStore(spark, scratch(spark, "store"), fanout=10)
    one, two, three = arrivals(spark, 3)
    old = store.append(one)
    store.append(two)
    with pytest.raises(shards.Conflict, match="there already"):
        store.commit(old, [])  # another writer has made this version
    assert store.read().count() == 80 and store.read(1).count() == 40
    three.write.parquet(f"{store.path}/runs/left-by-a-lost-writer")
    assert store.read().count() == 80
    assert store.vacuum() == [] and store.read(1).count() == 40  # all is younger than a day
    gone = store.vacuum(keep=1, older_than=0)
    assert [x.rsplit("/", 1)[1] for x in gone] == ["left-by-a-lost-writer"]  # run one is a part of version 2 too
    assert store.versions() == [2] and store.read().count() == 80


def lots(spark, low, high, rows=50):
    return spark.createDataFrame([(k * 1000 + i, f"text {i} " * 5, "en", "s", i, k) for k in range(low, high) for i in range(rows)], DDL + ", lot int")


def test_many_arrivals_at_once_and_again(spark):
    """Two calls whose lots have the same names, over runs of mixed tiers; a reader of an old version keeps its rows."""
    store = shards.ShardStore(spark, scratch(spark, "store"), target_bytes=32 << 10, fanout=4)
    first = store.append_by(lots(spark, 0, 3), "lot")
    assert first["version"] == 1 and [r["rows"] for r in first["runs"]] == [50] * 3
    reader = store.read(1)
    m = store.append_by(lots(spark, 8, 12), "lot")  # lot=10 after lot=9
    assert sum(r["rows"] for r in m["runs"]) == 350 and len(m["runs"]) == 1
    assert [len({r["folder"] for r in store.manifest(v)["runs"]}) for v in store.versions()] == [3, 7, 1]
    assert [r["folder"].rsplit("=", 1)[1] for r in store.manifest(2)["runs"]] == ["0", "1", "2", "8", "9", "10", "11"]
    m = store.append_by(lots(spark, 0, 2), "lot")
    assert sum(r["rows"] for r in m["runs"]) == 450 == store.read().count() and len({r["id"] for r in m["runs"]}) == len(m["runs"]) == 3
    assert reader.count() == 150
    store.vacuum(keep=1, older_than=0)
    assert store.read().count() == 450 and store.read().select("doc_id").distinct().count() == 350 and store.read().columns == [x.split()[0] for x in DDL.split(", ")]


def test_writers_that_meet(spark, monkeypatch):
    """A commit that another writer was faster with is tried again; a merge whose parts are gone is dropped."""
    store = shards.ShardStore(spark, scratch(spark, "store"), fanout=2)
    other = shards.ShardStore(spark, store.path, fanout=10)
    a, b, c, d = arrivals(spark, 4)
    real, todo = store.manifest, [lambda: other.append(b)]

    def late(version=None):
        got = real(version)
        if todo:
            todo.pop()()
        return got

    monkeypatch.setattr(store, "manifest", late)
    m = store.append(a)
    assert sum(r["rows"] for r in m["runs"]) == 80 == store.read().count() and len(m["runs"]) == 1
    other.append(c)
    monkeypatch.setattr(store, "merged", lambda parts, schema, f=store.merged: (f(parts, schema), *(other._merge(real(), real()["runs"]) for _ in todo2 if todo2.pop()))[0])
    todo2 = [1]
    m = store.append(d)
    assert sum(r["rows"] for r in m["runs"]) == 160 == store.read().count()
    with pytest.raises(ValueError, match="other columns"):
        store.append(a.drop("lang"))


def test_empty_and_odd_arrivals(spark):
    empty = spark.createDataFrame([], DDL)
    store, rows = shards.compacted(empty, 4)
    assert rows.count() == 0
    with pytest.raises(ValueError, match="no columns"):
        shards.ShardStore(spark, scratch(spark, "store")).read()
    df = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)], DDL)
    store, rows = shards.compacted(df, 4)
    assert sorted(map(repr, rows.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    store = shards.ShardStore(spark, scratch(spark, "store"), fanout=2)
    store.append(empty)
    m = store.append(empty)
    assert sum(r["rows"] for r in m["runs"]) == 0


TALK = [
    (1, 0, "user", "Hello there my friend. How are you today?"),
    (1, 1, "assistant", "> How are you today?\nI am fine, thanks."),
    (1, 2, "user", "Something else entirely, said out loud."),
    (1, 3, "user", "On Monday bob wrote:\n> > How are you\n> > today?\n> I am fine,\n> thanks.\nGood to hear."),
    (1, 4, "assistant", "> Good to hear.\nYes."),
    (1, 5, "user", "bob wrote:\nthis is no quote"),
    (2, 0, "user", "> Something else entirely, said out loud.\nReplying elsewhere"),
    (2, 1, None, None),
    (2, 2, "user", ""),
    (None, 1, "user", "> hi there"),
    (3, None, "user", "x"),
    (2, 1, None, None),
    (4, 7, "user", "A sentence that stands in two places. Yes."),
    (6, 1, "user", "A sentence that stands in two places."),
    (7, 0, "user", "> A sentence that stands\n> in two places.\nWho said it?"),
    (7, 1, "user", "> Yes.\nToo little to tell whose it is."),
    (7, 2, "user", ">> Who said it?\n> Unknown.\nDeep in the same talk."),
    (2, 3, "user", ">> nothing\n> Unknown words here.\n"),
]


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, lines string, position int")


def test_quotes(spark):
    got = {(r.conv_id, r.position): r for r in quotes.reply_ordered(talk(spark, TALK)).collect()}
    order = [got[1, k].turn for k in range(6)]
    assert order == [0, 1, 3, 4, 2, 5]
    assert [got[1, k].reply_to for k in range(6)] == [None, 0, 1, 3, None, None]
    assert [got[1, k].depth for k in range(6)] == [0, 1, 2, 3, 0, 0]
    assert got[1, 2].text == "Good to hear." and got[1, 2].quote_levels == 2 and got[1, 2].quoted_lines == 4
    assert got[1, 5].text == "bob wrote:\nthis is no quote"
    assert (got[2, 0].linked_conv, got[2, 0].linked_turn, got[2, 0].reply_to) == (1, 2, None)
    links = {(r.conv_id, r.turn): (r.linked_conv, r.linked_turn, r.reply_to) for r in got.values()}
    assert [links[7, k] for k in range(3)] == [(6, 1, None), (None, None, None), (7, 0, 0)]  # the earlier turn, not the smaller conversation
    assert len(got) == len(TALK)
    assert quotes.reply_ordered(talk(spark, [])).collect() == []
    lines = {(r.conv_id, r.position): r.line for r in quotes.chat_lines(talk(spark, TALK)).collect()}
    assert lines[1, 1] == "<|assistant|>\nI am fine, thanks." and lines[2, 1] == "<|user|>\n"


def test_quotes_against_sql(spark):
    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", TALK)
    df = quotes.reply_ordered(talk(spark, TALK))
    want = c.sql(f"select {', '.join(df.columns)} from ({queries.SQL['op10_quotes']})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


def test_deeper_quotes(spark):
    rows = [
        (1, 0, "user", "The first words here."),
        (1, 1, "user", "Another message of the talk."),
        (1, 2, "user", ">> The first words here.\nOnly deep quotes."),
        (1, 3, "user", ">> Another message of the talk.\n> Lost words of nobody.\nUnknown above."),
        (1, 4, "user", ">> The first words here.\n> Another message of the talk.\nBoth are known."),
        (2, 0, "user", ">>> Another message of the talk.\nFrom afar."),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(talk(spark, rows)).collect()}
    assert [got[1, k].reply_to for k in range(5)] == [None, None, 0, 1, 1] and [got[1, k].root for k in range(5)] == [0, 1, 0, 1, 1]
    assert (got[2, 0].linked_conv, got[2, 0].linked_turn, got[2, 0].reply_to) == (1, 1, None)


def test_a_time_tells_the_origin(spark):
    rows = [(1, 0, "user", "A sentence that stands in two places.", 20), (2, 5, "user", "A sentence that stands in two places.", 10), (3, 0, "user", "> A sentence that stands in two places.", None)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at int")
    of = lambda df: next((r.linked_conv, r.linked_turn) for r in df.collect() if r.conv_id == 3)
    assert of(quotes.reply_ordered(m)) == (1, 0) and of(quotes.reply_ordered(m, "at")) == (2, 5)


def test_equal_hashes_are_no_quotes(spark):
    """A passage counts only if its text is the same, whatever its hash."""
    s = spark.createDataFrame([(1, 0, 0, 9, "one two", 2), (1, 1, 1, 9, "not the same", 3), (1, 2, 1, 9, "one two", 2)], "conv_id long, turn long, level int, key long, s string, words int")
    assert [tuple(r) for r in quotes._replies(s).collect()] == [(1, 2, 1, 0)]


def test_long_reply_chain(spark):
    rows = [(1, i, "user", (f"> message number {i - 1} is here.\n" if i else "") + f"message number {i} is here.") for i in range(70)]
    got = quotes.reply_ordered(talk(spark, rows)).collect()
    assert all(r.depth == r.turn == r.position and r.root == 0 for r in got)


# --- pipeline, queries -------------------------------------------------------------------------------------------------------------------

ITEM = "every evening the old clockmaker counted eleven silver gears beneath a lantern shaped like a sleeping heron"


def prose(seed, n=120):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    clean = [(i, prose(i)) for i in range(30)]
    texts = [*clean, (100, prose(3)), (101, prose(4) + " tail"), (102, "too short"), (103, "spam spam spam " * 60), (104, prose(200) + " " + ITEM + ". " + prose(201)), (105, prose(300) + ' password = "abcdef0123456789" ' + prose(301)), (106, None), (107, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DDL)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(30), 105}
    assert "<secret>" in out[105].text and all(out[i].text == t for i, t in clean)
    import public_tokenizers as P

    from corpusloom.llm import bpe

    t = bpe.tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert all(t.decode(r.ids).decode() == r.text for r in out.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "bpe"]
    stage = docs
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        stage = f(spark, stage, str(tmp_path))
        assert (stage.columns == docs.columns) == (k < 4)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls, repeated rows, and columns of other names."""
    wide = DDL + ", ids string, text2 string, __gone int, component_id long"
    bench = spark.createDataFrame([], "item_id long, text string")
    for name, rows in (("none", []), ("odd", [(None, prose(1)), (None, prose(1)), (5, None), (7, prose(2)), (7, prose(2)), (8, prose(2))])):
        spark.createDataFrame([(i, t, "en", None, None, "x", "y", 1, 2) for i, t in rows], wide).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted((r.doc_id for r in got), key=str) == ([] if name == "none" else [7, 7, None, None])
        assert all(len(r.ids) > 50 and r.component_id == 2 for r in got)


def test_encoding_is_decoded(spark):
    import public_tokenizers as P
    import pyarrow as pa

    from corpusloom.llm import bpe

    docs = spark.createDataFrame([(1, "plain é 日本 text", "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0)], DDL)
    assert {r.doc_id: len(r.ids) > 0 for r in corpus_pipeline.encode(spark, docs, "").collect()} == {1: True, 2: False, 3: False}
    t, texts = bpe.Tokenizer(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN), pa.array(["plain é 日本 text", ""])
    ids, n = t.encode_column(texts)
    bpe.checked(t, texts, ids, n)
    with pytest.raises(ValueError, match="do not decode"):
        bpe.checked(t, texts, ids[1:], n - [1, 0])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = sorted(map(repr, (tuple(r) for r in df.collect())))
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    if name in queries.SQL:
        assert rows == sorted(map(repr, c.sql(f"select {', '.join(df.columns)} from ({queries.SQL[name]})").fetchall()))
    elif name != "op4_decontaminate":
        assert len(rows) == c.sql(f"select count(*) from {'pages' if name == 'op8_warc' else 'documents'}").fetchall()[0][0]
