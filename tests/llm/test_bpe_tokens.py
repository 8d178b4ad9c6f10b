"""BPE and token files against the public libraries."""

import ast
import base64
import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from corpusloom.llm import bpe, rans

TEXTS = [
    None,
    "",
    " ",
    "   ",
    "a",
    "hello  world\n\n  x ",
    "don't we'll I'VE\t\ttabs \r\n",
    "naïve café — “quotes” 北京 😀👍🏽 \x1c\x1f\x85  x",
    "1234567 3.14 a1b2 <|endoftext|> \0nul",
    " \n \n y  \n",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "The quick Brown fox, jumps. Over; the LAZY dog!? ß İ Σς †‡ é",
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, ids string, n string")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n, seed=1):
    rng = random.Random(seed)
    alphabet = ["the ", "in", "g", " ", "\n", "  ", "é", "北", "'s", "1", ".", ",", "\t", "\r", " ", "x", "qz", "👍"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_are_the_library_s(reference):
    t = bpe.tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    for text in [x or "" for x in TEXTS] + fuzz(3000) + [long]:
        ids = bpe.ids_of(t.encode(text)).tolist()
        assert ids == reference.encode_ordinary(text), text[:80]
        assert t.decode(ids) == text.encode()


def test_texts_together(reference):
    """Many texts in one queue, with words that share ranks, repeat pairs, and are long."""
    t, rng = bpe.Tokenizer(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN), random.Random(5)
    words = ["".join(rng.choice("abesht") for _ in range(rng.randint(1, 70))) for _ in range(3000)] + ["a" * k for k in range(1, 70)] + ["ab" * k for k in range(1, 40)] + ["é" * k for k in range(1, 40)]
    texts = [x or "" for x in TEXTS] + fuzz(500, 9) + [" ".join(rng.choice(words) for _ in range(30)) for _ in range(300)] + ["x\0y \0 z", "\0", " \u3000 a", ""]
    for _ in range(2):  # the second time all is remembered
        ids, n = t.encode_column(pa.array(texts))
        want = [reference.encode_ordinary(x) for x in texts]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert t.decode_column(ids, n).to_pylist() == [x.encode() for x in texts]
    assert t.merge_many([w.encode() for w in words]) == [np.array(t.merge(w.encode()), "<u4").tobytes() for w in words]
    t.forget()
    assert t.encode_column(pa.array([], pa.string()))[0].tolist() == [] and t.merge_many([]) == []
    with pytest.raises(KeyError):
        t.decode_column(np.array([1 << 20]), np.array([1]))


def test_queue_pops_by_rank_then_place():
    q, rng = bpe.RankQueue(70_000), random.Random(3)
    items = [(rng.randrange(70_000), rng.randrange(1000)) for _ in range(2000)] + [(5, k) for k in (3, 1, 2)]
    for r, at in items:
        q.push(r, at)
    out = []
    while q.top:
        out.append(q.pop())
    assert out == sorted(items)


def test_report(spark, reference):
    rows = [*enumerate(TEXTS), (None, "x"), (3, TEXTS[3])]
    got = bpe.encode_report(docs(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "x" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = np.array(reference.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("pattern", [r"[a-z]+ [a-z]+|\S+|\s+", r"(\p{L}+)|[^\p{L}]", r"\p{Lu}?\p{Ll}+|."])
def test_other_patterns(pattern):
    """Chunks are cut only for the pattern that allows it; what no pre-token matches is dropped, as by the library."""
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library, t = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.Tokenizer(ranks, pattern)
    assert bpe.CUT_PATTERN == P.PATTERN and not t.cut
    for text in [x or "" for x in TEXTS] + fuzz(200, 8):
        assert bpe.ids_of(t.encode(text)).tolist() == library.encode_ordinary(text), text


def test_decoding_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()} == {1: b"", 2: b"", 3: b"a"}


def test_round_trip_of_tables(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    out = bpe.decode_documents(bpe.encode_documents(docs(spark, enumerate(TEXTS)), path, P.PATTERN), path, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in out} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode_report(docs(spark, []), path, P.PATTERN).collect() == []


# --- token files -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, rans.LANES - 1, rans.LANES, rans.LANES * 3 + 7, 20_000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 300).astype(np.uint32)
    coder = rans.Coder(rans.quantised(np.bincount(ids, minlength=400)))
    b = coder.encode(ids)
    points = b["points"]
    assert (coder.decode(b["raw"], n, points[0][2]) == ids).all() and (coder.decode_parts(b["raw"], n, points) == ids).all()
    for k, (step, word, states) in enumerate(points):
        last = points[k + 1][0] if k + 1 < len(points) else None
        part = ids[step * rans.LANES : None if last is None else last * rans.LANES]
        assert (coder.decode(b["raw"], n, states, step, word, last) == part).all()


def test_frequencies():
    for counts in ([1], [0, 5, 0], [10**12, 1, 1], [1] * 50_000, list(range(1000))):
        f = rans.quantised(np.array(counts))
        assert f.sum() == 1 << rans.SCALE_BITS and ((f > 0) == (np.array(counts) > 0)).all()


def test_one_id_only():
    ids = np.full(5000, 3, np.uint32)
    coder = rans.Coder(rans.quantised(np.bincount(ids)))
    b = coder.encode(ids)
    assert (coder.decode_parts(b["raw"], 5000, b["points"]) == ids).all()


def test_files(tmp_path):
    rng = np.random.default_rng(0)
    many = [(i, rng.integers(0, 50, n).astype(np.uint32)) for i, n in enumerate((0, 1, 300_000, 5, 0, 1_300_000, 7))]
    coder = rans.Coder(rans.quantised(np.bincount(np.concatenate([x for _, x in many]))))
    with open(tmp_path / "f", "wb") as out:
        rans.write_file(out, coder, iter(many))
    content = (tmp_path / "f").read_bytes()
    f = rans.TokenFile(content, coder)
    assert all(i == j and (a == b).all() for (i, a), (j, b) in zip(many, f.documents(), strict=True))
    first = next(f.sections())
    assert (np.concatenate([first.block(0, k) for k in range(rans.POINTS)]) == first.block(0)).all()
    assert max(len(s.blocks) for s in f.sections()) > 3 and sum(len(s.docs) for s in f.sections()) == len(many)
    bad = bytearray(content)
    bad[1000] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(rans.TokenFile(bytes(bad), coder).documents())
    with pytest.raises(ValueError, match="another table"):
        rans.TokenFile(content, rans.Coder(rans.quantised(np.ones(50))))
    with pytest.raises(ValueError, match="cut off"):
        rans.TokenFile(content[:-3], coder)


def test_table_beside_the_files():
    coder = rans.Coder(rans.quantised(np.array([5, 0, 1, 9])))
    again = rans.Coder.unpacked(coder.packed())
    assert again.table == coder.table and (again.freq == coder.freq).all()
    with pytest.raises(ValueError, match="not a frequency table"):
        rans.Coder.unpacked(b"RANSnone" + coder.packed()[8:])
    with pytest.raises(ValueError, match="damaged"):
        rans.Coder.unpacked(coder.packed()[:8] + b"\0" * 4 + coder.packed()[12:])


def test_files_are_read_in_a_new_process(spark, tmp_path):
    """Nothing but the folder is needed."""
    ids = spark.createDataFrame([(i, 3, np.array([i, 7, 2], "<u2").tobytes()) for i in range(200)], "doc_id long, n long, ids binary")
    rans.write_files(ids, "<u2", rans.quantised(rans.counted(ids, "<u2", 300)), f"file://{tmp_path}", 3)
    code = f"""
import glob
from corpusloom.llm.rans import Coder, TokenFile
coder = Coder.unpacked(open("{tmp_path}/table.freq", "rb").read())
print(sorted((i, x.tolist()) for p in glob.glob("{tmp_path}/*.rans") for i, x in TokenFile(open(p, "rb").read(), coder).documents()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(rans.__file__).parents[2]).stdout
    assert ast.literal_eval(out) == [(i, [i, 7, 2]) for i in range(200)]
    got = rans.read_files(spark, f"file://{tmp_path}").orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(i, 3 * i, 3) for i in range(200)]


def test_another_tokenizer_goes_to_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")  # keeps white space and case
    library, t = Tokenizer.from_file(path), rans.WordTokenizer(path)
    texts = [x or "" for x in TEXTS] + fuzz(100, 6)
    assert not t.by_words
    for text, raw in zip(texts, t.encode_batch(texts), strict=True):
        assert np.frombuffer(raw, t.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_are_the_library_s():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, t = Tokenizer.from_file(path), rans.word_tokenizer(path)
    texts = [x or "" for x in TEXTS] + fuzz(1500, 5) + ["†", "a†b †", "ABC.,;", "É.", "x\x1cy", "Ünïcödé ÄÖÜß. ªº µ´ ÿ; Āb é.; tschüß! Ð×÷"]
    for text, raw in zip(texts, t.encode_batch(texts), strict=True):
        assert np.frombuffer(raw, t.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_file_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(i * 3, t) for i, t in enumerate(TEXTS * 5)]
    got = sorted(tuple(r) for r in rans.round_trip(docs(spark, rows), P.path("word_bpe_49k.json"), 2, file_ids=200).collect())
    want, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_token_file_edges(spark):
    path = P.path("word_bpe_49k.json")
    assert rans.round_trip(docs(spark, []), path, 2).collect() == []
    got = rans.round_trip(docs(spark, [(7, "b"), (None, "a"), (7, "b"), (1, None)]), path, 2).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 2), (1, 1), (7, 2), (7, 2)] and [r.start for r in got] == [0, 2, 3, 5]
