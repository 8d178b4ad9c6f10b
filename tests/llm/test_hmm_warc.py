"""Hidden Markov scores against enumeration, WARC archives byte by byte."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from corpusloom.llm import hmm, warc


def model(states, classes, seed):
    rng = np.random.default_rng(seed)
    p = lambda *shape: rng.uniform(0.1, 1, shape)
    first, trans, emit = p(states), p(states, states), p(classes, states)
    return hmm.Model(first / first.sum(), trans / trans.sum(1, keepdims=True), emit / emit.sum(0))


def enumerated(x, m):
    k = len(m.first)
    return sum(m.first[p[0]] * math.prod(m.trans[p[t], p[t + 1]] * m.emit[x[t], p[t + 1]] for t in range(len(x))) for p in itertools.product(range(k), repeat=len(x) + 1))


@pytest.mark.parametrize("segment", [2, 3, 100])
def test_likelihood_is_the_sum_over_all_paths(segment, monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng, m = np.random.default_rng(1), model(3, 7, 2)
    texts = [rng.integers(0, 7, n) for n in (1, 2, 3, 5, 6, 6, 4)]
    assert np.allclose(np.exp(hmm.log_likelihoods(texts, m)), [enumerated(x, m) for x in texts], rtol=1e-10)


@pytest.mark.parametrize("segment", [2, 100])
def test_expected_counts_are_the_derivative(segment, monkeypatch):
    """Expected counts of transitions: trans * d log-likelihood / d trans, by enumeration of paths."""
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng, m = np.random.default_rng(3), model(2, 5, 4)
    texts = [rng.integers(0, 5, n) for n in (1, 3, 5, 4)]
    first, trans, emit = hmm.expected_counts(texts, m)
    want_f, want_t, want_e = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2))
    for x in texts:
        z = enumerated(x, m)
        for p in itertools.product(range(2), repeat=len(x) + 1):
            w = m.first[p[0]] * math.prod(m.trans[p[t], p[t + 1]] * m.emit[x[t], p[t + 1]] for t in range(len(x))) / z
            want_f[p[0]] += w
            for t in range(len(x)):
                want_t[p[t], p[t + 1]] += w
                want_e[x[t], p[t + 1]] += w
    assert np.allclose(first, want_f) and np.allclose(trans, want_t) and np.allclose(emit, want_e)


def test_long_text_does_not_vanish():
    x = np.random.default_rng(0).integers(0, 7, 50_000)
    assert -3 < hmm.log_likelihoods([x], model(4, 7, 1))[0] / len(x) < -1


def prose(seed, n):
    rng = random.Random(seed)
    tongues = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    return [" ".join(rng.choice(rng.choice([t] * 20 + tongues)) for _ in range(rng.randint(1, 120))) for t in (rng.choice(tongues) for _ in range(n))]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, rare string")


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(hmm, "COMMON", 50)  # so that most words go the way of the rare ones
    rows = [*enumerate(prose(1, 300)), (300, None), (301, ""), (302, "never seen words here"), (None, "a1 a2"), (5, "a1 B2 \x85é")]
    got = hmm.scores(docs(spark, rows), 2).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    seen = Counter()
    base = Counter()
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        seen[i, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens), 6)] += 1
    for r in got:
        base[r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)] += 1
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    assert base == seen
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # on held-out texts the states tell more than the counts


def test_classes(spark, monkeypatch):
    """Frequent buckets are classes of their own, others share, the end has one; sums over classes are those of the tokens."""
    monkeypatch.setattr(hmm, "FINE", 64)
    monkeypatch.setattr(hmm, "TIED", 8)
    monkeypatch.setattr(hmm, "OWN", 2)
    rows = [(5, 1000), (64 + 5, 1), (9, 700), (3, 2), (64 + 3, 1), (11, 4), (-64 + 12, 3), (hmm.END_KEY, 50)]
    of, per_class = hmm.classes_of(spark.createDataFrame(rows, "key long, c long"))
    assert of[5] == 8 and of[9] == 9 and of[64] == 10 and of[3] == of[11] == 3 and of[12] == 4 and len(of) == 65
    assert per_class[8].tolist() == [1001, 2] and per_class[9].tolist() == [700, 1] and per_class[10].tolist() == [50, 1]
    assert per_class[3].tolist() == [7, 3] and per_class[4].tolist() == [3, 1] and per_class.sum(0).tolist() == [1761, 8]
    of, per_class = hmm.classes_of(spark.createDataFrame([], "key long, c long"))
    assert of[64] == 8 and per_class.tolist() == [[0, 0]] * 9


def test_scores_without_training(spark):
    assert hmm.scores(docs(spark, []), 2).collect() == []
    only = next(i for i in range(100) if hmm.fold(i) == 2)
    r = hmm.scores(docs(spark, [(only, "a b")]), 2).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)


# --- WARC ----------------------------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, sha1 string, first int")


def test_round_trip(spark):
    big = "<p>" + "é" * 200_000
    rows = [(5, "u5", "same"), (3, "u 3\r\nX: y", "same"), (9, None, "same"), (4, "u4", None), (6, "u6", ""), (7, "u7", big), (8, "u8", big), (None, "u", "same"), (3, "again", "same"), (1, "u1", "\r\n\r\nWARC/1.1\r\n")]
    got = sorted((tuple(r) for r in warc.round_trip(pages(spark, rows)).collect()), key=str)
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    first = {"same": 3, "": 4, big: 7, rows[-1][2]: 1}
    want = []
    for i, _, h in rows:
        f = first[h or ""]
        again = i is not None and i != f
        want.append((i, len((h or "").encode()), sha(h), "revisit" if again else "response", f if again else None))
    assert got == sorted(want, key=str)


def test_many_archives(spark):
    rows = [(i, "u", f"page {i} " * 50) for i in range(300)]
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or ''}"
    df = pages(spark, rows)
    from corpusloom.llm.common import scratch

    path = scratch(spark, "warc")
    listed = warc.write_archives(df, path, archive_bytes=4000)
    assert listed.count() > 3 and listed.agg({"records": "sum"}).first()[0] == 300
    assert sorted(r.page_id for r in warc.read_archives(spark, path, listed).collect()) == list(range(300))
    assert warc.round_trip(pages(spark, [])).collect() == []


def archive(records, dictionary=b"WARC/1.1\r\nWARC-Type: response", packed=True):
    lead = warc.leading_frame(dictionary)
    if not packed:
        lead = warc.SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return lead + b"".join(map(c.compress, records))


def test_archives_are_checked():
    good = warc.record(1, "u", b"x" * 300_000, warc.digest(b"x"), None)
    for packed in (True, False):
        (h, block), _ = warc.read_archive(archive([good, good], packed=packed))
        assert h["warc-type"] == "response" and block.endswith(b"x" * 300_000)
    plain = zstandard.ZstdCompressor().compress(good)
    assert len(list(warc.read_archive(plain * 3))) == 3  # no dictionary
    incompressible = warc.record(2, "u", random.Random(0).randbytes(400_000), "d", None)
    assert list(warc.read_archive(archive([incompressible])))[0][1].endswith(incompressible[-10:-4])
    assert list(warc.read_archive(b"")) == []
    for bad in (good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date"), good[:-1], good + b"x", good.replace(b"Content-Length: 300", b"Content-Length: 301")):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(archive([bad])))
    for cut in (1, 5, 300):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.read_archive(archive([good])[:-cut]))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(archive([good]) + b"trailing"))


def test_base_trains_no_model(spark, monkeypatch):
    from corpusloom.llm import hmm as module

    def trained(*_):
        raise AssertionError("a model was trained")

    monkeypatch.setattr(module, "baum_welch", trained)
    docs = spark.createDataFrame([(i, f"a b{i} c a") for i in range(9)], "doc_id long, text string")
    got = module.scores(docs, hidden=False).collect()
    assert len(got) == 9 and all(r.score is None and r.n_tokens == 5 and r.base_score < 0 for r in got)
