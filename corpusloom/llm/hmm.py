"""Language-model scoring with a hidden Markov model.

A text is its lower-cased (A-Z) words and one end. A silent first state goes to the state of the first token, each state emits
the class of its token, and the class emits the token. Words fall into FINE buckets by their hash. The OWN most frequent
buckets, each of them hardly more than one frequent word, are classes of their own; the others share TIED classes, and the end
has one. So what the states learn has a fixed size at any size of the vocabulary; within a class tokens have add-one
probabilities, with one share for all unknown tokens.

Baum-Welch: in each round, tasks compute expected counts over all training texts, their sums are aggregated, and the model is
estimated anew. Long texts are cut into segments only to compute many at once: the K x K product of a segment's steps carries
the exact forward and backward vectors across, so the recursion is that of the whole text. Vectors are scaled and the logarithms of the
scales summed. Scores are base-10 logarithms.

Counts of tokens: those of the most frequent ones, COMMON at most, are sent to every task; of other tokens, none of which makes up
much of the corpus, a document's are joined with the counts by shuffle. So neither the vocabulary nor a frequent word is ever in
one place. Tokens are told apart by 64-bit hashes.

Defined cases: a null or empty text is its end alone; a null doc_id has the hash of the empty text; rows with one doc_id are
scored one by one; without training texts (an empty table, or one fold) all tokens are unknown; extra columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_schema, bytes_text, map_rows, release, small_batches, stored

STATES, ROUNDS = 6, 4
#: Buckets of words; of them, classes of their own at most; classes of the rest. FINE is a multiple of TIED.
FINE, OWN, TIED = 1 << 20, 1 << 13, 1 << 12
#: Tokens, at most, whose counts are sent to every task (16 bytes each).
COMMON = 1 << 18
SEGMENT, SEED, SMOOTHING, STAY = 2048, 3, 0.1, 0.9
#: Tokens that a task computes at once; a longer text is computed by itself.
AT_ONCE = 600_000
#: Distinct words that a task knows before it sends their counts on and begins anew.
WORDS_KEPT = 250_000
END_KEY = xxhash.xxh3_64_intdigest(b" ") >> 1  # no word has a space


def fold(doc_id: int | None, folds: int = 7) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


class Words:
    """Numbers of words, from 1 on, with each word's key (64-bit hash). A task begins anew between batches when it knows WORDS_KEPT."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.keys = array("q", [END_KEY])  # number 0 is the end

    def make(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self.keys.append(h - (h >> 63 << 64))  # signed
        got = self.known[word] = len(self.keys) - 1
        return got

    def of(self, text: str) -> np.ndarray:
        """Numbers of a text's tokens, the end's last."""
        get, make = self.known.get, self.make
        words = text.encode("utf-8", "surrogatepass").lower().split()
        words.append(b"")
        return np.fromiter([get(w) or (make(w) if w else 0) for w in words], np.int64, len(words))

    def fine(self, first: int = 0) -> np.ndarray:
        """Buckets of the words from a number on; the end's is FINE."""
        keys = np.array(self.keys[first:], np.int64)
        return np.where(keys == END_KEY, FINE, keys & (FINE - 1)).astype(np.int32)

    def full(self) -> bool:
        return len(self.keys) > WORDS_KEPT


class Model:
    """first (K): the silent state; trans (K, K); emit (classes, K)."""

    def __init__(self, first: np.ndarray, trans: np.ndarray, emit: np.ndarray):
        self.first, self.trans, self.emit = first, trans, emit

    @staticmethod
    def begin(share: np.ndarray, states: int = STATES, seed: int = SEED) -> "Model":
        """From the classes' shares, made a little different from state to state; a state mostly stays."""
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
        trans = np.where(np.eye(states, dtype=bool), STAY, (1 - STAY) / max(1, states - 1)) * rng.uniform(0.9, 1.1, (states, states))
        return Model(np.full(states, 1 / states), trans / trans.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def estimate(first: np.ndarray, trans: np.ndarray, emit: np.ndarray, unseen: np.ndarray) -> "Model":
        """From expected counts; of each class, its add-one counts are dealt to the states in equal parts."""
        first, trans, emit = first + SMOOTHING, trans + SMOOTHING, emit + unseen[:, None] / emit.shape[1]
        return Model(first / first.sum(), trans / trans.sum(1, keepdims=True), emit / emit.sum(0))


class Segments:
    """The tokens of some texts, in segments of at most SEGMENT tokens of one text. Longer segments stand first, so those that are
    longer than t are a prefix, and step t's tokens of all of them lie together: at[t]:at[t + 1] of flat."""

    def __init__(self, texts: list[np.ndarray]):
        self.texts = len(texts)
        lengths, of, place, begin, at = [], [], [], [], 0
        for d, x in enumerate(texts):
            for k, i in enumerate(range(0, len(x), SEGMENT)):
                lengths.append(min(SEGMENT, len(x) - i))
                of.append(d)
                place.append(k)
                begin.append(at + i)
            at += len(x)
        order = np.argsort(-np.array(lengths), kind="stable")
        self.lengths, self.of, self.place, begin = (np.array(x)[order] for x in (lengths, of, place, begin))
        self.steps = int(self.lengths[0])
        self.active = np.searchsorted(-self.lengths, -np.arange(self.steps), "left")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        tokens = np.concatenate(texts)
        self.flat = np.concatenate([tokens[begin[:n] + t] for t, n in enumerate(self.active)])
        by_place = np.argsort(self.place, kind="stable")
        self.rows = np.split(by_place, np.flatnonzero(np.diff(self.place[by_place])) + 1)  # the segments at each place of their texts
        self.single = len(self.rows) == 1

    def products(self, m: Model, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment the product of its steps, scaled, and the logarithm of the scale. e: emissions of flat."""
        k = len(m.first)
        p, log = np.tile(np.eye(k), (len(self.lengths), 1, 1)), np.zeros(len(self.lengths))
        for t, n in enumerate(self.active):
            q = (p[:n].reshape(-1, k) @ m.trans).reshape(n, k, k) * e[self.at[t] : self.at[t + 1], None, :]
            if t % 8 == 7 or t == self.steps - 1 or self.active[t + 1] < n:
                top = q.max((1, 2))
                q /= top[:, None, None]
                log[:n] += np.log(top)
            p[:n] = q
        return p, log

    def starts(self, m: Model, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scaled vectors before and after each segment, and each text's log-likelihood (nan where the segments tell it anyway)."""
        k = len(m.first)
        if self.single:
            return np.tile(m.first, (len(self.lengths), 1)), np.ones((len(self.lengths), k)), np.full(self.texts, np.nan)
        p, log = self.products(m, e)
        before, v, total = np.empty((len(p), k)), np.tile(m.first, (self.texts, 1)), np.zeros(self.texts)
        for rows in self.rows:
            d = self.of[rows]
            before[rows] = v[d]
            w = np.einsum("nk,nkj->nj", v[d], p[rows])
            s = w.sum(1)
            v[d] = w / s[:, None]
            total[d] += np.log(s) + log[rows]
        after, v = np.empty((len(p), k)), np.ones((self.texts, k))
        for rows in reversed(self.rows):
            d = self.of[rows]
            after[rows] = v[d]
            w = np.einsum("nkj,nj->nk", p[rows], v[d])
            v[d] = w / w.sum(1, keepdims=True)
        return before, after, total

    def forward(self, m: Model, e: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward vectors after each step, laid out as flat, and the sum of each segment's logarithms of scales."""
        f, log, v = np.empty_like(e), np.zeros(len(before)), before
        for t, n in enumerate(self.active):
            v = (v[:n] @ m.trans) * e[self.at[t] : self.at[t + 1]]
            s = v.sum(1)
            v /= s[:, None]
            log[:n] += np.log(s)
            f[self.at[t] : self.at[t + 1]] = v
        return f, log


def log_likelihoods(texts: list[np.ndarray], m: Model) -> np.ndarray:
    """Natural logarithm of each text's probability as a sequence of classes."""
    out = np.empty(len(texts))
    for part in parts(texts):
        s = Segments([texts[i] for i in part])
        e = m.emit[s.flat]
        before, _, total = s.starts(m, e)
        if s.single:
            total[s.of] = s.forward(m, e, before)[1]
        out[part] = total
    return out


def parts(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Which texts are computed at once: those that are one segment, by length, and then the others."""
    for long in (False, True):
        part, size = [], 0
        for i in sorted((i for i, x in enumerate(texts) if (len(x) > SEGMENT) == long), key=lambda i: len(texts[i])):
            if part and size + len(texts[i]) > AT_ONCE:
                yield part
                part, size = [], 0
            part.append(i)
            size += len(texts[i])
        if part:
            yield part


def expected_counts(texts: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, transitions and emissions."""
    k = len(m.first)
    first, pairs, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for part in parts(texts):
        s = Segments([texts[i] for i in part])
        e = m.emit[s.flat]
        before, b, _ = s.starts(m, e)
        f, _ = s.forward(m, e, before)
        for t in range(s.steps - 1, -1, -1):
            n, here = s.active[t], slice(s.at[t], s.at[t + 1])
            eb = e[here] * b[:n]
            f_now = f[here]
            f_now *= b[:n]  # becomes the posterior of step t; forward vectors of later steps are not needed any more
            f_now /= f_now.sum(1, keepdims=True)
            back = eb @ m.trans.T
            was = before[:n] if t == 0 else f[s.at[t - 1] : s.at[t - 1] + n]
            pairs += (was / (was * back).sum(1, keepdims=True)).T @ eb
            back /= back.sum(1, keepdims=True)
            b[:n] = back
        lead = s.rows[0]  # the first segments of all texts
        g = before[lead] * b[lead]
        first += (g / g.sum(1, keepdims=True)).sum(0)
        for j in range(k):
            emit[:, j] += np.bincount(s.flat, f[:, j], len(emit))
    return first, m.trans * pairs, emit


def read_texts(docs: DataFrame, held_out: int) -> tuple[DataFrame, DataFrame]:
    """What training takes from the texts, in one reading: (key, c) of each distinct training token, and (fine) of each training
    text, the buckets of its tokens as four-byte numbers. Both are in the shared folder."""
    ddl = "key long, n long, fine binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(1, np.int64)

        def counts():
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.array(words.keys, np.int64)[some]), pa.array(total[some]), pa.nulls(len(some), pa.binary())], schema=schema)

        for b in batches:
            texts = [words.of(t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if fold(i) != held_out]
            if not texts:
                continue
            seen = np.bincount(np.concatenate(texts), minlength=len(words.keys))
            seen[: len(total)] += total
            total, fine = seen, words.fine().astype("<u4")
            nothing = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array([fine[x].tobytes() for x in texts], pa.binary())], schema=schema)
            if words.full():
                yield counts()
                words, total = Words(), np.zeros(1, np.int64)
        yield counts()
        words = total = None
        release()

    small_batches(docs.sparkSession)
    found = stored(bytes_text(docs).mapInArrow(run, ddl), "training")
    counts = found.where("key is not null").groupBy("key").agg(F.sum("n").alias("c"))
    return stored(counts, "tokens"), found.where("fine is not null").select("fine")


def classes_of(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The class of each bucket (and, at FINE, of the end), and tokens and distinct tokens of each class. At most OWN buckets, TIED + OWN + 1
    sums and nothing else come to the driver."""
    fine = F.when(F.col("key") == F.lit(END_KEY), F.lit(FINE)).otherwise(F.col("key").bitwiseAND(F.lit(FINE - 1))).cast("int")
    buckets = stored(counts.groupBy(fine.alias("key")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")), "buckets")
    own = sorted(r.key for r in most_frequent(buckets.where(F.col("key") < FINE), OWN).select("key").collect())
    of = np.concatenate([np.arange(FINE) % TIED, [TIED + len(own)]]).astype(np.int32)
    of[own] = TIED + np.arange(len(own))
    spark = counts.sparkSession
    named = spark.createDataFrame([(k, TIED + i) for i, k in enumerate([*own, FINE])], "key int, own int")
    sums = buckets.join(F.broadcast(named), "key", "left").groupBy(F.coalesce("own", F.pmod("key", F.lit(TIED))).alias("class")).agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
    per_class = np.zeros((TIED + len(own) + 1, 2))
    for r in sums.collect():
        per_class[r["class"]] = r.c, r.v
    return of, per_class


def baum_welch(texts: DataFrame, of: np.ndarray, per_class: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Model:
    """The model after some rounds over all training texts (fine), with the class of each bucket. per_class: tokens and distinct tokens
    of each class. Each round's sums come to the driver: K * (TIED + OWN + K + 2) numbers, whatever the corpus."""
    unseen, size = per_class[:, 1] + 1, len(per_class)
    model = Model.begin((per_class[:, 0] + unseen) / (per_class[:, 0] + unseen).sum(), states)
    small_batches(texts.sparkSession)
    schema = arrow_schema("at int, x double")
    table = texts.sparkSession.sparkContext.broadcast(of)
    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, waiting, held = 0.0, [], 0

            def add():
                return total + np.concatenate([x.ravel() for x in expected_counts(waiting, shared.value)])

            for b in batches:
                waiting += [table.value[np.frombuffer(x, "<u4")] for x in b.column(0).to_pylist()]
                held = sum(map(len, waiting))
                if held >= 2 * AT_ONCE:
                    total, waiting, held = add(), [], 0
            if waiting:
                total = add()
            if not isinstance(total, float):
                some = np.flatnonzero(total > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], schema=schema)
            waiting = []
            release()

        sums = texts.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum(F.col("x").cast("decimal(30,9)")).cast("double").alias("x")).toPandas()
        flat = np.zeros(states + states * states + size * states)
        flat[sums["at"].to_numpy(int)] = sums["x"].to_numpy(float)
        model = Model.estimate(flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(-1, states), unseen)
    return model


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """(key, c) of the tokens whose counts reach the lowest step that at most `most` tokens reach. Steps are sixteenths of powers of two,
    so their histogram is small; a sorted limit would send that many rows of every partition to one place."""
    step = F.floor(F.log2("c") * 16)
    lowest, held = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        held += r.n
        if held > most:
            break
        lowest = r.step
    return counts.where(F.lit(False) if lowest is None else step >= lowest).select("key", "c")


def scores(docs: DataFrame, held_out: int = 2, rounds: int = ROUNDS, states: int = STATES, hidden: bool = True) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Without hidden no model is trained
    and score is null; no other column depends on the model."""
    spark = docs.sparkSession
    counts, training = read_texts(docs, held_out)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    of, per_class = classes_of(counts)
    model = baum_welch(training, of, per_class, rounds, states) if hidden else None
    share = np.log10(per_class.sum(1) + 1)  # of a class: its tokens, one more for each, and one for the unknown
    common = most_frequent(counts, COMMON).toPandas().sort_values("key")
    shared = spark.sparkContext.broadcast((model, of, share, common["key"].to_numpy(np.int64), np.log10(common["c"].to_numpy(float) + 1)))

    def start():
        m, of, of_class, known, known_logs = shared.value
        state = {"words": Words(), "logs": np.empty(0), "classes": np.empty(0, np.int32)}

        def logs_of(k: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.full(len(k), np.nan)
            at = np.minimum(np.searchsorted(known, k), len(known) - 1)
            return np.where(known[at] == k, known_logs[at], np.nan)

        def batch(rows):
            if state["words"].full():
                state.update(words=Words(), logs=np.empty(0), classes=np.empty(0, np.int32))
            words = state["words"]
            texts = [words.of(text) for text in rows["text"]]
            have = len(state["logs"])
            log = state["logs"] = np.concatenate([state["logs"], logs_of(np.array(words.keys[have:], np.int64))])
            classes = state["classes"] = np.concatenate([state["classes"], of[words.fine(have)]])
            out: dict[str, list] = {"doc_id": rows["doc_id"], "held_out": [fold(i) == held_out for i in rows["doc_id"]], "n_tokens": [], "n_common": [], "logs": [], "inner": [], "rare": []}
            for x in texts:
                a = log[x]
                absent = np.isnan(a)
                which, n = np.unique(x[absent], return_counts=True)
                out["n_tokens"].append(len(x))
                out["n_common"].append(len(x) - int(absent.sum()))
                out["logs"].append(float(a[~absent].sum()))
                out["inner"].append(float(of_class[classes[x]].sum()))
                out["rare"].append([{"key": words.keys[w], "n": c} for w, c in zip(which.tolist(), n.tolist(), strict=True)])
            out["hidden"] = (log_likelihoods([classes[x] for x in texts], m) / math.log(10)).tolist() if hidden else [None] * len(texts)
            return out

        return batch

    ddl = "doc_id long, held_out boolean, n_tokens long, n_common long, logs double, inner double, hidden double, rare array<struct<key: bigint, n: bigint>>"
    first = map_rows(bytes_text(docs), ddl, start).withColumn("row", F.monotonically_increasing_id())
    first = stored(first, "scored")
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.n").join(counts.select("key", "c"), "key")
    found = rare.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return first.drop("rare").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("hidden") + logs - F.col("inner")).alias("score"),
    )
