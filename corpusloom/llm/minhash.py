"""Near-duplicates by min-max hashing.

Of each permutation both the minimum and the maximum over a document's shingles are kept, so 120 permutations give 240
signature values for half the hash evaluations; both ends agree with probability J each. A band takes both ends of three
permutations. At similarity 0.8 all 40 bands miss with probability (1 - 0.8**6)**40 = 5e-6.

1. Documents with equal shingle sets become one class, numbered by a digest of the set.
2. Classes that share a band's bucket are tied to the bucket's smallest class; components of these ties are candidates.
3. Within a candidate component all pairs are considered in memory, in blocks of bounded weight and number that are paired
   with each other in separate tasks: a pair goes on if its sizes and its signatures allow the similarity (the estimate must
   be within six standard deviations, where both ends of a permutation are taken as one draw, for they may go together), and is
   confirmed on the full sets. Pairs that are connected already are skipped, and only the links of a spanning forest leave the task.
4. Classes that share a doc_id are linked as well. Components of the links, by their smallest doc_id, give component_id.

Sets are compared by 64-bit hashes of shingles, and classes are told apart by 64 bits of their digests.

Defined cases: a null or empty text has the empty set and is linked with nothing; with fewer words than a shingle has,
the whole sequence is the one shingle; a null doc_id is linked with nothing and its component_id and kept are null;
rows with the same doc_id are one document, whatever texts they have, so each has the same component_id, and what is linked
with one of the texts is linked with the document; n_shingles is that of the row's text; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_schema, bytes_text, joined_anew, map_rows, release, stored
from corpusloom.llm.components import connected_components

PERMUTATIONS, BAND = 120, 3
VALUES = 2 * PERMUTATIONS
#: Shingles, and classes, in a block of a candidate component, about.
BLOCK_SHINGLES, BLOCK_CLASSES = 1_000_000, 512
#: Bits of the map of candidate documents, which is broadcast: 4 MB at any size of the corpus.
MAP_BITS = 1 << 25
_WORDS_KEPT = 200_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes. Only A-Z is lower-cased; words are [^\\x20\\x09-\\x0D]+."""

    def __init__(self, words: int):
        self.k = words
        self.seen: dict[bytes, int] = {}
        self.factors = _mix(np.arange(1, words + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)

    def _hash(self, word: bytes) -> int:
        if len(self.seen) >= _WORDS_KEPT:
            self.seen.clear()
        h = self.seen[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, _U)
        if len(words) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], _U)
        get, make = self.seen.get, self._hash
        w = np.fromiter((get(x) or make(x) for x in words), _U, len(words))
        n = len(w) - self.k + 1
        total = np.zeros(n, _U)
        for j in range(self.k):
            total += w[j : j + n] * self.factors[j]
        return np.unique(_mix(total))


class MinMax:
    """Signatures: VALUES ends of permutations, as bucket keys of bands and as one byte each."""

    def __init__(self):
        rng = np.random.default_rng(5)
        self.a = rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
        self.mul = rng.integers(0, 1 << 63, 2 * BAND, np.uint64) * _U(2) + _U(1)

    def ends(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> _U(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
        for i in range(0, len(x), 4096):
            h = self.a[:, None] * x[None, i : i + 4096] + self.b[:, None]
            np.minimum(low, h.min(1), out=low)
            np.maximum(high, h.max(1), out=high)
        return np.stack([low, high], 1)  # (permutation, end)

    def bands(self, ends: np.ndarray) -> np.ndarray:
        v = ends.reshape(-1, 2 * BAND).astype(_U)
        key = np.zeros(len(v), _U)
        for j in range(2 * BAND):
            key = _mix(key * self.mul[j] + v[:, j] + _U(j))
        return (key ^ np.arange(len(v), dtype=_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)

    def signature(self, ends: np.ndarray) -> bytes:
        return ((ends.reshape(-1) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _number(shingles: np.ndarray) -> int:
    """The class of all documents with these shingles."""
    return int.from_bytes(xxhash.xxh3_128_digest(shingles.tobytes())[:8], "little", signed=True)


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, same, bands, sig): set size, number of the set's class, bucket keys and signature."""

    def start():
        shingler, minmax = Shingler(words), MinMax()

        def batch(rows):
            out: dict[str, list] = {"doc_id": rows["doc_id"], "n": [], "same": [], "bands": [], "sig": []}
            for text in rows["text"]:
                s = shingler(text)
                out["n"].append(len(s))
                if not len(s):
                    for k in ("same", "bands", "sig"):
                        out[k].append(None)
                    continue
                ends = minmax.ends(s)
                out["same"].append(_number(s))
                out["bands"].append(minmax.bands(ends))
                out["sig"].append(minmax.signature(ends))
            return out

        return batch

    return map_rows(bytes_text(docs), "doc_id long, n long, same long, bands array<long>, sig binary", start)


def _bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(MAP_BITS)) + 1  # buckets of bitmaps count from 1, as do the values in them


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits in which the bit of each id is set. What comes to the driver is at most MAP_BITS / 8 bytes."""
    bits = ids.select(_bit("id").alias("h"))
    parts = bits.groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return out


def _sets(docs: DataFrame, words: int, ids: DataFrame) -> DataFrame:
    """(id, same, set) of the documents whose bit is set in the map of ids: all of ids, and a few more; same is the set's class."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))
    source = bytes_text(docs).where("doc_id is not null").withColumn("h", _bit("doc_id"))
    source = source.withColumn("k", F.bitmap_bucket_number("h")).withColumn("p", F.bitmap_bit_position("h"))

    def start():
        shingler, bits = Shingler(words), shared.value

        def batch(rows):
            ids, same, sets = [], [], []
            for i, text, k, p in zip(rows["doc_id"], rows["text"], rows["k"], rows["p"], strict=True):
                if bits[(k - 1) * 4096 + p // 8] >> (p % 8) & 1:
                    got = shingler(text)
                    ids.append(i)
                    same.append(_number(got))
                    sets.append(got.tobytes())
            return {"id": ids, "same": same, "set": sets}

        return batch

    return map_rows(source, "id long, same long, set binary", start)


class _Forest(dict):
    def find(self, x: int) -> int:
        root = x
        while (p := self.get(root, root)) != root:
            root = p
        while (p := self.get(x, x)) != root:
            self[x] = root
            x = p
        return root


def spanning_links(ids: list[int], sets: list[np.ndarray], sigs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what is similar, as few as possible.

    Each document in turn is the pivot: its set marks the local vocabulary, and the sizes of its intersections with all
    documents that are not connected with it, and whose size and signature allow a link, are summed at once."""
    n = len(ids)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, sigs, sets, ids = sizes[order], sigs[order], [sets[i] for i in order], [ids[i] for i in order]
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(vocabulary), bool)
    p = percent / 100
    least = VALUES * p - 6 * 2 * (PERMUTATIONS * p * (1 - p)) ** 0.5
    forest, root = _Forest(), np.arange(n)
    links = []
    for i in range(n - 1):
        top = np.searchsorted(sizes, sizes[i] * 100 // percent, "right")  # sorted by size: larger sets can't reach it
        rest = np.arange(i + 1, top)
        rest = rest[root[rest] != root[i]]
        if not len(rest):
            continue
        rest = rest[(sigs[rest] == sigs[i]).sum(1) >= least]
        if not len(rest):
            continue
        mark[flat[begin[i] : begin[i + 1]]] = True
        for j in rest:
            if root[j] == root[i]:
                continue
            both = int(np.count_nonzero(mark[flat[begin[j] : begin[j + 1]]]))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                links.append((ids[i], ids[j]))
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
        mark[flat[begin[i] : begin[i + 1]]] = False
    return links


def _links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within each group g of members (g, id, set, sig). A group's rows stand together in one task."""
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, sigs = None, [], [], []

        def done():
            got = spanning_links(ids, sets, np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1), percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], schema=schema)

        for b in batches:
            for g, i, s, v in zip(*(b.column(k).to_pylist() for k in ("g", "id", "set", "sig")), strict=True):
                if g != group:
                    if len(ids) > 1:
                        yield done()
                    group, ids, sets, sigs = g, [], [], []
                ids.append(i)
                sets.append(np.frombuffer(s, _U))
                sigs.append(v)
        if len(ids) > 1:
            yield done()
        ids, sets, sigs = [], [], []
        release()

    return members.repartition("g").sortWithinPartitions("g").select("g", "id", "set", "sig").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    profiles = stored(_profiles(docs, words), "minmax")
    known = profiles.where("same is not null and doc_id is not null")
    classes = stored(known.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n").alias("n")), "classes")
    buckets = classes.select("same", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("same").alias("hub"), F.max("same").alias("top")).where("hub < top").select("bucket", "hub")
    ties = buckets.join(joined_anew(shared, "bucket"), "bucket").where("same <> hub").select(F.col("same").alias("a"), F.col("hub").alias("b"))
    candidates = stored(connected_components(ties), "candidates").withColumnRenamed("id", "same")

    weighed = candidates.join(classes.select("same", "id", "n", "sig"), "same")
    parts = F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_CLASSES))).cast("int")
    blocks = weighed.groupBy("component").agg(parts.alias("blocks"))
    placed = weighed.join(joined_anew(blocks, "component"), "component").withColumn("block", F.pmod(F.xxhash64(F.lit(7), "same"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (o != F.col("block")) | (F.col("blocks") == 1))  # two blocks hold the pairs of each as well
    pairs = F.transform(others, lambda o: F.struct(F.col("component"), F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    members = placed.join(_sets(docs, words, weighed.select("id")).dropDuplicates(["id", "same"]), ["id", "same"]).select("same", "set", "sig", F.explode(pairs).alias("g"))
    links = _links(members.select(F.xxhash64("g.component", "g.i", "g.j").alias("g"), F.col("same").alias("id"), "set", "sig"), percent)

    repeated = profiles.where("doc_id is not null").groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high"), F.bool_or(F.col("same").isNull()).alias("hole"))
    repeated = stored(repeated.where("low < high or (hole and low is not null)").select("doc_id", "low"), "repeated")  # documents with several texts
    shared_ids = known.select("doc_id", "same").join(repeated, "doc_id").where("same > low").select(F.col("same").alias("a"), F.col("low").alias("b"))
    components = connected_components(links.union(shared_ids))

    named = classes.select("same", "id").join(components.withColumnRenamed("id", "same"), "same", "left").withColumn("component", F.coalesce("component", "same"))
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(joined_anew(lowest, "component"), "component").select("same", "component_id")
    own = profiles.select("doc_id", F.col("n").alias("n_shingles"), "same").join(repeated, "doc_id", "left")
    out = own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("same", "low")).alias("same")).join(named, "same", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_dedup(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The documents, with all their columns, that have the smallest doc_id of their group. Rows without doc_id stay."""
    gone = stored(near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
