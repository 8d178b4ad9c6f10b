"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each merge rank has a bucket of list positions; a bitmap of two levels
marks the buckets that are not empty, and find-first-set gives the next rank. An entry whose pair has changed since
it was filed is stale and is skipped. Every operation costs a constant number of word operations (and the log of a
bucket), so a pre-token of n bytes takes O(n log n), not O(n²).

Short pre-tokens share one queue, a batch of them at a time: their lists lie in one array, and a bucket's positions are merged
in vectors, of each pre-token the leftmost only, so that each is merged in its own order. A long pre-token has a queue for
itself. Ids of short chunks are remembered within a bound until the task ends.

A text is first cut into chunks whose pre-tokens do not depend on what stands around them: before each space where no
white space follows a space; else runs of characters that are no white space with at most one space before, and the
pieces of white space between. That holds for the pattern CUT_PATTERN; with any other pattern a text is one chunk.

Defined cases: a null text is empty; an empty text has no ids; a null doc_id is kept as null; repeated rows are
encoded one by one; extra columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, arrow_schema, bytes_text, release, small_batches

# Fixed value: the pattern of pre-tokens for which texts may be cut into chunks first.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks and pre-tokens up to this length are remembered, so many of them; pairs of ids whose merge is remembered.
REMEMBER_CHARS, REMEMBER, PAIRS = 48, 100_000, 100_000
#: Pre-tokens of more bytes have a queue for themselves, so many others share one; bytes of text, about, that are encoded together.
SHORT_BYTES, SHARE, TOGETHER_BYTES = 64, 1 << 17, 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Positions by rank: two levels of 256-bit words mark the ranks that have positions. A bucket is one position, or a heap of more."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 256 + 1)
        self.top = 0
        self.bit = [1 << k for k in range(max(256, len(self.low)))]
        self.buckets: dict[int, int | list[int]] = {}

    def mark(self, rank: int) -> None:
        a = rank >> 8
        if not self.low[a]:
            self.top |= self.bit[a]
        self.low[a] |= self.bit[rank & 255]

    def push(self, rank: int, at: int) -> None:
        buckets = self.buckets
        if rank not in buckets:
            buckets[rank] = at
            self.mark(rank)
        elif isinstance(bucket := buckets[rank], int):
            buckets[rank] = [bucket, at] if bucket < at else [at, bucket]
        else:
            heapq.heappush(bucket, at)

    def pop(self) -> tuple[int, int]:
        """The leftmost position of the lowest rank; only while top is not 0."""
        top = self.top
        a = (top & -top).bit_length() - 1
        low = self.low[a]
        first = low & -low
        rank = (a << 8) + first.bit_length() - 1
        bucket = self.buckets[rank]
        if not isinstance(bucket, int):
            at = heapq.heappop(bucket)
            if bucket:
                return rank, at
        else:
            at = bucket
        del self.buckets[rank]
        self.low[a] = low = low ^ first
        if not low:
            self.top = top & (top - 1)
        return rank, at


class RankQueues(RankQueue):
    """The same of many lists at once: a bucket holds arrays of positions, and is taken whole."""

    def file(self, ranks: np.ndarray, at: np.ndarray) -> None:
        """Positions with their ranks; those of rank -1 have none."""
        has = ranks >= 0
        ranks, at = ranks[has], at[has]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        begin = 0
        for end in [*(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)] if len(at) else ():
            rank = int(ranks[begin])
            if rank in self.buckets:
                self.buckets[rank].append(at[begin:end])
            else:
                self.buckets[rank] = [at[begin:end]]
                self.mark(rank)
            begin = end

    def take(self) -> tuple[int, np.ndarray]:
        """The lowest rank and its positions in their order, each once; only while top is not 0."""
        a = (self.top & -self.top).bit_length() - 1
        first = self.low[a] & -self.low[a]
        rank = (a << 8) + first.bit_length() - 1
        self.low[a] ^= first
        if not self.low[a]:
            self.top &= self.top - 1
        parts = self.buckets.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Tokenizer:
    """Ranks and the pattern of pre-tokens, with what a task remembers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks.get(bytes([i])) for i in range(256)]
        self.pairs: dict[int, int] = {}  # (left id, right id) in one number: the id of both, or -1
        self.cut, found = pattern == CUT_PATTERN, regex.compile(pattern)
        self.pretokens = found.findall if self.cut else lambda text: [m.group() for m in found.finditer(text)]
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]").findall
        self.space_space = re.compile(f" [{SPACE}]").search
        self.odd = f" [{SPACE}]|\\x00"
        self.memory: dict[str, bytes] = {}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        self.vocabulary = pa.array([self.bytes_of.get(i) for i in range(max(ranks.values(), default=-1) + 1)], pa.binary())

    def forget(self) -> None:
        """To be called when a task ends: its memory goes back to the system."""
        self.memory, self.pairs = {}, {}
        release()

    def pair(self, a: int, b: int) -> int:
        r = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        if len(self.pairs) < PAIRS:
            self.pairs[a << 32 | b] = r
        return r

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, known, pair, queue = len(piece), self.pairs.get, self.pair, self.queue
        push, pop = queue.push, queue.pop
        ids = [self.single[x] for x in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        filed = [-1] * n  # the rank under which the pair that begins here is filed
        for i in range(n - 1):
            r = known(ids[i] << 32 | ids[i + 1])
            if r is None:
                r = pair(ids[i], ids[i + 1])
            if r >= 0:
                filed[i] = r
                push(r, i)
        while queue.top:
            rank, i = pop()
            if filed[i] != rank:
                continue  # stale
            j = after[i]
            ids[i] = rank
            filed[j] = -1
            k = after[i] = after[j]
            r = -1
            if k < n:
                before[k] = i
                r = known(rank << 32 | ids[k])
                if r is None:
                    r = pair(rank, ids[k])
                if r >= 0:
                    push(r, i)
            filed[i] = r
            h = before[i]
            if h >= 0:
                r = known(ids[h] << 32 | rank)
                if r is None:
                    r = pair(ids[h], rank)
                if r != filed[h]:
                    filed[h] = r
                    if r >= 0:
                        push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of some pre-tokens of a byte or more, as little-endian unsigned 32-bit integers."""
        if len(pieces) > SHARE:
            return [x for i in range(0, len(pieces), SHARE) for x in self.merge_many(pieces[i : i + SHARE])]
        if not pieces:
            return []
        queue = RankQueues(max(len(self.vocabulary), 1))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32)
        n, ends = len(data), np.cumsum(lengths)
        of = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        # Position n stands behind and before all lists.
        ids = np.append(np.array([-1 if x is None else x for x in self.single], np.int32)[data], np.int32(0))
        after, before, filed = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.full(n + 1, -1, np.int32)
        after[ends - 1] = before[ends - lengths] = n
        filed[: n - 1] = self.two[data[:-1] << 8 | data[1:]]
        filed[ends - 1] = -1
        alive = np.ones(n, bool)
        queue.file(filed[:n], np.arange(n, dtype=np.int32))
        while queue.top:
            rank, at = queue.take()
            at = at[filed[at] == rank]  # the others are stale
            own = of[at]
            first = np.append(True, own[1:] != own[:-1])[: len(at)]
            if not first.all():
                queue.file(np.full(len(at) - int(first.sum()), rank), at[~first])
                at = at[first]
            j = after[at]
            k = after[j]
            ids[at], filed[j], alive[j], after[at], before[k] = rank, -1, False, k, at
            h = before[at]
            right, left = k < n, h < n
            filed[at] = -1
            moved = np.concatenate([at[right], h[left]])
            filed[moved] = found = self._ranks(np.concatenate([ids[at[right]], ids[h[left]]]), np.concatenate([ids[k[right]], ids[at[left]]]))
            queue.file(found, moved)
        kept = ids[:n][alive].astype("<u4")
        stops = np.cumsum(np.bincount(of[alive], minlength=len(pieces))) * 4
        raw = kept.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, or -1."""
        keys, which = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        known, pair = self.pairs.get, self.pair
        return np.array([pair(k >> 32, k & 0xFFFFFFFF) if (r := known(k)) is None else r for k in keys.tolist()], np.int32)[which]

    def piece(self, text: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        got = self.memory.get(text)
        return array("I", self.merge(text.encode("utf-8", "surrogatepass"))).tobytes() if got is None else got

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()

    def encode_column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many there are of each. Chunks are found, told apart and put together in vectors; of those not
        seen before, new pre-tokens are merged together."""
        if not self.cut or not len(texts):
            raw = [b"".join(map(self.piece, self.pretokens(x))) for x in texts.to_pylist()]
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64)
        odd = pc.match_substring_regex(texts, self.odd)
        lists = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        if pc.any(odd).as_py():
            some = pc.indices_nonzero(odd)
            place = np.arange(len(texts))
            place[some.to_numpy()] = len(texts) + np.arange(len(some))
            lists = pa.concat_arrays([lists, pa.array([self.chunks(x) for x in texts.take(some).to_pylist()], lists.type)]).take(pa.array(place))
        coded = lists.flatten().dictionary_encode()
        found = pa.array(self._chunks(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        offsets = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1] if len(found) else np.zeros(1, np.int32)
        ids = np.frombuffer(found.buffers()[2], np.uint8)[: offsets[-1]].view("<u4") if offsets[-1] else np.empty(0, "<u4")
        stops = offsets[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)] // 4
        return ids, np.diff(stops.astype(np.int64), prepend=0)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each of some distinct chunks."""
        if len(self.memory) > REMEMBER:
            self.memory = {}
        memory = self.memory
        out = [memory.get(c) for c in chunks]
        new = [i for i, x in enumerate(out) if x is None]
        parts = [self.pretokens(chunks[i]) for i in new]
        pieces = list({p for ps in parts for p in ps if p not in memory})
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = [k for k, x in enumerate(raw) if len(x) <= SHORT_BYTES]
        made = dict(zip([pieces[k] for k in short], self.merge_many([raw[k] for k in short]), strict=True))
        for p in pieces:
            if p not in made:
                made[p] = self.piece(p)
        for i, ps in zip(new, parts, strict=True):
            out[i] = got = b"".join([made[p] if p in made else memory[p] for p in ps])
            if len(chunks[i]) <= REMEMBER_CHARS:
                made[chunks[i]] = got  # a chunk that reads like a pre-token has its ids
        memory.update({c: x for c, x in made.items() if len(c) <= REMEMBER_CHARS})
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_column(self, ids: np.ndarray, n: np.ndarray) -> pa.BinaryArray:
        """The bytes of each list of ids, which lie behind each other, n of each."""
        if len(ids) and (ids.max() >= len(self.vocabulary) or self.vocabulary.null_count and self.vocabulary.take(pa.array(ids)).null_count):
            raise KeyError("an id that the vocabulary does not have")
        pieces = self.vocabulary.take(pa.array(ids, pa.int64()))
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
        stops = np.concatenate([[0], offsets[np.cumsum(n)]]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(stops), pieces.buffers()[2] or pa.py_buffer(b"")])


#: Tokenizers of this process, with what they remember: a Python worker keeps them from task to task.
_HELD: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The process's tokenizer of these ranks and this pattern."""
    if (path, pattern) not in _HELD:
        _HELD[path, pattern] = Tokenizer(load_ranks(path), pattern)
    return _HELD[path, pattern]


def ids_of(raw: bytes) -> array:
    ids = array("I")
    ids.frombytes(raw)
    return ids


def _together(batches: Iterator, size) -> Iterator[list]:
    """Batches in groups of TOGETHER_BYTES, about: the more texts together, the fewer chunks are distinct."""
    waiting, held = [], 0
    for b in batches:
        waiting.append(b)
        held += size(b)
        if held >= TOGETHER_BYTES:
            yield waiting
            waiting, held = [], 0
    if waiting:
        yield waiting


def encode_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each document: ids counted and digested, and the digest of the bytes to which they decode."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = arrow_schema(ddl)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for group in _together(batches, lambda b: b.column("text").nbytes):
            table = pa.Table.from_batches(group).combine_chunks()
            names, texts = (table.column(k).combine_chunks() for k in ("doc_id", "text"))
            ids, n = t.encode_column(texts)
            stops = np.cumsum(n)
            sha = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip((stops - n).tolist(), stops.tolist(), strict=True)]
            decoded = t.decode_column(ids, n)
            back = [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded]
            yield pa.RecordBatch.from_arrays([names, pa.array(n), pa.array(sha, pa.string()), pa.array(back, pa.string())], schema=schema)
            group = table = texts = ids = decoded = None
            release()
        t.forget()

    return bytes_text(docs).mapInArrow(run, ddl)


def checked(t: Tokenizer, texts: pa.StringArray, ids: np.ndarray, n: np.ndarray) -> None:
    """Raises where the ids of some text do not decode to it."""
    if not t.decode_column(ids, n).equals(texts.cast(pa.binary())):
        raise ValueError("ids do not decode to their text")


def encode_documents(docs: DataFrame, path: str, pattern: str, output: str = "ids", check: bool = False) -> DataFrame:
    """The documents with a column of ids (array<int>), in place of any column of that name. check: the same task decodes them and compares the bytes."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer(path, pattern)
        for group in _together(texts, lambda b: b.nbytes):
            texts_now = pa.concat_arrays(group)
            ids, n = t.encode_column(texts_now)
            if check:
                checked(t, texts_now, ids, n)
            offsets, at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32), 0
            every = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))
            for b in group:
                yield every.slice(at, len(b))
                at += len(b)
            group = texts_now = ids = every = b = None
            release()
        t.forget()

    return docs.withColumn(output, encode(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """The documents with the bytes to which their ids decode; of null ids none."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return tokenizer(path, pattern).decode_column(flat, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))

    return docs.withColumn(output, decode(F.col(ids)))
