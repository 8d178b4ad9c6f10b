"""Token ids in files, coded with a static range asymmetric numeral system.

A corpus has one frequency table, from exact counts over all its ids, which is written once beside the files, with a checksum;
every file names it. A file holds the ids of a range of documents, in sections of whole documents. A section's ids are in blocks
that are coded independently: id i of a block belongs to lane i mod LANES, each lane has its own 64-bit state, and the lanes
share one stream of 32-bit words. A block notes the states and the place in the stream at its POINTS checkpoints too, from which
its parts are decoded side by side; it has a checksum of its words and one of its ids. Sections are read by themselves, each from its
place in a file, so that many tasks share a large file.

File: magic, checksum of the table; sections; an index (JSON, compressed) with the sections' places; the index's length and
checksum, magic. Section: length and checksum of its head; the head (JSON, compressed) with documents' ids and lengths and
blocks' places; blocks.

Defined cases: a null text is empty, so that its document is the end id alone; rows are ordered by doc_id, nulls first, and
rows of one doc_id by their ids' bytes; an empty table makes no file; extra columns do not matter.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, arrow_schema, bytes_text, map_rows, release, scratch, small_batches, stored

MAGIC, TABLE_MAGIC, TABLE_NAME = b"RANS0002", b"RANSFREQ", "table.freq"
LANES, SCALE_BITS, BLOCK_IDS, POINTS = 512, 20, 1 << 18, 4
#: Ids in a file, about.
FILE_IDS = 1 << 22
#: Words remembered by a task.
WORDS_KEPT = 300_000
_LOW = 31


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, 1 at least for each id that occurs."""
    total, full = int(counts.sum()), 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.int64)
    f = np.where(counts > 0, np.maximum(1, counts.astype(object) * full // total), 0).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - full
    k = 0
    while over > 0:  # take from the most frequent what rounding up gave to the rare
        less = min(over, max(1, int(f[order[k]]) // 64)) if f[order[k]] > 1 else 0
        f[order[k]] -= less
        over -= less
        k = (k + 1) % len(order)
    f[order[0]] -= over
    return f


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(_LOW + 32 - SCALE_BITS)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.table = zlib.crc32(freq.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray) -> dict:
        """The stream and what a decoder needs to begin at each checkpoint: its step, its place in the stream, and the states."""
        steps = -(-len(ids) // LANES)
        at = {steps * k // POINTS for k in range(POINTS)}
        x = np.full(LANES, 1 << _LOW, np.uint64)
        words, points, held = [], [], 0
        bits, low = np.uint64(SCALE_BITS), np.uint64(0xFFFFFFFF)
        for s in range(steps - 1, -1, -1):
            sym = ids[s * LANES : (s + 1) * LANES]
            y, f = x[: len(sym)], self.freq[sym]
            full = y >= self.limit[sym]
            if full.any():
                words.append((y[full] & low).astype("<u4"))
                held += len(words[-1])
                y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[: len(sym)] = (q << bits) + (y - q * f) + self.start[sym]
            if s in at:
                points.append((s, held, x.copy()))
        raw = b"".join(w.tobytes() for w in reversed(words))
        points = [(s, held - n, states) for s, n, states in reversed(points)]
        return {"ids": len(ids), "points": points, "raw": raw, "ids_crc": zlib.crc32(ids.astype("<u4").tobytes())}

    def decode(self, raw: bytes, n: int, states: np.ndarray, first_step: int = 0, word: int = 0, last_step: int | None = None) -> np.ndarray:
        """Ids of the steps from first_step up to last_step of a block of n ids; word is the place in the stream at first_step."""
        stream = np.frombuffer(raw, "<u4").astype(np.uint64)
        steps = -(-n // LANES)
        last = steps if last_step is None else last_step
        x, out = states.copy(), np.empty(min(n, last * LANES) - first_step * LANES, np.uint32)
        mask, bits, least = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(1 << _LOW)
        for s in range(first_step, last):
            m = min(LANES, n - s * LANES)
            y = x[:m]
            slot = y & mask
            sym = self.symbol[slot]
            out[(s - first_step) * LANES : (s - first_step) * LANES + m] = sym
            y = self.freq[sym] * (y >> bits) + slot - self.start[sym]
            need = np.flatnonzero(y < least)
            if len(need):
                y[need] = y[need] << np.uint64(32) | stream[word : word + len(need)]
                word += len(need)
            x[:m] = y
        return out


    def decode_parts(self, raw: bytes, n: int, points: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """All ids of a block; its parts from checkpoint to checkpoint are decoded side by side, and each one's last steps by themselves."""
        ends = [*[s for s, _, _ in points[1:]], -(-n // LANES)]
        common = min(e - s for (s, _, _), e in zip(points, ends, strict=True)) - 1
        if common < 2 or len(points) == 1:
            return self.decode(raw, n, points[0][2])
        stream = np.frombuffer(raw, "<u4").astype(np.uint64)
        x = np.stack([states for _, _, states in points])
        word = np.array([w for _, w, _ in points])
        made = np.empty((len(points), common, LANES), np.uint32)
        mask, bits, least = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(1 << _LOW)
        for s in range(common):
            slot = x & mask
            sym = self.symbol[slot]
            made[:, s] = sym
            x = self.freq[sym] * (x >> bits) + slot - self.start[sym]
            need = x < least
            count = need.sum(1)
            where = np.flatnonzero(need)
            if len(where):
                first = np.cumsum(count) - count
                x.ravel()[where] = x.ravel()[where] << np.uint64(32) | stream[np.repeat(word - first, count) + np.arange(len(where))]
                word += count
        out = np.empty(n, np.uint32)
        for k, ((s, _, _), end) in enumerate(zip(points, ends, strict=True)):
            out[s * LANES : (s + common) * LANES] = made[k].ravel()
            out[(s + common) * LANES : end * LANES] = self.decode(raw, n, x[k], s + common, int(word[k]), end)
        return out

    def packed(self) -> bytes:
        """The table as it stands beside the files."""
        raw = zlib.compress(self.freq.astype("<u4").tobytes(), 6)
        return TABLE_MAGIC + struct.pack("<II", self.table, len(self.freq)) + raw

    @staticmethod
    def unpacked(content: bytes) -> "Coder":
        if content[:8] != TABLE_MAGIC:
            raise ValueError("not a frequency table")
        crc, size = struct.unpack_from("<II", content, 8)
        raw = zlib.decompress(content[16:])
        if zlib.crc32(raw) != crc or len(raw) != 4 * size:
            raise ValueError("the frequency table is damaged")
        return Coder(np.frombuffer(raw, "<u4").astype(np.int64))


def _section(coder: Coder, names: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """Some whole documents: a head, and blocks of BLOCK_IDS to twice as many ids (the last, or only one, of any number)."""
    blocks, body, at = [], [], 0
    cuts = list(range(0, max(len(ids) - BLOCK_IDS, 1), BLOCK_IDS)) if len(ids) >= 2 * BLOCK_IDS else [0]
    for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
        if a == b:
            continue
        made = coder.encode(ids[a:b])
        raw = b"".join(states.astype("<u8").tobytes() for _, _, states in made["points"]) + made["raw"]
        blocks.append([at, len(raw), b - a, [[s, w] for s, w, _ in made["points"]], zlib.crc32(raw), made["ids_crc"]])
        body.append(raw)
        at += len(raw)
    head = zlib.compress(json.dumps({"docs": names, "lengths": lengths, "blocks": blocks}).encode(), 6)
    return struct.pack("<QI", len(head), zlib.crc32(head)) + head + b"".join(body)


def write_file(out, coder: Coder, docs: Iterator[tuple[int | None, np.ndarray]]) -> list[tuple[int, int, int, int]]:
    """Writes one file to a stream; documents come in their order, one at a time. Returns each section's place, bytes, documents and ids."""
    head = MAGIC + struct.pack("<I", coder.table)
    out.write(head)
    at, sections, names, waiting, held = len(head), [], [], [], 0

    def flush() -> None:
        nonlocal at, names, waiting, held
        raw = _section(coder, names, [len(x) for x in waiting], np.concatenate(waiting))
        out.write(raw)
        sections.append((at, len(raw), len(names), held))
        at += len(raw)
        names, waiting, held = [], [], 0

    for name, ids in docs:
        names.append(name)
        waiting.append(ids)
        held += len(ids)
        if held >= BLOCK_IDS:
            flush()
    if names:
        flush()
    index = zlib.compress(json.dumps({"sections": sections}).encode(), 6)
    out.write(index + struct.pack("<QI", len(index), zlib.crc32(index)) + MAGIC)
    return sections


class Section:
    """A section's head, and its blocks on demand."""

    def __init__(self, raw: bytes, coder: Coder):
        size, crc = struct.unpack_from("<QI", raw, 0)
        head = raw[12 : 12 + size]
        if zlib.crc32(head) != crc:
            raise ValueError("a section's head is damaged")
        found = json.loads(zlib.decompress(head))
        self.coder, self.body = coder, memoryview(raw)[12 + size :]
        self.docs, self.lengths, self.blocks = found["docs"], found["lengths"], found["blocks"]

    def block(self, k: int, part: int | None = None) -> np.ndarray:
        """Ids of a block, or of one of its parts, which is decoded from its checkpoint."""
        at, size, n, points, crc, ids_crc = self.blocks[k]
        whole = self.body[at : at + size]
        if zlib.crc32(whole) != crc:
            raise ValueError(f"block {k} is damaged")
        states = np.frombuffer(whole, "<u8", len(points) * LANES).reshape(-1, LANES).astype(np.uint64)
        raw = bytes(whole[8 * LANES * len(points) :])
        if part is not None:
            (step, word), last = points[part], points[part + 1][0] if part + 1 < len(points) else None
            return self.coder.decode(raw, n, states[part], step, word, last)
        ids = self.coder.decode_parts(raw, n, [(s, w, x) for (s, w), x in zip(points, states, strict=True)])
        if zlib.crc32(ids) != ids_crc:
            raise ValueError(f"block {k} does not decode to its ids")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's ids in their order; one block is held at a time, and what of a document lies before it."""
        left, k, have = [], 0, 0
        for name, n in zip(self.docs, self.lengths, strict=True):
            while have < n:
                left.append(self.block(k))
                have, k = have + len(left[-1]), k + 1
            ids = left[0] if len(left) == 1 else np.concatenate(left) if left else np.empty(0, np.uint32)
            left, have = [ids[n:]], have - n
            yield name, ids[:n]


class TokenFile:
    """A whole file: its index, and its sections on demand."""

    def __init__(self, content: bytes, coder: Coder):
        self.content, self.coder = content, coder
        if content[:8] != MAGIC or content[-8:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        if struct.unpack_from("<I", content, 8)[0] != coder.table:
            raise ValueError("the file was coded with another table")
        size, crc = struct.unpack_from("<QI", content, len(content) - 20)
        index = content[len(content) - 20 - size : len(content) - 20]
        if zlib.crc32(index) != crc:
            raise ValueError("the index is damaged")
        self.places = json.loads(zlib.decompress(index))["sections"]

    def sections(self) -> Iterator[Section]:
        for at, size, _, _ in self.places:
            yield Section(self.content[at : at + size], self.coder)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for s in self.sections():
            yield from s.documents()


# --- ids of texts -------------------------------------------------------------------------------------------------------------

#: Bytes of text, about, that are looked at together.
TOGETHER_BYTES = 8 << 20
_HELD: dict[str, "WordTokenizer"] = {}


def _byte_letters() -> dict[int, str]:
    """Latin letters as byte-level vocabularies write them: each byte of the UTF-8 form stands as a printable character, those that
    are not printable in their order from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    of = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(0x80, 0x100) if chr(c).isalpha()}


class WordTokenizer:
    """The library's tokenizer for vocabularies of words, with the ids of words remembered.

    Words of Latin letters go in lower case straight to the library's merges, and marks of punctuation behind them by themselves; other
    new words go to it in one text, between marks: a mark is a character with an id of its own, which no other text has. All this holds
    only where the tokenizer drops white space, never looks across it, lowers case, and cuts letters from punctuation; that is
    probed at the start. For any other tokenizer, whole texts go to the library."""

    MARKS = "†‡¶§¤•"
    ENDS = ".,;:!?"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.words = re.compile(f"[^{SPACE}]+").findall
        self.not_split = re.compile("[\x1c-\x1f]").search  # str.split() takes these for white space
        self.memory: dict[str, bytes] = {}
        self.merges, self.letters = self.library.model.tokenize, _byte_letters()
        self.code = "H" if self.kind.itemsize == 2 else "I"
        alone = [(m, ids[0]) for m in self.MARKS if len(ids := self._ids(m)) == 1]
        self.mark, self.mark_id = alone[0] if alone else (None, None)
        self.by_words = self._probed()

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _probed(self) -> bool:
        """Whether words, told apart as here, get the ids that the library gives to whole texts. The probe has each Latin letter in both cases at each end
        of a word, each mark behind letters, white space of all kinds, and words that are no letters."""
        if self.library.truncation or self.library.padding or not self.mark:
            return False
        latin = [chr(c) for c in (*range(0x41, 0x5B), *range(0xC0, 0x100)) if chr(c).isalpha()]
        text = " ".join([f"{c}ab the{c} {c}{c.lower()}" for c in latin] + [f"word{m} Éa{m}{m}" for m in self.ENDS])
        odd = ["a\u00a0b\u2003c", "  x\t\n\ny  ", "", "don't I'll x.y a-b, (a) 12,345.6 é1 3rd ...", "日本 a\u0301b İx ΑΣ. ß Ω", "\x1c a", "l'été, «a» “b”!", "a\u200bb", self.mark, "<|endoftext|> a"]
        try:
            for t in (text, *odd):
                ids, _ = self._by_words(pa.array([t, t + " " + t], pa.string()), [])
                if ids.tolist() != self._ids(t) + self._ids(t + " " + t):
                    return False
        except Exception as e:  # the library raises bare exceptions for models that have no such merges
            if type(e) is not Exception and not isinstance(e, (AssertionError, OverflowError)):
                raise
            return False
        finally:
            self.forget()
        return True

    def forget(self) -> None:
        """To be called when a task ends: its memory goes back to the system."""
        self.memory = {}
        release()

    def _learn(self, words: list[str]) -> None:
        """Ids of new words that are not plain."""
        memory, rest = self.memory, []
        for w in words:
            if self.mark not in w:
                rest.append(w)
            else:
                memory[w] = array(self.code, self._ids(w)).tobytes()
        size = self.kind.itemsize
        for i in range(0, len(rest), 2_000):
            part = rest[i : i + 2_000]
            ids = np.array(self._ids(f" {self.mark} ".join(part)), self.kind)
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            raw, at = ids.tobytes(), 0
            assert len(ends) == len(part), "each mark must come back as one id"
            for w, end in zip(part, ends, strict=True):
                memory[w] = raw[at * size : end * size]
                at = end + 1

    def _plain(self, cores: list[str]) -> list[bytes]:
        """Ids of words of small Latin letters."""
        memory, merges, letters, code = self.memory, self.merges, self.letters, self.code
        out = [memory.get(w) for w in cores]
        for i in [i for i, x in enumerate(out) if x is None]:
            w = cores[i]
            out[i] = memory[w] = array(code, [x.id for x in merges(w if w.isascii() else w.translate(letters))]).tobytes()
        return out

    def _other(self, words: list[str]) -> list[bytes]:
        self._learn([w for w in words if w not in self.memory])
        return [self.memory[w] for w in words]

    def _distinct(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of each of some distinct words, none of which is empty."""
        if len(self.memory) > WORDS_KEPT:
            self.memory = {}
        core = pc.ascii_rtrim(words, self.ENDS)
        offsets, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
        latin = np.ones(len(words), bool)
        latin[np.searchsorted(offsets, offsets[0] + np.flatnonzero(data[offsets[0] : offsets[-1]] >= 0xC4), "right") - 1] = False  # a first byte of U+0100 and above
        behind = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy()
        plain = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False) & latin & (behind < 2)
        which = np.flatnonzero(plain)
        cores = pc.utf8_lower(core.take(pa.array(which))).dictionary_encode()
        ids = pa.array(self._plain(cores.dictionary.to_pylist()), pa.binary()).take(cores.indices)
        last = data[offsets[1:][which] - 1]
        mark = np.where(behind[which] == 0, 0, 1)
        for k, m in enumerate(self.ENDS):
            mark[(mark > 0) & (last == ord(m))] = k + 1
        ends = pa.array([b"", *self._other(list(self.ENDS))], pa.binary()).take(pa.array(mark))
        ids = pc.binary_join_element_wise(ids, ends, b"")
        other = np.flatnonzero(~plain)
        more = pa.array(self._other(words.take(pa.array(other)).to_pylist()), pa.binary())
        place = np.empty(len(words), np.int64)
        place[which], place[other] = np.arange(len(which)), len(which) + np.arange(len(other))
        return pa.concat_arrays([ids, more]).take(pa.array(place))

    def _by_words(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            lists = pa.array([self.words(t) if self.not_split(t) else t.split() for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        full = pc.greater(pc.binary_length(words), 0)
        some = np.flatnonzero(full.to_numpy(zero_copy_only=False))
        place = np.full(len(words), len(some) + 1, np.int32)  # empty words have no ids
        place[some] = np.arange(len(some))
        ids = pa.concat_arrays([self._distinct(words.filter(full)), pa.array([np.array(end, self.kind).tobytes(), b""], pa.binary())])
        stops = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
        which = np.insert(place[coded.indices.to_numpy()], stops, len(some))  # the end after each text's words
        out = ids.take(pa.array(which))
        offsets = np.frombuffer(out.buffers()[1], np.int32)[: len(out) + 1]
        raw = out.buffers()[2]
        flat = np.frombuffer(raw, np.uint8)[: offsets[-1]].view(self.kind) if raw is not None and len(out) else np.empty(0, self.kind)
        ends = offsets[stops + np.arange(len(stops)) + 1] // self.kind.itemsize
        return flat, np.diff(ends.astype(np.int64), prepend=0)

    def encode_column(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end, and how many there are of each. Words are found, told apart and put together
        in vectors; only distinct words are looked at one by one."""
        if self.by_words:
            return self._by_words(texts, end)
        found = [[*x.ids, *end] for x in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.array([i for x in found for i in x], self.kind), np.array([len(x) for x in found], np.int64)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as numbers of self.kind."""
        ids, n = self.encode_column(pa.array(texts, pa.string()), [])
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _HELD:
        _HELD[path] = WordTokenizer(path)
    return _HELD[path]


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, n, ids): ids with the end id, in little-endian numbers of two bytes, or four for large vocabularies."""

    schema = arrow_schema("doc_id long, n long, ids binary")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, waiting, held = word_tokenizer(path), [], 0

        def made():
            b = pa.Table.from_batches(waiting).combine_chunks()
            names, texts = (b.column(k).combine_chunks() for k in ("doc_id", "text"))
            ids, n = t.encode_column(texts, [end])
            offsets = np.concatenate([[0], np.cumsum(n) * t.kind.itemsize]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])
            return pa.RecordBatch.from_arrays([names, pa.array(n), raw], schema=schema)

        for b in batches:
            waiting.append(b)
            held += b.column("text").nbytes
            if held >= TOGETHER_BYTES:  # the more texts together, the fewer words are distinct
                yield made()
                waiting, held = [], 0
        if waiting:
            yield made()
        waiting = []
        t.forget()

    return bytes_text(docs).mapInArrow(run, "doc_id long, n long, ids binary")


def counted(ids: DataFrame, kind: str, size: int) -> np.ndarray:
    """Exact counts of ids over a table; size of them come to the driver."""
    schema = arrow_schema("id int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            ids = b.column(0)
            _, offsets, data = ids.buffers()
            first, last = np.frombuffer(offsets, np.int32)[[ids.offset, ids.offset + len(ids)]] if len(ids) else (0, 0)
            if last > first:
                total += np.bincount(np.frombuffer(data, np.uint8)[first:last].view(kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], schema=schema)

    small_batches(ids.sparkSession)
    out = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def _open(path: str):
    return pa.fs.FileSystem.from_uri(path)


def write_files(ids: DataFrame, kind: str, freq: np.ndarray, path: str, files: int) -> None:
    """Writes a table of (doc_id, n, ids) in doc_id order below a folder: files, the frequency table, and the list of what counts, a row
    for each section: (part, file, section, at, size, docs, ids)."""
    ddl = "part int, file string, section int, at long, size long, docs long, ids long"
    schema = arrow_schema(ddl)
    small_batches(ids.sparkSession)
    shared = ids.sparkSession.sparkContext.broadcast(freq)
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{TABLE_NAME}", compression=None) as out:
        out.write(Coder(freq).packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def docs():
            for b in batches:
                for name, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                    yield name, np.frombuffer(x, kind).astype(np.uint32)

        rows = docs()
        first = next(rows, None)
        if first is None:
            return
        fs, root = _open(path)
        name = f"{uuid.uuid4().hex}.rans"

        def again():
            yield first
            yield from rows

        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            made = write_file(out, Coder(shared.value), again())
        n = len(made)
        columns = [[TaskContext.get().partitionId()] * n, [name] * n, range(n), *zip(*made, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), x.type) for c, x in zip(columns, schema, strict=True)], schema=schema)
        release()

    dealt = ids.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    dealt.select("doc_id", "ids").mapInArrow(run, ddl).write.parquet(f"{path}/sections")


def _placed(listed: DataFrame) -> DataFrame:
    """(file, at, size, base): sections with the ids before them. Sums are made by groups of files first, so no window orders more than a
    thousandth of the files at once, or the sections of one file."""
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = listed.groupBy("part").agg(F.sum("ids").alias("n")).withColumn("g", F.shiftright("part", 10))
    groups = parts.groupBy("g").agg(F.sum("n").alias("all")).select("g", before("all", Window.orderBy("g")).alias("low"))
    parts = parts.join(groups, "g").select("part", (F.col("low") + before("n", Window.partitionBy("g").orderBy("part"))).alias("low"))
    return listed.join(parts, "part").select("part", "section", "file", "at", "size", (F.col("low") + before("ids", Window.partitionBy("part").orderBy("section"))).alias("base"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document, from the files that are listed below a folder, whoever wrote them: doc_id, start, n_tokens, ids_crc32.
    Tasks open the sections that are dealt to them at their places."""
    listed = spark.read.schema("part int, file string, section int, at long, size long, docs long, ids long").parquet(f"{path}/sections")
    placed = _placed(listed)
    tasks = max(1, -(-(listed.agg(F.sum("ids")).first()[0] or 0) // FILE_IDS))

    def start():
        fs, root = _open(path)
        with fs.open_input_stream(f"{root}/{TABLE_NAME}", compression=None) as f:
            coder = Coder.unpacked(f.read())

        def batch(rows):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
            for file, at, size, base in zip(*(rows[k] for k in ("file", "at", "size", "base")), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    if f.read_at(12, 0) != MAGIC + struct.pack("<I", coder.table):
                        raise ValueError(f"{file} is no token file of this table")
                    raw = f.read_at(size, at)
                for name, ids in Section(raw, coder).documents():
                    out["doc_id"].append(name)
                    out["start"].append(base)
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids))
                    base += len(ids)
            return out

        return batch

    return map_rows(placed.repartition(tasks, "part", "section"), "doc_id long, start long, n_tokens long, ids_crc32 long", start)


def round_trip(docs: DataFrame, tokenizer_path: str, end: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes the documents, writes their ids to files and reads these back."""
    spark = docs.sparkSession
    t = word_tokenizer(tokenizer_path)
    ids = stored(tokenized(docs, tokenizer_path, end), "ids")
    freq = quantised(counted(ids, t.kind.str, t.size))
    total = ids.agg(F.sum("n")).first()[0] or 0
    path = scratch(spark, "rans")
    write_files(ids, t.kind.str, freq, path, max(1, -(-total // file_ids)))
    return read_files(spark, path)
