"""WARC archives in Zstandard: writer, and reader of archives whose dictionary leads.

An archive begins with a skippable frame that holds a dictionary (itself compressed, or not); then each record is one frame,
compressed with that dictionary. The reader finds a frame's end from its block headers, decodes one frame at a time, and
checks version, headers, Content-Length, the record's end, and the digest of every payload.

Of equal payloads the record with the smallest page_id is a response and others are revisits that name it.

Archives are written by tasks to the shared folder under names of their own. What a task wrote counts only if its row is in
the list of archives, which Spark commits as a whole; files of lost or repeated tasks are left aside.

Defined cases: a null html is empty; a row without page_id is a response; rows that share the smallest page_id of a payload
are all responses; an empty table gives no archive; extra columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_schema, map_rows, sample_rows, scratch, small_batches, stored

#: Compressed bytes after which a task begins another archive; Spark reads an archive as one row.
ARCHIVE_BYTES = 8 << 20
#: Pages on which the dictionary is trained, characters of each that are read for that, and bytes of the dictionary.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 64 << 10
# Fixed values of the formats.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split()).encode('utf-8', 'surrogatepass').decode('utf-8', 'replace')}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def leading_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at a place ends, from its header and its blocks' headers."""
    if int.from_bytes(data[at : at + 4], "little") != FRAME:
        raise WarcError(f"no frame at byte {at}")
    if at + 5 > len(data):
        raise WarcError("a frame is cut off")
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = (single, 2, 4, 8)[flags >> 6]
    p = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size
    while True:
        if p + 3 > len(data):
            raise WarcError("a frame is cut off")
        block = int.from_bytes(data[p : p + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise WarcError(f"a block of unknown kind at byte {p}")
        p += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            break
    p += 4 * (flags >> 2 & 1)
    if p > len(data):
        raise WarcError("a frame is cut off")
    return p


def headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"a header line without a name: {line[:40]!r}")
        out[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a frame's one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("not a WARC record")
    h = headers(lines)
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in h]
    if missing:
        raise WarcError(f"a record without {', '.join(missing)}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"the length of {h['warc-record-id']} is not its Content-Length")
    return h, rest[:-4]


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, in their order."""
    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == SKIPPABLE:
        at = 8 + int.from_bytes(data[4:8], "little")
        if at > len(data):
            raise WarcError("the dictionary is cut off")
        packed = bytes(data[8:at])
        if int.from_bytes(packed[:4], "little") == FRAME:
            packed = zstandard.ZstdDecompressor().decompress(packed)
        dictionary = zstandard.ZstdCompressionDict(packed)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        frame = reader.decompressobj()
        raw = frame.decompress(data[at:end])
        if not frame.eof:
            raise WarcError(f"the frame at byte {at} does not end")
        yield parse_record(raw)
        at = end


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample; where there is too little to train on, the sample's text as it is."""
    rows = sample_rows(pages, "page_id", SAMPLE_PAGES).select(F.substring("html", 1, SAMPLE_CHARS).alias("t")).limit(4 * SAMPLE_PAGES).collect()
    samples = sorted(r.t.encode("utf-8", "surrogatepass") for r in rows if r.t)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"


def _with_originals(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, sha1, first): first is the smallest page_id of an equal payload, where it is another's."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    sha = F.sha1(F.col("html").cast("binary"))
    groups = p.select("page_id", sha.alias("sha1")).groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    groups = stored(groups.where("first < last").select("sha1", "first"), "payloads")  # of single payloads nothing need be known
    return p.withColumn("sha1", sha).join(groups, "sha1", "left").withColumn("first", F.when(F.col("first") < F.col("page_id"), F.col("first")))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below a folder; returns the list of those that count: (archive, records, bytes)."""
    dictionary = train_dictionary(pages)
    schema = arrow_schema("archive string, records long, bytes long")
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        lead = leading_frame(dictionary)
        name, out, records, size = "", None, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], schema=schema)

        for b in batches:
            for page, url, html, sha, first in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "sha1", "first")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out, records, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, len(lead)
                    out.write(lead)
                payload = html.encode("utf-8", "surrogatepass")
                frame = packer.compress(record(page, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), first))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    made = _with_originals(pages).select("page_id", "url", "html", "sha1", "first").mapInArrow(run, "archive string, records long, bytes long")
    return stored(made, "archives")


def read_archives(spark: SparkSession, path: str, archives: DataFrame | None = None) -> DataFrame:
    """One row for each record of the archives in a folder, or of those listed: page_id, payload_bytes, payload_digest, record_type, refers_to, payload_ok."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if archives is not None:
        files = files.join(archives.select("archive"), "archive", "left_semi")

    def start():
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None

        def batch(rows):
            out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for content in rows["content"]:
                for h, block in read_archive(content):
                    head, gap, payload = block.partition(b"\r\n\r\n")
                    kind, said = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = headers(head.partition(b"\r\n")[2]).get("content-length", "")
                    if not gap or not size.isdigit():
                        raise WarcError(f"{h['warc-record-id']} has no HTTP headers")
                    if kind == "response" and (len(payload) != int(size) or digest(payload) != said):
                        raise WarcError(f"the payload of {h['warc-record-id']} is not what its headers say")
                    if kind == "revisit" and (payload or "warc-refers-to" not in h):
                        raise WarcError(f"{h['warc-record-id']} is no proper revisit")
                    for k, v in (("page_id", number(h["warc-record-id"])), ("payload_bytes", int(size)), ("payload_digest", said), ("record_type", kind), ("refers_to", number(h["warc-refers-to"]) if kind == "revisit" else None)):
                        out[k].append(v)
            return out

        return batch

    return map_rows(files, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", start)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages and reads the archives back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    archives = write_archives(pages, path)
    if archives.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, path, archives)
