"""WARC archives compressed with Zstandard and a shared dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; each record is one frame behind it. Writing deduplicates payloads:
of records with equal payloads the one with the largest id is a response, the
others are revisits that refer to it. Reading loads the dictionary from the
leading frame, finds the end of each frame from its block headers, decodes one
record per frame and validates headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, new_path

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: The dictionary is trained on at most so many pages, none longer than so many characters.
DICT_PAGES = 400
DICT_PAGE_CHARS = 50_000
DICT_BYTES = 32_768
#: An archive is closed once it holds so many bytes.
ROLL_BYTES = 8 << 20

RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | None) -> str:
    h = f"{int(page_id is None):016x}{(page_id or 0) & (2**64 - 1):016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(rid: str) -> int | None:
    h = rid.removeprefix("<urn:uuid:").removesuffix(">").replace("-", "")
    if len(h) != 32:
        raise ValueError(f"not a record id of this archive: {rid}")
    n = int(h[16:], 16)
    return None if int(h[:16], 16) else n - (1 << 64) * (n >> 63)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, response_id: int | None, is_response: bool) -> bytes:
    """One serialized record; a revisit keeps the HTTP head and leaves the payload out."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    head = [
        VERSION, f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}", "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if not is_response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(response_id)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """A row of RECORD_SCHEMA from one decoded frame; raises ValueError if it is not a whole valid record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] != VERSION:
        raise ValueError("a frame does not begin with a WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"malformed header line: {line!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := [f for f in MANDATORY if f.lower() not in fields]:
        raise ValueError(f"headers are missing: {missing}")
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError(f"content length {size} does not match the record")
    if fields.get("warc-block-digest", "sha1:" + sha1_base32(block)) != "sha1:" + sha1_base32(block):
        raise ValueError("block digest does not match")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise ValueError("the block has no HTTP head")
    whole = next((int(h.split(b":", 1)[1]) for h in http.split(b"\r\n")[1:] if h.lower().startswith(b"content-length:")), None)
    if kind == "response":
        if whole != len(payload) or digest != sha1_base32(payload):
            raise ValueError("payload length or digest does not match")
        refers = None
    elif kind == "revisit":
        if payload or whole is None or "warc-refers-to" not in fields or fields.get("warc-profile") != PROFILE:
            raise ValueError("malformed revisit")
        refers, payload = page_of(fields["warc-refers-to"]), None
    else:
        raise ValueError(f"unexpected record type {kind}")
    return page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, refers, whole, digest, payload


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its header and block headers."""
    import zstandard

    if bytes(data[at : at + 4]) != FRAME_MAGIC:
        raise ValueError("no Zstandard frame where one must begin")
    flags = data[at + 4]
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        if at + 3 > len(data):
            raise ValueError("truncated frame")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, (block >> 1) & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
        if last:
            at += 4 * bool(flags & 4)
            if at > len(data):
                raise ValueError("truncated frame")
            return at


def read_archive(raw: bytes) -> Iterator[tuple]:
    """The records of one archive."""
    import zstandard

    data, at, dictionary = memoryview(raw), 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == SKIPPABLE_MAGIC:
        size = struct.unpack_from("<I", raw, 4)[0]
        stored = bytes(data[8 : 8 + size])
        if len(stored) != size:
            raise ValueError("truncated dictionary frame")
        if stored[:4] == FRAME_MAGIC:  # the dictionary itself may be compressed
            stored = zstandard.ZstdDecompressor().decompress(stored)
        dictionary, at = zstandard.ZstdCompressionDict(stored), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        frame = data[at:end]
        size = zstandard.frame_content_size(frame)
        yield parse_record(decoder.decompress(frame) if size >= 0 else decoder.decompressobj().decompress(frame))
        at = end


def train_dictionary(pages: DataFrame) -> bytes | None:
    """A Zstandard dictionary from a bounded sample of pages; none if they are too few."""
    import zstandard

    html = pages.select("page_id", "html").where(F.length("html").between(1, DICT_PAGE_CHARS)).withColumn("o", F.xxhash64("html", "page_id"))
    # the order's limit first, so that tasks send numbers and no pages
    last = html.select("o").orderBy("o").limit(DICT_PAGES).agg(F.max("o")).first()[0]
    rows = html.where(F.col("o") <= F.lit(last)).limit(DICT_PAGES).collect() if last is not None else []
    rows.sort(key=lambda r: r["o"])
    samples = [record_bytes(r["page_id"], None, r["html"].encode(), None, True) for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


def _save(directory: str, name: str, raw: bytes) -> str:
    """Write a file whole under its final name, so that a repeated task replaces its own output."""
    if directory.startswith("file:") or "://" not in directory:
        local = directory.removeprefix("file://").removeprefix("file:")
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        with open(part, "wb") as f:
            f.write(raw)
        os.replace(part, f"{local}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(directory)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as f:  # visible once it is closed
            f.write(raw)
    return f"{directory}/{name}"


def write_warc(pages: DataFrame, directory: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; returns ``file, records, bytes`` of the archives.

    Null html is an empty payload. A row is a response if its payload has under
    ``min_bytes`` bytes or its page_id is the largest of those with an equal
    payload (rows that repeat that id are all responses); others are revisits of
    it. Among equal payloads null ids count as smallest; if all are null all are
    responses. Very long pages are one record each. No rows write no archive.
    Extra columns are not read. An archive counts once its task has ended: read
    with the manifest, as a task that died may have left files behind.
    """
    raw_dict = train_dictionary(pages)
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long_enough = F.octet_length("html") >= min_bytes
    copies = materialize(p.where(long_enough).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").select("digest", "response_id"), "warc-copies")
    # only digests that occur more than once are looked up; rows of a hot digest are split by Spark if it must shuffle
    typed = p.join(broadcast_if_small(copies, copies.count()), "digest", "left").withColumn(
        "is_response", ~long_enough | F.col("response_id").isNull() | F.coalesce(F.col("page_id") == F.col("response_id"), F.lit(False))
    )
    sent = p.sparkSession.sparkContext.broadcast(raw_dict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdCompressionDict(sent.value) if sent.value else None
        packer = zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=True) if d else zstandard.ZstdCompressor(level=6, write_checksum=True)
        first = struct.pack("<II", SKIPPABLE_MAGIC, len(sent.value)) + sent.value if sent.value else b""
        part, done, frames, size = TaskContext.get().partitionId(), [], [], 0

        def close() -> None:
            nonlocal frames, size
            if frames:
                raw = first + b"".join(frames)
                done.append((_save(directory, f"part-{part:06d}-{len(done):05d}.warc.zst", raw), len(frames), len(raw)))
            frames, size = [], 0

        for b in batches:
            for i, u, h, r, ok in zip(*(b.column(c) for c in ("page_id", "url", "html", "response_id", "is_response")), strict=True):
                frames.append(packer.compress(record_bytes(i.as_py(), u.as_py(), h.as_py().encode(), r.as_py(), ok.as_py())))
                size += len(frames[-1])
                if size >= ROLL_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return materialize(typed.select("page_id", "url", "html", "response_id", "is_response").mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


def _listed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files of ``manifest``: a writing task numbers its archives from 0, and one that died before may have left more."""
    name = F.regexp_extract("path", r"part-(\d+)-(\d+)\.warc\.zst$", 1).alias("part")
    nth = F.regexp_extract("path", r"part-(\d+)-(\d+)\.warc\.zst$", 2).cast("long").alias("nth")
    of_task = manifest.select(F.col("file").alias("path")).select(name).groupBy("part").agg(F.count("*").alias("n"))  # a row for each writing task
    return files.select("*", name, nth).join(broadcast_if_small(of_task, of_task.count()), "part").where("nth < n").select("content")


def read_warc(spark: SparkSession, directory: str, payload: bool = True, manifest: DataFrame | None = None) -> DataFrame:
    """The records of the archives in a folder (RECORD_SCHEMA; payloads on demand; null for revisits).

    With the ``manifest`` that ``write_warc`` returned only its archives are read,
    else all in the folder. A record that is cut short, lacks a mandatory header or
    does not match its lengths or digests fails the query. An archive without
    records gives no rows.
    """
    schema = RECORD_SCHEMA if payload else RECORD_SCHEMA.rpartition(", ")[0]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    width = len(names) if payload else len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], types[k]) for k in range(width)], names[:width])

        for b in batches:
            for raw in b.column(0):
                some, size = [], 0
                for r in read_archive(raw.as_py()):
                    some.append(r[:width])
                    size += len(r[6] or b"") if payload else 200
                    if size >= ROLL_BYTES:
                        yield rows(some)
                        some, size = [], 0
                if some:
                    yield rows(some)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(directory).select("path", "content")
    files = _listed(files, manifest) if manifest is not None else files.select("content")
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back (without payloads)."""
    spark = pages.sparkSession
    directory = new_path(spark, "warc")
    manifest = write_warc(pages, directory)
    if not manifest.agg(F.sum("records")).first()[0]:
        return spark.createDataFrame([], RECORD_SCHEMA.rpartition(", ")[0])
    return read_warc(spark, directory, payload=False, manifest=manifest)
