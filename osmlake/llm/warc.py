"""WARC archives as Zstandard: one dictionary, one frame for each record.

An archive begins with a skippable frame that holds the dictionary; every
record is a frame of its own.  Reading takes the dictionary from that frame,
decodes one frame at a time, and checks versions, headers, lengths, ids and
digests.

Archives are written by the tasks that compress the records, through
``pyarrow.fs``, into the shared folder; each attempt of a task writes files
of its own name and only those that the manifest (a table) names are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.llm import textkernel as tk
from osmlake.llm.runtime import bounded_sample, materialise, partitions, shared_dir

#: The magic numbers of a dictionary's skippable frame and of a data frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Bytes of the trained dictionary, and how many payloads of at most how many bytes it is trained on.
DICTIONARY, SAMPLE, SAMPLE_BYTES = 32 << 10, 400, 16 << 10
#: An archive is closed at about this size.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
LEVEL = 3
#: Salts over which the rows of one payload are dealt in the join that finds its response.
SALTS = 16

#: Fixed values of the records' headers.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadWarc(ValueError):
    """The bytes aren't a well-formed archive."""


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A stable record id for a page."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the response of the same payload."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page", str(refers_to))]
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; raises BadWarc unless all is in order."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise BadWarc("no WARC/1.1 header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or name.lower() in headers:
            raise BadWarc("a header line is malformed or repeated")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadWarc(f"no {name}")
    if not headers["content-length"].isdigit() or len(rest) != (n := int(headers["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise BadWarc("the length isn't that of the block")
    block = rest[:n]
    if headers["warc-type"] == "response":
        if int(headers["warc-payload-length"]) != n or headers["warc-payload-digest"] != f"sha1:{digest(block)}":
            raise BadWarc("the payload isn't the one that the headers describe")
    elif headers["warc-type"] == "revisit":
        if n or "warc-refers-to" not in headers or headers.get("warc-profile") != PROFILE:
            raise BadWarc("a revisit has a block or refers to nothing")
    else:
        raise BadWarc("another type of record")
    return headers, block


def read_archive(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame at a time."""
    if len(data) < 8:
        raise BadWarc("no leading frame")
    magic, size = struct.unpack_from("<II", data, 0)
    if magic != SKIPPABLE or 8 + size > len(data):
        raise BadWarc("no dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])) if size else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(data):
        if len(data) - at < 4 or struct.unpack_from("<I", data, at)[0] != FRAME:
            raise BadWarc("not a frame")
        step = reader.decompressobj()
        out = []
        end = at
        while not step.eof and end < len(data):
            out.append(step.decompress(data[end : end + 16384]))
            end = min(end + 16384, len(data))
        if not step.eof:
            raise BadWarc("a frame is cut off")
        at = end - len(step.unused_data)
        yield parse(b"".join(out))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads (empty where zstd can't make one of so few)."""
    sample = bounded_sample(pages.where("html is not null").where(F.octet_length("html") <= SAMPLE_BYTES), ["page_id", "html"], SAMPLE)
    texts = [bytes(r[0]) for r in sample.select(F.col("html").cast("binary")).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_responses(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): html null becomes empty; refers_to is null for responses.

    Of the pages of equal payloads that with the largest page_id is the
    response.  Only payloads that occur twice are joined, and their rows are
    dealt over salts, so one common payload doesn't land in one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    repeated = keyed.groupBy("sha", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("sha", "size", "response")
    repeated = repeated.where(F.col("size") >= LEAST_REVISIT).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(repeated, ["sha", "size", "salt"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("response"), F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, base: str) -> DataFrame:
    """Write every page to archives below ``base``; the manifest (path, records, bytes), materialised."""
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages))
    folder = f"{base}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = dictionary.value
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
        store, root = fs.FileSystem.from_uri(folder)
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, n = f"{root}/{uuid.uuid4().hex}.warc.zst", 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                    size = out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
                size += out.write(writer.compress(record(page_id, url, html.encode(), refers_to)))
                n += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])

    return materialise(with_responses(pages).mapInArrow(run, "path string, records long, bytes long"), f"{base}/manifest")


def read_archives(manifest: DataFrame, base: str, payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the archives.

    The number of records of each archive must be that of the manifest.
    ``payload=False``: without the payloads, which are read and checked all the
    same.
    A revisit has no payload of its own; its length and digest are those of
    the response that it refers to.
    """
    folder = f"{base}/archives"
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as f:
                    data = memoryview(f.read())
                held, size, n = [], 0, 0
                for head, block in read_archive(data):
                    refers = head.get("warc-refers-to-page")
                    held.append((int(head["warc-page-id"]) if head.get("warc-page-id") else None, head.get("warc-target-uri"), int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], int(refers) if refers else None, *[block] * payload))
                    size, n = size + len(block), n + 1
                    if size > tk.BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names)
                if n != records:
                    raise BadWarc(f"{path} has {n} records, not {records}")

    dealt = manifest.select("path", "records").repartition(max(partitions(manifest, 1 << 20), 1), "path")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null html counts as empty.  Rows that repeat a page_id each have a record;
    with equal payloads they are all responses.  A page with a null page_id is
    a response and never the one that others refer to.  An empty table gives an
    empty result; extra columns are ignored.
    """
    base = shared_dir(pages.sparkSession)
    return read_archives(write_archives(pages, base), base, payload=False).drop("url")
