"""Change files: OSM change XML, gzipped or plain.

A file is read through Spark's own file systems, so wherever Spark can read.
Decompressing and cutting it into pieces of whole elements is one cheap pass
by one task, as gzip can't be split; the pieces are dealt over all tasks and
parsed there.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from osmlake.schemas import CHANGES, MEMBERS
from osmlake.sources.files import write_stream

#: Elements in a batch, bytes that are decompressed at once, and bytes of XML after which a piece is cut.
BATCH, READ, PIECE = 4096, 4 << 20, 1 << 20
_OPS, _KINDS = ("create", "modify", "delete"), ("node", "way", "relation")
_MARKUP = re.compile(rb"<!--.*?-->|<(/?)(create|modify|delete|node|way|relation)(?=[\s/>])", re.DOTALL)


def sequence_of(path: str) -> int | None:
    """The sequence number in a name such as ``4780.osc.gz``; None for other names."""
    m = re.search(r"(?:^|/)(\d+)\.osc(?:\.gz)?$", path)
    return int(m[1]) if m else None


def pieces(stream) -> Iterator[tuple[str, bytes]]:
    """(operation, XML of whole elements) of a change file, in file order; a piece ends at the next element after ``PIECE`` bytes."""
    held, at, op, begin = b"", 0, None, None
    while block := stream.read(READ):
        held += block
        comment = held.rfind(b"<!--")
        stop = comment if comment >= 0 and held.find(b"-->", comment) < 0 else len(held)
        safe = max(at, min(stop, len(held) - 16))  # a tag that the block cuts through is seen with the next block
        for m in _MARKUP.finditer(held, at):
            if m.start() >= safe:
                break
            at = m.end()
            closes, name = m[1], m[2].decode() if m[2] else None
            if name in _OPS:
                if closes and begin is not None:
                    yield op, held[begin : m.start()]
                op, begin = (None if closes else name), None
            elif name and not closes and op:
                if begin is not None and m.start() - begin >= PIECE:
                    yield op, held[begin : m.start()]
                    begin = None
                begin = m.start() if begin is None else begin
        at = max(at, safe)
        drop = at if begin is None else begin
        held, at, begin = held[drop:], at - drop, None if begin is None else 0
    for m in _MARKUP.finditer(held, at):
        if m[2] and m[2].decode() in _OPS:
            if m[1] and begin is not None:
                yield op, held[begin : m.start()]
            op, begin = (None if m[1] else m[2].decode()), None
        elif m[2] and not m[1] and op and begin is None:
            begin = m.start()
    if begin is not None:
        raise ValueError("a change file ends inside an operation")


def _number(value: str | None, kind: type):
    return None if value is None else kind(value)


def elements(op: str, piece: bytes) -> Iterator[dict]:
    """The elements of a piece, in file order.

    A missing changeset becomes 0, a missing role the empty string; no tags:
    an empty map; no node references: null.  Repeated keys of one element's
    tags: the last one counts.  Ids, versions and timestamps must be there.
    """
    for _, node in ElementTree.iterparse(io.BytesIO(b"<piece>" + piece + b"</piece>")):
        if node.tag not in _KINDS:
            continue
        a = node.attrib
        refs = [int(n.attrib["ref"]) for n in node.iter("nd")] if node.tag == "way" else []
        members = [{"type": m.attrib["type"], "ref": int(m.attrib["ref"]), "role": m.attrib.get("role", "")} for m in node.iter("member")] if node.tag == "relation" else []
        yield {
            "id": int(a["id"]), "type": node.tag, "op": op, "version": int(a["version"]), "timestamp": a["timestamp"],
            "uid": _number(a.get("uid"), int), "user": a.get("user"), "changeset": int(a.get("changeset", 0)),
            "tags": list({t.attrib["k"]: t.attrib["v"] for t in node.iter("tag")}.items()),
            "lat": _number(a.get("lat"), float), "lon": _number(a.get("lon"), float), "refs": refs or None, "members": members or None, "latest_ts": a["timestamp"],
        }
        node.clear()


def read_changes(spark: SparkSession, *paths: str) -> DataFrame:
    """The elements of change files, from any path that Spark reads; a compressed file must be below 2 GB.

    Python holds one block and one piece of a file's text, and the compressed
    file as it came.
    """
    schema = StructType.fromDDL(CHANGES)
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = pa.BufferReader(content.as_buffer())
                for k, (op, piece) in enumerate(pieces(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)):
                    yield pa.RecordBatch.from_pydict({"path": [path], "k": pa.array([k], pa.int32()), "op": [op], "piece": pa.array([piece], pa.binary())})

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict] = []
            for op, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in elements(op, piece):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    files = reduce(DataFrame.union, [spark.read.format("binaryFile").load(p).select("path", "content") for p in paths])  # a task for each
    cuts = files.mapInArrow(cut, "path string, k int, op string, piece binary")
    return cuts.repartition("path", "k").select("op", "piece").mapInArrow(parse, schema)


def _attribute(name: str, value) -> Column:
    escaped = F.col(value) if isinstance(value, str) else value
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    return F.when(escaped.isNotNull(), F.concat(F.lit(f' {name}="'), escaped, F.lit('"'))).otherwise(F.lit(""))


def as_xml(changes: DataFrame) -> DataFrame:
    """(op, xml) of change records: each as one element."""
    text = lambda c: F.col(c).cast("string")
    head = F.concat(*(_attribute(n, text(n)) for n in ("id", "version", "timestamp", "uid", "user", "changeset", "lat", "lon")))
    tags = F.transform(F.coalesce(F.map_entries("tags"), F.array().cast("array<struct<key:string,value:string>>")), lambda t: F.concat(F.lit("<tag"), _attribute("k", t["key"]), _attribute("v", t["value"]), F.lit("/>")))
    refs = F.transform(F.coalesce("refs", F.array().cast("array<bigint>")), lambda r: F.concat(F.lit("<nd"), _attribute("ref", r.cast("string")), F.lit("/>")))
    members = F.transform(
        F.coalesce("members", F.array().cast(MEMBERS)), lambda m: F.concat(F.lit("<member"), _attribute("type", m["type"]), _attribute("ref", m["ref"].cast("string")), _attribute("role", m["role"]), F.lit("/>"))
    )
    body = F.concat(F.lit("<"), F.col("type"), head, F.lit(">"), F.array_join(tags, ""), F.array_join(refs, ""), F.array_join(members, ""), F.lit("</"), F.col("type"), F.lit(">"))
    return changes.select("op", body.alias("xml"))


def write_changes(changes: DataFrame, path: str) -> None:
    """One gzipped change file of the records, on any file system of Spark's; rows stream through the driver."""
    def text() -> Iterator[bytes]:
        yield b'<?xml version="1.0" encoding="UTF-8"?>\n<osmChange version="0.6">'
        now = None
        for row in as_xml(changes).orderBy("op").toLocalIterator():
            if row.op != now:
                yield (f"</{now}>" if now else "").encode() + f"<{row.op}>".encode()
                now = row.op
            yield row.xml.encode()
        yield (f"</{now}>" if now else "").encode() + b"</osmChange>"

    write_stream(changes.sparkSession, path, text(), compress=path.endswith(".gz"))
