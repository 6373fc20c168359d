"""Byte-level BPE: overlapping chunks are pre-tokenised, stitched and encoded.

A pre-token depends only on the text from its own start on, so two chunkings
agree from any boundary that both have.  A chunk is pre-tokenised from its
first character, whatever that cuts through; where its boundaries meet those
of the chunk before it inside their overlap, the two are stitched.  Matches
that end within ``AHEAD`` characters of the end of a chunk are not trusted.
If no boundary is shared, the earlier chunk goes on to where one is.

Chunks of documents above ``LONG`` characters are rows of their own, dealt over
all tasks, which pre-tokenise them and encode the pieces; gathered by document
they are stitched and the ids of the pieces that stand are joined.  Shorter
documents are cut, stitched and encoded within a task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.llm import textkernel as tk
from osmlake.llm.runtime import partitions

#: Characters in a chunk, and how many of them the next chunk repeats.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Documents of more characters are pre-tokenised by many tasks.
LONG = 1 << 21
#: Characters after a match that the pattern may have to see (the longest contraction has three).
AHEAD = 4
#: Pieces whose ids a worker remembers.
REMEMBERED = 1 << 18


def read_ranks(path: str) -> bytes:
    """The raw bytes of a rank file (at most a few MB: one line for each token of the vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def boundaries(pattern, text: str, start: int, stop: int) -> list[int]:
    """Ends of the pre-tokens of ``text[start:stop]``, taken as a text of its own."""
    return [start + m.end() for m in pattern.finditer(text[start:stop])]


def chunk_starts(length: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where the chunks of a text begin; the last one reaches its end."""
    return list(range(0, max(1, length - overlap), max(1, chunk - overlap)))


def stitch(pattern, text: str, found: list[tuple[int, int, list[int]]]) -> list[int]:
    """Boundaries of the whole text, from (start, stop, boundaries) of its chunks in order."""
    cuts = [0]
    for start, stop, ends in found:
        if stop <= cuts[-1] or cuts[-1] == len(text):
            continue
        trusted = ends if stop == len(text) else [x for x in ends if x <= stop - AHEAD]
        shared = {start, *trusted}
        k = len(cuts) - 1
        while k >= 0 and cuts[k] >= start and cuts[k] not in shared:
            k -= 1
        if k >= 0 and cuts[k] >= start:
            at = cuts[k]
            del cuts[k + 1 :]
            cuts += [x for x in trusted if x > at]
            continue
        span = 2 * (stop - cuts[-1])  # no boundary is shared: go on from the last one, over a span that grows
        while cuts[-1] < stop - AHEAD or stop == len(text) != cuts[-1]:
            end = min(len(text), cuts[-1] + span)
            more = boundaries(pattern, text, cuts[-1], end)
            cuts += more if end == len(text) else [x for x in more if x <= end - AHEAD]
            span *= 2
    return cuts


def stitched(pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pre-tokens of the whole text, from those of its overlapping chunks."""
    if len(text) <= chunk:
        return pattern.findall(text)
    spans = [(a, min(len(text), a + chunk)) for a in chunk_starts(len(text), chunk, overlap)]
    cuts = stitch(pattern, text, [(a, b, boundaries(pattern, text, a, b)) for a, b in spans])
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


class ByteBpe:
    """Encoder and decoder for one rank file."""

    _held: dict[bytes, ByteBpe] = {}

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.pattern = regex.compile(pattern)
        self._piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})._encode_single_piece
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_of[rank] = token
        self.digits = [str(k) for k in range(len(self.bytes_of))]
        self._ids: dict[str, list[int]] = {}

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> ByteBpe:
        """One instance for each rank file and pattern in a worker."""
        key = hashlib.sha256(ranks + pattern.encode()).digest()
        if key not in cls._held:
            cls._held[key] = cls(ranks, pattern)
        return cls._held[key]

    def encode(self, text: str) -> list[int]:
        return self.encode_pieces(stitched(self.pattern, text))

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        known = self._ids
        for piece in pieces:
            try:
                ids += known[piece]
            except KeyError:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[piece] = got = list(self._piece(piece.encode()))
                ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: A chunk of a long document: where it begins, its text, the ends of its pieces, and the ids of those with how many each has.
CHUNKS = "doc_id long, h long, at long, piece string"
ENCODED = f"{CHUNKS}, ends array<long>, counts array<int>, ids array<int>"


def _standing(bpe: ByteBpe, parts: list[dict]) -> list[int]:
    """The ids of a whole text from its encoded chunks in order: those of the pieces that the stitched text has, others encoded here."""
    text = "".join(p["piece"][: q["at"] - p["at"]] for p, q in zip(parts, parts[1:])) + parts[-1]["piece"]
    cuts = np.array(stitch(bpe.pattern, text, [(p["at"], p["at"] + len(p["piece"]), p["ends"]) for p in parts]), np.int64)
    start, end = cuts[:-1], cuts[1:]
    source, local = np.full(len(start), -1, np.int64), np.zeros(len(start), np.int64)
    for c, p in enumerate(parts):
        ends = np.array(p["ends"], np.int64)
        begins = np.concatenate([[p["at"]], ends[:-1]])[: len(ends)]
        k = np.minimum(np.searchsorted(start, begins), max(0, len(start) - 1))
        same = np.flatnonzero((start[k] == begins) & (end[k] == ends) & (source[k] < 0)) if len(start) else np.zeros(0, np.int64)
        source[k[same]], local[k[same]] = c, same
    offsets = [np.concatenate([[0], np.cumsum(p["counts"], dtype=np.int64)]) for p in parts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(source) != 0) | (np.diff(local) != 1)])) if len(start) else np.zeros(0, np.int64)
    ids: list[int] = []
    for a, b in zip(new.tolist(), np.append(new[1:], len(start)).tolist()):
        c = int(source[a])
        if c < 0:
            ids += bpe.encode_pieces([text[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist())])
        else:
            ids += parts[c]["ids"][int(offsets[c][local[a]]) : int(offsets[c][local[b - 1] + 1])]
    return ids


def _encoded(docs: DataFrame, ranks, pattern: str, finish, schema) -> DataFrame:
    """``finish(doc ids, lists of token ids)`` of all documents; long ones take the way over chunk rows."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") > LONG, F.lit(False))
    chunk, overlap = CHUNK, OVERLAP

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks.value, pattern)
        for batch in tk.small_batches(batches):
            texts = batch.column(1).to_pylist()
            yield finish(batch.column(0), [bpe.encode(t or "") for t in texts], bpe)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("piece", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, text, h = (batch.column(c)[k].as_py() for c in ("doc_id", "text", "h"))
                for a in chunk_starts(len(text), chunk, overlap):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "h": h, "at": a, "piece": text[a : a + chunk]}], schema=kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks.value, pattern)
        for batch in batches:
            more = pa.schema([*batch.schema, ("ends", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])
            for row in batch.to_pylist():
                ends = boundaries(bpe.pattern, row["piece"], 0, len(row["piece"]))
                found = [bpe.encode_pieces([row["piece"][a:b]]) for a, b in zip([0, *ends], ends)]
                own = {"ends": [row["at"] + x for x in ends], "counts": [len(x) for x in found], "ids": [i for x in found for i in x]}
                yield pa.RecordBatch.from_pylist([row | own], schema=more)

    def join(rows: pa.Table) -> pa.Table:
        bpe = ByteBpe.of(ranks.value, pattern)
        copies = rows.column("at").to_pylist().count(0)
        unique = {r["at"]: r for r in rows.to_pylist()}
        parts = [unique[k] for k in sorted(unique)]
        ids = _standing(bpe, parts)
        return pa.Table.from_batches([finish(pa.array([parts[0]["doc_id"]] * copies, pa.int64()), [ids] * copies, bpe)])

    chunks = slim.where(is_long).withColumn("h", F.xxhash64("text")).mapInArrow(cut, CHUNKS)
    spread = chunks.repartition(partitions(docs, 16 << 20), "doc_id", "h", "at").mapInArrow(work, ENCODED)
    return slim.where(~is_long).mapInArrow(short, schema).unionByName(spread.groupBy("doc_id", "h").applyInArrow(join, schema))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text; null text: no ids.

    Repeated rows each get a row, a null doc_id stays null, an empty table
    gives an empty result.  Extra columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def finish(doc_ids: pa.Array, ids: list[list[int]], _: ByteBpe) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _encoded(docs, ranks, pattern, finish, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the concatenated bytes of every row's ids; null ids: empty."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks.value, pattern)
        for batch in tk.small_batches(batches):
            out = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the bytes they decode to.

    ``keep_ids``: the ids themselves follow, as a column of arrays.  Encoding
    and decoding run in the same task, so ids never leave it.  Null text counts
    as empty; repeated rows each get a row; a null doc_id stays null; an empty
    table gives an empty result.  Extra columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def finish(doc_ids: pa.Array, ids: list[list[int]], bpe: ByteBpe) -> pa.RecordBatch:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        columns = [
            doc_ids,
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([sha(" ".join(map(bpe.digits.__getitem__, x)).encode()) for x in ids], pa.string()),
            pa.array([sha(bpe.decode(x)) for x in ids], pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    return _encoded(docs, ranks, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
