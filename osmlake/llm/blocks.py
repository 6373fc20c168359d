"""Documents in blocks, and corpus-wide counts of hashed keys that come back to each block.

A block is some MB of whole documents.  Each block sends its distinct 64-bit
keys, sorted, as delta-coded arrays to the partitions of the key space; each
partition adds up the counts of all blocks and answers every block with the
totals in the order of its keys.  One row carries thousands of keys, a key is
sent at most once by a block however often it occurs there, and the table of
blocks is bucketed by block, so texts are never shuffled again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from osmlake.llm.runtime import block_table_name, partitions

#: Bytes of text in a block (a longer document is a block of its own).
BLOCK_BYTES = 4 << 20
#: Most buckets of the table of blocks (Spark allows 100,000); a bucket then has several blocks, which changes no result.
BUCKETS = 1 << 15
BLOCK, PART = "__block__", "__part__"


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    v = np.ascontiguousarray(values, dtype="<i8")
    low, high = (int(v.min()), int(v.max())) if len(v) else (0, 0)
    width = 8 if low < 0 or high >> 32 else 4 if high >> 16 else 2 if high >> 8 else 1
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    """The inverse of ``pack_ints``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=1 << 40) if len(data) > 1 else b"", np.uint8)
    planes = raw.reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<i8")


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys, as differences."""
    return pack_ints(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data).view(np.uint64), dtype=np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of the key space that each key is in; it never falls as keys rise."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def split(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """(part, range) of each part that has some of the sorted keys."""
    own = part_of(keys, parts)
    edge = np.flatnonzero(np.diff(own, prepend=-1, append=-1)) if len(own) else np.zeros(0, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(own[a]), slice(a, b)


class Dealer:
    """Deals rows to blocks as they come: for each the block's id and its place there."""

    def __init__(self, limit: int = 0):
        self.limit = limit or BLOCK_BYTES
        self.open: dict = {}

    def deal(self, sizes: list[int], flags: list | None = None) -> tuple[list[int], list[int]]:
        """``flags``: rows of different flags never share a block."""
        blocks, places = [], []
        for size, flag in zip(sizes, flags or [None] * len(sizes)):
            block, held, n = self.open.get(flag, (0, self.limit + 1, 0))
            if held + size > self.limit:
                block, held, n = uuid.uuid4().int >> 66, 0, 0
            self.open[flag] = (block, held + size + 1, n + 1)
            blocks.append(block)
            places.append(n)
        return blocks, places


def write_blocks(placed: DataFrame, n: int, base: str) -> DataFrame:
    """A table with a block column, written once in ``n`` buckets of blocks."""
    name = block_table_name()
    placed.write.option("compression", "zstd").option("path", f"{base}/blocks").bucketBy(min(BUCKETS, n), BLOCK).saveAsTable(name)
    return placed.sparkSession.table(name)


def block_table(docs: DataFrame, base: str, apart: str | None = None) -> DataFrame:
    """``docs`` with a block column, written once as a table bucketed by block.

    Rows stay in the task that read them: no shuffle.  ``apart``: a boolean
    column; its true and its false rows never share a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer()
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text").cast("binary")), 0).to_pylist()
            blocks, _ = dealer.deal(sizes, batch.column(apart).to_pylist() if apart else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], [*batch.schema.names, BLOCK])

    return write_blocks(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(BLOCK, LongType())])), partitions(docs, BLOCK_BYTES), base)


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a block by doc_id (nulls first) and text, so that every pass sees them alike."""
    rows = list(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] or ""))
    return table.take(pa.array(order, pa.int64()))


SENT = f"{PART} int, {BLOCK} long, apart boolean, keys binary, counts binary"
ANSWER = f"{BLOCK} long, {PART} int, counts binary, apart_counts binary"


def send(block: int, apart: bool, parts: int, kinds: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """A block's rows: for each kind its sorted distinct keys and their counts."""
    rows = []
    for kind, (keys, counts) in enumerate(kinds):
        rows += [(kind * parts + p, block, apart, pack_keys(keys[r]), pack_ints(counts[r])) for p, r in split(keys, parts)]
    columns = list(zip(*rows)) if rows else [[]] * 5
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[PART, BLOCK, "apart", "keys", "counts"])


def _totals(table: pa.Table) -> pa.Table:
    """Answers of one partition of the key space.

    A last row with a null block has the sums over its keys: all counts, keys
    with a count, and the same without what blocks apart have counted.
    """
    blocks, apart = table.column(BLOCK).to_pylist(), table.column("apart").to_pylist()
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = [unpack_ints(x) for x in table.column("counts").to_pylist()]
    sizes = [len(k) for k in keys]
    flat, n = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    order = np.argsort(flat)
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    times = np.diff(first, append=len(flat))
    del flat
    total = np.add.reduceat(n[order], first)
    n[~np.repeat(np.array(apart, bool), sizes)] = 0
    total_aside = np.add.reduceat(n[order], first)
    back, back_aside = np.empty_like(n), np.empty_like(n)
    back[order], back_aside[order] = np.repeat(total, times), np.repeat(total_aside, times)
    cut = np.cumsum(sizes)[:-1]
    rows = [
        (b, p, pack_ints(x), pack_ints(y) if a else None)
        for b, p, a, x, y in zip(blocks, table.column(PART).to_pylist(), apart, np.split(back, cut), np.split(back_aside, cut))
    ]
    kept = total - total_aside
    sums = [int(total.sum()), int((total > 0).sum()), int(kept.sum()), int((kept > 0).sum())]
    rows.append((None, table.column(PART)[0].as_py(), pack_ints(np.array(sums)), None))
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=[BLOCK, PART, "counts", "apart_counts"])


def corpus_counts(table: DataFrame, parts: int, kinds: Callable[[pa.Table], tuple[bool, list[tuple[np.ndarray, np.ndarray]]]]) -> DataFrame:
    """Answers to all blocks of ``table``; ``kinds`` gives a block's (apart, [(sorted keys, counts), ...])."""

    def emit(rows: pa.Table) -> pa.Table:
        return send(rows.column(BLOCK)[0].as_py(), *(lambda a, k: (a, parts, k))(*kinds(rows)))

    return by_part(table.groupBy(BLOCK).applyInArrow(emit, SENT), parts).applyInArrow(_totals, ANSWER)


def by_part(rows: DataFrame, parts: int):
    """Messages grouped by partition of the key space, with as many tasks as partitions: a task doesn't grow with the input.

    The partition itself says which task takes it, so that no task gets several by chance.
    """
    return rows.repartitionById(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts), F.col(PART)).groupBy(PART)


def answers(rows: pa.Table, parts: int, kinds: int, column: str = "counts") -> list[np.ndarray]:
    """The totals for each kind, in the order of the block's keys."""
    by_part = sorted((p, x) for p, x in zip(rows.column(PART).to_pylist(), rows.column(column).to_pylist()))
    out = []
    for kind in range(kinds):
        own = [unpack_ints(x) for p, x in by_part if kind * parts <= p < (kind + 1) * parts]
        out.append(np.concatenate(own) if own else np.zeros(0, np.int64))
    return out


def key_parts(docs: DataFrame) -> int:
    """Partitions of the key space, in proportion to the documents."""
    return partitions(docs, 3 << 20)


def not_null(df: DataFrame) -> DataFrame:
    return df.where(F.col(BLOCK).isNotNull())
