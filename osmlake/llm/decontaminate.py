"""Benchmark decontamination by a prefix-filtered set join.

The windows of an item (13 consecutive words; a shorter item is one window)
are sets of shingles.  A document can contain a window only if it has all of
its shingles, so for containment the prefix that must match is one token: the
rarest shingle of the window, rarity being counted over all documents.
Documents are joined on those prefix tokens alone.  A hit at a position fixes
where the window would start; the length bound (it must fit in the document)
and the positional bound discard hits, and the others are verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.llm import textkernel as tk
from osmlake.llm.runtime import fresh_name, materialise, shared_dir

#: Words of a window, words of a shingle.
WINDOW, SHINGLE = 13, 3
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is joined block by block.
BLOCK = 8 << 20
#: Blocks that one pass over the documents holds in memory.
HELD = 4
#: Columns of the hits so far, and whether a window of full length is among them.
MASK, MET, FULL = "__hit_words__", "__met_items__", "__full_window__"


@dataclass
class Windows:
    """Distinct windows of one block of items: word hashes, their shingles, and which items have them."""

    data: bytes
    word_start: np.ndarray
    word_end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    size: np.ndarray
    item: np.ndarray

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, window, offset in it, words in the shingle) of all windows."""
        out = []
        for width in range(1, SHINGLE + 1):
            own = np.flatnonzero(np.minimum(self.size, SHINGLE) == width)
            n = self.size[own] - width + 1
            window = np.repeat(own, n)
            offset = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
            at = self.first[window] + offset
            h = self.hashes[at].copy() if len(at) else np.zeros(0, np.uint64)
            for k in range(1, width):
                h = tk.combine(h, self.hashes[at + k])
            out.append((h, window, offset, np.full(len(h), width)))
        return tuple(np.concatenate(x) for x in zip(*out))


def benchmark_windows(texts: list[bytes]) -> Windows:
    """The windows of items, in order; ``item`` is the index of the owning text."""
    w = tk.Words(texts, tk.ALNUM_TABLE, lower=True)
    count = w.counts()
    n = np.where(count >= WINDOW, count - WINDOW + 1, (count > 0).astype(np.int64))
    item = np.repeat(np.arange(len(texts)), n)
    first = w.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    return Windows(w.data, w.start, w.end, w.hashes(), first, np.minimum(count[item], WINDOW), item)


def shingle_hashes(hashes: np.ndarray) -> list[np.ndarray]:
    """Hashes of all runs of 1 .. SHINGLE words."""
    out = [hashes]
    for k in range(1, SHINGLE):
        out.append(tk.combine(out[-1][: max(0, len(hashes) - k)], hashes[k:]))
    return out


def shingle_counts(docs: DataFrame, texts: list[bytes]) -> dict[int, int]:
    """How often each shingle of the windows occurs in all documents (pre-aggregated in each task)."""
    wanted = np.unique(benchmark_windows(texts).shingles()[0])
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = shared.value
        total = np.zeros(len(want), np.int64)
        for batch in tk.small_batches(batches):
            own = tk.as_bytes(batch.column(0))
            for a, b in tk.blocks(own):
                w = tk.Words(own[a:b], tk.ALNUM_TABLE, lower=True)
                for h in shingle_hashes(w.hashes()):
                    at = lookup(want, h)
                    total += np.bincount(at[at >= 0], minlength=len(want))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(want[met].view(np.int64)), pa.array(total[met])], ["shingle", "n"])

    if not len(wanted):
        return {}
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found.column("shingle").to_pylist(), found.column("n").to_pylist()))


_BITS = 20


def lookup(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions in a sorted array of distinct hashes, -1 where a value isn't there; a bit table answers most."""
    out = np.full(len(values), -1, np.int64)
    if not len(sorted_values) or not len(values):
        return out
    shift = np.uint64(64 - _BITS)
    there = np.zeros(1 << _BITS, bool)
    there[(sorted_values >> shift).astype(np.int64)] = True
    maybe = np.flatnonzero(there[(values >> shift).astype(np.int64)])
    at = np.searchsorted(sorted_values, values[maybe])
    at[at == len(sorted_values)] = 0
    ok = sorted_values[at] == values[maybe]
    out[maybe[ok]] = at[ok]
    return out


@dataclass
class Prefixes:
    """The join table: prefix tokens, sorted, and for each the windows that it is the rarest shingle of."""

    windows: Windows
    token: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def prefixes(texts: list[bytes], rarity: dict[int, int]) -> Prefixes:
    """One prefix token for each window: its rarest shingle, ties by the leftmost."""
    windows = benchmark_windows(texts)
    h, window, offset, _ = windows.shingles()
    n = np.fromiter((rarity.get(x, 0) for x in h.view(np.int64).tolist()), np.int64, len(h))
    order = np.lexsort((offset, n, window))
    best = order[np.concatenate([[True], window[order][1:] != window[order][:-1]])] if len(order) else order
    best = best[n[best] > 0]  # a window with a shingle that no document has is in none
    best = best[np.argsort(h[best], kind="stable")]
    token, begin = np.unique(h[best], return_index=True)
    return Prefixes(windows, token, begin, np.append(begin[1:], len(best)), window[best], offset[best])


def hits(table: Prefixes, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every verified occurrence in a block of documents."""
    hashes = w.hashes()
    starts, found = [], []
    text_of = np.searchsorted(w.first, np.arange(len(w)), side="right") - 1
    for h in shingle_hashes(hashes):
        at = lookup(table.token, h)
        pos = np.flatnonzero(at >= 0)
        n = table.end[at[pos]] - table.begin[at[pos]]
        entry = np.repeat(table.begin[at[pos]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = np.repeat(pos, n)
        window = table.window[entry]
        start = pos - table.offset[entry]  # the positional bound: only here can the window start
        size = table.windows.size[window]
        ok = (start >= w.first[text_of[pos]]) & (start + size <= w.first[text_of[pos] + 1])  # the length bound
        starts.append(start[ok])
        found.append(window[ok])
    start, window = np.concatenate(starts), np.concatenate(found)
    for k in range(WINDOW):
        size = table.windows.size[window]
        at = np.minimum(start + k, len(hashes) - 1)
        same = (k >= size) | (hashes[at] == table.windows.hashes[np.minimum(table.windows.first[window] + k, len(table.windows.hashes) - 1)])
        start, window = start[same], window[same]
    b = table.windows
    exact = np.fromiter(
        (all(w.data[w.start[s + k] : w.end[s + k]] == b.data[b.word_start[f + k] : b.word_end[f + k]] for k in range(n)) for s, f, n in zip(start.tolist(), b.first[window].tolist(), b.size[window].tolist())),
        bool,
        len(start),
    )
    return start[exact], window[exact]


def _benchmark_blocks(benchmark: DataFrame) -> Iterator[tuple[list[bytes], list[str]]]:
    """The benchmark in blocks of a bounded size, each (texts, item ids as strings)."""
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    texts, ids, held = [], [], 0
    for row in items.toLocalIterator(prefetchPartitions=True):
        if texts and held + len(row.text) > BLOCK:
            yield texts, ids
            texts, ids, held = [], [], 0
        texts.append(bytes(row.text))
        ids.append(row.item_id)
        held += len(row.text)
    yield texts, ids


def _judge(texts: list[bytes], tables: list, masks: list[bytes | None], met: list[list[str] | None], full: list[bool | None]) -> Iterator[tuple[np.ndarray, set[str], bool]]:
    """(hit words, items, whether a full window was met) of every text under some tables, added to what earlier tables have found."""
    for a, b in tk.blocks(texts):
        w = tk.Words(texts[a:b], tk.ALNUM_TABLE, lower=True)
        edge = np.zeros(len(w) + 1, np.int64)
        items = [set(x or ()) for x in met[a:b]]
        whole = np.array([bool(x) for x in full[a:b]])
        for shared in tables:
            table, ids = shared.value
            start, window = hits(table, w)
            size = table.windows.size[window]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + size, -1)
            owner = np.searchsorted(w.first, start, side="right") - 1
            whole[owner[size == WINDOW]] = True
            for k, i in zip(owner.tolist(), table.windows.item[window].tolist()):
                items[k].add(ids[i])
        hit = np.cumsum(edge[:-1]) > 0
        for k in range(b - a):
            own = hit[w.first[k] : w.first[k + 1]]
            mask = masks[a + k]
            if mask is not None:
                own = own | np.unpackbits(np.frombuffer(mask, np.uint8), count=len(own)).astype(bool)
            yield own, items[k], bool(whole[k])


def contamination(docs: DataFrame, benchmark: DataFrame, keep_rows: bool = False, any_window: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document.

    A word is hit if it lies in any occurrence of a window of any item.  A
    document is contaminated if a twentieth or more of its words are hit;
    ``any_window``: also if it has one window of full length, however long the
    rest of it is (items shorter than a window count by the share alone, as a
    word or two may stand anywhere).  Null and empty texts have no words; items
    without words have no windows; items that share an id count once; repeated
    rows each get a row; a null doc_id is kept as null.  An empty benchmark
    contaminates nothing, an empty table gives an empty result.  A benchmark of
    any size works: it is taken in blocks of ``BLOCK`` bytes, each broadcast.
    Up to ``HELD`` blocks are searched in one pass; beyond that each pass leaves
    its hits beside the documents in a table of the shared folder and the next
    one adds to them.  ``keep_rows``: return instead the whole rows of ``docs``
    that aren't contaminated, whatever their other columns are called.
    """
    spark = docs.sparkSession
    rows = docs if keep_rows else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = rows.columns
    own = [fresh_name(rows, n) for n in (MASK, MET, FULL)]
    base, passes, tables = shared_dir(spark), 0, []
    state = rows.withColumns({n: F.lit(None).cast(kind) for n, kind in zip(own, ("binary", "array<string>", "boolean"))})
    for texts, ids in _benchmark_blocks(benchmark):
        if len(tables) == HELD:
            state = materialise(_add(state, tables, own), f"{base}/{passes}")
            passes, tables = passes + 1, []
        tables.append(spark.sparkContext.broadcast((prefixes(texts, shingle_counts(rows, texts)), ids)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small_batches(batches):
            found = list(_judge(tk.as_bytes(batch.column("text")), tables, *(batch.column(c).to_pylist() for c in own)))
            n = [len(h) for h, *_ in found]
            hit = [int(h.sum()) for h, *_ in found]
            bad = [h > 0 and 20 * h >= m or any_window and full for m, h, (*_, full) in zip(n, hit, found)]
            if keep_rows:
                yield batch.select(names).filter(pa.array([not b for b in bad], pa.bool_()))
                continue
            items = [sorted(x) for _, x, _ in found]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array(bad, pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    schema = docs.schema if keep_rows else "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return state.mapInArrow(finish, schema)


def _add(state: DataFrame, tables: list, own: list[str]) -> DataFrame:
    """The state after some more tables; ``own``: the names of its three columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small_batches(batches):
            found = list(_judge(tk.as_bytes(batch.column("text")), tables, *(batch.column(c).to_pylist() for c in own)))
            new = {
                own[0]: pa.array([np.packbits(h).tobytes() for h, *_ in found], pa.binary()),
                own[1]: pa.array([sorted(x) for _, x, _ in found], pa.list_(pa.string())),
                own[2]: pa.array([x for *_, x in found], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns)], batch.schema.names)

    return state.mapInArrow(run, state.schema)
