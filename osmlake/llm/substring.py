"""Substring deduplication with a compressed FM-index for each shard.

A window is 20 consecutive words of one document.  Windows are dealt to shards
by content, so equal windows always meet in one shard and no document is held
against all others: the key of a window is the least hash of the 6-word grams
in it, and consecutive windows of the same key travel together as a segment.
Keys that occur once in the corpus (counted over all documents) hold no repeat
and are not sent.  A key that very many segments share is dealt further by the
hash of each window.  Equal segments are merged where they arise and again in
the shard, so thousands of copies are one entry.

A shard's index holds what may repeat, once: of the windows whose hash was met
twice the first occurrence, neighbours joined.  Everything that documents have
sent is streamed through backward search over its wavelet tree; the matching
statistics say which stretches reach 20 words of the index, and locating them
says where each was first.  These intervals go back to the blocks, which remove
the words of every interval that started earlier than their own.  Hashes only
choose what is indexed: a word goes where the search, on the words themselves,
has found its window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from osmlake.llm import blocks as bk
from osmlake.llm import textkernel as tk
from osmlake.llm.fmindex import FmIndex
from osmlake.llm.runtime import materialise, neutral, shared_dir

#: Words of a window and of the grams that choose its shard.
WINDOW, GRAM = 20, 6
#: Segments in the corpus from which a key is dealt by the hash of each window.
COMMON = 2048
#: Windows of a piece that is searched from its end; longer segments are several pieces.
PIECE = 12
NO_DOC = -(1 << 63)

SEGMENTS = f"{bk.PART} int, {bk.BLOCK} long, docs binary, starts binary, sizes binary, more binary, texts binary"
#: Intervals: of which entry that a block sent, its first window, windows, and where that first started.
INTERVALS = ("entry", "first", "windows", "docs", "starts")
REPEATS = f"{bk.BLOCK} long, {bk.PART} int, " + ", ".join(f"{c} binary" for c in INTERVALS)


class Segments:
    """The segments of a block's documents (rows in the order of ``bk.in_order``)."""

    def __init__(self, texts: list[bytes]):
        self.words = b"\n".join(texts).split()
        counts = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.joined = b" ".join(self.words)
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        self.end = self.start + size
        h = tk.span_hash(self.joined, self.start, self.end) if len(size) else np.zeros(0, np.uint64)
        span = WINDOW - GRAM + 1
        grams = tk.windows(h, GRAM)
        self.grams, self.hashes = grams, h
        least, reach = grams, 1
        while reach * 2 <= span:
            least = np.minimum(least[: len(least) - reach], least[reach:]) if len(least) > reach else least[:0]
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :]) if len(least) > span - reach else least[:0]
        # windows that lie in one document
        owner = np.repeat(np.arange(len(texts)), counts)
        n = len(least)
        ok = owner[:n] == owner[WINDOW - 1 : WINDOW - 1 + n] if n else np.zeros(0, bool)
        at = np.flatnonzero(ok)
        key = least[at]
        new = np.concatenate([[True], (np.diff(at) > 1) | (key[1:] != key[:-1]) | (owner[at[1:]] != owner[at[:-1]])]) if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        #: First word, number of windows, key and document of each segment.
        self.at = at[begin]
        self.size = np.diff(np.append(begin, len(at)))
        self.key = key[begin]
        self.owner = owner[self.at] if len(self.at) else np.zeros(0, np.int64)

    def weights(self) -> np.ndarray:
        """1 for each segment, 2 if its key's gram is in it at two places (it may repeat within itself)."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        left, right = np.full(len(self.at), -1, np.int64), np.full(len(self.at), -1, np.int64)
        last = self.at + self.size - 1
        for k in range(WINDOW - GRAM + 1):
            p = self.at + k
            left = np.where((left < 0) & (self.grams[p] == self.key), p, left)
            p = last + k
            right = np.where(self.grams[p] == self.key, p, right)
        return 1 + (left != right).astype(np.int64)

    def dealt(self, counts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, windows, shard key) of what is sent: repeated keys, common ones window by window."""
        n = counts[np.searchsorted(keys, self.key)] if len(self.key) else np.zeros(0, np.int64)
        plain, common = np.flatnonzero((n > 1) & (n < COMMON)), np.flatnonzero(n >= COMMON)
        reps = self.size[common]
        at = np.repeat(self.at[common], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        whole = self.hashes[at].copy()
        for k in range(1, WINDOW):
            whole = tk.combine(whole, self.hashes[at + k])
        return np.concatenate([self.at[plain], at]), np.concatenate([self.size[plain], np.ones(len(at), np.int64)]), np.concatenate([self.key[plain], tk.mix(whole)])


def _block(rows: pa.Table) -> tuple[pa.Table, Segments]:
    rows = bk.in_order(rows)
    return rows, Segments(tk.as_bytes(rows.column("text").combine_chunks()))


def _doc_ids(rows: pa.Table) -> np.ndarray:
    return np.fromiter((NO_DOC if x is None else x for x in rows.column("doc_id").to_pylist()), np.int64, rows.num_rows)


def _kinds(rows: pa.Table) -> tuple[bool, list[tuple[np.ndarray, np.ndarray]]]:
    _, s = _block(rows)
    keys, place = np.unique(s.key, return_inverse=True)
    return False, [(keys, np.bincount(place, s.weights(), minlength=len(keys)).astype(np.int64))]


class Sent:
    """What a block sends: its distinct repeated segments by shard, first occurrences first."""

    def __init__(self, rows: pa.Table, s: Segments, found: pa.Table, parts: int):
        keys = np.unique(s.key)
        at, size, key = s.dealt(bk.answers(found, parts, 1)[0] if found.num_rows else np.zeros(len(keys), np.int64), keys)
        shard = bk.part_of(tk.mix(key), parts)
        order = np.lexsort((at, shard))
        self.at, self.size, self.shard = at[order], size[order], shard[order]
        begin, end = s.start[self.at].tolist(), s.end[self.at + self.size + WINDOW - 2].tolist()
        #: For each sent occurrence its entry, by shard: text -> number.
        self.entry = np.empty(len(self.at), np.int64)
        self.edges = np.flatnonzero(np.diff(self.shard, prepend=-1, append=-1)) if len(self.at) else np.zeros(0, np.int64)
        self.held: list[tuple[int, list[int], list[bytes]]] = []
        joined = s.joined
        for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist()):
            known: dict[bytes, int] = {}
            firsts: list[int] = []
            for k in range(a, b):
                text = joined[begin[k] : end[k]]
                number = known.setdefault(text, len(known))
                if number == len(firsts):
                    firsts.append(k)
                self.entry[k] = number
            self.held.append((int(self.shard[a]), firsts, list(known)))


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (n of them) of every row, one after another."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Shard:
    """Distinct entries of a shard: their words as numbers, their windows, and where each was first."""

    def __init__(self, entries: list[tuple[bytes, int]], doc: np.ndarray, start: np.ndarray, times: np.ndarray):
        self.doc, self.start, self.times = doc, start, times
        self.size = np.fromiter((n for _, n in entries), np.int64, len(entries))
        known: dict[bytes, int] = {}
        length = self.size + WINDOW - 1
        self.words = np.fromiter((known.setdefault(w, len(known)) for text, _ in entries for w in text.split(b" ")), np.int64, int(length.sum()))
        self.vocabulary = len(known)
        #: Of every window: its entry, its place there, and its first word.
        self.entry = np.repeat(np.arange(len(entries)), self.size)
        self.place = _spread(np.zeros(len(entries), np.int64), self.size)
        self.at = _spread(np.cumsum(length) - length, self.size)

    def candidates(self) -> np.ndarray:
        """Whether a window is the first occurrence of one whose hashes were met twice."""
        one, two = (tk.windows(tk.mix(self.words.astype(np.uint64) + np.uint64(seed)), WINDOW)[self.at] for seed in (1, 1 << 40))
        order = np.lexsort((self.start[self.entry] + self.place, self.doc[self.entry], two, one))
        lead = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        met = np.add.reduceat(self.times[self.entry[order]], np.flatnonzero(lead))
        out = np.zeros(len(order), bool)
        out[order[np.flatnonzero(lead)[met > 1]]] = True
        return out

    def intervals(self) -> tuple[np.ndarray, ...]:
        """(entry, first window, windows, doc, start): stretches of entries that the index has, and where each first started."""
        chosen = np.flatnonzero(self.candidates())
        if not len(chosen):
            return tuple(np.zeros(0, np.int64) for _ in INTERVALS)
        new = np.concatenate([[True], (np.diff(chosen) > 1) | (np.diff(self.entry[chosen]) != 0)])
        lead = chosen[new]  # the first window of each run of neighbours
        n = np.diff(np.append(np.flatnonzero(new), len(chosen))) + WINDOW - 1
        run = self.words[_spread(self.at[lead], n)]
        used, run = np.unique(run, return_inverse=True)
        text = np.insert(run + 1, np.cumsum(n), 0)  # 0 after each run
        begin = np.cumsum(n + 1) - n - 1
        index = FmIndex(text, len(used) + 1)
        number = np.zeros(self.vocabulary, np.int64)
        number[used] = np.arange(1, len(used) + 1)
        query = number[self.words]
        pieces = -(-self.size // PIECE)
        inner = _spread(np.zeros(len(pieces), np.int64), pieces) * PIECE
        first = np.repeat(np.cumsum(self.size) - self.size, pieces) + inner
        rows = index.occurrences(query, self.at, first, np.minimum(np.repeat(self.size, pieces) - inner, PIECE), WINDOW)
        hit = np.flatnonzero(rows >= 0)
        position = index.locate(rows[hit])  # the index has no window twice
        source = np.searchsorted(begin, position, side="right") - 1
        e = self.entry[lead[source]]
        doc, start = self.doc[e], self.start[e] + self.place[lead[source]] + position - begin[source]
        entry, place = self.entry[hit], self.place[hit]
        new = np.concatenate([[True], (np.diff(entry) != 0) | (np.diff(place) != 1) | (np.diff(doc) != 0) | (np.diff(start) != 1)]) if len(hit) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        out = (entry[first], place[first], np.diff(np.append(first, len(hit))), doc[first], start[first])
        own = (self.times[out[0]] == 1) & (self.doc[out[0]] == out[3]) & (self.start[out[0]] + out[1] == out[4])
        return tuple(x[~own] for x in out)  # the only occurrence of an entry needn't hear of itself


def _shard(table: pa.Table) -> pa.Table:
    """The repeats of one shard, for each block that sent it segments."""
    sent, text_of = [], {}
    for block, docs, starts, sizes, texts in zip(*(table.column(c).to_pylist() for c in (bk.BLOCK, "docs", "starts", "sizes", "texts"))):
        docs, starts, sizes = (bk.unpack_ints(x) for x in (docs, starts, sizes))
        number = np.empty(len(docs), np.int64)
        for k, text in enumerate(bk.zstandard.ZstdDecompressor().decompress(texts, max_output_size=1 << 40).split(b"\n")):
            number[k] = text_of.setdefault((text, int(sizes[k])), len(text_of))
        sent.append((block, number, docs, starts))
    number, docs, starts = (np.concatenate(x) for x in zip(*((n, d, s) for _, n, d, s in sent)))
    times = np.bincount(number) + np.bincount(number, np.concatenate([x for x in _more(table)])).astype(np.int64)
    order = np.lexsort((starts, docs, number))
    lead = order[np.concatenate([[True], number[order][1:] != number[order][:-1]])]  # the first occurrence of each distinct segment
    entry, *rest = Shard(list(text_of), docs[lead], starts[lead], times).intervals()
    n_of = np.bincount(entry, minlength=len(text_of))
    base = np.cumsum(n_of) - n_of
    rows, part = [], table.column(bk.PART)[0].as_py()
    for block, number, _, _ in sent:
        n = n_of[number]
        if n.any():
            own = _spread(base[number], n)
            rows.append((block, part, *map(bk.pack_ints, (np.repeat(np.arange(len(number)), n), *(x[own] for x in rest)))))
    types = [pa.int64(), pa.int32()] + [pa.binary()] * len(INTERVALS)
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[bk.BLOCK, bk.PART, *INTERVALS])


def _more(table: pa.Table) -> list[np.ndarray]:
    """How often each block has its segments beyond once."""
    return [bk.unpack_ints(x) for x in table.column("more").to_pylist()]


def _removed(rows: pa.Table, s: Segments, sent: Sent, found: pa.Table) -> np.ndarray:
    """For each word of the block whether a repeated window covers it."""
    doc_of = np.repeat(_doc_ids(rows), np.diff(s.first))
    pos_of = np.arange(len(s.words)) - np.repeat(s.first[:-1], np.diff(s.first))
    edge = np.zeros(len(s.words) + 1, np.int64)
    said = {p: k for k, p in enumerate(found.column(bk.PART).to_pylist())}
    columns = {c: found.column(c).to_pylist() for c in INTERVALS}
    for (shard, firsts, _), a, b in zip(sent.held, sent.edges[:-1].tolist(), sent.edges[1:].tolist()):
        if shard not in said:
            continue
        entry, first, windows, doc, start = (bk.unpack_ints(columns[c][said[shard]]) for c in INTERVALS)
        n_of = np.bincount(entry, minlength=len(firsts))
        n = n_of[sent.entry[a:b]]
        k = _spread((np.cumsum(n_of) - n_of)[sent.entry[a:b]], n)  # the intervals of each occurrence
        at = np.repeat(sent.at[a:b], n) + first[k]
        earlier = (doc[k] < doc_of[at]) | ((doc[k] == doc_of[at]) & (start[k] < pos_of[at]))
        at, upto = at[earlier], (at + windows[k] + WINDOW - 1)[earlier]
        edge += np.bincount(at, minlength=len(edge)) - np.bincount(upto, minlength=len(edge))
    return np.cumsum(edge[:-1]) > 0


def _run(docs: DataFrame, finish, schema) -> DataFrame:
    base = shared_dir(docs.sparkSession)
    parts = bk.key_parts(docs)
    table = bk.block_table(docs, base)
    known = bk.not_null(materialise(bk.not_null(bk.corpus_counts(table, parts, _kinds)), f"{base}/counts"))

    def emit(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows, s = _block(rows) if rows.num_rows else (rows, Segments([]))
        sent = Sent(rows, s, found, parts)
        ids = _doc_ids(rows)
        out = []
        for (shard, firsts, texts), a, b in zip(sent.held, sent.edges[:-1].tolist(), sent.edges[1:].tolist()):
            at, more = sent.at[firsts], np.bincount(sent.entry[a:b], minlength=len(firsts)) - 1
            owner = np.searchsorted(s.first, at, side="right") - 1
            out.append((shard, found.column(bk.BLOCK)[0].as_py(), bk.pack_ints(ids[owner]), bk.pack_ints(at - s.first[owner]), bk.pack_ints(sent.size[firsts]), bk.pack_ints(more), bk.zstandard.ZstdCompressor(level=1).compress(b"\n".join(texts))))
        types = [pa.int32(), pa.int64()] + [pa.binary()] * 5
        columns = list(zip(*out)) if out else [[]] * 7
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[bk.PART, bk.BLOCK, "docs", "starts", "sizes", "more", "texts"])

    segments = table.groupBy(bk.BLOCK).cogroup(known.groupBy(bk.BLOCK)).applyInArrow(emit, SEGMENTS)
    repeats = materialise(bk.by_part(segments, parts).applyInArrow(_shard, REPEATS), f"{base}/repeats")
    empty = [F.lit(None).cast("binary").alias(c) for c in INTERVALS]
    side = known.select(bk.BLOCK, bk.PART, "counts", *empty).unionByName(repeats.withColumn("counts", F.lit(None).cast("binary")))

    def settle(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows, s = _block(rows)
        is_count = found.column("counts").is_valid()
        sent = Sent(rows, s, found.filter(is_count), parts)
        return finish(rows, s, _removed(rows, s, sent, found.filter(pa.compute.invert(is_count))))

    return table.groupBy(bk.BLOCK).cogroup(side.groupBy(bk.BLOCK)).applyInArrow(settle, schema)


def _kept_texts(s: Segments, gone: np.ndarray) -> list[bytes]:
    out = []
    for k in range(len(s.first) - 1):
        a, b = int(s.first[k]), int(s.first[k + 1])
        if not gone[a:b].any():
            out.append(s.joined[int(s.start[a]) : int(s.end[b - 1])] if b > a else b"")
        else:
            out.append(b" ".join([s.words[i] for i in (np.flatnonzero(~gone[a:b]) + a).tolist()]))
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every document.

    Words covered by a window whose word sequence also starts earlier (in a
    smaller doc_id, or earlier in the same document) are removed.  A null doc_id
    counts as the smallest.  Rows that share a doc_id are each a document whose
    positions equal the other's: neither is earlier.  Null and empty texts have
    no words.  Extra columns are ignored.
    """

    def finish(rows: pa.Table, s: Segments, gone: np.ndarray) -> pa.Table:
        cut = np.concatenate([[0], np.cumsum(gone)])
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "n_words": pa.array(np.diff(s.first)),
                "n_removed": pa.array(cut[s.first[1:]] - cut[s.first[:-1]], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in _kept_texts(s, gone)], pa.string()),
            }
        )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _run(slim, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): the removed intervals of every document, in words."""

    def finish(rows: pa.Table, s: Segments, gone: np.ndarray) -> pa.Table:
        starts, ends = [], []
        for k in range(rows.num_rows):
            a, b = int(s.first[k]), int(s.first[k + 1])
            own = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
            starts.append(np.flatnonzero(own == 1))
            ends.append(np.flatnonzero(own == -1))
        n = [len(x) for x in starts]
        at = np.repeat(np.arange(rows.num_rows), n)
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"doc_id": rows.column("doc_id").take(pa.array(at)), "start": flat(starts), "end": flat(ends)})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _run(slim, finish, "doc_id long, start long, end long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows of ``docs``; a text with repeats becomes its kept words, joined by one space.

    Texts without repeats, null and empty ones among them, stay as they are;
    ``n_chars``, where there is such a column, follows the text.  A null doc_id
    counts as the smallest; rows that share a doc_id are each a document, and
    of equal ones neither is earlier.  An empty table stays empty; other
    columns are kept whatever they are called.
    """
    plain = neutral(docs, ("doc_id", "text", "n_chars"))
    names = plain.columns

    def finish(rows: pa.Table, s: Segments, gone: np.ndarray) -> pa.Table:
        cut = np.concatenate([[0], np.cumsum(gone)])
        hit = (cut[s.first[1:]] > cut[s.first[:-1]]).tolist()
        old = rows.column("text").to_pylist()
        new = [t.decode() if h else o for t, h, o in zip(_kept_texts(s, gone), hit, old)]
        out = rows.select(names).set_column(names.index("text"), "text", pa.array(new, pa.string()))
        if "n_chars" in names:
            k = names.index("n_chars")
            sizes = [len(t) if h else n for t, h, n in zip(new, hit, rows.column("n_chars").to_pylist())]
            out = out.set_column(k, "n_chars", pa.array(sizes, rows.schema.field("n_chars").type))
        return out

    schema = StructType([StructField(f.name, StringType() if f.name == "text" else f.dataType) for f in plain.schema.fields])
    return _run(plain, finish, schema).toDF(*docs.columns)
