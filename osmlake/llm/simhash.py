"""SimHash near-duplicates by pivot distance tables.

Every text gets a 64-bit fingerprint.  Each distinct fingerprint is given its
row of the pivot table: its Hamming distances to fixed reference
fingerprints.  By the triangle inequality two fingerprints that link differ by
at most the radius in every coordinate, so a pair is discarded as soon as one
coordinate differs by more; survivors are verified bit by bit.  Pairs are only
looked at inside buckets that share all but ``radius`` of a fixed number of bit
blocks (two fingerprints within the radius agree on the others whichever bits
differ), so the work is not quadratic in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from osmlake.llm import blocks as bk
from osmlake.llm import textkernel as tk
from osmlake.llm.components import connected_components
from osmlake.llm.runtime import materialise, neutral, partitions, shared_dir

#: Most bits in which linked fingerprints differ.
RADIUS = 3
#: Words in a shingle.
SHINGLE = 3
#: The seed of the shingle hash.
SEED = 42
#: Reference fingerprints; the first is zero, the others are fixed pseudo-random words.
PIVOTS = np.concatenate([np.zeros(1, np.uint64), tk.mix(np.arange(1, 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))])
#: Pairs that are held in memory at once.
PAIR_BLOCK = 1 << 20
#: A bucket with more fingerprints is dealt into finer buckets first, inside its task.
LARGE_BUCKET = 1024
#: A bucket with more fingerprints is dealt over tasks, by blocks of the bits that its key leaves free.
TASK_BUCKET = 1 << 16


def fingerprint(text: bytes) -> int:
    """The SimHash of one text: a bit is 1 if set in over half of the shingle hashes; no words: 0."""
    words = text.translate(tk.LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    start = np.zeros(len(words), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    np.cumsum(lengths[:-1] + 1, out=start[1:])
    end = (start + lengths)[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end)), np.uint64, len(end))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long; null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small_batches(batches):
            fps = np.fromiter(map(fingerprint, tk.as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: list[int], blocks: int, keep: int) -> list[int]:
    """The bit masks of each choice of ``keep`` out of ``blocks`` near-equal blocks of the given bits."""
    cut = [bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks] for k in range(blocks)]
    return [sum(1 << b for c in choice for b in c) for choice in combinations(cut, keep)]


def bucket_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks such that fingerprints within the radius agree under one; finer as n grows."""
    blocks = radius + 1
    while blocks < radius + 5 and n / 2 ** (64 * (blocks - radius) / blocks) > 64:
        blocks += 1
    return _masks(list(range(64)), blocks, blocks - radius)


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks of blocks of the bits that ``mask`` leaves free: two fingerprints of a bucket within the radius agree under one."""
    return _masks([b for b in range(64) if not mask >> b & 1], radius + 1, 1)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, node, mask, own, more): every fingerprint once in each bucket that it is in.

    A bucket of more than ``TASK_BUCKET`` is split: its fingerprints go to the
    finer buckets of ``finer_masks`` instead, numbered after the masks.
    """
    under = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("own")) for k, m in enumerate(masks)])
    rows = nodes.where("node is not null").select("fp", "node", F.explode(under).alias("b")).select("fp", "node", "b.mask", "b.own")
    large = rows.groupBy("mask", "own").agg(F.count("*").alias("n")).where(F.col("n") > TASK_BUCKET).select("mask", "own")
    finer = F.array(*[F.array(*[F.lit(_signed(x)).cast("long") for x in finer_masks(m)]) for m in masks])
    split = rows.join(large, ["mask", "own"]).select("fp", "node", "mask", "own", F.posexplode(F.get(finer, F.col("mask"))).alias("k", "under"))
    numbered = (len(masks) + F.col("mask") * (RADIUS + 1) + F.col("k")).cast("int").alias("mask")
    return (
        rows.join(large, ["mask", "own"], "left_anti")
        .select("fp", "node", "mask", "own", F.lit(0).cast("long").alias("more"))
        .unionByName(split.select("fp", "node", numbered, "own", F.col("fp").bitwiseAND(F.col("under")).alias("more")))
    )


def _expand(order_key: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions i < j of a sorted array whose keys differ by at most ``reach``, in bounded blocks."""
    upto = np.searchsorted(order_key, order_key + reach, side="right")
    count = upto - np.arange(len(order_key)) - 1
    total = np.cumsum(count)
    at = 0
    while at < len(order_key):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIR_BLOCK, side="right")))
        c = count[at:stop]
        left = np.repeat(np.arange(at, stop), c)
        offset = np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
        yield left, left + 1 + offset
        at = stop


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints of the same group within the radius, found through the pivot table."""
    if len(fps) < 2:
        return
    near = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    key = group.astype(np.int64) * 256 + near[:, 0]
    order = np.argsort(key, kind="stable")
    key, near, sorted_fps = key[order], near[order], fps[order]
    for i, j in _expand(key, radius):
        for p in range(1, near.shape[1]):
            if not len(i):
                break
            ok = np.abs(near[i, p] - near[j, p]) <= radius
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(sorted_fps[i] ^ sorted_fps[j]) <= radius
        yield order[i[ok]], order[j[ok]]


def _roots(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least-index labels of the components that ``label`` and the pairs (i, j) span."""
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def spanning_stars(fps: np.ndarray, group: np.ndarray, bits: list[int] | None = None, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the index of the least one it is linked to inside its group, directly or not.

    Groups above ``LARGE_BUCKET`` are first dealt into finer buckets by blocks
    of the bits that their own key leaves free.
    """
    n = len(fps)
    label = np.arange(n)
    _, group, size = np.unique(group, return_inverse=True, return_counts=True)
    big = size[group] > LARGE_BUCKET
    bits = list(range(64)) if bits is None else bits
    if big.any() and len(bits) >= 4 * (radius + 1):
        at = np.flatnonzero(big)
        varying = [b for b in bits if len(np.unique((fps[at] >> np.uint64(b)) & np.uint64(1))) > 1]
        if len(varying) < 4 * (radius + 1):
            varying = bits
        for mask in _masks(varying, radius + 1, 1):
            own = fps[at] & np.uint64(mask)
            pair = np.stack([group[at].astype(np.uint64), own], axis=1)
            _, finer = np.unique(pair, axis=0, return_inverse=True)
            rest = [b for b in varying if not mask >> b & 1]
            inner = spanning_stars(fps[at], finer.ravel(), rest, radius)
            label = _roots(n, at, at[inner], label)
        small = np.flatnonzero(~big)
    else:
        small = np.arange(n)
    for i, j in close_pairs(fps[small], group[small], radius):
        label = _roots(n, small[i], small[j], label)
    return label


_KEY = ("mask", "own", "more")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges of each bucket of a partition that is sorted by bucket; buckets are never cut."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        fps, node = (t.column(c).to_numpy() for c in ("fp", "node"))
        _, group = np.unique(np.stack([t.column(c).to_numpy().astype(np.int64) for c in _KEY], axis=1), axis=0, return_inverse=True)
        by_node = np.argsort(node, kind="stable")
        label = spanning_stars(fps.view(np.uint64)[by_node], group.ravel()[by_node])
        node = node[by_node]
        star = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(node[star]), pa.array(node[label[star]])], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= 20_000:
            last = held[-1]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == last.column(c)[-1].as_py() for c in _KEY])
            cut = int(np.argmin(same)) if not same.all() else len(same)
            held.append(batch.slice(0, cut))
            batch = batch.slice(cut)
            if batch.num_rows:
                yield solve(held)
                held, rows = [], 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield solve(held)


def _named(fps: DataFrame, base: str) -> DataFrame:
    """(fp, component_id) of every fingerprint, from (doc_id, fp)."""
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), f"{base}/nodes")
    dealt = keyed(nodes, bucket_masks(nodes.count())).repartition(partitions(nodes, 4 << 20), *_KEY).sortWithinPartitions(*_KEY)
    groups = connected_components(dealt.select("fp", "node", *_KEY).mapInArrow(_links, "u long, v long"))
    return nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    component_id is the least doc_id that is reachable over links between
    fingerprints that differ in at most ``RADIUS`` bits, itself included.
    Null and empty texts have fingerprint zero and link like any other.
    Rows with the same doc_id each get a row; a null doc_id takes part in no
    choice of the least id.  An empty table gives an empty result.  Extra
    columns are ignored.
    """
    base = shared_dir(docs.sparkSession)
    fps = materialise(fingerprints(docs), f"{base}/fingerprints")
    return fps.join(_named(fps, base), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id isn't the least of the near-duplicate component that their text is in.

    Each row is judged by its own text: of rows that share a doc_id but not
    their text, one may go and the other stay.  Rows that repeat the
    representative's doc_id in its component stay, as they are the same
    document; rows without a doc_id stay.  Null and empty texts are alike, so
    one document of them stays.  An empty table stays empty; other columns are
    kept whatever they are called.  Texts aren't shuffled: they are written
    once with their fingerprints in a table bucketed by block, and only the
    places of the rows that go are sent to the blocks.
    """
    base, names = shared_dir(docs.sparkSession), docs.columns
    plain = neutral(docs, ("doc_id", "text"))
    own = ["__fp__", bk.BLOCK, "__place__"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = bk.Dealer()
        for batch in tk.small_batches(batches):
            texts = tk.as_bytes(batch.column("text"))
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            blocks, places = dealer.deal([len(t) for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64)), pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], [*batch.schema.names, *own])

    schema = StructType([*plain.schema.fields, *(StructField(n, t) for n, t in zip(own, (LongType(), LongType(), IntegerType())))])
    table = bk.write_blocks(plain.mapInArrow(run, schema), partitions(docs, bk.BLOCK_BYTES), base)
    slim = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__fp__").alias("fp"), bk.BLOCK, "__place__")
    dropped = slim.join(_named(slim.select("doc_id", "fp"), base), "fp").where("doc_id <> component_id")
    marks = dropped.groupBy(bk.BLOCK).agg(F.collect_list("__place__").alias("__gone__"))  # at most the rows of a block
    joined = table.join(marks.hint("shuffle_hash"), bk.BLOCK, "left").where(~F.coalesce(F.array_contains("__gone__", F.col("__place__")), F.lit(False)))
    return joined.select(*plain.columns).toDF(*names)
