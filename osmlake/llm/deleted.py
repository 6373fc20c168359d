"""Language-model scores by deleted interpolation.

Bigram and unigram maximum-likelihood estimates are mixed with weights that
depend on how often the context was seen (its bucket: the binary logarithm of
its count).  A part of the training documents is set aside ("deleted"); the
weights are learned by expectation-maximisation on its n-gram counts under the
estimates of the rest.  Scores use the estimates of all training documents.

Counts cover all documents.  What the weights are learned from is a histogram
of the set-aside tokens over (bucket, ratio of the two estimates), which has a
fixed number of cells whatever the corpus.  Expectation-maximisation sees the
mean ratio of each cell instead of that of each token; a cell is a twentieth of
a decade wide, so what a token adds to a weight is off by less than 0.001.

Words and bigrams are counted by 64-bit hashes: two that share one would be
counted as one, a chance of about n * n / 2**65 for n distinct ones (one in
4,000 for any among 10**8).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.llm import blocks as bk
from osmlake.llm import textkernel as tk
from osmlake.llm.runtime import fold, materialise, shared_dir

#: Documents whose fold of 5 is 1 are never learned from; of the others, one in ``ASIDE`` is set aside for the weights.
ASIDE = 16
#: Buckets of context counts.
BUCKETS = 40
#: Cells of log10(bigram / unigram estimate): width, and the range on either side of 0.
CELL, REACH = 0.05, 9.0
CELLS = int(2 * REACH / CELL) + 1
ROUNDS = 60
#: Parts of a decade in which logarithms are added up.
MICRO = 1e6

END, START = np.uint64(0x5DEECE66D5DEECE6), np.uint64(0x1234567DEADBEEF1)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, bigram hashes, owning text)."""
    w = tk.Words(texts, lower=True)
    token = np.insert(w.hashes(), w.first[1:], END)
    owner = np.repeat(np.arange(len(texts)), w.counts() + 1)
    before = np.concatenate([[START], token[:-1]]).astype(np.uint64)
    before[np.concatenate([[0], np.cumsum(w.counts()[:-1] + 1)])] = START
    return token, tk.combine(before, token), owner


def ratio_cell(bigram: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """The cell of each token; cell 0: the bigram estimate is 0."""
    with np.errstate(divide="ignore"):
        r = np.log10(bigram / unigram)
    return np.where(bigram > 0, 1 + np.clip(np.round((r + REACH) / CELL), 0, CELLS - 1), 0).astype(np.int64)


def bucket(context: np.ndarray) -> np.ndarray:
    """The bucket of a context count (at least 1)."""
    return np.minimum(np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), BUCKETS - 1)


def learn_weights(histogram: np.ndarray, rounds: int = ROUNDS, ratio: np.ndarray | None = None) -> np.ndarray:
    """Weights of the bigram estimate by bucket, by EM on a (bucket, cell) histogram of held-out tokens.

    ``ratio``: bigram estimate / unigram estimate that stands for each cell,
    its middle unless given.  A bucket without tokens takes the weight of the
    next one below, 0.5 at first.
    """
    middle = np.concatenate([[0.0], 10 ** (np.arange(CELLS) * CELL - REACH)])
    ratio = np.broadcast_to(middle, histogram.shape) if ratio is None else ratio
    weights = np.full(BUCKETS, 0.5)
    met = histogram.sum(axis=1)
    for _ in range(rounds):
        w = weights[:, None]
        posterior = w * ratio / (w * ratio + 1 - w)
        weights = np.clip(np.where(met > 0, (histogram * posterior).sum(axis=1) / np.maximum(met, 1), weights), 1e-4, 1 - 1e-4)
    for b in range(BUCKETS):
        if not met[b]:
            weights[b] = weights[b - 1] if b else 0.5
    return weights


def unigram_estimate(count: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """The smoothed unigram estimate, also the base model."""
    return (count + 0.5) / (total + 0.5 * (distinct + 1))


def bigram_estimate(pair: np.ndarray, context: np.ndarray) -> np.ndarray:
    return pair / np.maximum(context, 1)


def _texts(rows: pa.Table) -> list[bytes]:
    return tk.as_bytes(rows.column("text").combine_chunks())


def _kinds(rows: pa.Table) -> tuple[bool, list[tuple[np.ndarray, np.ndarray]]]:
    """Every token and bigram of the block, counted in its training documents."""
    rows = bk.in_order(rows)
    learned = rows.column("learned").to_numpy().astype(np.int64)
    token, pair, owner = tokens(_texts(rows))
    out = []
    for keys in (token, pair):
        distinct, place = np.unique(keys, return_inverse=True)
        out.append((distinct, np.bincount(place, learned[owner], minlength=len(distinct)).astype(np.int64)))
    return bool(rows.column("aside")[0].as_py()), out


def _estimates(texts: list[bytes], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token counts, bigram counts, context counts, owner) of every token."""
    token, pair, owner = tokens(texts)
    _, place = np.unique(token, return_inverse=True)
    c1 = counts[0][place]
    _, place = np.unique(pair, return_inverse=True)
    c2 = counts[1][place]
    ends = c1[-1]  # the end of the last text: each text has one start and one end
    context = np.concatenate([[ends], c1[:-1]])
    context[np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])] = ends
    return c1, c2, context, owner


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Null and empty texts have one token, the end.  ``n_known``: tokens that
    training documents have.  Without training documents the unigram estimate
    is that of one unknown token.  Repeated rows each count and get a row; a
    null doc_id counts as an empty text in the fold and stays null.  An empty
    table gives an empty result; extra columns are ignored.
    """
    base = shared_dir(docs.sparkSession)
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (fold("doc_id", 5) != 1).alias("learned"),
        ((fold("doc_id", 5) != 1) & (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(ASIDE)) == 0)).alias("aside"),
    )
    parts = bk.key_parts(docs)
    table = bk.block_table(slim, base, "aside")
    known = materialise(bk.corpus_counts(table, parts, _kinds), f"{base}/counts")
    sums = [0, 0, 0, 0]
    rows = known.where(F.col(bk.BLOCK).isNull() & (F.col(bk.PART) < parts)).select("counts").toArrow().column(0).to_pylist()
    for row in rows:  # one row of four numbers for each partition of the key space
        sums = [a + int(b) for a, b in zip(sums, bk.unpack_ints(row))]
    total, distinct, kept_total, kept_distinct = sums

    def observe(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = bk.in_order(rows)
        everything, aside = (bk.answers(found, parts, 2, c) for c in ("counts", "apart_counts"))
        c1, c2, context, _ = _estimates(_texts(rows), [a - b for a, b in zip(everything, aside)])
        seen = context > 0
        low = unigram_estimate(c1[seen], kept_total, kept_distinct)
        high = bigram_estimate(c2[seen], context[seen])
        cell = bucket(context[seen]) * (CELLS + 1) + ratio_cell(high, low)
        n = np.bincount(cell, minlength=BUCKETS * (CELLS + 1))
        log = np.log10(high / low, out=np.zeros(len(low)), where=high > 0)
        sums = np.bincount(cell, np.round(log * MICRO), minlength=len(n)).astype(np.int64)  # whole numbers add up alike in any order
        at = np.flatnonzero(n)
        return pa.table({"cell": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64()), "logs": pa.array(sums[at], pa.int64())})

    cells = table.where("aside").groupBy(bk.BLOCK).cogroup(bk.not_null(known).where("apart_counts is not null").groupBy(bk.BLOCK)).applyInArrow(observe, "cell long, n long, logs long")
    histogram, logs = np.zeros(BUCKETS * (CELLS + 1)), np.zeros(BUCKETS * (CELLS + 1))
    for row in cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("logs").alias("logs")).toArrow().to_pylist():  # at most BUCKETS * (CELLS + 1) rows
        histogram[row["cell"]], logs[row["cell"]] = row["n"], row["logs"] / MICRO / row["n"]
    histogram, ratio = histogram.reshape(BUCKETS, CELLS + 1), 10 ** logs.reshape(BUCKETS, CELLS + 1)
    ratio[:, 0] = 0
    weights = learn_weights(histogram, ratio=ratio)

    def judge(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = bk.in_order(rows)
        texts = _texts(rows)
        c1, c2, context, owner = _estimates(texts, bk.answers(found, parts, 2))
        low = unigram_estimate(c1, total, distinct)
        w = np.where(context > 0, weights[bucket(context)], 0.0)
        add = lambda x: np.bincount(owner, x, minlength=len(texts))
        n = np.bincount(owner, minlength=len(texts))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(add(c1 > 0).astype(np.int64)),
                "base_score": pa.array(add(np.log10(low))),
                "score": pa.array(add(np.log10(w * bigram_estimate(c2, context) + (1 - w) * low))),
            }
        )

    scored = table.groupBy(bk.BLOCK).cogroup(bk.not_null(known).groupBy(bk.BLOCK)).applyInArrow(judge, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
