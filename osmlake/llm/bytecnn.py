"""Quality by a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that together cover all of it.  Bytes
are embedded, learned filters slide over every chunk, each filter's response
is max-pooled over the chunk, a linear layer gives the chunk's log-odds, and
their mean gives the one probability of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.llm import textkernel as tk
from osmlake.llm.mil import training_sample
from osmlake.llm.runtime import fold

#: Bytes in a chunk and bytes that the next chunk repeats.
CHUNK, OVERLAP = 256, 32
#: Embedding size, filter width in bytes, stride, filters.
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 2, 24
#: Labelled documents of each class that the fit uses at most, and the longest of them in bytes.
SAMPLE_EACH, SAMPLE_BYTES = 2500, 20_000
#: Chunks of a document that one pass of the fit looks at (drawn anew each pass; scoring uses all).
FIT_CHUNKS = 6
EPOCHS, RATE, STEP = 14, 0.01, 64


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks as a byte matrix, owning text of each); short ends are padded with byte 0."""
    step = CHUNK - OVERLAP
    parts, owner = [], []
    for k, text in enumerate(texts):
        n = max(1, -(-(len(text) - OVERLAP) // step))
        parts.append(text.ljust(n * step + OVERLAP, b"\0"))
        owner.append(np.full(n, k))
    rows = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(p, np.uint8), CHUNK)[::step] for p in parts]
    return np.concatenate(rows), np.concatenate(owner)


class ByteCnn:
    """Parameters: embedding (256 x EMBED), filters, their biases, output weights and bias; about 3,000 numbers."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.1, FILTERS).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(max-pooled responses after the rectifier, position of each maximum) for chunks x."""
        e = self.p["embed"][x].reshape(len(x), CHUNK * EMBED)
        seen = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        r = (np.ascontiguousarray(seen).reshape(-1, WIDTH * EMBED) @ self.p["filter"]).reshape(len(x), -1, FILTERS)
        at = r.argmax(axis=1)
        return np.maximum(np.take_along_axis(r, at[:, None], axis=1)[:, 0] + self.p["bias"], 0), at

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Chunk log-odds, a bounded number of chunks at a time."""
        out = [self.highest(x[k : k + 256]) @ self.p["out"] + self.p["base"] for k in range(0, len(x), 256)]
        return np.concatenate(out)

    def highest(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x].reshape(len(x), CHUNK * EMBED)
        seen = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        r = np.ascontiguousarray(seen).reshape(-1, WIDTH * EMBED) @ self.p["filter"]
        return np.maximum(r.reshape(len(x), -1, FILTERS).max(axis=1) + self.p["bias"], 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """One probability for each whole text."""
        if not texts:
            return np.zeros(0)
        x, owner = chunks(texts)
        n = np.bincount(owner, minlength=len(texts))
        mean = np.bincount(owner, self.logits(x), minlength=len(texts)) / n
        return 1 / (1 + np.exp(-np.clip(mean.astype(float), -40, 40)))

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, at = self.pooled(x)
        n = np.bincount(owner, minlength=len(y))
        z = np.bincount(owner, h @ self.p["out"] + self.p["base"], minlength=len(y)) / n
        d_chunk = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n / len(y))[owner].astype(np.float32)
        d_pool = d_chunk[:, None] * self.p["out"] * (h > 0)
        where = at[:, :, None] * STRIDE + np.arange(WIDTH)
        byte = x[np.arange(len(x))[:, None, None], where]  # chunk, filter, position
        seen = self.p["embed"][byte].reshape(len(x), FILTERS, WIDTH * EMBED)
        d_seen = (d_pool[:, :, None] * self.p["filter"].T).reshape(-1, EMBED)
        d_embed = np.stack([np.bincount(byte.ravel(), d_seen[:, k], minlength=256) for k in range(EMBED)], axis=1)
        return {
            "embed": d_embed.astype(np.float32),
            "filter": np.einsum("cf,cfk->kf", d_pool, seen),
            "bias": d_pool.sum(axis=0),
            "out": d_chunk @ h,
            "base": np.array([d_chunk.sum()], np.float32),
        }


def fit(texts: list[bytes], labels: np.ndarray, prior: float | None = None, epochs: int = EPOCHS) -> ByteCnn:
    """Adam on the log-likelihood of document labels.

    ``prior``: the share of label 1 among the labelled rows that the sample
    was balanced from; the output bias is moved to it.  Without both classes
    the model is constant.
    """
    net = ByteCnn()
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    if not len(labels) or labels.min() == labels.max():
        net.p["out"][:] = 0
        net.p["base"][:] = np.log(rate / (1 - rate))
        return net
    r = np.random.default_rng(3)
    cut = [chunks([t])[0] for t in texts]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for k in range(0, len(order), STEP):
            own = order[k : k + STEP]
            picked = [cut[i] if len(cut[i]) <= FIT_CHUNKS else cut[i][r.choice(len(cut[i]), FIT_CHUNKS, replace=False)] for i in own]
            owner = np.repeat(np.arange(len(own)), [len(x) for x in picked])
            g = net.gradients(np.concatenate(picked), owner, labels[own].astype(float))
            t += 1
            rate_now = RATE * (1 - 0.9 * epoch / epochs)
            for name, d in g.items():
                m[name] += 0.1 * (d - m[name])
                v[name] += 0.01 * (d * d - v[name])
                net.p[name] -= rate_now * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-7)
    if prior is not None and 0 < prior < 1:
        net.p["base"] += np.float32(np.log(prior / (1 - prior)) - np.log(rate / (1 - rate)))
    return net


def train(docs: DataFrame, labels: DataFrame) -> ByteCnn:
    """A network from a bounded sample of labelled documents, set to the share of label 1 among all training labels."""
    texts, y = training_sample(docs, labels, "quality", SAMPLE_EACH, SAMPLE_BYTES)
    prior = labels.where("quality in (0, 1)").where(fold("doc_id", 5) != 0).agg(F.avg("quality")).first()[0]
    return fit(texts, y, prior)


def score(docs: DataFrame, net: ByteCnn) -> DataFrame:
    """(doc_id, score) for every document; null and empty texts are one chunk of padding."""
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteCnn()
        own.p = shared.value
        for batch in tk.small_batches(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(tk.as_bytes(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train, then (doc_id, held_out, score, predicted) for every document.

    A null text is scored as an empty one; a null doc_id stays null, is held
    out as an empty text would be and is never learned from.  Rows that repeat
    a doc_id each get a row, and with a label each is learned from.  Without
    labels of both classes every document has the same score; an empty table
    gives an empty result.  Extra columns of either table are ignored.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
