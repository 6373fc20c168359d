"""Toxicity by multiple-instance learning.

Only documents have labels; their sentences are the instances.  A sentence has
a probability from hashed word features, the document's is their noisy-or
``1 - prod(1 - p)``.  The log-likelihood of the document labels is maximised
through the noisy-or, so the model also says which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.llm import textkernel as tk
from osmlake.llm.runtime import bounded_sample, fold

#: Weights of the model (a power of two); the last is the bias.
BUCKETS = 1 << 18
#: Labelled documents of each class that the fit uses at most, and the longest of them in bytes.
SAMPLE_EACH, SAMPLE_BYTES = 4000, 20_000
#: SPARSITY: the weight of the L1 penalty, which leaves weights only to words that tell.
EPOCHS, RATE, SPARSITY = 50, 0.5, 2e-4
#: Documents in a step of the fit.
STEP = 256

#: Besides the whole word, its first so many bytes are features (longer words share their beginnings).
PREFIXES = (5, 6)
#: Training documents that a feature must occur in; rarer ones keep weight 0.
LEAST_DOCUMENTS = 8

#: Bytes that end a sentence, and bytes stripped from both ends of a word.
SENTENCE_ENDS = b".!?|"
STRIPPED = b"\"'()[]{}<>.,;:!?*#$%&|-_"

_END = tk.separator_table(SENTENCE_ENDS)
_STRIP = tk.separator_table(STRIPPED)
_NEWLINE = tk.separator_table(b"\n")


@dataclass
class Bag:
    """Features of a block of texts: feature, the sentence it is in, sentence -> text."""

    feature: np.ndarray
    sentence: np.ndarray
    owner: np.ndarray
    span: np.ndarray
    n_texts: int


def sentences(texts: list[bytes]) -> Bag:
    """Every text is cut into sentences; a text without words has one empty sentence."""
    w = tk.Words(texts, lower=True)
    raw = np.frombuffer(w.data, np.uint8)
    n = len(w)
    owner_of_word = np.searchsorted(w.first, np.arange(n), side="right") - 1
    newline = np.concatenate([[0], np.cumsum(_NEWLINE[raw])])
    breaks = np.zeros(n, dtype=bool)
    if n:
        breaks[1:] = _END[raw[w.end[:-1] - 1]] | (newline[w.start[1:]] > newline[w.end[:-1]]) | (owner_of_word[1:] != owner_of_word[:-1])
        breaks[0] = True
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        start += (start < end) & _STRIP[raw[np.minimum(start, len(raw) - 1)]]
        end -= (start < end) & _STRIP[raw[end - 1]]
    sentence = np.cumsum(breaks) - 1
    at = np.flatnonzero(breaks)
    owner = owner_of_word[at]
    last = np.concatenate([at[1:], [n]]) - 1 if len(at) else at
    base = w.text_start[owner]
    span = np.stack([w.start[at] - base, w.end[last] - base], axis=1) if len(at) else np.zeros((0, 2), np.int64)
    found, held = [tk.span_hash(w.data, start, end)], [sentence]
    for size in PREFIXES:
        long = np.flatnonzero(end - start > size)
        found.append(tk.mix(tk.span_hash(w.data, start[long], start[long] + size) + np.uint64(size)))
        held.append(sentence[long])
    feature = (np.concatenate(found) % np.uint64(BUCKETS - 1)).astype(np.int64)
    sentence = np.concatenate(held)
    empty = np.flatnonzero(np.bincount(owner, minlength=len(texts)) == 0)
    return Bag(feature, sentence, np.concatenate([owner, empty]), np.concatenate([span, np.zeros((len(empty), 2), np.int64)]), len(texts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sentence_logits(weights: np.ndarray, bag: Bag) -> np.ndarray:
    """The log-odds of every sentence."""
    return np.bincount(bag.sentence, weights[bag.feature], minlength=len(bag.owner)) + weights[-1]


def noisy_or(weights: np.ndarray, bag: Bag) -> tuple[np.ndarray, np.ndarray]:
    """(document probabilities, sentence probabilities)."""
    z = sentence_logits(weights, bag)
    spared = np.bincount(bag.owner, np.logaddexp(0, z), minlength=bag.n_texts)
    return -np.expm1(-spared), _sigmoid(z)


def sentence_gradient(weights: np.ndarray, bag: Bag, y: np.ndarray) -> np.ndarray:
    """How the documents' mean negative log-likelihood changes with the log-odds of each sentence."""
    doc, p = noisy_or(weights, bag)
    pull = np.where(y > 0, -(1 - doc) / np.maximum(doc, 1e-9), 1.0)
    return p * pull[bag.owner] / len(y)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by proximal AdaGrad on the documents' log-likelihood; without both classes a constant model."""
    weights = np.zeros(BUCKETS)
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    weights[-1] = np.log(rate / (1 - rate)) - 5
    if not len(labels) or labels.min() == labels.max():
        weights[-1] = np.log(rate / (1 - rate))
        return weights
    order = np.random.default_rng(5).permutation(len(texts))
    steps = []
    for k in range(0, len(order), STEP):
        own = order[k : k + STEP]
        bag = sentences([texts[i] for i in own])
        steps.append((bag, labels[own].astype(float), *np.unique(bag.feature, return_inverse=True)))
    met = np.zeros(BUCKETS, np.int64)
    for bag, *_ in steps:
        met += np.bincount(np.unique(np.stack([bag.owner[bag.sentence], bag.feature]), axis=1)[1], minlength=BUCKETS)
    used = met >= LEAST_DOCUMENTS
    held = np.full(BUCKETS, 1e-3)
    for _ in range(epochs):
        for bag, y, touched, inverse in steps:
            g_sentence = sentence_gradient(weights, bag, y)
            g = np.bincount(inverse, g_sentence[bag.sentence], minlength=len(touched))
            g, touched = g[used[touched]], touched[used[touched]]
            held[touched] += g * g
            pace = RATE / np.sqrt(held[touched])
            w = weights[touched] - pace * g
            weights[touched] = np.sign(w) * np.maximum(np.abs(w) - pace * SPARSITY, 0)
            g = g_sentence.sum()
            held[-1] += g * g
            weights[-1] -= RATE * g / np.sqrt(held[-1])
    return weights


def training_sample(docs: DataFrame, labels: DataFrame, column: str, each: int, longest: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``each`` labelled training documents of each class, in a fixed pseudo-random order.

    Only rows whose ``fold(doc_id, 5)`` is not 0 are used.  The bound keeps the
    driver's memory and the broadcast of ids bounded at any corpus size.
    """
    usable = labels.where(f"{column} in (0, 1) and doc_id is not null").where(fold("doc_id", 5) != 0).select("doc_id", F.col(column).cast("int").alias("label")).distinct()
    chosen = bounded_sample(usable.where("label = 1"), ["doc_id"], each).union(bounded_sample(usable.where("label = 0"), ["doc_id"], each))
    texts = docs.where("text is not null").where(F.octet_length("text") <= longest).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "label", F.col("text").cast("binary").alias("text")).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    return tk.as_bytes(rows.column("text").combine_chunks()), rows.column("label").to_numpy().astype(np.int64)


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights (a fixed 2 MB) from a bounded sample of labelled documents."""
    return fit(*training_sample(docs, labels, "toxic", SAMPLE_EACH, SAMPLE_BYTES))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, n_sentences, worst_start, worst_end, worst_score) for every document.

    ``score`` is the document's probability; the worst sentence is the first
    of the highest probability, as a byte span of the text.  Null and empty
    texts are scored as one empty sentence.  Repeated rows each get a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in tk.small_batches(batches):
            texts = tk.as_bytes(batch.column(1))
            for a, b in tk.blocks(texts):
                bag = sentences(texts[a:b])
                doc, p = noisy_or(w, bag)
                order = np.lexsort((bag.span[:, 0], -p, bag.owner))
                first = order[np.searchsorted(bag.owner[order], np.arange(b - a))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(doc), pa.array(np.bincount(bag.owner, minlength=b - a)), pa.array(bag.span[first, 0]), pa.array(bag.span[first, 1]), pa.array(p[first])],
                    ["doc_id", "score", "n_sentences", "worst_start", "worst_end", "worst_score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, n_sentences long, worst_start long, worst_end long, worst_score double"
    )


def offending(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score): every sentence at or above the threshold, as byte spans of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small_batches(batches):
            texts = tk.as_bytes(batch.column(1))
            for a, b in tk.blocks(texts):
                bag = sentences(texts[a:b])
                p = _sigmoid(sentence_logits(shared.value, bag))
                hit = np.flatnonzero(p >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(bag.owner[hit])), pa.array(bag.span[hit, 0]), pa.array(bag.span[hit, 1]), pa.array(p[hit])], ["doc_id", "start", "end", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, end long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train, then (doc_id, held_out, score, predicted, ...) for every document.

    A null text is scored as an empty one; a null doc_id stays null, is held
    out as an empty text would be and is never learned from.  Rows that repeat
    a doc_id each get a row, and with a label each is learned from.  Without
    labels of both classes every sentence has the same score; an empty table
    gives an empty result.  Extra columns of either table are ignored.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_start", "worst_end", "worst_score")


def keep_inoffensive(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model, trained on them, doesn't call toxic (score below 0.5).

    Each row is judged by its own text, whatever its doc_id; a null text counts
    as empty.  Columns are kept whatever they are called; an empty table stays
    empty.
    """
    weights = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small_batches(batches):
            texts = tk.as_bytes(batch.column("text"))
            keep = np.concatenate([noisy_or(shared.value, sentences(texts[a:b]))[0] < 0.5 for a, b in tk.blocks(texts)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
