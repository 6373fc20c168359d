"""Models against slow versions of themselves, and every operator on rows without an id, repeated ids and empty tables."""

import hashlib
import re
import zlib
from collections import Counter
from math import exp, log, log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from osmlake.llm import bpe, bytecnn, decontaminate, deleted, mil, ogg, simhash, substring
from tests.llm.test_operators import LOWER, docs, texts  # noqa: F401  fixtures

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SAID = [b"One vile thing. Another one! And\na line | bar", b"", b"the same the same. the", b"'quoted' (word) x?\n\n... nasty ends"]


# -- 5


def slow_sentences(text: bytes) -> list[list[bytes]]:
    """Sentences as lists of stripped words: cut after a word that ends in an end mark, and at line ends."""
    out, now = [], []
    for line in text.translate(LOWER).split(b"\n"):
        for word in re.findall(rb"[^\x20\x09-\x0D]+", line):
            now.append(word)
            if word[-1:] in (b".", b"!", b"?", b"|"):
                out.append(now)
                now = []
        if now:
            out.append(now)
            now = []
    return out or [[]]


def slow_features(word: bytes) -> list[int]:
    """The numbers of a word's features, by the operator's own hash of one word at a time."""
    for _ in range(3):
        if word and word[0] in mil.STRIPPED:
            word = word[1:]
        if word and word[-1] in mil.STRIPPED:
            word = word[:-1]
    one = lambda w: mil.tk.span_hash(w + b" ", np.array([0]), np.array([len(w)]))
    found = [one(word)] + [mil.tk.mix(one(word[:n]) + np.uint64(n)) for n in mil.PREFIXES if len(word) > n]
    return [int(x[0] % np.uint64(mil.BUCKETS - 1)) for x in found]


def test_noisy_or_as_a_product():
    weights = np.random.default_rng(1).normal(-0.5, 1, mil.BUCKETS)
    got, _ = mil.noisy_or(weights, mil.sentences(SAID))
    for text, p in zip(SAID, got):
        spared = 1.0
        for sentence in slow_sentences(text):
            z = weights[-1] + sum(weights[f] for w in sentence for f in slow_features(w))
            spared *= 1 - 1 / (1 + exp(-z))
        assert abs(1 - spared - p) < 1e-9


def test_gradient_of_the_noisy_or():
    weights = np.random.default_rng(2).normal(-0.5, 0.5, mil.BUCKETS)
    bag, y = mil.sentences(SAID), np.array([1.0, 0, 0, 1])

    def loss(w):
        p, _ = mil.noisy_or(w, bag)
        return -np.mean(np.where(y > 0, np.log(p), np.log1p(-p)))

    by_sentence = mil.sentence_gradient(weights, bag, y)
    for f in [*np.unique(bag.feature).tolist(), mil.BUCKETS - 1]:
        own = by_sentence.sum() if f == mil.BUCKETS - 1 else by_sentence[bag.sentence[bag.feature == f]].sum()
        up, down = weights.copy(), weights.copy()
        up[f] += 1e-6
        down[f] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - own) < 1e-6


# -- 10


def doubles(net):
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_convolution_by_loops():
    net = doubles(bytecnn.ByteCnn())
    net.p["bias"] += np.linspace(-0.1, 0.1, bytecnn.FILTERS)
    samples = [b"", b"short text", bytes(range(256)) * 2 + b"end", b"a" * 256]
    for text, got in zip(samples, net.score(samples)):
        step, logits = bytecnn.CHUNK - bytecnn.OVERLAP, []
        for at in range(0, max(1, len(text) - bytecnn.OVERLAP), step):
            chunk = text[at : at + bytecnn.CHUNK].ljust(bytecnn.CHUNK, b"\0")
            z = float(net.p["base"][0])
            for f in range(bytecnn.FILTERS):
                best = max(
                    sum(float(net.p["embed"][chunk[k + j]] @ net.p["filter"][j * bytecnn.EMBED : (j + 1) * bytecnn.EMBED, f]) for j in range(bytecnn.WIDTH))
                    for k in range(0, bytecnn.CHUNK - bytecnn.WIDTH + 1, bytecnn.STRIDE)
                )
                z += max(0.0, best + net.p["bias"][f]) * net.p["out"][f]
            logits.append(z)
        assert abs(got - 1 / (1 + exp(-sum(logits) / len(logits)))) < 1e-9


def test_gradients_of_the_network():
    net = doubles(bytecnn.ByteCnn(3))
    x, owner = bytecnn.chunks([b"some text of a document", b"x" * 400, b"other words"])
    y = np.array([1.0, 0, 1])

    def loss():
        mean = np.bincount(owner, net.logits(x)) / np.bincount(owner)
        return np.mean(np.logaddexp(0, mean) - y * mean)

    r = np.random.default_rng(0)
    for name, g in net.gradients(x, owner, y).items():
        flat = net.p[name].reshape(-1)
        for k in [*r.choice(len(flat), min(8, len(flat)), replace=False).tolist(), int(np.abs(g).argmax())]:
            was = flat[k]
            flat[k] = was + 1e-5
            up = loss()
            flat[k] = was - 1e-5
            slope, flat[k] = (up - loss()) / 2e-5, was
            assert abs(slope - g.reshape(-1)[k]) < 1e-4 * max(1, abs(slope)), name


# -- 6


def test_scores_by_exact_expectation_maximisation(spark, docs, texts):  # noqa: F811
    told = docs.select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(deleted.ASIDE)) == 0).alias("aside")).distinct().collect()
    aside = {r.doc_id for r in told if r.aside and zlib.crc32(str(r.doc_id).encode()) % 5 != 1}
    assert aside
    said = [(i, [None, *re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)), ""]) for i, t in texts]
    learned = [(i, w) for i, w in said if zlib.crc32(str(i).encode()) % 5 != 1]

    def counts(rows):
        one, two, before = Counter(), Counter(), Counter()
        for _, w in rows:
            one.update(w[1:])
            two.update(zip(w, w[1:]))
            before.update(w[:-1])
        total, distinct = sum(one.values()), len(one)
        low = lambda x: (one[x] + 0.5) / (total + 0.5 * (distinct + 1))
        high = lambda c, x: two[c, x] / before[c] if before[c] else 0.0
        return low, high, before

    low, high, before = counts([r for r in learned if r[0] not in aside])
    cells = {}
    for i, w in learned:
        if i in aside:
            for c, x in zip(w, w[1:]):
                if before[c]:
                    cells.setdefault(int(np.log2(before[c])), []).append((high(c, x), low(x)))
    weights, known = {}, 0.5
    for b in range(deleted.BUCKETS):
        for _ in range(deleted.ROUNDS if b in cells else 0):
            was = weights.get(b, 0.5)
            weights[b] = min(max(np.mean([was * h / (was * h + (1 - was) * u) for h, u in cells[b]]), 1e-4), 1 - 1e-4)
        known = weights.setdefault(b, known)
    low, high, before = counts(learned)
    want = sorted((i, sum(log10(m) for m in ((lambda w_: w_ * high(c, x) + (1 - w_) * low(x))(weights[int(np.log2(before[c]))] if before[c] else 0.0) for c, x in zip(w, w[1:]))), len(w)) for i, w in said)
    got = sorted((r.doc_id, r.score) for r in deleted.score(docs).collect())
    for (i, exact, n), (j, found) in zip(want, got):
        assert i == j and abs(exact - found) < 1e-3 * n  # thousandths of a decade a token


# -- all of them


ODD = [(None, "one two three four"), (None, None), (None, "one two three four"), (3, "one two three four"), (3, "other words entirely here"), (4, ""), (9, "α β γ " * 30), (9, "α β γ " * 30)]
BENCHMARK = " ".join(["α β γ"] * 6)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without an id, rows that share one, and columns called like everything that the operators add."""
    names = ("__block__", "__part__", "__fp__", "__place__", "__gone__", "__hit_words__", "__met_items__", "__full_window__", "score", "label", "fp", "column1", "BLOCK", "n_words")
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})


def test_rows_without_an_id(spark, odd):
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    labels = spark.createDataFrame([(3, 1, 0), (9, 0, 1), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, BENCHMARK)], "item_id long, text string")
    ids = Counter(i for i, _ in ODD)
    plain = {
        "bpe": bpe.round_trip(odd, RANKS, PATTERN), "substring": substring.repeats(odd), "ogg": ogg.decode_media(ogg.encode_media(odd)), "mil": mil.classify(odd, labels), "deleted": deleted.score(odd),
        "simhash": simhash.near_duplicates(odd), "decontaminate": decontaminate.contamination(odd, benchmark), "bytecnn": bytecnn.classify(odd, labels),
    }
    found = {k: df.collect() for k, df in plain.items()}
    for name, rows in found.items():
        assert Counter(r.doc_id for r in rows) == ids, name
    assert Counter((r.doc_id, r.decoded_sha256) for r in found["bpe"]) == Counter((i, sha(t)) for i, t in ODD)
    assert Counter((r.doc_id, r.payload_bytes) for r in found["ogg"]) == Counter((i, max(64, -(-len((t or "").encode()) // 64) * 64)) for i, t in ODD)
    assert {r.component_id for r in found["simhash"] if r.doc_id is None} == {3, 4}
    assert sorted(r.n_removed for r in found["substring"]) == [0] * 6 + [87, 87]  # in a periodic text all but its first three words started earlier
    assert Counter((r.doc_id, r.n_hit) for r in found["decontaminate"])[9, 90] == 2  # bytes from 0x80 are words too
    for name, df in plain.items():
        assert len(df.columns) > 2, name


def test_stages_on_odd_rows_and_on_nothing(spark, odd, tmp_path):
    rows = odd.withColumn("n_chars", F.length("text"))
    spark.createDataFrame([(3, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words that nothing has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {"toxicity": 8, "near_duplicates": 8, "substring_dedup": 8, "decontamination": 8, "encoding": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
        if name != "encoding":
            assert out.dtypes == rows.dtypes, name
            assert all(r["__block__"] == "__block__" and r["column1"] == "column1" for r in out.collect())
        assert out.count() <= kept[name] and (name in ("toxicity", "near_duplicates") or out.count() == 8), name
        if name == "near_duplicates":  # rows without an id, the least of each group and what repeats it
            assert Counter(r.doc_id for r in out.collect()) == Counter({None: 3, 3: 2, 4: 1, 9: 2})
