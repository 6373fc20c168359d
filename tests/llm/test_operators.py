"""Each operator against a brute-force version on awkward rows, and on an empty table."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from osmlake.llm import blocks, bpe, bytecnn, chattree, decontaminate, deleted, fmindex, mil, ogg, simhash, substring, warc
from osmlake.llm import textkernel as tk
from osmlake.llm.components import connected_components

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORDS = ["the", "of", "Tha", "réeux", "ß", "a", "12", "on,", "x" * 300, "and", "it's", "ñ", "end."]


def prose(r: random.Random, n: int) -> str:
    return "".join(r.choice(WORDS) + r.choice([" ", "  ", "\n", "\t", " \x0b"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    """Null and empty texts, copies, near copies, shared passages, periodic and very long texts, a repeated row."""
    r = random.Random(4)
    passage, long = prose(r, 60), prose(r, 4000)
    rows = [(k, prose(r, r.randint(0, 120))) for k in range(40)]
    rows += [(40 + k, prose(r, 15) + passage + prose(r, 15)) for k in range(6)]
    rows += [(50, None), (51, ""), (52, " \n"), (53, long), (54, long), (55, long + "more words here"), (56, "ha " * 70), (57, "ha " * 30 + "ho"), (58, "a b c " * 30), (59, "one"), (60, "two words")]
    rows += [(61, rows[3][1]), (-5, rows[4][1]), (62, passage), (59, "one")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names clash with those that the operators add."""
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    return df.withColumns({"score": F.lit("x"), "ids": F.lit(1), "__part__": F.lit(2), "fp": F.lit(None).cast("int"), "block": F.lit("b"), "lang": F.lit("en")})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def by_id(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def test_words_and_hashes():
    r = random.Random(1)
    data = [prose(r, 30).encode() for _ in range(9)] + [b"", b" ", b"a"]
    w = tk.Words(data)
    expected = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in data]
    assert w.counts().tolist() == [len(x) for x in expected]
    flat = [x for e in expected for x in e]
    assert [w.data[a:b] for a, b in zip(w.start, w.end)] == flat
    assert len(set(w.hashes().tolist())) == len(set(flat))


def test_packed_integers():
    for v in ([], [0], [5, 255, 256], [-1, 7], [1 << 40, 3], [70000]):
        assert blocks.unpack_ints(blocks.pack_ints(np.array(v, np.int64))).tolist() == v
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (blocks.unpack_keys(blocks.pack_keys(keys)) == keys).all()
    assert sum(len(keys[s]) for _, s in blocks.split(keys, 7)) == 1000


# -- 1


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("long", [bpe.LONG, 100])
def test_bpe_round_trip(docs, texts, nothing, encoding, long, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", long)
    monkeypatch.setattr(bpe, "CHUNK", 200 if long == 100 else bpe.CHUNK)
    monkeypatch.setattr(bpe, "OVERLAP", 20 if long == 100 else bpe.OVERLAP)
    want = Counter()
    for i, t in texts:
        ids = encoding.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert by_id(bpe.round_trip(docs, RANKS, PATTERN)) == want
    assert bpe.round_trip(nothing, RANKS, PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in texts)


def test_chunks_stitch_to_the_whole():
    rx, r = regex.compile(PATTERN), random.Random(1)
    for _ in range(1500):
        s = "".join(r.choice(["'", "ll", "l", "re", " ", "  ", "\n", "a", "bcd", "1", "!", "é", "   ", "x" * 30]) for _ in range(r.randint(0, 60)))
        assert bpe.stitched(rx, s, r.randint(8, 40), r.randint(1, 7)) == rx.findall(s)


# -- 2


def test_warc_round_trip(spark):
    rows = [(1, "u1", "<p>a</p>"), (2, None, None), (3, "u3", ""), (4, "http://x/\r\ny", "<p>a</p>"), (9, "u", "z" * 300_000), (7, "u", "z" * 300_000), (7, "u", "z" * 300_000), (None, "u", "only"), (5, "é", "ü" * 50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit(1)).withColumn("salt", F.lit(0))
    last: dict[str, int] = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        to = last.get(h) if i is not None and last[h] != i else None
        want[i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if to is not None else "response", to] += 1
    assert by_id(warc.round_trip(pages)) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_faults_are_found():
    good = warc.record(1, "u", b"payload", None)
    head, block = warc.parse(good)
    assert block == b"payload" and head["warc-page-id"] == "1"
    for bad in (good[:-1], good.replace(b"payload\r\n\r\n", b"payloae\r\n\r\n"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(warc.BadWarc):
            warc.parse(bad)
    with pytest.raises(warc.BadWarc):
        list(warc.read_archive(memoryview(b"\0" * 20)))


# -- 3


def removed(rows):
    """Brute force: words that a window which also starts earlier covers."""
    words = [(NO if i is None else i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first: dict[tuple, tuple] = {}
    for i, w in words:
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i, k):
                gone |= set(range(k, k + 20))
        out.append((i, w, gone))
    return out


NO = -(1 << 63)


@pytest.mark.parametrize("common", [2048, 3])
def test_substring_dedup(docs, texts, nothing, common, monkeypatch):
    monkeypatch.setattr(substring, "COMMON", common)
    want = Counter((i, len(w), len(g), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in g)).hexdigest()) for i, w, g in removed(texts))
    assert by_id(substring.repeats(docs)) == want
    assert substring.repeats(nothing).count() == 0


def test_substring_texts_and_intervals(docs, texts):
    out = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    brute = {i: (w, g) for i, w, g in removed(texts)}
    for i, t in texts:
        w, g = brute[i]
        assert out[i] == (b" ".join(x for k, x in enumerate(w) if k not in g).decode() if g else t)
    spans = Counter()
    for r in substring.intervals(docs).collect():
        spans[r.doc_id] += r.end - r.start
    assert {i: n for i, n in spans.items() if n} == {i: len(g) for i, _, g in removed(texts) if g}


def test_fm_index_finds_what_is_there():
    r = np.random.default_rng(2)
    text = np.concatenate([r.integers(1, 4, 400), [0], r.integers(1, 4, 300), [0], np.full(70, 2), [0]])
    index = fmindex.FmIndex(text, 4)
    assert sorted(index.locate(np.arange(len(text))).tolist()) == list(range(len(text)))
    query = np.concatenate([text[50:90], text[402:420], r.integers(0, 4, 60), np.full(30, 2)])
    said = text.astype(np.uint8).tobytes()
    for floor, most in ((0, 16), (0, 40), (30, 7)):
        ends = np.arange(floor, len(query) + 1)
        matched, low, high = index.statistics(query, ends, np.full(len(ends), floor), most)
        assert (high > low).all()
        first = index.earliest(low, high)
        for e, m, a, n in zip(ends.tolist(), matched.tolist(), first.tolist(), (high - low).tolist()):
            there = [k for k in range(min(most, e - floor) + 1) if 0 not in query[e - k : e] and query[e - k : e].astype(np.uint8).tobytes() in said]
            assert m == max(there)
            found = [x for x in range(len(text) - m + 1) if (text[x : x + m] == query[e - m : e]).all()] if m else [0]
            assert a == found[0] and (not m or n == len(found))


def test_fm_index_steps_from_match_to_match():
    r = np.random.default_rng(6)
    text = np.append(np.insert(r.integers(1, 9, 300), [90, 150, 260], 0), 0)
    index = fmindex.FmIndex(text, 9)
    query = np.concatenate([text[40:140], r.integers(0, 9, 25), text[200:240], text[10:60]])
    at = np.concatenate([np.arange(0, 100), np.arange(110, len(query) - 7)])
    rows = index.occurrences(query, at, np.array([0, 64, 100, 101]), np.array([64, 36, 1, len(at) - 101]), 8)
    for a, row in zip(at.tolist(), rows.tolist()):
        found = [x for x in range(len(text) - 7) if 0 not in query[a : a + 8] and (text[x : x + 8] == query[a : a + 8]).all()]
        assert (index.locate(np.array([row]))[0] in found) if found else row == -1


def test_fm_index_is_compressed():
    r = np.random.default_rng(3)
    text = np.append(r.integers(1, 1000, 100_000), 0)
    index = fmindex.FmIndex(text, 1000)
    assert index.nbytes() < 3 * len(text)  # against 8 bytes a word for the words alone


def test_the_search_decides_what_repeats(docs, texts, monkeypatch):
    entries = [(b" ".join(b"w%d" % k for k in range(a, b)), b - a - 19) for a, b in ((0, 40), (10, 30), (5, 45), (100, 125))]
    shard = substring.Shard(entries, np.array([7, 5, 9, 1]), np.array([0, 3, 0, 0]), np.array([1, 1, 1, 2]))
    got = sorted(zip(*(x.tolist() for x in shard.intervals())))
    want = [(0, 10, 1, 5, 3), (2, 0, 5, 7, 5), (2, 5, 1, 5, 3), (2, 6, 10, 7, 11), (3, 0, 6, 1, 0)]
    assert got == want
    nothing_found = lambda self, query, ends, floors, most: (np.zeros(len(ends), np.int64),) * 3
    monkeypatch.setattr(fmindex.FmIndex, "statistics", nothing_found)
    assert [len(x) for x in shard.intervals()] == [0] * 5


# -- 4


def slow_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_media(docs, texts, nothing):
    assert ogg.checksum(b"OggS and some bytes") == slow_crc(b"OggS and some bytes")
    got = {r.doc_id: r for r in ogg.decode_media(ogg.encode_media(docs)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = ogg.store(payload, len(raw))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.seconds == len(payload) / ogg.RATE
    assert got[53].feature == got[54].feature and ogg.decode_media(ogg.encode_media(nothing)).count() == 0


def test_ogg_lacing_and_faults():
    for n in (0, 1, 254, 255, 256, 510, 4096, 255 * 255, 255 * 256 + 3):
        data = b"".join(ogg.pages(5, [(b"head", 0), (bytes(n), n)]))
        s = ogg.demultiplex(data)[5]
        assert s.packets == [b"head", bytes(n)] and s.granules == [0, n]
    good = ogg.store(b"a" * 128, 100)
    for bad in (good[:-1], good[:50] + b"x" + good[51:], good + good[:60], good[: len(good) // 2]):
        with pytest.raises(ogg.BadOgg):
            ogg.demultiplex(bad)


# -- 5 and 10


def labelled(spark, column):
    r = random.Random(8)
    bad = ["vile", "nasty", "grim"] if column == "toxic" else ["$$$$", "%%%%", "####"]
    rows, labels = [], []
    for k in range(500):
        y = int(r.random() < 0.4)
        words = [r.choice(["the", "of", "thing", "andly", "here", "tion."]) for _ in range(r.randint(20, 90))]
        if y == (column == "toxic"):
            for _ in range(6):
                words[r.randrange(len(words))] = r.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, y))
    rows += [(900, None), (901, ""), (902, "of " * 9000), (None, "the"), (3, "dup")]
    labels += [(None, 1), (77777, 1), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("z")).withColumn("score", F.lit(1))
    return docs, spark.createDataFrame(labels, f"doc_id bigint, {column} int").withColumn("lang", F.lit("q")), dict(x for x in labels if x[0] is not None)


@pytest.mark.parametrize(("operator", "column", "threshold"), [(mil, "toxic", 0.5), (bytecnn, "quality", 0.3)])
def test_classifiers(spark, operator, column, threshold):
    docs, labels, truth = labelled(spark, column)
    rows = operator.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth and r.doc_id < 500]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert operator.classify(docs.limit(0), labels).count() == 0
    assert operator.classify(docs, labels.limit(0)).count() == len(rows)


def test_offending_sentences(spark):
    docs, labels, _ = labelled(spark, "toxic")
    weights = mil.train(docs, labels)
    own = spark.createDataFrame([(1, "The thing here. A vile nasty grim thing. Of the andly.")], "doc_id bigint, text string")
    found = mil.offending(own, weights, 0.3).collect()
    assert [own.first().text[r.start : r.end] for r in found] == ["A vile nasty grim thing."]
    kept = {r.doc_id for r in mil.keep_inoffensive(docs, labels).collect()}
    assert {900, 901} <= kept


# -- 6


def test_deleted_interpolation(docs, texts, nothing):
    tokens = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)) + [None]) for i, t in texts]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    c = Counter(x for i, w in tokens if fold(i) != 1 for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((i, fold(i) == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens)
    rows = deleted.score(docs).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and all(r.score <= 0 for r in rows)
    assert deleted.score(nothing).count() == 0


def test_em_finds_the_weights():
    h = np.zeros((deleted.BUCKETS, deleted.CELLS + 1))
    h[3, 0], h[3, deleted.ratio_cell(np.array([0.1]), np.array([0.001]))[0]] = 50, 50
    h[5, 0] = 10
    w = deleted.learn_weights(h)
    assert 0.45 < w[3] < 0.55 and w[5] < 0.01 and w[4] == w[3]


# -- 7


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    label[i] = min(label[i], label[j])
    return label


def test_simhash(docs, texts, nothing):
    fps = [brute_fingerprint(t) for _, t in texts]
    order = sorted(range(len(texts)), key=lambda k: texts[k][0])
    root = brute_components([fps[k] for k in order])
    want = Counter((texts[k][0], f"{fps[k]:016x}", texts[order[root[n]]][0]) for n, k in enumerate(order))
    assert by_id(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = {r.doc_id for r in simhash.keep_representatives(docs).collect()}
    assert kept == {c for _, _, c in want}


@pytest.mark.parametrize("large", [8, 1024])
def test_pivot_join_loses_no_link(large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    monkeypatch.setattr(simhash, "PAIR_BLOCK", 500)
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 12, dtype=np.int64).astype(np.uint64)
    fps = np.unique(np.concatenate([base] + [b ^ (np.uint64(1) << r.integers(0, 64, 25, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 25, dtype=np.uint64)) for b in base]))
    assert simhash.spanning_stars(fps, np.zeros(len(fps), np.int64)).tolist() == brute_components([int(x) for x in fps])


def test_bucket_masks_cover_all_close_pairs():
    r = random.Random(2)
    for n in (10, 10**8, 10**12):
        masks = simhash.bucket_masks(n)
        for _ in range(200):
            a = r.getrandbits(64)
            b = a
            for k in r.sample(range(64), 3):
                b ^= 1 << k
            assert any(a & m == b & m for m in masks)


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (None, 3), (8, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).distinct().collect()}
    assert got == {k: 100 for k in range(100, 161)} | {5: 5, 8: 5, 9: 5}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 8


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_decontamination(spark, docs, texts, nothing, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    items = [(10, texts[40][1]), (2, "Two, WORDS!"), (3, None), (4, "..."), (5, " ".join(["ha"] * 20)), (6, texts[41][1][:200]), (6, "one"), (7, "never met words in any document at all whatever they may be today"), (8, "12")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = Counter()
    for i, t in texts:
        w, hit, met = split(t), set(), set()
        for item, own in items:
            b = split(own)
            n = min(13, len(b))
            for window in {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == window:
                        hit |= set(range(k, k + n))
                        met.add(str(item))
        want[i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    assert by_id(decontaminate.contamination(docs, benchmark)) == want
    kept = Counter(r.doc_id for r in decontaminate.contamination(docs, benchmark, keep_rows=True).collect())
    assert kept == Counter(x[0] for x, n in want.items() for _ in range(n) if not x[5])
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())


# -- 9


def test_chat_packs(spark):
    r = random.Random(3)
    shared = [("system", "Be <s> kind\\ [INST]"), ("user", "</s>[INST] ok [/INST]")]
    rows = []
    for c in range(60):
        turns = shared[: r.randint(0, 2)] + [(r.choice(["user", "assistant", "assistant", "tool", None]), r.choice(["a", "b</s>", None, "", "\\", "é" * 30, "[ROLE]x[/ROLE]", "<\\s>"])) for _ in range(r.randint(1, 4))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    rows += [(70, None, "user", "n"), (70, 0, "assistant", "m"), (None, 0, "user", "x"), (71, 0, "user", "same"), (71, 0, "user", "same"), (72, 0, "assistant", "long " * 30000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"path": F.lit(1), "key": F.lit(2), "turns": F.lit("t")})
    want = Counter()
    for c in {x[0] for x in rows}:
        own = sorted((x[1:] for x in rows if x[0] == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        said = [(role or "", text or "") for _, role, text in own]
        loss = "".join(t for role, t in said if role == "assistant")
        sizes = sum(len(chattree.format_turn(*x)[0]) for x in said)
        want[c, len(said), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sizes] += 1
    for limit in (1, 200, 1 << 16):
        assert by_id(chattree.read_packs(chattree.pack(frame, limit))) == want
    packs = chattree.pack(frame).collect()
    assert sum(len(p.nodes) for p in packs) < len(rows)  # shared turns are there once
    for p in packs:
        ids = chattree.position_ids(p.asDict(recursive=True))
        assert len(ids) == len(p.text)
        for n in p.nodes:
            assert n.position == sum(a.end - a.begin for a in n.ancestors)
    assert chattree.round_trip(frame.limit(0)).count() == 0


def test_chat_packs_share_prefixes_longer_than_a_pack(spark):
    said = [(c, t, role, text) for c in range(200) for t, role, text in ((0, "user", "x" * 500), (1, "assistant", f"{c % 150:03}"))]  # the last 50 are copies
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").coalesce(1)
    packs = chattree.pack(frame, 100).collect()
    assert sum(len(p.leaves) for p in packs) == 200
    assert sum(n.parent == -1 for p in packs for n in p.nodes) == len(packs) <= 60  # once a pack, not once a conversation
    by_id = lambda df: sorted(map(tuple, df.collect()))
    assert by_id(chattree.read_packs(chattree.pack(frame, 100))) == by_id(chattree.read_packs(chattree.pack(frame)))
    assert all(sum(n.end - n.begin for n in p.nodes if n.parent != -1) < 200 for p in packs)
    copies = chattree.pack(frame.where("turn = 0"), 100).collect()
    assert sum(len(p.leaves) for p in copies) == 200 and sum(len(p.nodes) for p in copies) == len(copies) <= 60


def test_escapes_are_reversible():
    r = random.Random(6)
    for _ in range(2000):
        s = "".join(r.choice(["\\", "<", "s", ">", "/", "[", "INST", "]", "ROLE", "<s>", "</s>", "[INST]", "[/INST]"]) for _ in range(r.randint(0, 9)))
        e = chattree.escape(s)
        assert chattree.unescape(e) == s and not any(c in e for c in chattree.CONTROLS)
        for role in ("user", "assistant", "x[/ROLE]", ""):
            assert chattree.parse_turn(chattree.format_turn(role, s)[0]) == (role, s)


def test_chat_turns_that_read_alike_are_not_one(spark):
    rows = [(1, 0, "assistant\nx", "y"), (2, 0, "assistant", "x\ny"), (3, 0, "a", "b1,2"), (3, 1, "", "x"), (4, 0, "a", "b"), (4, 1, "1,2", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: r for r in chattree.round_trip(frame).collect()}
    assert (got[2].loss_chars, got[2].formatted_chars) == (3, 7) and got[1].loss_chars == 0
    for c in (1, 2, 3, 4):
        own = "".join(f"{role}\n{text}\n" for i, _, role, text in rows if i == c)
        assert got[c].turns_sha256 == hashlib.sha256(own.encode()).hexdigest()


def test_representatives_are_judged_by_their_own_text(spark):
    a, b = "one two three four five six", "other words that nothing else has at all"
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (1, a, 4), (None, a, 5), (7, None, 6), (8, "", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __block__ int").withColumns({"__fp__": F.lit("x"), "__place__": F.lit(0), "__gone__": F.lit(None).cast("int")})
    out = simhash.keep_representatives(frame)
    assert out.columns == frame.columns and sorted(r["__block__"] for r in out.collect()) == [1, 3, 4, 5, 6]
    assert simhash.keep_representatives(frame.limit(0)).count() == 0


def test_large_buckets_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_BUCKET", 5)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(30)})
    frame = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp % (1 << 64): r.component_id for r in simhash._named(frame, simhash.shared_dir(spark)).collect()}
    assert [got[f] for f in fps] == brute_components(fps)


def test_any_full_window_contaminates(spark):
    item = " ".join(f"w{k}" for k in range(20))
    long = " ".join(["plain"] * 2000)
    rows = [(1, f"{long} {item} {long}"), (2, long), (3, " ".join(item.split()[:12])), (4, f"{long} short"), (5, f"{item} {long} {item}"), (None, item), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__hit_words__": F.lit(1), "__met_items__": F.lit("m"), "__full_window__": F.lit("f")})
    benchmark = spark.createDataFrame([(1, item), (2, "short")], "item_id long, text string")
    kept = lambda **k: sorted(r.doc_id or 0 for r in decontaminate.contamination(docs, benchmark, keep_rows=True, **k).collect())
    assert kept() == [1, 2, 3, 4, 5, 6] and kept(any_window=True) == [2, 3, 4, 6]
    assert decontaminate.contamination(docs, benchmark, keep_rows=True).dtypes == docs.dtypes
