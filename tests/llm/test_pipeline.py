"""The pipeline: its stages' columns and decisions, and its result against brute force on the stages' inputs."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from osmlake.llm import bpe, queries
from tests.llm.test_operators import brute_components, brute_fingerprint, removed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, item = prose(60), prose(30)
    rows = [(k, prose(80), "en", "s", 1) for k in range(200)]
    rows += [(200 + k, rows[k][1], "en", "s", 1) for k in range(5)]
    rows += [(210 + k, f"{prose(50)} {passage} {prose(50)}", "en", "s", 1) for k in range(3)]
    rows += [(220, f"{prose(40)} {item} {prose(40)}", "en", "s", 1), (221, None, None, None, None), (222, "", "en", "s", 0)]
    toxic = [(300 + k, f"{prose(30)} vile nasty {prose(30)} grim vile.", "en", "s", 1) for k in range(80)]
    documents = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows + toxic, documents).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(x[0], 1, int(x[0] >= 300)) for x in rows[:200] + toxic], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_decide_as_brute_force_does(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.dtypes
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder).cache()
        out[name] = (before, docs)
        if name != "encoding":
            assert docs.dtypes == columns
    ids = lambda df: {r.doc_id for r in df.collect()}
    gone = ids(out["toxicity"][0]) - ids(out["toxicity"][1])
    assert len(gone & set(range(300, 380))) > 75 and len(gone & set(range(230))) < 5
    rows = sorted((r.doc_id, r.text) for r in out["near_duplicates"][0].collect() if r.doc_id != 221)
    root = brute_components([brute_fingerprint(t) for _, t in rows])
    kept = {rows[k][0] for k, x in enumerate(root) if k == x}
    assert ids(out["near_duplicates"][1]) - {221} == kept - {222} | ({222} & ids(out["near_duplicates"][1]))
    source = [(r.doc_id, r.text) for r in out["substring_dedup"][0].collect()]
    want = {i: b" ".join(x for k, x in enumerate(w) if k not in g).decode() for i, w, g in removed(source) if g}
    after = {r.doc_id: r.text for r in out["substring_dedup"][1].collect()}
    assert after == {i: want.get(i, t) for i, t in source} and len(want) >= 2
    assert ids(out["decontamination"][0]) - ids(out["decontamination"][1]) == {220}
    own = bpe.ByteBpe.of(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text or "" for r in out["encoding"][0].collect()}
    final = {r.doc_id: r for r in out["encoding"][1].collect()}
    assert set(final) == set(texts)
    assert all(own.decode(r.ids).decode() == texts[i] and r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in final.items())
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()} == {(i, r.ids_sha256) for i, r in final.items()}


def test_every_operator_has_its_query():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 11)} and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
