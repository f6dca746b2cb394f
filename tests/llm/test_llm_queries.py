"""Registered queries of the package against their SQL twins or brute force, on the smallest tables."""

import hashlib
import zlib

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

import __spark_entry__ as contract
import corpus_pipeline
from seamline.llm import byte_bpe
from seamline.llm.queries import QUERIES, SHARDS, SQL
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def texts(spark, data):
    return dict(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))


@pytest.mark.parametrize("name", list(SQL))
def test_twin(spark, data, name):
    assert compare(spark, connect(data), data, name).startswith("OK")


def test_all_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, len(numbers) + 1)) and set(QUERIES) | {"pipeline"} <= set(contract.queries())


def test_token_counts(shipped, data, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = QUERIES["op6_token_counts"](shipped, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def expected_ids(text):
    ranks = byte_bpe.Ranks(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [library.encode_ordinary(t) for t in text]


def test_byte_bpe(shipped, data, texts):
    rows = QUERIES["op10_byte_bpe"](shipped, data).collect()
    for r, ids in zip(rows, expected_ids([texts[r.doc_id] for r in rows]), strict=True):
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize(("name", "target", "least"), [("op1_quality", "quality", 0.9), ("op5_toxicity", "toxic", 0.75)])
def test_held_out_accuracy(shipped, name, target, least):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[target] for r in shipped.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](shipped, folder).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    rare = 0 if target == "quality" else 1
    hit = sum(p == y == rare for p, y in known)
    assert hit / sum(y == rare for _, y in known) >= least
    assert hit / sum(p == rare for p, _ in known) >= 0.9


@pytest.mark.parametrize(("size", "least"), [("sf0.001", 0.6), ("sf0.01", 0.8)])
def test_toxic_documents_of_small_tables_are_dropped(shipped, size, least):
    folder = f"/root/testdata/{size}"
    labels = {r.doc_id: r.toxic for r in shipped.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = shipped.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](shipped, docs, folder).select("doc_id").collect()}
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - kept
    for fold in (True, False):
        toxic = {k for k, y in labels.items() if y == 1 and (zlib.crc32(str(k).encode()) % 5 == 0) == fold}
        assert len(gone & toxic) >= least * len(toxic)
    assert not any(labels.get(k) == 0 for k in gone)


def test_decontamination(shipped, data, texts):
    items = {r.item_id: " ".join(r.text.split()).lower() for r in shipped.read.parquet(f"{data}/benchmark.parquet").collect()}
    plain = {k: " ".join(t.split()).lower() for k, t in texts.items()}
    copies = {(k, i) for k, t in plain.items() for i, x in items.items() if x in t}
    rows = QUERIES["op4_decontamination"](shipped, data).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.score > 0.999} == copies


def test_sharding_is_even(shipped, data, texts):
    rows = QUERIES["op7_sharding"](shipped, data).collect()
    assert len(rows) == len(texts) and {r["shard"] for r in rows} <= set(SHARDS)


def test_chat_calls_follow_the_turns(shipped, data):
    turns = {(r.conv_id, r.turn): r for r in shipped.read.parquet(f"{data}/conversations.parquet").collect()}
    rows = QUERIES["op9_chat_format"](shipped, data).collect()
    assert len(rows) == sum(r.role != "assistant" for r in turns.values())
    for r in rows:
        answer = turns.get((r.conv_id, r.position + 1))
        assert r.n_results == int(answer is not None and answer.role == "assistant") and r.valid and r.order_major == r.position


def test_pipeline_stages_by_brute_force(shipped, data, tmp_path):
    docs = shipped.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(shipped, docs, data).write.parquet(path)
        docs = shipped.read.parquet(path)
        kept[name] = docs.collect()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    assert ids["line_dedup"] == ids["toxicity"] and ids["byte_bpe"] == ids["decontamination"] <= ids["ngram_join"] <= ids["toxicity"]
    text = {r.doc_id: r.text for r in kept["decontamination"]}
    for r in kept["byte_bpe"]:
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    seen = {}
    for r in sorted(kept["line_dedup"], key=lambda r: r.doc_id):
        for line in r.text.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").lower()
            assert len(key) < 10 or seen.setdefault(key, r.doc_id) == r.doc_id
    assert sorted(map(tuple, contract.queries()["pipeline"](shipped, data).collect())) == sorted(map(tuple, kept["byte_bpe"]))
