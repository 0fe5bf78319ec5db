import io
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_pack_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
    data = tf.pack(ids, bits)
    assert len(data) == -(-n // 64) * 8 * bits
    assert (tf.unpack(data, bits, n) == ids).all()


def test_pack_refuses_wide_ids():
    with pytest.raises(ValueError):
        tf.pack(np.array([8]), 3)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 999), max_size=40), max_size=12), st.integers(1, 64))
def test_file_round_trip_and_random_access(docs, block):
    sink = io.BytesIO()
    sink.close = lambda: None
    w = tf.Writer(sink, tf.width(1000), block)
    for k, ids in enumerate(docs):
        w.add(None if k == 3 else k, np.array(ids, "<u4"))
    w.close()
    r = tf.Reader(pa.BufferReader(sink.getvalue()))
    assert [x.tolist() for x in r.documents()] == docs
    assert [r.document(k).tolist() for k in range(len(docs))] == docs
    flat = [x for ids in docs for x in ids]
    assert r.ids(3, 17).tolist() == flat[3:17]


TEXTS = ["", "Hello, World!", "it's don't 'S", "the the,, ... %%% a1b22²³ ½", "ÉÀ ß ÿ µ ª Ünïcode\x85\xa0x", "<|endoftext|> x", "é İ ΑΣ ς 漢字 \x1c a", "a" * 5000, "\n\t  ", "x​y 🙂🙂 z"]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aAzZ0 9,.'sß\xc9\xe9²\xa0\x85\n|%!<>", max_size=60)))
def test_encoder_equals_library(text):
    got = np.frombuffer(tf.encoder(PATH).encode([text])[0], "<u4").tolist()
    assert got == WHOLE.encode(text, add_special_tokens=False).ids


def test_encoder_with_small_cache(monkeypatch):
    monkeypatch.setattr(tf, "CACHE", 3)
    coder = tf.Encoder(PATH)
    for text in TEXTS + ["one two three four five", "two six seven", "one two"]:
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def brute(rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_table(spark):
    rows = [(10 - k, t) for k, t in enumerate(TEXTS)] + [(50, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, n_tokens int")
    got = tf.token_files(docs)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(brute(rows))


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tf.token_files(docs).collect())
    assert [x[0] for x in got] == [0, 2, 4, 6] and got[0][1] is None and [x[1] for x in got[1:]] == [1, 1, 1]


def test_empty_table(spark):
    assert tf.token_files(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rolled_files(spark, tmp_path):
    rows = [(k, "one two three " * (k % 7)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tf.write_files(docs, str(tmp_path), PATH, roll=25)
    assert manifest.count() >= 16 and manifest.selectExpr("max(n_tokens) AS n").first().n < 25 + 20
    assert sorted(tuple(r)[:4] for r in tf.read_files(spark, manifest).collect()) == sorted(brute(rows))


def test_other_pipelines_go_to_the_library(tmp_path):
    """The short way is taken only for the pipeline that it stands for."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert tf.Encoder(PATH).short
    replaced = json.loads(json.dumps(spec["normalizer"]))
    replaced["normalizers"][1]["content"] = "_"
    added = {"id": 49408, "content": "world", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    for k, change in enumerate([{"normalizer": replaced}, {"normalizer": None}, {"added_tokens": [*spec["added_tokens"], added]}]):
        path = str(tmp_path / f"{k}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec | change, f)
        coder, whole = tf.Encoder(path), Tokenizer.from_file(path)
        assert not coder.short
        assert np.frombuffer(coder.encode(["Hello  world, A b"])[0], "<u4").tolist() == whole.encode("Hello  world, A b", add_special_tokens=False).ids


def test_encoder_equals_library_on_all_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    coder = tf.Encoder(PATH)
    for low in range(0, len(texts), 500):
        part = texts[low : low + 500]
        want = WHOLE.encode_batch_fast(part, add_special_tokens=False)
        assert coder.encode(part) == [np.array(x.ids, "<u4").tobytes() for x in want]


def test_query(spark):
    got = tf.op1(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(tuple(r)[:4] for r in got) == sorted(brute(rows))
