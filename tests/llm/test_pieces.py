import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import pieces as px
from marlstone.llm.shared import table

SF = "/root/testdata/sf0.01"
M = px.Model(px.given(None))
PIECES = sorted(M.ids)


def same(text):
    ids = M.encode([text])[0].tolist()
    assert ids == M.library.encode(text), repr(text)
    assert M.decode(ids) == M.library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join))
def test_text_of_pieces(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aeinst. \n-=²é☃▁0", max_size=60))
def test_few_signs(text):
    same(text)


@pytest.mark.parametrize("n", range(50))
def test_runs_of_blanks(n):
    for before in ("", "a", "1", "\n"):
        for after in ("", "a", "1", "\n", "é", "☃", "▁x"):
            same(before + " " * n + after)


def test_long_texts():
    rng = random.Random(3)
    same("".join(rng.choice("abcdefgh") for _ in range(200_000)))  # one unit
    same("a" * 100_000)
    same(" ".join(rng.choice(PIECES) for _ in range(100_000)))
    assert not any(len(u) > px.LONG_UNIT for u in M.known)


def test_full_cache(monkeypatch):
    monkeypatch.setattr(px, "CACHE", 10)
    monkeypatch.setattr(px, "PAIRS", 5)
    own = px.Model(px.given(None))
    texts = ["one two three", "four five six seven eight nine ten eleven twelve", "thirteen one two", ""]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == [M.library.encode(x) for x in texts]
    assert len(own.known) <= 10


def test_backtracking_steps_back():
    """A made-up model in which the longest first piece leads nowhere."""
    own = object.__new__(px.Model)
    own.scores = {"ab": -1.0, "bc": 0.0, "abc": -2.0, "bcd": -3.0, "cd": -4.0}
    own.ids = {p: k for k, p in enumerate([*"abcd", *own.scores])}
    own.pairs = {}
    import ahocorasick

    own.automaton = ahocorasick.Automaton()
    for p in own.ids:
        own.automaton.add_word(p, len(p))
    own.automaton.make_automaton()
    for text in ("abcd", "abc", "abab", "abcabcd", "cdab", "dcba", "bcdbcd", "aabbccdd"):
        assert own.cut(text) == own.merged(text)


def test_columns_and_cases(spark):
    long = "x" * 300_000
    rows = [(1, None, 0, "a"), (1, "Hello  world", 1, "b"), (None, "é☃", 2, None), (2, "", 3, "c"), (3, long, 4, ""), (1, None, 0, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string")
    got = sorted(px.round_trip(docs).collect(), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = M.library.encode(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=str)
    ids = px.encoded(docs)
    assert sorted((r[0] or 0, r[1]) for r in ids.collect()) == sorted((r[0] or 0, M.library.encode(r[1] or "")) for r in rows)
    assert sorted((r[0] or 0, r[1]) for r in px.decoded(ids).collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert px.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] == ""


def test_empty_table(spark):
    assert px.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(px.given(None), "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = 1
    path = tmp_path / "other.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        px.Model(str(path))


def test_unknown_signs_without_byte_pieces(tmp_path):
    """One unknown id a run, across units too."""
    from sentencepiece import sentencepiece_model_pb2

    with open(px.given(None), "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.trainer_spec.byte_fallback = False
    keep = [p for p in proto.pieces if p.type != px.BYTE]
    del proto.pieces[:]
    proto.pieces.extend(keep)
    path = tmp_path / "no-bytes.model"
    path.write_bytes(proto.SerializeToString())
    own = px.Model(str(path))
    for text in ("a\n\n☺☺ ☺\x01b", "\x02", "☺ \n☺", "plain", ""):
        assert own.encode([text])[0].tolist() == own.library.encode(text)


def test_query_against_the_library(spark):
    texts = {r[0]: r[1] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = px.op12(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = M.library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(M.library.decode(ids).encode()).hexdigest()
