import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import language

SF = "/root/testdata/sf0.01"
TINY = [("the house is on the hill and it was there", "en"), ("das haus ist auf dem berg und nicht da", "de"), ("la casa está en la colina y no hay", "es")] * 30


@pytest.fixture(scope="module")
def model():
    return language.fit(TINY)


def plain(model, text):
    """Logits from the definition: the mean over all features of all words."""
    total, n = np.zeros(len(model.langs)), 0
    for w in language.words(text):
        f, counts = language.features([w])
        total += model.parts[f].sum(axis=0)
        n += int(counts[0])
    return total / max(n, 1) + model.bias


def test_features():
    f, counts = language.features(["ab", "a", "été"])
    assert counts.tolist() == [1 + 3 + 2 + 1, 1 + 2 + 1 + 0, 1 + 4 + 3 + 2]
    alone, _ = language.features(["a"])
    assert f[counts[0] : counts[0] + counts[1]].tolist() == alone.tolist()


@pytest.mark.parametrize("text", ["The House, on!", "a1b2 das-haus", "x" * 3000, "½ la casa", "été 12"])
def test_logits_equal_definition(model, text):
    assert np.allclose(model.logits([text])[0], plain(model, text), atol=1e-4)


def test_small_cache_changes_nothing(model, monkeypatch):
    want = model.predict([t for t, _ in TINY])
    monkeypatch.setattr(language, "CACHE", 2)
    assert [x for t, _ in TINY for x in model.predict([t])] == want


def test_predicts_training_languages(model):
    assert [model.predict([t])[0][0] for t, _ in TINY[:3]] == ["en", "de", "es"]


def test_without_letters(model):
    assert model.predict([None, "", "12 %%", "½", "\n"]) == [("und", 0.0)] * 5


def test_degenerate_fits():
    assert language.fit([]).predict(["abc"]) == [("und", 0.0)]
    assert language.fit([("abc", "en")]).predict(["x", "1"]) == [("en", 1.0), ("und", 0.0)]
    assert language.fit([("12", "en"), (None, "de")]).langs == []


def test_table(spark, model):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "das haus ist", 0.1), (3, "das haus ist", 0.1), (None, "la casa", 0.2)], "doc_id long, text string, score double")
    got = language.identify(docs, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "es"), (1, "und"), (2, "und"), (3, "de"), (3, "de")]
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 3]
    assert language.identify(docs.limit(0), model).count() == 0


def test_query_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = language.op10(spark, SF).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    model = language.fit(language.training_rows(spark.read.parquet(f"{SF}/documents.parquet")))
    assert language.accepted(spark.read.parquet(f"{SF}/documents.parquet"), model).count() >= 0.99 * len(docs)


@pytest.mark.parametrize("unlearned", ["de", "fr"])
def test_rejects_an_unlearned_language_and_keeps_held_out_texts(spark, unlearned):
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang IS NOT NULL AND length(text) BETWEEN 50 AND 5000").collect()]
    held = [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs]
    model = language.fit([(r.text, r.lang) for r, h in zip(docs, held, strict=True) if not h and r.lang != unlearned][:4000])
    keep = lambda own: np.mean([s >= model.reject for _, s in model.predict([r.text for r in own])])
    own = [r for r, h in zip(docs, held, strict=True) if h]
    assert keep([r for r in own if r.lang == unlearned]) < 0.3
    assert keep([r for r in own if r.lang != unlearned]) > 0.99


def test_training_never_sees_held_out(spark):
    name = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))
    rows = [(k, f"w{name(k)}: Text", "en") for k in range(200)] + [(500, None, "en"), (501, "abc", None), (None, "abc", "en")]
    got = language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(t for t, _ in got) == sorted(f"w{name(k)} text" for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2)


def test_rare_languages_and_long_texts_teach(spark):
    rows = [(k, "the house", "en") for k in range(3000)] + [(k, "das haus " * 30_000, "de") for k in range(3000, 3010)]
    got = language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100)
    count = Counter(lang for _, lang in got)
    assert count["de"] == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(3000, 3010)) and 50 < count["en"] < 150
    assert max(len(t.split()) for t, _ in got) == language.DRAWN


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=8), st.integers(1, 200))
def test_even_share(counts, total):
    share = language.even_share(counts, total)
    given = lambda s: sum(min(n, s) for n in counts)
    assert given(share) <= total and (share == max(counts) or given(share + 1) > total)


def test_calibration_equals_definition():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    z = rng.normal(0, 1, (400, 3)) * 4
    z[np.arange(400), y] += 6
    m = language.Model(["a", "b", "c"], np.zeros((1, 3)), np.zeros(3))
    language._calibrate(m, z, y)

    def loss(scale):
        total, slip = 0.0, 1 / 402
        for row, own in zip(z, y, strict=True):
            e = np.exp(row / scale - max(row / scale))
            p = e / e.sum() + 1e-12
            total -= sum((1 - slip if k == own else slip / 2) * np.log(p[k]) for k in range(3))
        return total / 400

    scales = np.geomspace(0.005, 50, 120)
    best = min(range(120), key=lambda k: loss(scales[k]))
    assert m.temperature == scales[best] and 0 < best < 119
    right = sorted(p.max() for p, own in zip(language.softmax(z / m.temperature), y, strict=True) if p.argmax() == own)
    assert right[0] <= m.reject <= right[1]


def test_rejects_other_scripts_and_random_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(language.training_rows(docs))
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(2, 10)))
    for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцч", "αβγδεζηθικλμνξοπρστυφχψω", "अआइईउऊएऐओऔकखगघ"):
        texts = [" ".join(word(letters) for _ in range(30)) for _ in range(200)]
        frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
        assert language.accepted(frame, model).count() <= 4, letters
    assert 0.005 < model.temperature < 50


def test_clashing_and_extra_columns(spark, model):
    rows = [(1, "das haus ist", "x", True, 3), (2, None, None, None, None), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, keep boolean, score int")
    assert [tuple(r) for r in language.accepted(docs, model).collect()] == rows[:1]
    assert sorted(tuple(r)[:2] for r in language.identify(docs, model).collect()) == [(1, "de"), (2, "und"), (2, "und")]
