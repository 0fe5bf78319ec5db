import string
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import quality

SF = "/root/testdata/sf0.01"


def test_features_of_odd_texts():
    for text in (None, "", " ", "\n\n", "a", "🙂" * 10, "A!! B!! " * 50000, "\ud800"):
        x = quality.features(text)
        assert x.shape == (len(quality.FEATURES),) and np.isfinite(x).all()


def test_features_by_hand():
    x = dict(zip(quality.FEATURES, quality.features("AB AB ab, *** x***\nx"), strict=True))
    assert x["repeat"] == 1 / 6 and x["upper_words"] == 2 / 6 and x["lone_words"] == 1 / 6 and x["mark_words"] == 1 / 6 and x["lines_again"] == 0


def brute_features(text):
    """Each feature from its words, one sign and one word at a time."""
    data = list((text or "").encode("utf-8", "replace"))
    share = lambda test: sum(map(test, data)) / max(1, len(data))
    words = (text or "").split()
    of_words = lambda test: sum(map(test, words)) / max(1, len(words))
    marks = [w for w in string.punctuation]
    bare = lambda w: "".join(c for c in w if c not in marks)
    lines = (text or "").split("\n")
    n = max(1, len(words))
    return [
        share(lambda b: chr(b) in string.ascii_uppercase), share(lambda b: chr(b) in string.digits), share(lambda b: b < 127 and chr(b) in string.punctuation and chr(b) not in ",."),
        share(lambda b: chr(b) in ",."), share(lambda b: b == 32), share(lambda b: b < 32 or b == 127), share(lambda b: b > 127),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(a == b for a, b in zip(words, words[2:], strict=False)) / n,
        min(1, len(set(words)) / n**0.8), min(2, len(text or "") / n / 10),
        of_words(lambda w: not w.isalpha() and bare(w) != "" and len(w) - len(bare(w)) > 1), of_words(lambda w: len(w) > 1 and w.isupper()), of_words(lambda w: bare(w) == ""),
        1 - len(set(lines)) / len(lines), np.log1p(n) / 10,
    ]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=50), st.text(alphabet="aAbB1 .,!*\n\t\x7fé", max_size=60)))
def test_features_equal_brute(text):
    assert np.allclose(quality.features(text), brute_features(text))


def test_weights_equal_plain_gradient_descent():
    """The same pairs, loss and penalty, by small plain steps until nothing changes."""
    rng = np.random.default_rng(2)
    x = rng.random((120, len(quality.FEATURES)))
    y = (x[:, 0] + 0.5 * rng.random(120) < 0.7).astype(int)
    m = quality.fit(x, y, pairs=400, steps=3000, ridge=0.05)
    e = np.concatenate([x, np.sqrt(x)], axis=1)
    z = np.clip((e - e.mean(axis=0)) / np.maximum(e.std(axis=0), 1e-3), -8, 8)
    draw = np.random.default_rng(11)
    diff = z[draw.choice(np.flatnonzero(y == 1), 400)] - z[draw.choice(np.flatnonzero(y == 0), 400)]
    w = np.zeros(z.shape[1])
    for _ in range(20_000):
        w -= 0.05 * (-(diff.T @ (1 / (1 + np.exp(diff @ w)))) / 400 + 0.05 * w)
    assert np.allclose(m.weights, w, atol=1e-3)
    rank = sorted(z @ w)
    bad = int((y == 0).sum())
    assert np.isclose(m.threshold, (rank[bad - 1] + rank[bad]) / 2, atol=1e-2)


def test_long_texts_teach(spark):
    docs = spark.createDataFrame([(k, "word " * 20_000) for k in range(1, 4)], "doc_id long, text string")
    x, y = quality.training_rows(docs, spark.createDataFrame([(k, 1) for k in range(1, 4)], "doc_id long, quality int"))
    assert len(y) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(1, 4))


def test_ranking_learns_a_known_order():
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.FEATURES)))
    y = (x[:, 2] < 0.8).astype(int)
    m = quality.fit(x, y)
    rank = m.rank(x)
    assert np.mean(rank[y == 1][:, None] > rank[y == 0][None, :]) > 0.97
    assert ((m.score(x) >= quality.CUT) == (rank >= m.threshold)).all()
    assert m.score(x).min() >= 0 and m.score(x).max() <= 1


def test_one_kind_of_label():
    assert quality.fit(np.zeros((3, len(quality.FEATURES))), np.ones(3, int)) is None
    assert quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0, int)) is None


def test_table(spark):
    docs = spark.createDataFrame([(k, ("good words here and there " * 5) if k % 2 else "BAD!! BAD!! " * 9, 1) for k in range(200)] + [(900, None, 1), (901, "", 1), (None, "x", 1), (1, "good words here", 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(900, 0), (None, 1), (1, 1)], "doc_id long, quality int")
    x, y = quality.training_rows(docs, labels)
    held = {k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(y) in (sum(k % 2 for k in range(200) if k not in held) + d for d in (0, 1, 2, 3))
    got = quality.scored(docs, quality.fit(x, y)).collect()
    assert len(got) == 204
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200)
    assert quality.scored(docs.limit(0), None).count() == 0
    assert {r.score for r in quality.scored(docs, None).collect()} == {0.5}
    assert quality.fit(*quality.training_rows(docs, labels.limit(0))) is None


def test_query_held_out(spark):
    got = {r.doc_id: r for r in quality.op3(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(got[r.doc_id], r.quality) for r in labels if r.doc_id in got and got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert len(held) > 40 and np.mean([r.predicted == q for r, q in held]) > 0.97
    assert np.mean([r.predicted for r, q in held if q == 1]) > 0.99
