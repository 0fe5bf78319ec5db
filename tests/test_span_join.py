"""Span joins against loops over all pairs."""

import random

import pytest

from marlstone.operators import span_join

SPANS = "doc_id long, start int, end int, name string"


def made_up(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.randrange(300)
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), start, start + rng.choice([0, 1, 3, 9, 90]), rng.choice("xyz")))
    return rows + [(4, None, 3, "n"), (4, 2, None, "n"), rows[0]]


def apart(a, b):
    return max(b[1] - a[2], a[1] - b[2], 0)


def whole(rows):
    return [r for r in rows if None not in r[:3]]


@pytest.mark.parametrize("seed,width,window", [(1, 7, 0), (2, 64, 5), (3, 1, 2), (4, 1000, 40)])
def test_joins(spark, seed, width, window):
    left, right = made_up(seed, 60), made_up(seed + 9, 50)
    a, b = spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS)
    near = span_join.near_join(a, b, "doc_id", window, width)
    assert near.columns == ["doc_id", "start", "end", "name", "right_start", "right_end", "right_name"]
    pairs = [(x, y) for x in whole(left) for y in whole(right) if x[0] == y[0]]
    assert sorted(map(tuple, near.collect())) == sorted((*x, *y[1:]) for x, y in pairs if apart(x, y) <= window)
    inside = span_join.inside_join(a, b, "doc_id", width)
    assert sorted(map(tuple, inside.collect())) == sorted((*x, *y[1:]) for x, y in pairs if y[1] <= x[1] and x[2] <= y[2])
    for plan in (near, inside):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
    own = spark.createDataFrame(whole(left), SPANS)
    got = sorted(map(tuple, span_join.nearest(own, spark.createDataFrame(whole(right), SPANS), "doc_id").collect()), key=str)
    assert got == sorted(((*x, min((apart(x, y) for y in whole(right) if y[0] == x[0]), default=None)) for x in whole(left)), key=str)


def test_empty(spark):
    none, some = spark.createDataFrame([], SPANS), spark.createDataFrame([(1, 0, 2, "x")], SPANS)
    assert span_join.near_join(none, some, "doc_id", 3).count() == span_join.inside_join(some, none, "doc_id").count() == 0
    assert span_join.nearest(some, none, "doc_id").first()["distance"] is None


def test_spans_of_texts(spark):
    docs = spark.createDataFrame([(1, "the cat the"), (2, None), (3, "")], "doc_id long, text string")
    found = span_join.exploded(docs, "doc_id", span_join.phrase_spans_col({"t": ["the"], "c": ["cat", "cat the"]})("text"))
    assert sorted(map(tuple, found.collect())) == [(1, "c", 4, 11), (1, "t", 0, 3), (1, "t", 8, 11)]
    found = span_join.exploded(docs, "doc_id", span_join.pattern_spans_col({"w": r"\w+"})("text"))
    assert [tuple(r)[2:] for r in found.orderBy("start").collect()] == [(0, 3), (4, 7), (8, 11)]
