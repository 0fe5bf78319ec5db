import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import fingerprints as fp


def plain_chunks(data):
    """Chunks by the definition, a byte at a time."""
    out, start = [], 0
    padded = bytes(16) + data
    while start < len(data):
        end = min(start + fp.MOST, len(data))
        for at in range(start + fp.LEAST - 1, end - 1):
            h = sum(int(fp.GEAR[padded[at + 16 - age]]) << age for age in range(16)) % 2**16
            if h & int(fp.EARLY if at < start + fp.NORMAL else fp.LATE) == 0:
                end = at + 1
                break
        out.append(data[start:end])
        start = end
    return out


def plain_digest(chunk):
    h = sum(int(fp.SPREAD[b]) * pow(fp.BASE, len(chunk) - 1 - k, 2**64) for k, b in enumerate(chunk)) % 2**64
    h ^= len(chunk) * 0xC2B2AE3D27D4EB4F % 2**64
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> shift)) * by % 2**64
    return (h ^ (h >> 31)) >> 16


def plain(data):
    return sorted({plain_digest(c) << 12 | len(c) for c in plain_chunks(data)})


def sample(seed, n):
    return "".join(random.Random(seed).choices("abcdefg hé\n", k=n)).encode()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=400), st.integers(0, 99).map(lambda k: sample(k, 17 * k))), max_size=6), st.integers(1, 600))
def test_fingerprints_equal_definition(texts, batch):
    before, fp.BATCH = fp.BATCH, batch
    try:
        assert [x.tolist() for x in fp.fingerprints(texts)] == [plain(t) for t in texts]
    finally:
        fp.BATCH = before


def test_chunks_have_bounded_sizes():
    sizes = [len(c) for c in plain_chunks(sample(1, 20000))]
    assert all(fp.LEAST <= n <= fp.MOST for n in sizes[:-1]) and 35 < np.mean(sizes) < 75


def test_insertion_keeps_most_chunks():
    data = sample(2, 8000)
    a, b, c = fp.fingerprints([data, data[:3000] + b"inserted" + data[3000:], sample(3, 8000)])
    assert fp.likeness(a, b) > 0.95 and fp.likeness(a, c) < 0.05 and fp.likeness(a, a) == 1


@pytest.mark.parametrize("n", [0, 1, 5])
def test_shown_round_trip(n):
    a = np.sort(np.random.default_rng(n).integers(0, 2**60, n, dtype="u8"))
    assert fp.parsed(fp.shown(a)).tolist() == a.tolist()


def test_likeness_of_empty():
    none, some = fp.fingerprints([b"", b"x"])
    assert (fp.likeness(none, none), fp.likeness(none, some), fp.likeness(some, none)) == (1, 0, 0)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        new = fp.edited(t, rows[(k + 1) % len(rows)][1])
        own, other, following = (np.array(plain(x.encode()), "u8") for x in (t, new, rows[(k + 1) % len(rows)][1]))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.shown(own), fp.shown(other), fp.likeness(own, other), fp.likeness(own, following)))
    return sorted(out, key=str)


ROWS = [(k * 3, sample(k, (k * 7919) % 700).decode()) for k in range(60)]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:2], [*ROWS, (None, "null id"), (6, "again"), (6, "again"), (1000, None), (1001, ""), (1002, "é" * 900)], [(None, "b"), (None, "a")]])
def test_table(spark, rows):
    docs = spark.createDataFrame([(i, t, "f", 2) for i, t in rows], "doc_id long, text string, fingerprint string, pid int")
    got = fp.compared(docs)
    assert got.columns[:1] == ["doc_id"] and sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_many_ranges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for parts in (1, 2, 17, 40, 300):
        spread, last = fp.ranged(docs, parts)
        own = {r.doc_id: r.pid for r in spread.where("tail = 0").collect()}
        bounds = sorted({r.doc_id for r in spread.where("tail = 1").collect()})
        assert len(bounds) == last and all(pid == sum(b <= i for b in bounds) for i, pid in own.items())


def test_empty_table(spark):
    assert fp.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500").collect()]
    got = fp.compared(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    whole = fp.op4(spark, "/root/testdata/sf0.001").collect()
    by_text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    prints = {}
    assert len(whole) == len(by_text)
    assert all(prints.setdefault(by_text[r.doc_id], r.fingerprint) == r.fingerprint for r in whole)
    long = [r for r in whole if r.n_chars > 400]
    assert np.mean([r.near_edited > 0.6 for r in long]) > 0.95 and np.mean([r.near_next < 0.3 for r in long]) > 0.9
