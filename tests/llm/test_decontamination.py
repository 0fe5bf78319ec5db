import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import decontamination as dc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    own, hit, names = tokens(text), set(), set()
    where = {}
    for item, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            where.setdefault(tuple(w[k : k + window]), set()).add(item)
    for size in {len(w) for w in where}:
        for k in range(len(own) - size + 1):
            if (w := tuple(own[k : k + size])) in where:
                hit.update(range(k, k + size))
                names |= where[w]
    names = sorted(str(x) for x in names if x is not None)
    return len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def ours(text, index):
    own = dc.words(text)
    ranges, names = dc.match(index, dc.coded(index, own)) if index else ([], set())
    names = sorted(str(x) for x in names if x is not None)
    n = sum(b - a for a, b in ranges)
    return len(own), n, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n > 0


TEXT = st.lists(st.sampled_from(["a", "b", "C", "é", "x1", ",", "zz"]), max_size=30).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.sampled_from(["1", "2", "10", None]), TEXT), max_size=5), st.integers(1, 5))
def test_match_equals_brute(text, items, window):
    assert ours(text, dc.build(items, window)) == brute(text, items, window)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=4), st.lists(st.integers(0, 3), max_size=20))
def test_automaton_lengths(sequences, stream):
    a = dc.Automaton()
    for s in sequences:
        a.add(s)
    held = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)} | {()}
    for k, (_, length) in enumerate(a.lengths(stream), 1):
        assert length == max(n for n in range(k + 1) if tuple(stream[k - n : k]) in held)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_words_equal_pattern(text):
    assert [w.decode("utf-8", "surrogatepass") for w in dc.words(text)] == tokens(text)
    data = text.encode("utf-8", "surrogatepass")
    assert len(dc.word_bounds(text)) == len(tokens(text)) and all(0 <= a < b <= len(data) for a, b in dc.word_bounds(text))


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item!"), (2, "Short item!"), (12, "two three four five six seven eight nine ten eleven twelve"), (None, "no id here"), (3, None), (4, "... !")]
DOCS = [(1, "x One, two three four five six seven eight nine TEN eleven y"), (2, None), (3, ""), (4, "a short item and no id here"), (4, "a short item and no id here"), (None, "short"), (6, "clean words " * 2000), (7, "one two three four five six seven eight nine")]


def rows_of(frame):
    return sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())


def test_table_in_one_and_in_more_blocks(spark):
    items = spark.createDataFrame([(i, t, "q") for i, t in ITEMS], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(i, t, 5) for i, t in DOCS], "doc_id long, text string, items int")
    want = sorted((i or 0, *brute(t, ITEMS)) for i, t in DOCS)
    assert rows_of(dc.found(docs, items)) == want
    assert len(list(dc.indexes(items, block=8))) > 2
    assert rows_of(dc.found(docs, items, block=8)) == want
    assert rows_of(dc.found(docs, items.limit(0))) == sorted((i or 0, *brute(t, [])) for i, t in DOCS)
    assert dc.found(docs.limit(0), items).count() == 0


def test_cleaned(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in DOCS], "doc_id long, text string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in dc.cleaned(docs, items).collect()), key=str)
    kept = [(2, None, None), (3, "", 0), (0, "short", 5), (6, DOCS[6][1], len(DOCS[6][1])), (7, DOCS[7][1], len(DOCS[7][1]))]
    assert got == sorted(kept, key=str)
    loose = {r.doc_id: r.text for r in dc.cleaned(docs, items, most=1.0).collect()}
    assert loose[1] == "x  y" and loose[4] == "a  and "
    assert all(brute(t, ITEMS)[1] == 0 for t in loose.values())


def test_cleaned_in_more_blocks_equals_one(spark):
    word = [f"w{k}" for k in range(60)]
    own = [(1, " ".join(word[:20])), (2, " ".join(word[15:30]))]  # they overlap in w15 to w19
    items = spark.createDataFrame(ITEMS + [(i + 20, t) for i, t in own], "item_id long, text string")
    texts = [(11, "begin " + " ".join(word)), (12, " ".join(word[:12] + ["a", "b"] + word[20:30] + ["c"] * 12)), (13, " ".join(word[12:26] + ["z"] * 30))]
    rows = [(i, t, None if t is None else len(t), "x") for i, t in DOCS + texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, hits string")
    assert len(list(dc.indexes(items, block=8))) > 2
    for most in (0.5, 1.0):
        want = sorted((tuple(r) for r in dc.cleaned(docs, items, most=most).collect()), key=str)
        assert sorted((tuple(r) for r in dc.cleaned(docs, items, block=8, most=most).collect()), key=str) == want
    kept = {r.doc_id: r.text for r in dc.cleaned(docs, items, block=8).collect()}
    assert kept[11] == "begin  " + " ".join(word[30:])
    assert 12 not in kept  # 12 and 10 of 36 words, by two blocks


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows_of(dc.op8(spark, SF))
    assert got == sorted((i, *brute(t, items)) for i, t in docs)
    assert sum(r[5] for r in got) > 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(tuple(r) for r in dc.op8(spark, SF).collect()) == sorted(con.sql(dc.OP8_SQL).fetchall())
