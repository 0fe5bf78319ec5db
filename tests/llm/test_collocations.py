import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from marlstone.llm import collocations as cx

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "lang string, text string"


def brute(rows, longest=5, least=100, covered=100, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(w[s : s + k]) for s in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if a >= least and " " in p}
        dropped = set()
        for p, a in candidates.items():
            w = p.split(" ")
            dropped |= {q for m in range(2, len(w)) for s in range(len(w) - m + 1) if 100 * a >= covered * candidates[q := " ".join(w[s : s + m])]}
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                w = p.split(" ")
                cuts = [(counts[" ".join(w[:k])], counts[" ".join(w[k:])]) for k in range(1, len(w))]
                score, _, ends, begins = min((1000 * a * n[lang] // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
                scored.append((-score, -a, p.encode(), ends, begins))
        for rank, (score, a, p, x, y) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def check(spark, rows, schema=SCHEMA, parts=3, **how):
    found = cx.collocations(spark.createDataFrame(rows, schema).repartition(parts), bits=how.pop("bits", 20), **how)
    assert found.columns == COLUMNS
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute(rows, **how)
    return got


def made_up(seed, n, words, langs=("en", "de", None)):
    rng = random.Random(seed)
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? "]
    return [(rng.choice(langs), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(30)))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rows = made_up(seed, 120, ["a", "B", "b", "c c", "É", "é", "x\x0by", "ǆ", "d'"])
    assert check(spark, rows, least=3, covered=[100, 60, 100][seed], first=[2000, 7, 2000][seed])


def test_filled_buckets(spark):
    """With 8 buckets the filters let everything through; counts stay exact."""
    check(spark, made_up(7, 200, [f"w{k}" for k in range(12)]), least=4, bits=3)


def test_chunks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(cx, "CHUNK", 50)
    rows = made_up(11, 60, ["one", "two", "three"]) + [("en", "one two three. " * 4000)]
    check(spark, rows, least=300)


def test_counts_above_a_byte(spark):
    check(spark, [("en", "big small " * 500), ("en", "big small")] * 3, least=700)


def test_overlaps_count(spark):
    assert check(spark, [("en", "so " * 30)], least=10)[-1][3] == 26


def test_cases(spark):
    assert check(spark, [], least=1) == []
    assert check(spark, [(None, None), ("en", ""), ("en", " .\t,")], least=1) == []
    assert check(spark, [("en", "alone")] * 5, least=2) == []
    check(spark, [(None, "a b")] * 3 + [("und", "a b")] * 2, least=5)  # a null language is `und`
    check(spark, [("", "a b\x00 c")] * 3, least=2)


def test_clashing_columns(spark):
    rows = [(*r, 1, "p", 2, b"z") for r in made_up(3, 60, ["a", "b"])]
    check(spark, rows, SCHEMA + ", n int, phrase string, segment int, buckets binary", least=3)


def test_exact_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits: the same expression over large counts."""
    a, n, left, right = 3_000_000_019, 9_000_000_000_037, 3_100_000_003, 7_000_000_001
    expr = "(1000 * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    assert spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").selectExpr(expr).first()[0] == 1000 * a * n // (left * right)


def test_buckets():
    rng = np.random.default_rng(1)
    own, plain = cx.Buckets(18, 100), np.zeros(1 << 18, "i8")
    for size in (10, 100_000, 400_000):
        hashed = rng.integers(0, 1 << 63, size, dtype="u8") * np.uint64(2)
        hashed[: size // 2] = hashed[0]
        own.add(hashed)
        np.add.at(plain, (hashed >> np.uint64(46)).astype("i8"), 1)
    assert (own.counts == np.minimum(plain, 100)).all()
    back = np.zeros_like(own.counts)
    for k, data in own.segments():
        back[k << 16 : (k + 1) << 16] = own.unpacked(data)
    assert (back == own.counts).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    rows = con.sql("SELECT lang, text FROM documents").fetchall()
    got = sorted(tuple(r) for r in cx.op11(spark, folder).collect())
    assert got == brute(rows) == sorted(con.sql(cx.OP11_SQL).fetchall())
