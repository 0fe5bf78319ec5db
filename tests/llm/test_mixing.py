import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest

from marlstone.llm import mixing

SF = "/root/testdata/sf0.01"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("repeats", [1.0, 1.2, 2.0, 50.0])
def test_solve_repeats(repeats):
    shares = [0.5, 0.3, 0.15, 0.05]
    a = mixing.solve(shares, repeats)
    most = max(mixing.passes(shares, a))
    assert most <= repeats + 1e-9 and min(mixing.passes(shares, a)) == 1
    assert a == 0 or math.isclose(most, repeats, rel_tol=1e-9)


@pytest.mark.parametrize("target", [0.5, 1.2, 1.3, 1.38])
def test_solve_entropy(target):
    shares = [0.5, 0.3, 0.15, 0.05]
    a = mixing.solve(shares, None, target)
    got = mixing.entropy(mixing.weights(shares, a))
    assert math.isclose(got, target, rel_tol=1e-6) or (a == 1 and got >= target) or (a == 0 and got <= target) or (target < mixing.entropy(shares) and a > 1 - 1e-9)


def test_solve_refuses_both():
    with pytest.raises(ValueError):
        mixing.solve([1.0], 2.0, 1.0)


def brute(rows, repeats):
    """The rows' copies from the definition, with plain lists."""
    sized = [(i, s, len(re.findall("[^ \t-\r]+", t or ""))) for i, t, s in rows]
    totals = Counter()
    for _, s, n in sized:
        totals[s] += n
    known = {s: n for s, n in totals.items() if n}
    top, least = max(known.values(), default=1), min(known.values(), default=1)
    a = 0.0 if top / least <= repeats else 1 - math.log(repeats) / math.log(top / least)
    out = Counter()
    for s, total in totals.items():
        wanted = int(total * (top / total) ** (1 - a) + 1e-6) if total else 0
        whole = max(1, wanted // total) if total else 1
        left = max(0, wanted - whole * total)
        own = [r for r in sized if r[1] == s]
        name = "" if s is None else f"={s}"

        def place(r):
            d = md5("mix" + ("" if r[0] is None else str(r[0])))
            block = int(d[:3], 16)
            return int(md5(f"mix/{whole}/{block}/{name}")[:12], 16), block, int(d[3:15], 16)

        taken = set()
        if left:
            run = 0
            ordered = sorted({place(r) for r in own})
            for p in ordered:
                run += sum(r[2] for r in own if place(r) == p)
                if run > left:
                    break
                taken.add(p)
        for r in own:
            for e in range(whole + (place(r) in taken)):
                out[(r[0], s, r[2], e)] += 1
    return out


def rows_of(frame):
    return Counter((r.doc_id, r.source, r.mix_tokens, r.mix_epoch) for r in frame.collect())


@pytest.mark.parametrize("blocks", [2, 4096])
@pytest.mark.parametrize("repeats", [1.0, 1.3, 3.0, 40.0])
def test_rows_equal_brute(spark, monkeypatch, repeats, blocks):
    rng = random.Random(9)
    rows = [(k, " ".join("w" * rng.randrange(0, 30)), rng.choice(["a"] * 12 + ["b"] * 4 + ["c"] * 2 + [None])) for k in range(300)]
    rows += [(500, None, "a"), (501, "", "empty"), (None, "x y", "b"), (1, "x y", "c"), (1, "x y", "c")]
    if blocks == 2:  # many documents in a block
        monkeypatch.setattr(mixing, "number", lambda text, start, digits: mixing.F.conv(mixing.F.substring(text, start, digits), 16, 10).cast("long") if digits > 3 else mixing.F.lit(7).cast("long"))
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, whole int")
    frame = mixing.mixed(docs, repeats)
    got = rows_of(frame)
    if blocks == 4096:
        assert got == brute(rows, repeats)
    assert set(frame.columns) > set(docs.columns)
    kept = Counter()
    for (i, s, _, e), n in got.items():
        if e == 0:
            kept[(i, s)] += n
    assert kept == Counter((i, s) for i, _, s in rows)
    tokens = Counter()
    for (_, s, n, _), c in got.items():
        tokens[s] += n * c
    totals = Counter()
    for _, t, s in rows:
        totals[s] += len((t or "").split())
    assert all(tokens[s] <= repeats * totals[s] + 1e-6 and tokens[s] >= totals[s] for s in totals)


def test_target_entropy(spark):
    docs = spark.createDataFrame([(k, "w " * 5, "a" if k % 10 else "b") for k in range(400)], "doc_id long, text string, source string")
    got = Counter()
    for r in mixing.mixed(docs, None, 0.5).collect():
        got[r.source] += r.mix_tokens
    total = sum(got.values())
    assert abs(mixing.entropy([n / total for n in got.values()]) - 0.5) < 0.02


def test_epochs_have_their_own_order(spark):
    docs = spark.createDataFrame([(k, "w", "a" if k < 90 else "b") for k in range(100)], "doc_id long, text string, source string")
    rows = [r for r in mixing.mixed(docs, 9.0).collect() if r.source == "b"]
    orders = [[r.doc_id for r in sorted(rows, key=lambda r: (r.mix_turn, r.mix_key)) if r.mix_epoch == e] for e in range(3)]
    assert len({tuple(o) for o in orders}) == 3 and all(sorted(o) == sorted(orders[0]) for o in orders)


def test_empty_table(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(mixing.OP9_SQL).fetchall())
    got = sorted(tuple(r) for r in mixing.op9(spark, SF).collect())
    assert got == want and len(got) > 1000


def test_clashing_names(spark):
    rows = [(k, f"w {k} " * (k % 5), "a" if k % 3 else "b", k, "whole", 2 * k) for k in range(40)]
    plain = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key long, mix_whole string, Mix_Epoch long")
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns, "mix_source", "mix_tokens", "mix_block", "mix_key_", "mix_epoch_", "mix_turn"]
    assert all(r.mix_key == r.doc_id and r.mix_whole == "whole" and r["Mix_Epoch"] == 2 * r.doc_id for r in got.collect())
    assert sorted((r.doc_id, r.mix_epoch_, r.mix_key_) for r in got.collect()) == sorted((r.doc_id, r.mix_epoch, r.mix_key) for r in mixing.mixed(plain).collect())
