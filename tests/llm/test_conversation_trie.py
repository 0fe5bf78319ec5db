import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from marlstone.llm import conversation_trie as tx

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def said(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """Every prefix as a tuple of turns, every node sent to all its ancestors one by one."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    for v in own.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, said(*x[1:])))
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        base = c - int(math.fmod(c, 5))
        h = zlib.crc32(str(c).encode()) % 9
        whole = own[c] if base == c else own.get(base, [])[:h] + own[c][h:]
        whole = tuple(x[1:] for x in whole)
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in children
            saved[s[:d]] += (len(m) - 1) * (len(s[-1][1].encode()) if s else 0)
    return sorted(
        (
            (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s] if s in children else 0, leaves[s], saved[s],
             hashlib.sha256(",".join(map(str, sorted(ends[s] if s in ends else []))).encode()).hexdigest())
            for s, m in members.items()
        ),
        key=str,
    )


def check(spark, rows, schema=SCHEMA):
    found = tx.trie(spark.createDataFrame(rows, schema).repartition(3))
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def random_rows(seed, n, words="ab", longest=6):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.choice([None, rng.randrange(4)]), rng.choice(["user", "", None]), rng.choice([*words, "é" * 3, None, ""])) for _ in range(n * longest // 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_random_tables(spark, seed):
    check(spark, random_rows(seed, 40))


def test_copies_of_one_conversation(spark, monkeypatch):
    """A hot node: its ids are joined in several strings, its rows are looked up by turns."""
    monkeypatch.setattr(tx, "CHUNK", 7)
    monkeypatch.setattr(tx.shared, "HOT_ROWS", 20)
    rows = [(c * 5, k, "user", f"turn {k}") for c in range(60) for k in range(4)] + [(c * 5, k, "user", f"turn {min(k, 2)} {c * (k > 2)}") for c in range(60, 120) for k in range(5)]
    check(spark, rows)


def test_a_long_conversation_and_its_parts(spark):
    rows = [(0, k, "user", str(k)) for k in range(300)] + [(5, k, "user", str(k)) for k in range(150)] + [(10, k, "user", str(k) if k < 100 else "x") for k in range(200)]
    check(spark, rows)


def test_cases(spark):
    assert tx.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert tx.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    # An absent first conversation, ids that end turnless, repeated rows, ids below zero, a text of a megabyte.
    turnless = next(c for c in range(1, 1000) if c % 5 and tx.head(c) >= 1)
    rows = [(turnless, 0, "user", "gone"), (1000, None, None, None), (1000, 3, "a", "b"), (1000, 3, "a", "b"), (-3, 0, "user", "x"), (-7, 1, "user", "y" * 1_000_000), (-5, 0, "user", "x")]
    check(spark, rows)


def test_clashing_columns(spark):
    rows = [(*r, 1, "z", b"q", True) for r in random_rows(9, 20)]
    check(spark, rows, SCHEMA + ", depth int, ends_sha256 string, digest binary, first boolean")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = sorted((tuple(r) for r in tx.op13(spark, folder).collect()), key=str)
    found = con.sql(tx.OP13_SQL)
    assert found.columns == COLUMNS
    assert got == brute(rows) == sorted(found.fetchall(), key=str)
