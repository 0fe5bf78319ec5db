"""Each registered query of the library against its DuckDB SQL, as the driver compares them."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from marlstone.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert got or name in ("pattern_contains", "pattern_match_flag", "extract_phones")
    if name in ORACLES:
        found = con.sql(ORACLES[name])
        assert sorted(frame.columns) == sorted(found.columns)
        want = rows_of(found.columns, found.fetchall())
        assert len(got) == len(want)
        assert [a for a, b in zip(got, want, strict=True) if a != b][:3] == [b for a, b in zip(got, want, strict=True) if a != b][:3]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
