import gzip
import hashlib
import io
import zlib

import duckdb
import pyarrow as pa
import pytest

from marlstone.llm import shared, warc


def digest(b):
    return hashlib.sha256(b).hexdigest()


def made(n):
    return [warc.record(k, f"http://x/{k}\n", b"p%d\r\n\r\n" % k * (k % 5), digest(b"p%d\r\n\r\n" % k * (k % 5)), None) for k in range(n)]


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_normalise_any_members(cut):
    recs = made(40)
    whole = b"".join(recs)
    source = b"".join(gzip.compress(whole[k : k + len(whole) // cut + 1]) for k in range(0, len(whole), len(whole) // cut + 1))
    target, index = io.BytesIO(), io.BytesIO()
    n, size = warc.normalise(io.BytesIO(source), target, index)
    assert (n, size) == (40, len(target.getvalue()))
    assert gzip.decompress(target.getvalue()) == whole
    for k, line in enumerate(index.getvalue().decode().splitlines()):
        urn, kind, offset, length, full = line.split("\t")
        fields, block = warc.read_record(io.BytesIO(target.getvalue()), int(offset), int(length))
        assert (urn, kind, int(full)) == (f"<urn:page:{k}>", "response", len(recs[k]))
        assert warc.described(fields, block)["payload_bytes"] == len(b"p%d\r\n\r\n" % k * (k % 5))


def test_truncated_archive_raises():
    source = gzip.compress(b"".join(made(3))[:-9])
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(source), io.BytesIO(), io.BytesIO())


def test_folded_header():
    assert warc.headers(b"WARC/1.0\r\nA: b\r\n c\r\nD:e") == {"a": "b c", "d": "e"}


def brute(rows):
    groups = {}
    for page_id, html in rows:
        if page_id is not None:
            groups.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, html in rows:
        body = (html or "").encode()
        head = min(groups.get(html or "", [None]))
        again = len(body) >= 100 and head is not None and head != page_id
        out.append((page_id, len(body), digest(body), "revisit" if again else "response", head if again else None))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 4000)
    big = "é" * 60
    rows = [(5, big), (3, big), (9, big), (3, big), (1, "x" * 99), (2, "x" * 99), (4, None), (6, ""), (7, "y" * 5000), (8, "a\r\n\r\nWARC/1.1\r\n" * 20), (None, big), (None, "z" * 100)]
    pages = spark.createDataFrame([(a, b, 1) for a, b in rows], "page_id long, html string, digest int")
    got = [tuple(r) for r in warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_files_are_member_per_record(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "h" * k) for k in range(50)], "page_id long, url string, html string")
    row = warc.archived(pages).where("page_id = 33").first()
    with shared.open_input(row["archive"]) as f:
        fields, block = warc.read_record(f, row["offset"], row["length"])
    assert fields["warc-target-uri"] == "u33" and block.endswith(b"\r\n\r\n" + b"h" * 33)


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(con.sql(warc.OP2_SQL).fetchall(), key=key)
    assert sorted((tuple(r) for r in warc.op2(spark, "/root/testdata/sf0.001").collect()), key=key) == want


def test_an_archive_cut_at_a_record_is_refused():
    """All records before the cut are whole, but the gzip member isn't."""
    whole = b"".join(warc.record(k, "u", b"x" * 50, "d", None) for k in range(3))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    flushed = packer.compress(whole) + packer.flush(zlib.Z_SYNC_FLUSH)
    assert b"".join(warc.inflate(io.BytesIO(flushed + packer.flush()))) == whole
    with pytest.raises(ValueError, match="within a gzip member"):
        list(warc.records(warc.inflate(io.BytesIO(flushed))))
    one = gzip.compress(whole)
    assert b"".join(warc.inflate(io.BytesIO(one + one))) == whole * 2
    with pytest.raises(ValueError, match="within a gzip member"):
        list(warc.inflate(io.BytesIO(one + one[:20])))
