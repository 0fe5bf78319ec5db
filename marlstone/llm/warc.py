"""Operator 2, WARC: one-stream gzip archives normalised to a gzip member for each record, with an offset index.

``normalise`` inflates an archive once, as a stream and whatever its members,
and rewrites every record as a member of its own. The sidecar index has a line
for each record: id, type, offset, compressed and inflated length, tab
separated. With it, ``read_record`` seeks to any record.

Cases: a null or empty html has an empty payload, a response. Rows that repeat
the smallest page_id of a group of equal payloads are all responses. A null
page_id is written as an empty id; it never leads a group unless all ids of the group are
null, and then the group's rows are responses. Other columns are ignored. An
empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST = 100
ROLL = 128 << 20
CHUNK = 1 << 20
FILES = "path string, n_records long, n_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long, archive string"


def mark_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, and refers_to for records that repeat an earlier payload.

    Heads of groups come from a partial aggregate of (digest, page_id); only
    groups of more than one row are joined back, so a hot payload is one
    narrow row on the one side and splits freely on the other.
    """
    made = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        (F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    heads = (
        made.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "head")
    )
    joined = made.join(heads, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("head") != F.col("page_id"), F.col("head")).when(F.col("page_id").isNull(), F.col("head")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 record. A revisit holds the HTTP headers alone."""
    name = "" if page_id is None else page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {re.sub(r'[\s\x00-\x1f]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Header fields with lower-case names; a folded line continues the one before."""
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            fields[last] = value.strip()
    return fields


def inflate(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or more members, in chunks; ValueError if it ends within a member."""
    member, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            begun = True
            if made := member.decompress(data, 4 * CHUNK):
                yield made
            if member.eof:
                data, member, begun = member.unused_data, zlib.decompressobj(31), False
            else:
                data = member.unconsumed_tail
        while not member.eof and (made := member.decompress(b"", 4 * CHUNK)):
            yield made
        if member.eof:
            member, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends within a gzip member")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of inflated WARC bytes, one at a time in memory."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            while held.startswith(b"\r\n", at):
                at += 2
            cut = held.find(b"\r\n\r\n", at)
            if cut < 0:
                break
            head = bytes(held[at:cut])
            if not head.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            length = int(headers(head)["content-length"])
            if len(held) < cut + 4 + length:
                break
            yield head + b"\r\n\r\n" + bytes(held[cut + 4 : cut + 4 + length]) + b"\r\n\r\n"
            at = cut + 4 + length
        del held[:at]
    if bytes(held).strip(b"\r\n"):
        raise ValueError("the archive ends within a record")


def normalise(source, target, index, level: int = 3) -> tuple[int, int]:
    """Rewrite source's records as gzip members of target; index gets a line for each. Returns records and bytes written."""
    at = n = 0
    for whole in records(inflate(source)):
        fields = headers(whole[: whole.find(b"\r\n\r\n")])
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = packer.compress(whole) + packer.flush()
        target.write(member)
        index.write(f"{fields.get('warc-record-id', '')}\t{fields.get('warc-type', '')}\t{at}\t{len(member)}\t{len(whole)}\n".encode())
        at, n = at + len(member), n + 1
    return n, at


def read_record(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record whose member is at offset."""
    file.seek(offset)
    whole = zlib.decompress(file.read(length), 31)
    head, _, block = whole.partition(b"\r\n\r\n")
    fields = headers(head)
    return fields, block[: int(fields["content-length"])]


def _number(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def described(fields: dict[str, str], block: bytes) -> dict:
    """A page's row from its record; a response's digest and length are those of the bytes read."""
    http, _, body = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response":
        size, digest = len(body), hashlib.sha256(body).hexdigest()
        if f"sha256:{digest}" != fields["warc-payload-digest"]:
            raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
    else:
        size, digest = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
    return {"page_id": _number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": _number(fields.get("warc-refers-to", ""))}


def write_streams(marked: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write mark_revisits' rows as archives that are one gzip stream each, rolled by inflated size; a row for each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, k, out = f"{folder}/{shared.attempt_name()}", 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{name}-{k}.warc.gz"
                    out, packer, size, n, wrote = shared.open_output(path), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0, 0
                data = record(*row)
                wrote += out.write(packed) if (packed := packer.compress(data)) else 0
                size, n = size + len(data), n + 1
                if size >= ROLL:
                    wrote += out.write(packer.flush())
                    out.close()
                    yield _file(path, n, wrote)
                    out, k = None, k + 1
        if out is not None:
            wrote += out.write(packer.flush())
            out.close()
            yield _file(path, n, wrote)

    return shared.written(marked.mapInArrow(write, FILES), "warc-streams", keep=True)


def _file(path: str, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})


def _each(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The files' paths, one to a task. The driver sees a path for each archive."""
    paths = [(k, r["path"]) for k, r in enumerate(files.select("path").orderBy("path").collect())]
    return spark.createDataFrame(paths, "n int, path string").repartitionById(max(1, len(paths)), "n").select("path")


def normalise_files(spark: SparkSession, files: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Normalise every archive of `files` (path) into folder, an archive and an index for each; a row for each archive."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, k = f"{folder}/{shared.attempt_name()}", 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                made = f"{name}-{k}.warc.gz"
                with shared.open_input(path) as source, shared.open_output(made) as target, shared.open_output(f"{made}.idx") as index:
                    n, size = normalise(source, target, index, level)
                k += 1
                yield _file(made, n, size)

    return shared.written(_each(spark, files).mapInArrow(work, FILES), "warc-members", keep=True)


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Every record of normalised archives, found through their indexes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in ROWS.split(", "))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with shared.open_input(f"{path}.idx") as f:
                    lines = f.read().decode().splitlines()
                with shared.open_input(path) as f:
                    for line in lines:
                        offset, length = map(int, line.split("\t")[2:4])
                        rows.append(described(*read_record(f, offset, length)) | {"offset": offset, "length": length, "archive": path})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return _each(spark, files).mapInArrow(work, ROWS)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages as archives, normalise those, and read them back."""
    spark = pages.sparkSession
    streams = write_streams(mark_revisits(pages, least), shared.new_folder(spark, "warc-raw"))
    members = normalise_files(spark, streams, shared.new_folder(spark, "warc"))
    return read_files(spark, members)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived(shared.table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > head THEN head END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head
      FROM pages)
"""
