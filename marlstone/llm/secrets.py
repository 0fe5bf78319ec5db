"""Operator 6, secret scans with structural confirmation.

Three base patterns (assign, access, hex) find their spans as given. Further
spans are reported only after a candidate's bytes were decoded and parsed:

- ``jwt``: three base64url parts; the first a JSON object with "alg", the
  second a JSON object, the signature of the length that the algorithm gives;
- ``der``: base64 (in PEM armour, bare, or bare in lines) or hex that is a whole DER private
  key: PKCS#1, SEC1, PKCS#8 plain or encrypted, every nested length exact;
- ``openssh``: base64 (bare or armoured) or hex of an openssh-key-v1 container whose
  nested lengths use up the bytes.

Line ends may be written as backslash n and backslash r, as they are in JSON. Keys whose armour says
that their body is encrypted as a whole can't be parsed and are not reported.
Spans are code points, end exclusive, of the whole match; armour is part of it.

Cases: null and empty texts have no spans. Texts of any length are scanned
whole; the patterns run in linear time. Rows that repeat are each kept. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KINDS = ("assign", "access", "hex", "jwt", "der", "openssh")
ROWS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

#: The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
LEAST_VALUE = 6
# A run of [A-Z0-9] holds one match from its first AKIA, and a run of [0-9a-f] is one match, so the least lengths can be part of the patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# Base64 of "{" and what may follow it in JSON: a quote or white space.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?:ey[ABIJ]|ew[0ko])[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BREAK = r"(?:\r?\n|\\r\\n|\\n)"
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]++|\\[nr])++)-----END \1-----")
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/]{{39,}}(?:{BREAK}[A-Za-z0-9+/]++)++={{0,2}}")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Za-z])")
#: PBES2 and others of PKCS#5, and the schemes of PKCS#12, as DER object ids begin.
PASSWORD_BASED = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")

#: Bytes of a signature by algorithm; None: any length.
SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": None, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None, "none": 0}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def decoded(text: str) -> bytes | None:
    """The bytes of base64 or base64url with or without padding; None if it is neither."""
    plain = re.sub(r"\s|\\[nr]", "", text).rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill data exactly, by DER's rules on lengths; None if they don't."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80 or size >> 8 * (n - 1) == 0:
                return None
        if tag & 0x1F == 0x1F or at + size > len(data):
            return None
        found.append((tag, data[at : at + size]))
        at += size
    return found


def is_der_key(data: bytes, nested: bool = True) -> bool:
    """A whole DER private key: PKCS#1 RSA, SEC1 EC, or PKCS#8 around either or around a raw key or an encrypted one."""
    outer = items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    parts = items(outer[0][1])
    if parts and nested and [t for t, _ in parts] == [0x30, 4]:
        algorithm = items(parts[0][1])
        return bool(algorithm) and algorithm[0][0] == 6 and algorithm[0][1].startswith(PASSWORD_BASED) and len(parts[1][1]) >= 16
    if not parts or parts[0][0] != 2 or parts[0][1] not in (b"\0", b"\1"):
        return False
    tags = [t for t, _ in parts]
    if len(parts) >= 9 and tags[:9] == [2] * 9:
        return all(0 < len(x) and x[0] < 0x80 for _, x in parts[1:9])
    if parts[0][1] == b"\1" and len(parts) >= 2 and tags[1] == 4 and set(tags[2:]) <= {0xA0, 0xA1}:
        return 16 <= len(parts[1][1]) <= 66 and all(items(x) is not None for _, x in parts[2:])
    if nested and len(parts) >= 3 and tags[1:3] == [0x30, 4]:
        algorithm = items(parts[1][1])
        if not algorithm or algorithm[0][0] != 6:
            return False
        inner = parts[2][1]
        raw = items(inner)
        return is_der_key(inner, False) or bool(raw) and len(raw) == 1 and raw[0][0] in (2, 4) and len(raw[0][1]) >= 16
    return False


def is_openssh_key(data: bytes) -> bool:
    """An openssh-key-v1 container: cipher, kdf and options, then as many public keys as it says and the private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= n <= 16 and all(field() for _ in range(n)) and bool(field()) and at == len(data)


def is_token(text: str) -> bool:
    """A signed token: header and claims are JSON objects, and the signature has the algorithm's length."""
    head, claims, signature = text.split(".")
    try:
        known = [json.loads(decoded(x) or b"") for x in (head, claims)]
    except (ValueError, RecursionError):
        return False
    alg = known[0].get("alg") if all(isinstance(x, dict) for x in known) else None
    if not isinstance(alg, str) or alg not in SIGNED:
        return False
    data, need = decoded(signature) if signature else b"", SIGNED[alg]
    return data is not None and (len(data) == need if need is not None else len(data) >= 64)


def _kind(data: bytes | None) -> int | None:
    if not data:
        return None
    return 4 if is_der_key(data) else 5 if is_openssh_key(data) else None


def lines_of_key(text: str) -> int | None:
    """Where a DER key in base64 lines ends within text, whose first line it begins with; None if it isn't one.

    The outer length tells how many signs belong to it; they must end with a line.
    """
    head = decoded(text[:8])
    if not head or head[:1] != b"\x30" or len(head) < 6:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4:
        return None
    size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    left = -(-size * 4 // 3)
    for m in re.finditer("[A-Za-z0-9+/]+|" + BREAK, text):
        left -= len(m[0]) if m[0][0] not in "\r\n\\" else 0
        if left <= 0:
            end = m.end()
            while text[end : end + 1] == "=" and end - m.end() < 2:
                end += 1
            return end if left == 0 and is_der_key(decoded(text[:end]) or b"") else None
    return None


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what decodes and parses."""
    found: list[tuple[int, int, int]] = []
    if "." in text:
        found += [(m.start(), 3, m.end()) for m in JWT.finditer(text) if is_token(m[0])]
    taken: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            if (kind := _kind(decoded(m[2]))) is not None:
                found.append((m.start(), kind, m.end()))
                taken.append(m.span())
    for m in LINES.finditer(text):
        if not any(a <= m.start() < b for a, b in taken) and (end := lines_of_key(m[0])) is not None:
            found.append((m.start(), 4, m.start() + end))
            taken.append((m.start(), m.start() + end))
    for pattern, bytes_of in ((BARE, decoded), (LONG_HEX, lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            # "MII", "MC", "MH", "b3Bl", "30": how DER sequences and the OpenSSH magic begin
            if m[0][:1] in "Mb36" and not any(a <= m.start() < b for a, b in taken) and (kind := _kind(bytes_of(m[0]))) is not None:
                found.append((m.start(), kind, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256 and all spans of a text."""
    base = base_spans(text) if text else []
    kinds = [kind for _, kind, _ in base]
    own = joined(base)
    spans = sorted(set(base) | set(confirmed_spans(text))) if text else []
    return kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(own.encode()).hexdigest(), joined(spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text). No shuffle: each batch is scanned where it was read."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *scan(text.as_py())) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ROWS)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(shared.table(spark, sf_dir, "documents"))
