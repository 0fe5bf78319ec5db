"""Operator 4, document fingerprints by content-defined chunking.

A gear hash runs over a text's UTF-8 bytes: the sum of the last 16 bytes' table
values, each doubled for every byte since, in 16 bits. It depends on those bytes
alone, so numpy gets it for all positions in four doublings, for many texts at once. A
chunk ends where the hash has enough high bits of 0: more of them before the
normal size, fewer after it (normalised chunking), never before LEAST bytes
and at MOST at the latest.

A fingerprint is the sorted set of a text's chunk digests with their lengths, 48
and 12 bits each, in hex. An insertion shifts no boundary but those near it. Likeness is
containment weighted by length: the bytes of shared chunks over the bytes of the smaller set.

Neighbours by ascending doc_id come from one range shuffle. Its bounds are
quantiles of doc_id; the rows at a bound go to the range before it as well, so that
a range knows the text that follows it.

Cases: null and empty texts have an empty fingerprint; two empty ones are alike by 1, an
empty and another by 0. Rows that repeat a doc_id are ordered by their text; a null doc_id comes first. Other
columns are ignored; an empty table gives no rows; a sole document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST, NORMAL, MOST = 16, 48, 256
EARLY, LATE = np.uint16(0x7E00), np.uint16(0x1E00)
GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear%d" % k).digest()[:8] for k in range(256)), "<u8")
SPREAD = np.frombuffer(b"".join(hashlib.sha256(b"chunk%d" % k).digest()[:8] for k in range(256)), "<u8")
BASE = 0x9E3779B97F4A7C15
BATCH = 1 << 21
ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Powers of BASE modulo 2 ** 64, for each place in the longest chunk.
POWERS = np.cumprod(np.array([1] + [BASE] * MOST, "u8"), dtype="u8")


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum over the last 16 bytes of their table values times 2 to the power of their age."""
    h = GEAR.astype("u2")[data]
    for k in (1, 2, 4, 8):
        older = h[:-k] << np.uint16(k)
        h = h.copy()
        h[k:] += older
    return h


def boundaries(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends within each data[start:stop], flat, and how many each has.

    The hash is not reset at a text's start: a boundary lies at least LEAST bytes
    in, and texts are set apart by 16 zero bytes, so it sees no other text.
    """
    h = gear(data)
    loose = np.flatnonzero((h & LATE) == 0)
    strict = ((h[loose] & EARLY) == 0).tolist()
    loose_at = loose.tolist()
    first = np.searchsorted(loose, starts).tolist()
    out: list[int] = []
    counts = []
    n_loose = len(loose_at)
    for start, stop, k in zip(starts.tolist(), stops.tolist(), first, strict=True):
        before = len(out)
        while start < stop:
            normal, end = start + NORMAL, min(start + MOST, stop)
            low = start + LEAST - 1
            while k < n_loose and loose_at[k] < low:
                k += 1
            while k < n_loose and (at := loose_at[k]) < end - 1:
                if strict[k] or at >= normal:
                    end = at + 1
                    break
                k += 1
            out.append(end)
            start = end
        counts.append(len(out) - before)
    return np.array(out, "i8"), np.array(counts, "i8")


def digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 48-bit digest of each chunk: a polynomial of its bytes' table values, mixed with its length."""
    sizes = ends - begins
    place = np.repeat(ends, sizes) - 1 - _ramp(begins, sizes)
    terms = SPREAD[data[_ramp(begins, sizes)]] * POWERS[place]
    h = np.add.reduceat(terms, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, "u8")
    h = h ^ (sizes.astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(16)


def _ramp(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ..., for each chunk in turn."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its chunks as sorted, distinct numbers: a digest's 48 bits above a length's 12."""
    out: list[np.ndarray] = []
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < BATCH):
            size += len(texts[high]) + 16
            high += 1
        out += _fingerprints(texts[low:high])
        low = high
    return out


def _fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    gap = bytes(16)
    data = np.frombuffer(gap + gap.join(texts) + gap, "u1")
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    starts = np.cumsum(sizes + 16) - sizes
    ends, counts = boundaries(data, starts, starts + sizes)
    begins = np.concatenate(([0], ends[:-1]))
    heads = np.cumsum(counts) - counts
    some = counts > 0
    begins[heads[some]] = starts[some]
    begins = begins[: len(ends)]
    codes = digests(data, begins, ends) << np.uint64(12) | (ends - begins).astype("u8")
    return [np.unique(codes[a : a + n]) for a, n in zip(heads.tolist(), counts.tolist(), strict=True)]


def shown(print_: np.ndarray) -> str:
    """15 hex digits for each chunk."""
    if not len(print_):
        return ""
    return "".join([f"{x:015x}" for x in print_.tolist()])


def parsed(text: str) -> np.ndarray:
    return np.array([int(text[k : k + 15], 16) for k in range(0, len(text), 15)], "u8")


def weight(print_: np.ndarray) -> int:
    return int((print_ & np.uint64(0xFFF)).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bytes of shared chunks over those of the smaller set, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return weight(a[b[at] == a]) / min(weight(a), weight(b))


def edited(text: str, following: str) -> str:
    """text with its last quarter's code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def ranked(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """docs with pid, how many of the sorted bounds are at most doc_id: 16-fold search, so the cost grows with log(bounds)."""
    docs = docs.withColumn("pid", F.lit(0))
    step = 1
    while step * 16 <= len(bounds):
        step *= 16
    table, turns = F.lit(bounds) if bounds else F.array().cast("array<bigint>"), F.lit(list(range(1, 17)))
    while step >= 1:
        each = F.lit(step)
        more = F.size(F.filter(turns, lambda k: F.coalesce(F.get(table, F.col("pid") + k * each - 1) <= F.col("doc_id"), F.lit(False))))  # noqa: B023
        docs = docs.withColumn("pid", F.col("pid") + more * F.lit(step))
        step //= 16
    return docs


def ranged(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with pid, their range by doc_id, and tail, above 0 for rows that only follow the range; and the last pid.

    Bounds are approximate quantiles, which are values that occur: the rows at
    a bound are the next range's first. The driver sees `parts` numbers. A null doc_id is before all bounds.
    """
    shares = [k / parts for k in range(1, parts)] or [0.5]
    seen = docs.select(F.percentile_approx("doc_id", shares, 10_000).alias("q"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("null")).first()
    least, null = seen["least"], bool(seen["null"])
    bounds = sorted({q for q in seen["q"] or [] if null or q > least}) if parts > 1 else []
    first = F.col("doc_id").isNull() if null else F.col("doc_id") == F.lit(least).cast("long")
    at_bound = F.get(F.lit(bounds), F.col("pid") - 1) == F.col("doc_id") if bounds else F.lit(False)
    copies = F.array(
        F.struct(F.col("pid"), F.lit(0).alias("tail")),
        F.when(at_bound, F.struct((F.col("pid") - 1).alias("pid"), F.lit(1).alias("tail"))),
        F.when(first, F.struct(F.lit(len(bounds)).alias("pid"), F.lit(2).alias("tail"))),
    )
    spread = ranked(docs, bounds).withColumn("to", F.explode(F.filter(copies, lambda x: x.isNotNull())))
    return spread.select("doc_id", "text", "to.pid", "to.tail"), len(bounds)


def compared(docs: DataFrame) -> DataFrame:
    """The rows of ROWS for docs (doc_id, text)."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spread, last = ranged(plain, shared.partitions(spark))
    # Within a range: its rows, then what follows it; in the last range the very first document follows.
    sorted_ = spread.repartitionById(last + 1, "pid").sortWithinPartitions("pid", "tail", "doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (doc_id, text) that wait for the one after
        current, over = None, False
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                ids, texts, pids, tails = (c.to_pylist() for c in batch.slice(low, 256).columns)
                for doc_id, text, pid, tail in zip(ids, texts, pids, tails, strict=True):
                    if pid != current:  # a task may hold more than one range
                        current, over, held = pid, False, []
                    if over:
                        continue
                    held.append((doc_id, text))
                    if tail:
                        yield _compared(held)
                        over, held = True, []
                if len(held) > 1:
                    yield _compared(held)
                    held = held[-1:]

    return sorted_.mapInArrow(work, ROWS)


def _compared(held: list[tuple]) -> pa.RecordBatch:
    """Rows of all but the last of held."""
    texts = [t for _, t in held]
    changed = [edited(a, b) for a, b in pairwise(texts)]
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    changed_data = [t.encode("utf-8", "surrogatepass") for t in changed]
    prints = fingerprints([*data, *changed_data])
    own, new = prints[: len(data)], prints[len(data) :]
    rows = {
        "doc_id": pa.array([i for i, _ in held[:-1]], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in changed_data],
        "fingerprint": [shown(p) for p in own[:-1]],
        "edited_fingerprint": [shown(p) for p in new],
        "near_edited": pa.array([likeness(a, b) for a, b in zip(own, new, strict=False)], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in pairwise(own)], pa.float64()),
    }
    return pa.RecordBatch.from_pydict(rows)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(shared.table(spark, sf_dir, "documents"))
