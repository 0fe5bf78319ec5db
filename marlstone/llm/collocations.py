"""Operator 11, phrase collocations: n-grams counted level by level with hashed buckets, then scored by their weakest cut.

Pass k reads all texts and counts the k-grams that may be frequent, exactly.
While it does, it also counts (k+1)-grams by the bucket of their hash. Two
bitmaps go to the next pass: buckets that reach the threshold, and the hashes
of the k-grams that did (Apriori: both k-grams of a (k+1)-gram must be
frequent). Only (k+1)-grams whose two k-grams passed the filters enter a
bucket. The filters let too much through when they fill, never too little;
what passes is counted by its words.

Bucket counts stop at the threshold, in a task and when tasks are added up, so
a byte is enough below 256. A bitmap has 2**bits bits whatever the corpus; it
is all that is broadcast. From some hundred n-grams a bucket on, only Apriori
prunes; set `bits` higher for larger corpora.

Candidates stay tables. Their parts' counts are looked up with hot parts dealt
over tasks; the first rows of a language are found in TURNS heats and a final.

Cases: null and empty texts have no words; a null lang is `und`. Rows count
once each, repeated ones too. Other columns are ignored. An empty table, or one
without frequent phrases, gives no rows. Texts are read whole; a task holds
CHUNK bytes of texts and one text. Ties in score and count are ordered by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

LONGEST = 5
LEAST = 100
COVERED = 100
FIRST = 2000
BITS = 26
SEGMENT = 16
CHUNK = 8 << 20
TURNS = 64
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
COUNTED = "lang string, phrase string, n long, hash long, segment int, buckets binary"

_LOWER = bytes(range(256)).lower()
_KIND = bytes(1 if c in BLANKS else 2 if c in BREAKS else 0 for c in range(256))


class Words:
    """The words of some texts: their codes, whether each follows the one before within a piece, and their language."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        import xxhash

        langs = langs.fill_null("und").dictionary_encode()
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], "i8", len(texts) + 1, 8 * texts.offset)
        whole = bytes(memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]]) if offsets[-1] > offsets[0] else b""
        raw, kind = np.frombuffer(whole, "u1"), np.frombuffer(whole.translate(_KIND), "u1")
        begins = offsets[:-1] - offsets[0]
        inside = kind == 0
        edge = np.ones(len(raw) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[begins] = True
        starts = np.flatnonzero(edge[:-1] & inside)
        ends = np.flatnonzero(edge[1:] & inside) + 1
        lengths = np.concatenate(([0], np.cumsum(ends - starts)))
        data = raw[inside].tobytes().translate(_LOWER)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths.astype("i8")), pa.py_buffer(data)]).dictionary_encode()
        self.n = len(starts)
        self.codes = words.indices.to_numpy(zero_copy_only=False).astype("i8")
        self.dictionary = words.dictionary.to_pylist()
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.dictionary), "u8", len(self.dictionary))
        # The first word after a break, or of a text, follows none.
        self.follows = np.ones(self.n + 1, bool)
        self.follows[np.searchsorted(starts, np.flatnonzero(kind == 2))] = False
        first = np.searchsorted(starts, begins)
        self.follows[first] = False
        self.follows = self.follows[:-1]
        text = np.repeat(np.arange(len(begins)), np.diff(first, append=self.n))
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype("i8")[text] if self.n else np.zeros(0, "i8")
        self.seeds = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs], "u8")

    def grams(self, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: the hash of the n-gram at each position, and whether there is one within its piece."""
        hashed = (self.seeds[self.lang] if self.n else np.zeros(0, "u8")) ^ self.hashes[self.codes] if self.n else np.zeros(0, "u8")
        out = [(_mixed(hashed), np.ones(self.n, bool))]
        own = self.hashes[self.codes] if self.n else np.zeros(0, "u8")
        for k in range(1, longest):
            before, there = out[-1]
            m = max(0, self.n - k)
            out.append((_mixed(before[:m] * np.uint64(0x9E3779B97F4A7C15) + own[k:]), there[:m] & self.follows[k:]))
        return out

    def counted(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the distinct k-grams among those at `at`, by their words, and how often each is there."""
        same, size = self.lang[at], max(1, len(self.dictionary))
        first, n = np.zeros(0, "i8"), np.zeros(0, "i8")
        for j in range(k):
            _, first, same, n = np.unique(same * size + self.codes[at + j], return_index=True, return_inverse=True, return_counts=True)
        return at[first], n

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join([self.dictionary[c] for c in self.codes[at : at + k].tolist()])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1")) & np.uint8(1) > 0


class Buckets:
    """Counts by bucket that stop at `most`."""

    def __init__(self, bits: int, most: int):
        self.shift, self.most = np.uint64(64 - bits), most
        self.dtype = np.dtype("u1" if most < 256 else "<u2" if most < 65536 else "<u4")
        self.segment = min(SEGMENT, bits)
        self.counts = np.zeros(1 << bits, self.dtype)

    def add(self, hashed: np.ndarray) -> None:
        at, n = np.unique((hashed >> self.shift).astype("u4"), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + np.minimum(n, self.most), self.most).astype(self.dtype)

    def segments(self) -> Iterator[tuple[int, bytes]]:
        """Those with a count, dense (0) or as positions and counts (1)."""
        for k, own in enumerate(self.counts.reshape(-1, 1 << self.segment)):
            at = np.flatnonzero(own)
            if len(at) * (2 + self.dtype.itemsize) >= own.nbytes:
                yield k, b"\0" + own.tobytes()
            elif len(at):
                yield k, b"\1" + at.astype("<u2").tobytes() + own[at].tobytes()

    def unpacked(self, data: bytes) -> np.ndarray:
        if data[0] == 0:
            return np.frombuffer(data, self.dtype, offset=1)
        n = (len(data) - 1) // (2 + self.dtype.itemsize)
        out = np.zeros(1 << self.segment, self.dtype)
        out[np.frombuffer(data, "<u2", n, 1)] = np.frombuffer(data, self.dtype, n, 1 + 2 * n)
        return out


def _bitmap(rows: DataFrame, bits: int, most: int) -> np.ndarray:
    """Buckets whose counts add up to `most`, as 2**bits bits. A task adds up whole segments; the driver sees a bit a bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Buckets(min(bits, SEGMENT), most)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = own.unpacked(data).astype("i8")
                if k in sums:
                    counts += sums[k]
                sums[k] = np.minimum(counts, most).astype(own.dtype)
        found = {k: np.packbits(x >= most, bitorder="little") for k, x in sums.items()}
        found = {k: x.tobytes() for k, x in found.items() if x.any()}
        yield pa.RecordBatch.from_pydict({"segment": pa.array(found, pa.int32()), "bits": pa.array(found.values(), pa.binary())})

    bitmap = np.zeros((1 << bits) // 8, "u1")
    size = (1 << min(bits, SEGMENT)) // 8
    for k, data in rows.repartition("segment").mapInArrow(add, "segment int, bits binary").collect():
        bitmap[k * size : (k + 1) * size] = np.frombuffer(data, "u1")
    return bitmap


def _reached(frequent: DataFrame, bits: int) -> np.ndarray:
    """The hashes of frequent n-grams, as 2**bits bits."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Buckets(bits, 1)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).astype("i8").view("u8"))
        yield from _packed(own)

    return _bitmap(frequent.select("hash").mapInArrow(mark, "segment int, buckets binary"), bits, 1)


def _packed(buckets: Buckets) -> Iterator[pa.RecordBatch]:
    ks, data = [], []
    for k, x in buckets.segments():
        ks.append(k)
        data.append(x)
        if len(ks) == 64:
            yield pa.RecordBatch.from_pydict({"segment": pa.array(ks, pa.int32()), "buckets": pa.array(data, pa.binary())})
            ks, data = [], []
    yield pa.RecordBatch.from_pydict({"segment": pa.array(ks, pa.int32()), "buckets": pa.array(data, pa.binary())})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    held: list[pa.RecordBatch] = []
    size = 0

    def words() -> Words:
        table = pa.Table.from_batches(held).combine_chunks()
        return Words(*(c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in table.columns))

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            room = CHUNK - size + (int(sizes[low - 1]) if low else 0)
            high = max(low + 1, int(np.searchsorted(sizes, room, "right")))
            held.append(batch.slice(low, high - low))
            size += int(sizes[high - 1]) - (int(sizes[low - 1]) if low else 0)
            low = high
            if size >= CHUNK or low < batch.num_rows:
                yield words()
                held, size = [], 0
    if held:
        yield words()


def counts(docs: DataFrame, k: int, last: bool, least: int, bits: int, near: np.ndarray | None, frequent: np.ndarray | None) -> DataFrame:
    """Pass k over docs (lang, text). Rows with a phrase hold counts of k-grams, one without (k = 1) all words of a language, the others bucket counts of (k+1)-grams."""
    spark = docs.sparkSession
    filters = None if k == 1 else spark.sparkContext.broadcast((near, frequent))
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = None if last else Buckets(bits, least)
        for words in _chunks(batches):
            grams = words.grams(k if last else k + 1)
            hashed, there = grams[k - 1]
            if k > 1:
                buckets_of, grams_of = filters.value
                known = _set(grams_of, grams[k - 2][0] >> shift)
                there = there & known[: len(there)] & known[1 : len(there) + 1]
                at = np.flatnonzero(there)
                at = at[_set(buckets_of, hashed[at] >> shift)]
                there = np.zeros(len(there), bool)
                there[at] = True
            else:
                at = np.arange(words.n)
            first, n = words.counted(at, k)
            langs = [words.langs[x] for x in words.lang[first].tolist()]
            phrases = [words.phrase(x, k) for x in first.tolist()]
            totals = np.bincount(words.lang, minlength=len(words.langs)) if k == 1 else np.zeros(0, "i8")
            of = pa.array([*langs, *(words.langs if k == 1 else ())], pa.string())
            yield pa.RecordBatch.from_arrays([
                of, pa.array([*phrases, *[None] * len(totals)], pa.binary()).cast(pa.string()), pa.array(np.concatenate((n, totals)).astype("i8")),
                pa.array(np.concatenate((hashed[first].view("i8"), np.zeros(len(totals), "i8")))), pa.nulls(len(of), pa.int32()), pa.nulls(len(of), pa.binary()),
            ], ["lang", "phrase", "n", "hash", "segment", "buckets"])
            if buckets is not None:
                following, whole = grams[k]
                whole = whole & there[: len(whole)] & there[1 : len(whole) + 1]
                buckets.add(following[whole])
        if buckets is not None:
            for batch in _packed(buckets):
                m = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *batch.columns], ["lang", "phrase", "n", "hash", "segment", "buckets"])

    found = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, COUNTED)
    return shared.written(found, f"grams-{k}")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, n of all words) and (lang, phrase, k, f) of all phrases of up to `longest` words with f >= least."""
    shared.modest_batches(docs.sparkSession)
    near = known = sizes = None
    levels = []
    for k in range(1, longest + 1):
        raw = counts(docs, k, k == longest, least, bits, near, known)
        summed = raw.where("segment IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("hash").alias("hash"))
        level = shared.written(summed.where((F.col("f") >= least) | F.col("phrase").isNull()), f"frequent-{k}")
        if k == 1:
            sizes = level.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
            level = level.where("phrase IS NOT NULL")
        levels.append(level.select("lang", "phrase", F.lit(k).alias("k"), "f"))
        if k == longest or level.isEmpty():
            break
        near, known = _bitmap(raw.where("segment IS NOT NULL").select("segment", "buckets"), bits, least), _reached(level, bits)
        if not near.any():
            break
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return sizes, whole


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """The best `first` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer candidate holds it and has at least `covered` percent of its occurrences.
    """
    with shared.scratch(docs.sparkSession) as kept:
        sizes, whole = frequent_phrases(docs, longest, least, bits)
        words = F.split("phrase", " ")
        candidates = whole.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))

        # Every shorter phrase inside a candidate, with the most occurrences of one that holds it.
        spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(w, s, m), ' '))))")
        inside = candidates.where("k > 2").withColumn("w", words).select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
        holders = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        left = candidates.join(holders, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(covered) * F.col("a")))

        # Two parts for each cut, one lookup for all.
        cuts = F.expr("flatten(transform(sequence(1, k - 1), c -> array(struct(c AS cut, true AS is_first, array_join(slice(w, 1, c), ' ') AS part), struct(c AS cut, false AS is_first, array_join(slice(w, c + 1, k - c), ' ') AS part))))")
        parts = left.withColumn("w", words).select("lang", "phrase", "a", F.explode(cuts).alias("x")).select("lang", "phrase", "a", "x.*")
        parts = parts.withColumn("key", F.struct("lang", "part"))
        keyed = whole.select(F.struct("lang", F.col("phrase").alias("part")).alias("key"), "f")
        known = shared.looked_up(parts.select(F.to_json("key").alias("key"), "lang", "phrase", "a", "cut", "is_first"), keyed.select(F.to_json("key").alias("key"), "f"), "key", "phrase")
        both = known.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("is_first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_first"), F.col("f"))).alias("r"))
        sized = shared.looked_up(both, sizes, "lang", "phrase")
        scored = sized.withColumn("score", F.expr("(1000 * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
        weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "n", "x.l", "x.r", "x.score")

        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        heat = F.pmod(F.xxhash64("phrase"), F.lit(TURNS))
        heats = weakest.withColumn("heat", heat).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "heat").orderBy(*order))).where(F.col("rank") <= first)
        ranked = heats.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
        return kept(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(shared.table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM lists
), grams AS (
    SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase FROM starts, range(1, {LONGEST + 1}) AS ks(k) WHERE s + k - 1 <= len(w)
), f AS (
    SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), sizes AS (
    SELECT lang, count(*) AS n FROM starts GROUP BY lang
), candidates AS (
    SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), inside AS (
    SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS most
    FROM candidates, range(2, {LONGEST}) AS ms(m), range(1, {LONGEST}) AS ss(s) WHERE m < k AND s + m - 1 <= k GROUP BY ALL
), cuts AS (
    SELECT c.lang, c.phrase, a, p.f AS l, q.f AS r, n, cut, ((1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f))::BIGINT AS score
    FROM candidates AS c LEFT JOIN inside AS i ON i.lang = c.lang AND i.phrase = c.phrase
    JOIN sizes ON sizes.lang = c.lang, range(1, {LONGEST}) AS cs(cut), f AS p, f AS q
    WHERE (most IS NULL OR 100 * most < {COVERED} * a) AND cut < c.k AND p.lang = c.lang AND q.lang = c.lang
        AND p.phrase = array_to_string(w[1 : cut], ' ') AND q.phrase = array_to_string(w[cut + 1 : c.k], ' ')
), weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weakest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {FIRST}
"""
