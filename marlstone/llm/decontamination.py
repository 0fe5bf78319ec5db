"""Operator 8, benchmark decontamination with a generalised suffix automaton.

The automaton of all items' word sequences is built once; training texts are
streamed through it, tracking the longest suffix that occurs within an item.
Where that length reaches a window (WINDOW item words, or a whole item that is shorter)
the window's words are hit.

Before the automaton sees a text, runs of words are found whose neighbours
occur as neighbours in some item: vectorised lookups in a set of word pairs, with
no misses, only some runs too many. Only runs as long as the shortest window
are streamed. Items are taken in blocks of at most BLOCK words, each with
its own automaton and its own pass over the texts, one after another: driver and workers hold one
block at a time, and the spans of all blocks are merged before anything is counted or cut.

Words are runs of ASCII letters and digits and of everything above ASCII, after A-Z
are lower-cased.

Cases: null and empty texts have no words. Items without words have no window;
items that repeat an item_id count once; items with a null item_id hit, but are not
listed. Rows that repeat get equal rows; other columns are ignored; an empty table of documents
gives no rows, an empty table of items no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import shared

WINDOW = 10
BLOCK = 200_000
PAIR_BITS = 22

#: A-Z to a-z; other ASCII that isn't a letter or digit to blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
ROWS = "doc_id long, n_words long, hits array<int>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """A suffix automaton of several sequences: each state stands for substrings that end at the same places."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the substrings that end in p's followed by c."""
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:  # an earlier sequence holds this prefix already
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
                continue
            state, p = self._state(self.len[last] + 1, 0, {}), last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                self.link[state] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
            last = state

    def lengths(self, stream: list[int]) -> Iterator[tuple[int, int]]:
        """The state and the longest matching length after each symbol."""
        state = length = 0
        for c in stream:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            to = self.next[state].get(c)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield state, length


@dataclass
class Index:
    """What tasks need of one block of items."""

    vocabulary: dict[bytes, int]
    automaton: Automaton
    window_at: list[int]  # the state of the last `window` words, for states of at least that length
    items_at: dict[int, list[str | None]]  # items with the window that a state stands for
    short_at: dict[int, list[tuple[int, list[str | None]]]]  # whole short items that end at a state: length and ids
    pairs: np.ndarray
    least: int
    window: int


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + b.astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - PAIR_BITS)).astype("i8")


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Index | None:
    """An index of (item_id, text) rows; None if none has words."""
    vocabulary: dict[bytes, int] = {}
    sequences = []
    for item, text in items:
        if found := words(text):
            sequences.append((item, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]))
    if not sequences:
        return None
    automaton = Automaton()
    for _, s in sequences:
        automaton.add(s)
    n = len(automaton.len)
    window_at = [0] * n
    for state in sorted(range(n), key=automaton.len.__getitem__):
        if automaton.len[state] >= window:
            up = automaton.link[state]
            window_at[state] = window_at[up] if automaton.len[up] >= window else state
    items_at: dict[int, dict] = {}
    whole_at: dict[int, dict[int, dict]] = {}
    for item, s in sequences:
        for k, (state, length) in enumerate(automaton.lengths(s)):
            if length >= window:
                items_at.setdefault(window_at[state], {})[item] = None
            elif k == len(s) - 1:
                whole_at.setdefault(state, {}).setdefault(len(s), {})[item] = None
    short_at: dict[int, list] = {}
    if whole_at:
        for state in sorted(range(1, n), key=automaton.len.__getitem__):
            up = short_at.get(automaton.link[state], [])
            own = [(size, list(ids)) for size, ids in whole_at.get(state, {}).items()]
            if up or own:
                short_at[state] = up + own
    pairs = np.zeros(1 << PAIR_BITS, bool)
    for _, s in sequences:
        a = np.array(s)
        pairs[pair_slot(a[:-1], a[1:])] = True
    return Index(vocabulary, automaton, window_at, {k: list(v) for k, v in items_at.items()}, short_at, pairs, min(window, min(len(s) for _, s in sequences)), window)


def match(index: Index, codes: np.ndarray) -> tuple[list[tuple[int, int]], set]:
    """Hit ranges of word positions, in order and merged, and the items whose windows occur."""
    if len(codes) < index.least:
        return [], set()
    if index.least > 1:
        a, b = codes[:-1], codes[1:]
        ok = (a > 0) & (b > 0)
        ok[ok] = index.pairs[pair_slot(a[ok], b[ok])]
        need = index.least - 1
    else:
        ok, need = codes > 0, 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view("i1"), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= need
    ranges: list[tuple[int, int]] = []
    items: set = set()

    def hit(start: int, end: int) -> None:
        while ranges and ranges[-1][1] >= start:
            low, high = ranges.pop()
            start, end = min(start, low), max(end, high)
        ranges.append((start, end))

    for start, end in zip(starts[long].tolist(), (ends[long] + (index.least > 1)).tolist(), strict=True):
        for k, (state, length) in enumerate(index.automaton.lengths(codes[start:end].tolist()), start + 1):
            if length >= index.window:
                hit(k - index.window, k)
                items.update(index.items_at[index.window_at[state]])
            for size, ids in index.short_at.get(state, ()):
                if size <= length:
                    hit(k - size, k)
                    items.update(ids)
    return ranges, items


def coded(index: Index, found: list[bytes]) -> np.ndarray:
    """Numbers of words, 0 for those that no item has."""
    get = index.vocabulary.get
    return np.fromiter((get(w, 0) for w in found), "i8", len(found))


def indexes(items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> Iterator[Index]:
    """An index for each block of items, ordered by id and text; a block holds `block` words, or one item of more.

    Items come to the driver one partition at a time.
    """
    waiting: list[tuple[str | None, str | None]] = []
    size = 0
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        n = len(words(text))
        if waiting and size + n > block:
            if size:
                yield build(waiting, window)
            waiting, size = [], 0
        waiting.append((item, text))
        size += n
    if size:
        yield build(waiting, window)


def found_in(docs: DataFrame, index: Index | None, key: str) -> DataFrame:
    """key, doc_id, n_words, hits (start and end by turns) and items of docs (key, doc_id, text) for one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # at most BLOCK words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            counts, hits, items = [], [], []
            for text in batch.column(2):
                own = words(text.as_py())
                ranges, names = match(index, coded(index, own)) if index else ([], set())
                counts.append(len(own))
                hits.append([x for r in ranges for x in r])
                items.append(sorted(x for x in names if x is not None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [key, "doc_id", "n_words", "hits", "items"])

    return docs.select(F.col(key).cast("string").alias(key), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, f"{key} string, {ROWS}")


def merged(hits: list[int]) -> list[tuple[int, int]]:
    """Sorted, merged ranges from starts and ends by turns."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(zip(hits[::2], hits[1::2], strict=True)):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def in_blocks(docs: DataFrame, items: DataFrame, window: int, block: int, key: str) -> tuple[DataFrame, DataFrame | Index | None]:
    """Where one block holds all items: docs and its index (None without items). Else docs written with a row key, and (key, hits, items) of rows that are hit.

    Each block's hits are written before the block after the next is built.
    """
    shared.modest_batches(docs.sparkSession)
    blocks = indexes(items, window, block)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return docs, first
    keyed = shared.written(docs.withColumn(key, F.expr("uuid()")), "benchmark-docs")
    made = [shared.written(found_in(keyed, b, key).where(F.size("hits") > 0).select(key, "hits", "items"), "benchmark-hits") for b in chain((first, second), blocks)]
    hits = reduce(DataFrame.unionByName, made)
    return keyed, hits.groupBy(key).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def found(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and spans of each row of docs (doc_id, text).

    With one block of items no rows are shuffled. With more, each block's pass
    gives rows that hit, joined by a row key that is written with the documents once.
    """
    keyed, hits = in_blocks(docs.select("doc_id", "text"), items, window, block, "row")
    if isinstance(hits, DataFrame):
        none = F.array().cast("array<string>")
        parts = found_in(keyed, None, "row").drop("hits", "items").join(hits, "row", "left")
        parts = parts.withColumns({"hits": F.coalesce("hits", none.cast("array<int>")), "items": F.coalesce("items", none)})
    else:
        parts = found_in(docs.withColumn("row", F.lit("")), hits, "row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(h) for h in batch.column(2).to_pylist()]
            names = [sorted(set(x)) for x in batch.column(3).to_pylist()]
            n_hit = [sum(b - a for a, b in s) for s in spans]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()),
                pa.array(names, pa.list_(pa.string())), pa.array([[x for r in s for x in r] for s in spans], pa.list_(pa.int32())),
            ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

    return parts.select("doc_id", "n_words", "hits", "items").mapInArrow(work, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<int>")


def word_bounds(text: str) -> list[tuple[int, int]]:
    """Start and end, in UTF-8 bytes, of each word."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(FOLD), "u1") != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], data.view("i1"), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges and the signs between them."""
    data, bounds, kept, at = text.encode("utf-8", "surrogatepass"), word_bounds(text), [], 0
    for start, end in ranges:
        kept.append(data[at : bounds[start][0]])
        at = bounds[end - 1][1]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK, most: float = 0.5) -> DataFrame:
    """docs without spans that items hold; rows of which a larger share than `most` is hit go.

    Columns stay; n_chars, where there is one, is that of the text that is left. Spans of all
    blocks are found in the whole texts, merged, and cut at once; with one block that is one pass without a shuffle.
    """
    at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    width, schema = len(docs.columns), docs.schema
    packed = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all")
    keyed, hits = in_blocks(docs.select("doc_id", "text", packed), items, window, block, "row")
    if hits is None:
        return docs
    if isinstance(hits, DataFrame):
        frame, index = keyed.join(hits.select("row", "hits"), "row", "left").select("all.*", "hits"), None
        names = [*docs.columns, "hits"]
    else:
        frame, index, names = docs, hits, docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(index)  # at most BLOCK words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            texts, keep, changed = batch.column(at).to_pylist(), [], []
            known = batch.column(width).to_pylist() if index is None else None
            for k, text in enumerate(texts):
                own = words(text)
                ranges = match(index, coded(index, own))[0] if index else merged(known[k] or [])
                keep.append(sum(b - a for a, b in ranges) <= most * len(own))
                if ranges and keep[-1]:
                    texts[k] = cut(text, ranges)
                    changed.append(k)
            columns = list(batch.columns[:width])
            if size_at is not None:
                sizes = columns[size_at].to_pylist()
                for k in changed:
                    sizes[k] = len(texts[k])
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:width]).filter(pa.array(keep, pa.bool_()))

    return frame.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(work, StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(schema)])).toDF(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = found(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


WORDS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT * FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS window_
       FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS k FROM i)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS window_
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.window_ = iw.window_),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
