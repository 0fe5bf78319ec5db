"""Operator 1, token-ID files: fixed-width bit packing with block offsets.

Each id takes the fewest bits that hold the vocabulary. 64 ids fill exactly
`bits` little-endian 64-bit words, so packing and unpacking are a few numpy
operations on whole blocks, and any id is found from its block's offset.

A file holds, in this order: the magic, the packed blocks, the footer's arrays
(block offsets as uint64, document ids as int64, a byte for each document that
says whether its id is null, ids per document as uint64), a JSON header, the
JSON's length as uint32, and the magic again.

Cases: null and empty texts hold the end id alone. Rows that repeat a doc_id
are kept, ordered by their texts' hash. A null doc_id comes first. Other columns are
ignored. An empty table gives no files and no rows. A file is closed once it holds ROLL ids, so its size
doesn't grow with the corpus; a document is never split.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MAGIC = b"MTOKPK01"
BLOCK = 1 << 18
ROLL = 1 << 27
END_ID = 2
CACHE = 250_000
MANIFEST = "part int, turn int, path string, n_docs long, n_tokens long, n_blocks long, n_bytes long"


def width(vocabulary: int) -> int:
    """Bits that hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as a stream of `bits`-bit fields, lowest bits first, padded with zeros to 64 fields."""
    values = np.zeros(-(-len(ids) // 64) * 64, "<u8")
    values[: len(ids)] = ids
    if len(ids) and int(values.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return values.astype(f"<u{bits // 8}").tobytes()
    lanes = values.reshape(-1, 64)
    words = np.zeros((len(lanes), bits), "<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first `count` ids of a packed block, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}")[:count].astype("<u4")
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        field = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            field = field | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = field & mask
    return out.reshape(-1)[:count]


class Writer:
    """Writes one file as a stream: a block's ids and 17 bytes a document are all it holds."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.at = self.stream.write(MAGIC) and len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = 0
        self.offsets = [self.at]
        self.doc_ids: list[int] = []
        self.nulls = bytearray()
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_tokens += len(ids)
        if self.n_waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) // self.block * self.block
        for k in range(0, end, self.block):
            data = pack(ids[k : min(k + self.block, end)], self.bits)
            self.stream.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.waiting = [ids[end:].copy()] if end < len(ids) else []
        self.n_waiting = len(ids) - end

    def close(self) -> dict:
        self._flush(True)
        head = {"bits": self.bits, "block": self.block, "n_tokens": self.n_tokens, "n_docs": len(self.lengths), "n_blocks": len(self.offsets) - 1}
        body = np.array(self.offsets, "<u8").tobytes() + np.array(self.doc_ids, "<i8").tobytes() + bytes(self.nulls) + np.array(self.lengths, "<u8").tobytes()
        text = json.dumps(head).encode()
        self.stream.write(body + text + len(text).to_bytes(4, "little") + MAGIC)
        self.stream.close()
        return head | {"n_bytes": self.at + len(body) + len(text) + 12}


class Reader:
    """Opens a file; ids(start, stop) reads only the blocks that hold them."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 12)
        tail = file.read(12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(tail[:4], "little")
        file.seek(size - 12 - n)
        self.head = head = json.loads(file.read(n))
        self.bits, self.block, self.n_tokens = head["bits"], head["block"], head["n_tokens"]
        docs, blocks = head["n_docs"], head["n_blocks"]
        length = 8 * (blocks + 1) + 17 * docs
        file.seek(size - 12 - n - length)
        body = file.read(length)
        self.offsets = np.frombuffer(body, "<u8", blocks + 1)
        self.doc_ids = np.frombuffer(body, "<i8", docs, 8 * (blocks + 1))
        self.nulls = np.frombuffer(body, "u1", docs, 8 * (blocks + 1) + 8 * docs)
        self.lengths = np.frombuffer(body, "<u8", docs, 8 * (blocks + 1) + 9 * docs).astype("i8")
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def block_ids(self, k: int) -> np.ndarray:
        self.file.seek(int(self.offsets[k]))
        data = self.file.read(int(self.offsets[k + 1] - self.offsets[k]))
        return unpack(data, self.bits, min(self.block, self.n_tokens - k * self.block))

    def ids(self, start: int, stop: int) -> np.ndarray:
        stop = min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        ids = np.concatenate([self.block_ids(k) for k in range(first, last + 1)])
        return ids[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[np.ndarray]:
        """Every document's ids in order; each block is read once."""
        held, low, k = np.zeros(0, "<u4"), 0, 0
        for start, stop in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            parts = []
            while stop > low + len(held):
                if start < low + len(held):
                    parts.append(held[max(0, start - low) :])
                low, held, k = low + len(held), self.block_ids(k), k + 1
            parts.append(held[max(0, start - low) : stop - low])
            yield np.concatenate(parts) if len(parts) > 1 else parts[0]


#: Characters below U+0100 on which the tokenizer's normaliser only lower-cases, without the apostrophe
#: (contractions) and "<" (special tokens).
PLAIN = r"\t-\r\x20-&(-;=-~\x85\xa0-\xff"


class Encoder:
    """Whole texts to ids with the tokenizers library, equal to encode(text, add_special_tokens=False).

    The file's pipeline is NFC, white space to a blank, lower case, a split
    into letter runs, single digits and runs of other signs, then BPE within
    each piece. On texts of plain characters those steps reduce to lower() and
    one pattern, so a piece's ids don't depend on its neighbours: each distinct
    piece is encoded once by the library's model and kept. Every other text,
    and every tokenizer with another pipeline, goes to the library whole.
    """

    #: The normaliser and the splits that the short way stands for.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLITS = {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = max(self.whole.get_vocab_size(), 1 + max(self.whole.get_vocab().values(), default=0))
        suffix = spec["model"].get("end_of_word_suffix")
        # Added tokens that hold a "<" aren't in plain texts.
        plain_added = all("<" in x["content"] for x in spec.get("added_tokens") or [])
        model = spec["model"]
        plain_model = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
        self.short = spec.get("normalizer") == self.NORMALIZER and spec.get("pre_tokenizer") == self.SPLITS and plain_added and plain_model and bool(suffix)
        if self.short:
            self.pieces_only = Tokenizer.from_file(path)
            self.pieces_only.normalizer = normalizers.Sequence([])
            self.pieces_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.vocabulary, bool)
            self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)]] = True
            letters, digits = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
            self.odd = re.compile(f"[^{PLAIN}]")
            self.piece = re.compile(f"[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+")
        self.by_piece: dict[str, bytes] = {}
        self.by_word: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> list[str]:
        """Encode the pieces that are new, many in a call, and give them; a piece ends with an id whose token ends a word."""
        split = {w: self.piece.findall(w) for w in words}
        new = sorted({p for pieces in split.values() for p in pieces if p not in self.by_piece})
        lines = [" ".join(new[k : k + 64]) for k in range(0, len(new), 64)]
        for k, found in enumerate(self.pieces_only.encode_batch_fast(lines, add_special_tokens=False)):
            own = new[64 * k : 64 * k + 64]
            ids = np.array(found.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) == len(own):
                data, low = ids.tobytes(), 0
                for piece, high in zip(own, ends.tolist(), strict=True):
                    self.by_piece[piece] = data[low:high]
                    low = high
            else:
                for piece in own:
                    self.by_piece[piece] = np.array(self.whole.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        get = self.by_piece.__getitem__
        for w, pieces in split.items():
            self.by_word[w] = get(pieces[0]) if len(pieces) == 1 else b"".join(map(get, pieces))
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian uint32. Holds CACHE words and what the texts add."""
        out: list[bytes] = [b""] * len(texts)
        slow, quick, known, learnt = [], [], self.by_word, []
        for k, text in enumerate(texts):
            if text and (not self.short or self.odd.search(text)):
                slow.append(k)
            elif text:
                quick.append((k, text.lower().split()))
        if new := {w for _, words in quick for w in words if w not in known}:
            learnt = self._learn(new)
        for k, words in quick:
            out[k] = b"".join(map(known.__getitem__, words))
        for cache, added in ((known, new), (self.by_piece, learnt)):
            if len(cache) > CACHE:  # full caches keep what they had
                for x in added:
                    del cache[x]
        for low in range(0, len(slow), 256):
            own = slow[low : low + 256]
            for k, found in zip(own, self.whole.encode_batch_fast([texts[i] for i in own], add_special_tokens=False), strict=True):
                out[k] = np.array(found.ids, "<u4").tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, block: int = BLOCK, roll: int = ROLL) -> DataFrame:
    """Encode docs (doc_id, text) into files of ascending doc_id below folder; returns the manifest, a row for each file.

    One range shuffle of the texts, on the document's id and its text's hash.
    A task's rows become a file, or one after each `roll` ids, written as streams. Names hold the task
    attempt; the manifest, committed by Spark, names the files that count.
    """
    spark = docs.sparkSession
    shared.modest_batches(spark)
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h"))
        .repartitionByRange(shared.partitions(spark), "doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
        .drop("h")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, out, turn, name = encoder(tokenizer), None, 0, f"{folder}/{shared.attempt_name()}"
        end = np.array([end_id], "<u4").tobytes()

        def closed() -> pa.RecordBatch:
            head = out.close()
            numbers = {k: pa.array([head[k]], pa.int64()) for k in ("n_docs", "n_tokens", "n_blocks", "n_bytes")}
            return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "turn": pa.array([turn], pa.int32()), "path": [f"{name}-{turn}.tok"], **numbers})

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                ids = part.column(0).to_pylist()
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc_id, data in zip(ids, coder.encode(texts), strict=True):
                    if out is None:
                        out = Writer(shared.open_output(f"{name}-{turn}.tok"), width(max(coder.vocabulary, end_id + 1)), block)
                    out.add(doc_id, np.frombuffer(data + end, "<u4"))
                    if out.n_tokens >= roll:
                        yield closed()
                        out, turn = None, turn + 1
        if out is not None:
            yield closed()

    return shared.written(ranged.mapInArrow(write, MANIFEST), "token-manifest", keep=True)


def read_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the manifest's files: doc_id, start, n_tokens, ids_crc32 and the file's path; a task for each file.

    The driver sees a row for each file, to sum up where each file starts.
    """
    files, start = [], 0
    for row in manifest.select("path", "n_tokens").orderBy("part", "turn").collect():
        files.append((len(files), row["path"], start))
        start += row["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with shared.open_input(path) as f:
                    file = Reader(f)
                    sums = np.fromiter((zlib.crc32(x.tobytes()) for x in file.documents()), "i8", len(file.lengths))
                    for low in range(0, len(sums), 10_000):
                        cut = slice(low, low + 10_000)
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(file.doc_ids[cut], mask=file.nulls[cut].astype(bool)),
                            "start": pa.array(file.starts[:-1][cut] + base),
                            "n_tokens": pa.array(file.lengths[cut]),
                            "ids_crc32": pa.array(sums[cut]),
                            "path": pa.array([path] * len(sums[cut])),
                        })

    given = spark.createDataFrame(files, "n int, path string, base long")
    return given.repartitionById(max(1, len(files)), "n").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write docs as token files into the shared folder (or `folder`) and read them back."""
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_files(docs, folder or shared.new_folder(spark, "token-files"), tokenizer, end_id)
    return read_files(spark, manifest)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(shared.table(spark, sf_dir, "documents"))
