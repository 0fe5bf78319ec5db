"""Operator 12, SentencePiece: exact encoding of merge-type (BPE) models by backtracking, and decoding.

The merge rule joins, again and again, the neighbours whose joint piece scores
highest, the leftmost of equals. Its result needs no heap: a run of pieces is
the result if each piece, and each two neighbours put together, merge to
themselves. So the encoder goes from left to right, takes the longest piece at
a position (from one Aho-Corasick pass), checks it against the piece before it
by merging the two anew, falls back to shorter ones, and steps back where none
fits. A field of bits remembers the positions from which nothing goes on, so
every position is left at most once for each piece that ends there.

A text is cut into units first, between signs that no piece holds side by side;
no merge crosses such a cut, so a unit's ids don't depend on its neighbours. A
worker encodes a distinct unit once, and keeps as many as CACHE of them.

Signs that no piece holds become byte pieces where the model has them, else
one unknown id a run. Models with a normaliser of their own are served by the
library's normaliser; models that aren't of the merge type, or that have
user-defined symbols, are refused. Decoding is the library's.

Cases: null and empty texts have no ids and decode to "". Every row gives a
row, repeated doc_ids too; a null doc_id stays null. Other columns are ignored.
An empty table gives no rows. Long texts are encoded whole: only units beyond
the cache and the ids of one text are held.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: What a model file writes for a blank, and the kinds of its pieces and models that matter here (fixed values of the format).
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2
CACHE = 500_000
LONG_UNIT = 64
PAIRS = 1_000_000
TEXTS = 100
ODD = re.compile("[^\x00-\xff]")


class Model:
    """A merge-type model: encode() by backtracking, decode() by the library."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            data = f.read()
        proto = sentencepiece_model_pb2.ModelProto.FromString(data)
        kinds = [p.type for p in proto.pieces]
        if proto.trainer_spec.model_type != MERGE_TYPE or USER_DEFINED in kinds or UNUSED in kinds or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models without user-defined or unused pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        norm = proto.normalizer_spec
        self.plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE} if proto.trainer_spec.byte_fallback else {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        if self.ids:
            self.automaton.make_automaton()
        self.quick, self.unit = self._units(self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _units(pieces: dict[str, int]) -> tuple[re.Pattern, re.Pattern]:
        """The patterns that cut a text into units: of Latin-1 texts, which is quicker, and of all others.

        Signs are those characters of pieces, no letters or decimal digits, that no piece holds beside anything but
        signs and blanks before them. If a piece has a blank after something else, nothing is cut.
        """
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            return (re.compile(r"(?s).+"),) * 2
        besides: dict[str, set[str]] = {}
        for p in pieces:
            for a, b in pairwise(p.lstrip(BLANK)):
                besides.setdefault(a, set()).add(b)
                besides.setdefault(b, set()).add(a)
        signs = {c for c in {"\n", *"".join(pieces)} if not c.isalpha() and not c.isdecimal() and c != BLANK}
        while wrong := {c for c in signs if besides.get(c, set()) - signs}:
            signs -= wrong

        def cutting(own: str) -> re.Pattern:
            return re.compile(f"{BLANK}*(?:[{own}]+|[^{own}{BLANK}]+)|{BLANK}+") if own else re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

        return tuple(cutting("".join(map(re.escape, sorted(own)))) for own in ({c for c in signs if c < "\u0100"}, signs))

    def normalized(self, text: str) -> str:
        if self.plain:
            return BLANK + text.replace(" ", BLANK) if text else ""
        return self.library.normalize(text)

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, step by step: for two pieces put together, and for checks."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k, (a, b) in enumerate(pairwise(parts)):
                score = scores.get(a + b)
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def side_by_side(self, a: str, b: str) -> bool:
        """Whether two pieces put together merge to just these two; with "" before it, whether a piece merges to itself."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def cut(self, text: str) -> list[str]:
        """The pieces of one unit, by backtracking."""
        n = len(text)
        if n == 1:
            return [text]
        lengths = [[1] for _ in text]
        if self.ids:
            for end, length in self.automaton.iter(text):
                if length > 1:
                    lengths[end + 1 - length].append(length)  # ends ascend, so do a start's lengths
        failed = bytearray(n // 8 + 1)
        known, parts, turns = self.pairs, [], []
        at, before, turn = 0, "", len(lengths[0]) - 1
        while at < n:
            here = lengths[at]
            while turn >= 0:
                end = at + here[turn]
                if not failed[end >> 3] >> (end & 7) & 1:
                    piece = text[at:end]
                    fits = known.get((before, piece))
                    if fits or fits is None and self.side_by_side(before, piece):
                        break
                turn -= 1
            if turn >= 0:
                parts.append(piece)
                turns.append(turn)
                at, before = end, piece
                turn = len(lengths[at]) - 1 if at < n else 0
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not parts:
                    raise ValueError(f"no pieces for {text[:80]!r}")
                at -= len(parts.pop())  # the piece before again, but shorter
                turn = turns.pop() - 1
                before = parts[-1] if parts else ""
        return parts

    def _unit_ids(self, unit: str) -> bytes:
        parts = self.cut(unit)
        try:
            return array("i", map(self.ids.__getitem__, parts)).tobytes()
        except KeyError:
            pass
        out, was_unknown = array("i"), False
        for piece in parts:
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out.extend(map(self.bytes.__getitem__, piece.encode()))
            elif not was_unknown:
                out.append(self.unknown)
            was_unknown = found is None
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        units = [(self.quick if self.plain and not ODD.search(x) else self.unit).findall(self.normalized(x)) for x in texts]
        known = self.known
        new = set().union(*units) - known.keys()
        for u in new:
            known[u] = self._unit_ids(u)
        out = [np.frombuffer(b"".join(map(known.__getitem__, own)), "<i4") for own in units]
        if not self.bytes:  # a run of unknown signs across a cut is one id
            out = [x[~((x == self.unknown) & (np.concatenate(([-1], x[:-1])) == self.unknown))] if len(x) else x for x in out]
        if len(known) > CACHE:  # a full cache keeps what it had
            for u in new:
                del known[u]
        else:
            for u in new:
                if len(u) > LONG_UNIT:
                    del known[u]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    """One model for each Python worker, kept between tasks."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def given(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    for low in range(0, batch.num_rows, TEXTS):
        part = batch.slice(low, TEXTS)
        yield part.column(0), [x or "" for x in part.column(1).to_pylist()]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text's ids as an array; a narrow step."""
    path = given(path)
    shared.modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for batch in batches:
            for doc_ids, texts in _texts(batch):
                ids = coder.encode(texts)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("i4")
                yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of `ids`; null ids give "". A narrow step."""
    path = given(path)
    shared.modest_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                texts = [coder.decode(x) if x else "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text in one step: its number of ids and the digests of its ids and of the decoded text.

    Gives what encoded() and decoded() would, without sending ids and texts back to the JVM.
    """
    path = given(path)
    shared.modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        decimal = [str(i) for i in range(coder.library.get_piece_size())]
        for batch in batches:
            for doc_ids, texts in _texts(batch):
                counts, of_ids, of_texts = [], [], []
                for found in coder.encode(texts):
                    ids = found.tolist()
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    of_texts.append(hashlib.sha256((coder.decode(ids) if ids else "").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(shared.table(spark, sf_dir, "documents"))
