"""Operator 10, language ID: averaged hashed subword embeddings under a linear softmax.

A word is its own feature and its character n-grams of 2 to 4 within "<word>";
features are hashed into BUCKETS rows of an embedding table. A text's vector is
the mean over all its features, and a linear softmax over it gives languages.
Table and softmax are learned together by stochastic gradient descent in numpy.
A temperature fitted on a part kept aside, with smoothed targets from SMOOTHED rows on, calibrates the softmax, and the
rejection level is the quantile of that part's right scores that REJECTED of them fall
below: near the least one where the part has fewer than 1 / REJECTED rows.

The model is linear up to the softmax, so a word's part of the logits is a
small vector that each worker computes once and keeps; a text costs a lookup
for each of its words.

Fitted on a bounded sample, by hash of doc_id: about SAMPLE documents in all, dealt
evenly over languages, so that a rare one gives all its rows if it has fewer than its
share; of each at most DRAWN words, drawn from the whole text. Prediction reads every whole text.

Cases: a null text, or one without letters, is `und` with score 0. Ties go to
the language that sorts first. With no labelled row every text is `und`. Rows
that repeat get equal rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BUCKETS = 1 << 16
WIDTH = 16
SAMPLE = 4000
DRAWN = 2000
FEATURES = 256
EPOCHS = 4
REJECTED = 0.001
SMOOTHED = 100
CACHE = 100_000
UND = "und"
EDGE = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of doc_id as text, mod modulus, is remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


#: Multipliers of a gram's characters and of its length, any odd numbers.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")


def features(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-case words, flat, and how many each has: itself and its n-grams of 2 to 4 between marks."""
    sizes = np.fromiter(map(len, found), "i8", len(found)) + 2
    codes = np.frombuffer("".join([f"<{w}>" for w in found]).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    of, left = np.repeat(np.arange(len(found)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    owners = [np.arange(len(found))]
    hashes = [np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in found), "u8", len(found))]
    for n in (2, 3, 4):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, "u8") * MIX[4]
        for j in range(n):
            h = (h ^ codes[at + j]) * MIX[j]
        owners.append(of[at])
        hashes.append(h >> np.uint64(32))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(hashes)[order] % BUCKETS).astype("i8"), np.bincount(owner, minlength=len(found))


def words(text: str) -> list[str]:
    """Letter runs of a text in lower case."""
    return EDGE.sub(" ", text.lower()).split()


@dataclass
class Model:
    """logits = mean over features of table[feature] @ weights, plus bias; then divided by the temperature."""

    langs: list[str]
    parts: np.ndarray  # BUCKETS x languages: table @ weights
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0
    known: dict[str, bytes] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def _rows(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's part of the logits and its number of features, as float32."""
        parts = [words(c) for c in chunks]
        flat = [w for p in parts for w in p]
        rows = np.zeros((len(chunks), len(self.langs) + 1), "f4")
        if flat:
            f, counts = features(flat)
            sums = np.add.reduceat(self.parts[f], np.cumsum(counts) - counts, axis=0)
            of = np.repeat(np.arange(len(chunks)), [len(p) for p in parts])
            np.add.at(rows, of, np.column_stack([sums, counts]).astype("f4"))
        data, size = rows.tobytes(), 4 * rows.shape[1]
        return [data[k : k + size] for k in range(0, len(data), size)]

    def looked_up(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's rows. Words that a full cache doesn't hold are computed again for each call."""
        chunks = [t.lower().split() for t in texts]
        new = list(set().union(*chunks) - self.known.keys())
        fresh: dict[str, bytes] = {}
        for low in range(0, len(new), 20_000):
            part = new[low : low + 20_000]
            fresh.update(zip(part, self._rows(part), strict=True))
        if len(self.known) < CACHE:
            self.known.update(fresh)
            fresh = {}
        get = self.known.get
        for own in chunks:
            yield b"".join([get(c) or fresh[c] for c in own] if fresh else map(get, own))

    def logits(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Of each text; None for one without letters."""
        able = [bool(self.langs and t and any(map(str.isalpha, t))) for t in texts]
        found = self.looked_up([t for t, a in zip(texts, able, strict=True) if a])
        out: list[np.ndarray | None] = []
        for a in able:
            if a:
                rows = np.frombuffer(next(found), "f4").reshape(-1, len(self.langs) + 1)
                total = rows.sum(axis=0, dtype="f8")
                out.append(total[:-1] / max(total[-1], 1) + self.bias)
            else:
                out.append(None)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and calibrated probability of each text; (und, 0) for one without letters."""
        found = []
        for z in self.logits(texts):
            p = None if z is None else softmax(z / self.temperature)
            found.append((UND, 0.0) if p is None else (self.langs[int(p.argmax())], float(p.max())))
        return found


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Learn from (text, lang) rows; order matters only through the seed's permutation."""
    rows = sorted((t, lang) for t, lang in rows if t and any(map(str.isalpha, t)) and words(t))
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), "f4"), np.zeros(0))
    if len(langs) == 1:
        return Model(langs, np.zeros((BUCKETS, 1), "f4"), np.zeros(1))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    rows = [rows[k] for k in order]
    aside = len(rows) // 5 if len(rows) >= 50 else 0
    texts = [words(t) for t, _ in rows[aside:]]
    known = sorted({w for t in texts for w in t})
    of: dict[str, np.ndarray] = {}
    for low in range(0, len(known), 20_000):  # two bytes a feature, as buckets are below 2 ** 16
        part = known[low : low + 20_000]
        flat, counts = features(part)
        of.update(zip(part, np.split(flat.astype("u2"), np.cumsum(counts)[:-1]), strict=True))
    bags = [np.concatenate([of[w] for w in t]) for t in texts]
    y = np.array([langs.index(lang) for _, lang in rows])
    share = np.bincount(y[aside:], minlength=len(langs)) / max(1, len(rows) - aside)
    table = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, len(langs))), np.zeros(len(langs))
    weights += rng.normal(0, 0.1, weights.shape)
    batch, steps = 32, EPOCHS * -(-len(bags) // 32)
    for step in range(steps):
        rate = 4.0 * (1 - step / steps)
        pick = rng.integers(0, len(bags), batch)
        # Texts of some FEATURES drawn features each, so that long and short texts teach alike.
        drawn = np.stack([bags[k][rng.integers(0, len(bags[k]), FEATURES)] for k in pick])
        mean = table[drawn].mean(axis=1)
        err = softmax(mean @ weights + bias)
        err[np.arange(batch), y[aside:][pick]] -= 1
        err *= np.minimum(4, 1 / (len(langs) * share[y[aside:][pick]]))[:, None]
        back = (err @ weights.T)[:, None, :] * (rate / FEATURES)
        weights -= rate / batch * (mean.T @ err)
        bias -= rate / batch * err.sum(axis=0) * 0.1
        np.subtract.at(table, drawn, np.broadcast_to(back, (*drawn.shape, WIDTH)))
    model = Model(langs, (table @ weights).astype("f4"), bias)
    if aside:
        z = np.stack(model.logits([t for t, _ in rows[:aside]]))
        _calibrate(model, z, y[:aside])
    return model


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray) -> None:
    """The temperature of least log loss on rows kept aside, and the level that few right answers fall below."""
    scales = np.geomspace(0.005, 50, 120)
    # Smoothed targets as Platt's: where all answers are right, scores must not all become 1, which tells nothing apart.
    slip = 1 / (len(y) + 2) if len(y) >= SMOOTHED else 0.0
    target = np.full(z.shape, slip / (z.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - slip
    loss = [-(target * np.log(softmax(z / s) + 1e-12)).sum(axis=1).mean() for s in scales]
    model.temperature = float(scales[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.reject = float(np.quantile(right, REJECTED)) if len(right) else 0.0


def even_share(counts: list[int], total: int) -> int:
    """The largest number such that so many of each, or all where there are fewer, are at most total."""
    left = sorted(counts)
    for k, n in enumerate(left):
        if n * (len(left) - k) > total:
            return total // (len(left) - k)
        total -= n
    return max(left, default=0)


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """About `sample` rows (words, lang) at most, dealt evenly over languages. The driver sees a number for each language and these rows."""
    shared.modest_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = even_share(list(counts.values()), sample)
    rates = docs.sparkSession.createDataFrame([(lang, -(-(share << 40) // n)) for lang, n in counts.items()], "lang string, rate long")
    turn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py())
                if len(found) > DRAWN:
                    found = [found[k] for k in np.random.default_rng(doc_id & (1 << 63) - 1).integers(0, len(found), DRAWN)]
                texts.append(" ".join(found))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], ["text", "lang"])

    # A row for each language.
    return [tuple(r) for r in known.join(F.broadcast(rates), "lang").where(turn < F.col("rate")).select("doc_id", "text", "lang").mapInArrow(work, "text string, lang string").collect()]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and keep for each row of docs (doc_id, text); no shuffle."""
    spark = docs.sparkSession
    # The model's size is fixed by BUCKETS and the number of languages.
    sent = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [x for low in range(0, batch.num_rows, 250) for x in m.predict(batch.column(1).slice(low, 250).to_pylist())]
            score = np.array([s for _, s in found], "f8")
            lang = pa.array([lang for lang, _ in found], pa.string())
            keep = pa.array([lang != UND and s >= m.reject for lang, s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(score), keep], ["doc_id", "lang_pred", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double, keep boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is known well enough, all columns as they were."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [x for low in range(0, batch.num_rows, 250) for x in m.predict(batch.column(at).slice(low, 250).to_pylist())]
            keep = [lang != UND and s >= m.reject for lang, s in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", F.col("keep").alias("accepted"))
