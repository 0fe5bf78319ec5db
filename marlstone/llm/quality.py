"""Operator 3, quality classifier: Bradley-Terry ranking of documents from preference pairs.

Each text has a fixed vector of shape features (no labels, lang, source or id).
A document of label 1 is preferred to one of label 0; the weights of a linear
score are fitted by logistic loss on the features' differences of many such
pairs. A score threshold comes from a quantile of the training scores, the share of label 0 among
them; the score given out is a logistic of the distance to it, placed so that
the threshold reads 0.3.

Fitted on a bounded sample: at most about SAMPLE labelled rows by hash of
doc_id; the driver sees their features alone. Fitting and scoring read whole texts.

Cases: null and empty texts have the features of no words, so they too get a
score. With labels of one kind only every score is 0.5. A doc_id with several
label rows counts once for each. Rows that repeat get equal rows; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .language import held_out

SAMPLE = 6000
PAIRS = 10_000
CUT = 0.3

FEATURES = (
    "upper", "digit", "mark", "stop", "blank", "break", "high",
    "repeat", "again", "distinct", "word", "mark_words", "upper_words", "lone_words", "lines_again", "size",
)

#: The class of each byte: 0 lower case, 1 upper case, 2 digit, 3 other printable marks, 4 comma and full stop, 5 blank, 6 line break and other controls, 7 above ASCII.
CLASSES = np.array([6 if b < 32 or b == 127 else 5 if b == 32 else 7 if b > 127 else 4 if b in b",." else 2 if 48 <= b < 58 else 1 if 65 <= b < 91 else 0 if 97 <= b < 123 else 3 for b in range(256)])
WORD_MARKS = str.maketrans("", "", "".join(chr(b) for b in range(33, 127) if CLASSES[b] in (3, 4)))


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes and words, repetition and size of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    kinds = np.bincount(CLASSES, np.bincount(np.frombuffer(data, "u1"), minlength=256), 8) if data else np.zeros(8)
    size = max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    spread = sum(map(str.__eq__, words, words[2:]))
    known: dict[str, int] = {}
    for w in words:
        known[w] = known.get(w, 0) + 1
    marked = upper = lone = 0
    for w, c in known.items():  # kinds of words are told once for each distinct word
        if w.isupper() and len(w) > 1:
            upper += c
        if not w.isalpha():
            bare = w.translate(WORD_MARKS)
            if not bare:
                lone += c
            elif len(w) - len(bare) > 1:
                marked += c
    lines = text.split("\n")
    return np.array([
        kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size, kinds[7] / size,
        same / n, spread / n, min(1.0, len(known) / n**0.8), min(2.0, len(text) / n / 10), marked / n, upper / n, lone / n, 1 - len(set(lines)) / len(lines), np.log1p(n) / 10,
    ])


def expanded(x: np.ndarray) -> np.ndarray:
    """Features with their roots, so that a small share already tells."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=-1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        """The Bradley-Terry score: a difference of two is the log odds of a preference."""
        return np.clip((expanded(x) - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT exactly where rank is the threshold."""
        return 1 / (1 + (1 - CUT) / CUT * np.exp(np.clip(-self.slope * (self.rank(x) - self.threshold), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 11, steps: int = 300, ridge: float = 1e-3) -> Model | None:
    """Weights from pairs of a row of label 1 and one of label 0; None if one kind is missing."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(seed)
    e = expanded(x)
    mean, scale = e.mean(axis=0), np.maximum(e.std(axis=0), 1e-3)
    z = np.clip((e - mean) / scale, -8, 8)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    step = 4 / max(1e-9, np.linalg.eigvalsh(diff.T @ diff / pairs)[-1])
    look, momentum = w, 1.0
    for _ in range(steps):  # accelerated gradient on the convex loss log(1 + exp(-w diff))
        grad = -(diff.T @ (1 / (1 + np.exp(np.clip(diff @ look, -50, 50))))) / pairs + ridge * look
        new = look - step * grad
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, w, momentum = new + (momentum - 1) / later * (new - w), new, later
    rank = z @ w
    # The quantile at the share of label 0, then the middle of the gap between the scores around it.
    order = np.sort(rank)
    threshold = float((order[len(bad) - 1] + order[len(bad)]) / 2)
    spread = max(1e-6, float(np.median(np.abs(rank - threshold))))
    return Model(mean, scale, w, threshold, 4 / spread)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most about `sample` labelled documents, none of them held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < max(1, 1_000_000 * sample // n))
    # Bounded by `sample` rows of 12 bytes.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    names = [f"f{k}" for k in range(len(FEATURES))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in x.T)], ["doc_id", "quality", *names])

    got = rows.mapInArrow(work, "doc_id long, quality int, " + ", ".join(f"{c} double" for c in names)).collect()
    got.sort(key=tuple)
    return np.array([r[2:] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], int)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted for each of docs (doc_id, text); no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            score = m.score(x) if m else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= CUT).astype("i4"))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double, predicted int")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    model = fit(*training_rows(docs, shared.table(spark, sf_dir, "labels")))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
