"""Joins of spans across rows: what lies near, inside or nearest, as relations keyed by document.

Spans are rows with a key, a start and an end (exclusive). Joins by distance
are equi-joins on (key, bin of offsets), so no nested loop is needed and a
long document is dealt over tasks; each pair is given once, in the first bin
that both have. A span enters as many bins as it covers, so `width` should be
of the order of the spans' lengths and the window.

Cases: spans without key, start or end join with nothing. Repeated spans pair
once for each repetition. Columns of the caller's own stay, those of the right
side with the prefix `right_`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .phrases import Phrases

SPANS = "array<struct<name:string,start:int,end:int>>"
WIDTH = 256


def phrase_spans_col(lists: dict[str, Iterable[str]]):
    """A function of a column of folded text to the spans of each list's phrases."""
    lists = {k: list(v) for k, v in lists.items()}
    made: list[Phrases] = []

    @F.pandas_udf(SPANS)
    def apply(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Phrases(lists))
        return pd.Series([None if t is None else [{"name": n, "start": a, "end": b} for n, found in made[0].find(t).items() for a, b in found.spans] for t in texts], dtype=object)

    return apply


def pattern_spans_col(patterns: dict[str, str]):
    """A function of a column of text to the spans of Python patterns."""

    @F.pandas_udf(SPANS)
    def apply(texts: pd.Series) -> pd.Series:
        compiled = {n: re.compile(p) for n, p in patterns.items()}
        return pd.Series([None if t is None else [{"name": n, "start": m.start(), "end": m.end()} for n, p in compiled.items() for m in p.finditer(t)] for t in texts], dtype=object)

    return apply


def exploded(docs: DataFrame, key: str, spans: Column) -> DataFrame:
    """(key, name, start, end): a row for each span."""
    return docs.select(key, F.explode(spans).alias("_s")).select(key, F.col("_s.name").alias("name"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))


def gap(a: str = "", b: str = "right_") -> Column:
    """Signs between two spans of a row, 0 if they overlap."""
    return F.greatest(F.col(f"{b}start") - F.col(f"{a}end"), F.col(f"{a}start") - F.col(f"{b}end"), F.lit(0))


def _right(spans: DataFrame, key: str) -> DataFrame:
    return spans.select(F.col(key).alias("_key"), *(F.col(c).alias(f"right_{c}") for c in spans.columns if c != key))


def _bins(low: Column, high: Column, width: int) -> Column:
    """The bins from that of offset `low` to that of `high`."""
    return F.sequence(F.floor(low / width), F.greatest(F.floor(high / width), F.floor(low / width)))


def near_join(left: DataFrame, right: DataFrame, key: str, window: int, width: int = WIDTH) -> DataFrame:
    """Pairs of a left and a right span of one key with at most `window` signs between them."""
    low, right_low = F.col("start") - window, F.col("right_start")
    binned = left.where("start IS NOT NULL AND end IS NOT NULL").withColumn("_bin", F.explode(_bins(low, F.col("end") + window, width)))
    other = _right(right, key).where("right_start IS NOT NULL AND right_end IS NOT NULL").withColumn("_bin", F.explode(_bins(right_low, F.col("right_end"), width)))
    pairs = binned.join(other, (F.col(key) == F.col("_key")) & (binned["_bin"] == other["_bin"]) & (gap() <= window))
    first = binned["_bin"] == F.greatest(F.floor(low / width), F.floor(right_low / width))
    return pairs.where(first).drop("_bin", "_key")


def inside_join(inner: DataFrame, outer: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """Pairs of a span and one of `outer` that it lies in; inner spans enter one bin each."""
    binned = inner.where("start IS NOT NULL AND end IS NOT NULL").withColumn("_bin", F.floor(F.col("start") / width))
    other = _right(outer, key).where("right_start IS NOT NULL AND right_end IS NOT NULL").withColumn("_bin", F.explode(_bins(F.col("right_start"), F.col("right_end"), width)))
    within = (F.col("start") >= F.col("right_start")) & (F.col("end") <= F.col("right_end"))
    return binned.join(other, (F.col(key) == F.col("_key")) & (binned["_bin"] == other["_bin"]) & within).drop("_bin", "_key")


def nearest(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with `distance`: signs to the nearest right span of its key, null without one; a sorted merge, no join.

    The spans that begin before or with a span count by the greatest end among them, the others by the next start.
    """
    own = left.columns
    sides = left.withColumns({"_left": F.lit(True), "_end": F.lit(None).cast("long"), "_start": F.lit(None).cast("long")}).unionByName(
        right.select(F.col(key), F.col("start"), F.lit(False).alias("_left"), F.col("end").cast("long").alias("_end"), F.col("start").cast("long").alias("_start")), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy("start", "_left")  # right spans of the same start come first
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_start", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    merged = sides.withColumns({"_before": before, "_after": after}).where("_left")
    # greatest() and least() leave nulls out: a side without a span must stay null.
    gaps = [F.when(signs.isNotNull(), F.greatest(signs, F.lit(0))) for signs in (F.col("start") - F.col("_before"), F.col("_after") - F.col("end"))]
    distance = F.least(*gaps)
    return merged.select(*own, distance.cast("int").alias("distance"))
