"""The check over streams. All of it works on one row at a time, so the batch plan serves; patterns are broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.check import Known, check, known


def check_stream(messages: DataFrame, pack: dict, model: dict | None = None, patterns: DataFrame | Known | None = None) -> DataFrame:
    """Cards of a streaming DataFrame (message_id, text, sender, input_type), those of check(). Packs stay as they are now.

    Patterns too many to broadcast are refused, as a stream can't be joined by terms; refreshed() takes them.
    """
    return check(messages, pack, patterns, model)


def refreshed(read: Callable[[], dict], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes each micro-batch's cards by the packs in force when it begins.

    read() gives version and pack and, if there are any, patterns and model. A new version takes effect as a whole:
    patterns are weighed and broadcast anew for it, and the old ones freed. While it stays the same, what was made
    ready serves. A batch that is run again after a failure may meet a newer version.
    """
    held: dict = {}

    def run(batch: DataFrame, number: int) -> None:
        now = read()
        if not held or held["version"] != now["version"]:
            table = now.get("patterns")
            fresh = None if table is None else known(table)
            if held.get("patterns") is not None:
                held["patterns"].match.release()
            held.update(version=now["version"], pack=now["pack"], model=now.get("model"), patterns=fresh)
        write(check(batch, held["pack"], held["patterns"], held["model"]), number)

    return run


def verdict_counts(cards: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Verdicts counted by window; rows later than `late` are dropped."""
    return cards.withWatermark(time, late).groupBy(F.window(time, window), "verdict").agg(F.count(F.lit(1)).alias("n"))
