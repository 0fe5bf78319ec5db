"""Operator 9, mixing sources to target weights: temperature mixing.

A source's share of tokens is raised to an exponent from 0 to 1, found by
bisection, so that the normalised weights reach a target entropy or no source
repeats more often than a limit. The budget is the least with which no
source falls short of one pass, so no document is lost: the source with the largest
share is read once, the others once and part of another pass, or more.

Weights become rows as budgeted block permutations. A document's key puts it
into one of BLOCKS blocks of its source. Each pass permutes the blocks, and
the documents within one; whole passes take all, the last pass takes blocks in its
order while its tokens last, and the block where they end by the documents' order.

Where the last pass ends is one row for each source. It comes from sums by
(source, block) and, for one block of each source, from its rows; so a source with
most of the rows is never gathered in one task. All is DataFrame operations.

Cases: a null source is a source of its own. Null and empty texts have no
tokens; they and sources without any tokens are read as often as whole passes, once at least.
Rows that repeat are each kept and stay together. A null doc_id has a key of its
own. Extra columns stay; where one has the name of a column that is added, the added one
gets a "_" at its end. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

REPEATS = 1.5
BLOCKS = 4096
SEED = "mix"
ADDED = ("mix_source", "mix_tokens", "mix_block", "mix_key", "mix_epoch", "mix_turn")


def weights(shares: list[float], exponent: float) -> list[float]:
    raised = [p**exponent for p in shares]
    total = sum(raised)
    return [x / total for x in raised]


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def passes(shares: list[float], exponent: float) -> list[float]:
    """How often each source is read where the least-read one is read once."""
    rates = [w / p for w, p in zip(weights(shares, exponent), shares, strict=True)]
    return [r / min(rates) for r in rates]


def solve(shares: list[float], repeats: float | None = REPEATS, target_entropy: float | None = None) -> float:
    """The least exponent at which no source is read more than `repeats` times, or the largest at which the entropy is reached.

    Both shrink as the exponent grows from 0 (even weights) to 1 (the shares
    as they are). A target that no exponent reaches gives the nearer end.
    """
    if (repeats is None) == (target_entropy is None):
        raise ValueError("give either repeats or target_entropy")
    if not shares:
        return 1.0
    above = (lambda a: max(passes(shares, a)) > repeats) if repeats is not None else (lambda a: entropy(weights(shares, a)) >= target_entropy)
    low, high = 0.0, 1.0
    if not above(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) else (low, mid)
    return high if repeats is not None else low


def number(text: Column, start: int, digits: int) -> Column:
    """Hex digits of text as a number."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("long")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with mix_source, mix_tokens, mix_block and mix_key. Tokens are words between ASCII blanks and controls 9 to 13."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return docs.withColumns({
        "mix_source": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
        "mix_tokens": F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long"),
        "mix_block": number(digest, 1, 3),
        "mix_key": number(digest, 4, 12),
    })


def block_turn(source: Column, block: Column, turn: Column) -> Column:
    """Where a block stands in a pass's permutation of its source's blocks."""
    return number(F.md5(F.concat_ws("/", F.lit(SEED), turn.cast("string"), block.cast("string"), source)), 1, 12)


def plan(base: DataFrame, repeats: float | None = REPEATS, target_entropy: float | None = None) -> DataFrame:
    """For each source of base (keyed, without texts): whole passes, and the last place of the part of a pass after them.

    The driver sees a row for each source.
    """
    spark = base.sparkSession
    totals = [(r["mix_source"], r["n"]) for r in base.groupBy("mix_source").agg(F.sum("mix_tokens").alias("n")).orderBy("mix_source").collect()]
    known = [(s, n) for s, n in totals if n]
    all_tokens = sum(n for _, n in known)
    shares = [n / all_tokens for _, n in known]
    times = dict(zip([s for s, _ in known], passes(shares, solve(shares, repeats, target_entropy)) if shares else [], strict=True))
    rows = []
    for s, n in totals:
        wanted = int(n * times.get(s, 1.0) + 1e-6)
        whole = max(1, wanted // n) if n else 1
        rows.append((s, whole, max(0, wanted - whole * n)))
    quotas = spark.createDataFrame(rows, "mix_source string, mix_whole int, quota long").where("quota > 0")

    turn = block_turn(F.col("mix_source"), F.col("mix_block"), F.col("mix_whole"))
    blocks = base.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("n")).join(quotas, "mix_source").withColumn("turn", turn)
    along = Window.partitionBy("mix_source").orderBy("turn", "mix_block")
    # At most BLOCKS rows of a source. The block in which the quota ends is the first whose running sum exceeds it.
    before = F.sum("n").over(along) - F.col("n")
    ends = blocks.withColumn("before", before).where((F.col("before") <= F.col("quota")) & (F.col("before") + F.col("n") > F.col("quota"))).select("mix_source", "mix_block", "before", "quota", F.col("turn").alias("mix_end_turn"))
    within = Window.partitionBy("mix_source").orderBy("mix_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = base.join(ends, ["mix_source", "mix_block"]).withColumn("sum", F.sum("mix_tokens").over(within) + F.col("before")).where(F.col("sum") <= F.col("quota"))
    last = inside.groupBy("mix_source").agg(F.max("mix_key").alias("mix_end_key"))
    place = ends.join(last, "mix_source", "left").select("mix_source", "mix_block", "mix_end_turn", F.coalesce("mix_end_key", F.lit(-1).cast("long")).alias("mix_end_key"))
    given = spark.createDataFrame([r[:2] for r in rows], "mix_source string, mix_whole int")
    return shared.written(given.join(place.withColumnRenamed("mix_block", "mix_end_block"), "mix_source", "left"), "mix-plan")


def mixed(docs: DataFrame, repeats: float | None = REPEATS, target_entropy: float | None = None) -> DataFrame:
    """docs, each row as often as its source's passes take it, with mix_source, mix_tokens, mix_block, mix_key, mix_epoch and mix_turn.

    Ordered by (mix_epoch, mix_turn, mix_key) within a source, rows are its stream of passes.
    """
    base = shared.written(keyed(docs.select("doc_id", "text", "source")).drop("text", "source"), "mix-rows")
    where = plan(base, repeats, target_entropy)
    # A row's own columns go by number, so that none of them meets a name of ours.
    own = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    # Not hinted: Spark broadcasts the plan if it is small, else splits a hot source's join.
    joined = keyed(docs.toDF(*own.values()), own["doc_id"], own["text"], own["source"]).join(where, "mix_source")
    turn = block_turn(F.col("mix_source"), F.col("mix_block"), F.col("mix_whole"))
    taken = F.col("mix_end_turn").isNotNull() & (
        (turn < F.col("mix_end_turn"))
        | ((turn == F.col("mix_end_turn")) & (F.col("mix_block") < F.col("mix_end_block")))
        | ((F.col("mix_block") == F.col("mix_end_block")) & (F.col("mix_key") <= F.col("mix_end_key")))
    )
    epochs = F.sequence(F.lit(0), F.col("mix_whole") - 1 + taken.cast("int"))
    out = joined.withColumn("mix_epoch", F.explode(epochs))
    out = out.withColumn("mix_turn", block_turn(F.col("mix_source"), F.col("mix_block"), F.col("mix_epoch")))
    names = added_names(docs.columns)
    return out.select(*(F.col(number).alias(c) for c, number in own.items()), *(F.col(c).alias(name) for c, name in names.items()))


def added_names(columns: list[str]) -> dict[str, str]:
    """The names under which the columns of ADDED come beside those of the table."""
    taken, names = {c.lower() for c in columns}, {}
    for c in ADDED:
        name = c
        while name in taken:
            name += "_"
        taken.add(name)
        names[c] = name
    return names


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"))


OP9_SQL = """
WITH base AS (
  SELECT doc_id, source, '=' || source AS s, len(regexp_extract_all(text, '[^ \\t-\\r]+')) AS n,
         ('0x' || md5('mix' || doc_id)[1:3])::BIGINT AS block, ('0x' || md5('mix' || doc_id)[4:15])::BIGINT AS k
  FROM documents),
totals AS (SELECT s, sum(n) AS n FROM base GROUP BY s),
shares AS (SELECT s, n, n / (SELECT sum(n) FROM totals) AS p FROM totals),
solved AS (
  SELECT CASE WHEN max(p) / min(p) <= 1.5 THEN 0.0 ELSE 1 - ln(1.5) / ln(max(p) / min(p)) END AS a, max(p) AS top FROM shares),
quotas AS (
  SELECT s, n, floor(n * pow(top / p, 1 - a) + 1e-6)::BIGINT AS wanted, wanted // n AS whole, wanted - whole * n AS quota
  FROM shares, solved),
blocks AS (
  SELECT b.s, b.block, sum(b.n) AS n, any_value(quota) AS quota,
         ('0x' || md5('mix/' || any_value(whole) || '/' || b.block || '/' || b.s)[1:12])::BIGINT AS turn
  FROM base b JOIN quotas q ON b.s = q.s WHERE quota > 0 GROUP BY b.s, b.block),
ran AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY turn, block) - n AS before FROM blocks),
rows_ran AS (
  SELECT b.doc_id, b.s, b.block, r.before + r.n <= r.quota AS all_of_it,
         r.before + sum(b.n) OVER (PARTITION BY b.s, b.block ORDER BY b.k) <= r.quota AS some
  FROM base b JOIN ran r ON b.s = r.s AND b.block = r.block)
SELECT b.doc_id, b.source, b.n AS n_tokens, e.epoch, b.block
FROM base b JOIN quotas q ON b.s = q.s LEFT JOIN rows_ran r ON r.doc_id = b.doc_id AND r.s = b.s,
     LATERAL (SELECT unnest(range(0, (q.whole + CASE WHEN r.all_of_it OR r.some THEN 1 ELSE 0 END)::BIGINT))::INT AS epoch) e
"""
