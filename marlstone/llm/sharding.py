"""Operator 5, sharding: longest-processing-time scheduling of groups that stay together.

Equal texts form a group. Groups go to shards from the largest down, each to
the least-loaded shard (ties: the lowest), which keeps the shards' bytes near
equal (law ``bytes``).

Groups are sorted by size, the largest first, by one range shuffle, and taken by class: sizes below
4096 are classes of their own, larger ones keep twelve leading binary digits, so there are at
most some 110,000 classes whatever the corpus. Only the classes' counts and sums reach the driver.
There the heap deals items of one size to shards by turns: as soon as shards are level they take turns in a fixed
order, so a class of any count is a few runs of turns. A group's turn is its rank in the
global sort, from counts of each (partition, class) and a rank within it.

A large class's items are dealt as if they had its mean size. Classes are apart, so all together this shifts
a shard's load by less than the largest group's size. The loads of all large groups are then summed truly, and groups below
4096 bytes, whose sizes are exact, are dealt on top of these: they level the shards as LPT does.

Cases: a null text counts as no bytes and belongs with the empty texts. Rows
that repeat are each kept, in their group's shard. A null doc_id takes a slot before
the others of its shard. Other columns are ignored. An empty table gives no rows.
A group larger than an even share sits alone in its shard, as LPT leaves it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SHARDS = 8
DIGITS = 12


def size_class(size: Column) -> Column:
    """size with its DIGITS leading binary digits kept and the rest 0; exact below 2 ** DIGITS."""
    length = F.length(F.bin(size))
    drop = F.greatest(length - F.lit(DIGITS), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


Turns = list[tuple[int, list[int]]]


def deal(loads: list[int], size: int, count: int) -> tuple[Turns, list[int]]:
    """LPT's turns for `count` items of one size, runs of (first item, shards that take turns), and how many each shard takes."""
    turns: Turns = []
    dealt = [0] * len(loads)
    heap = [(load, j) for j, load in enumerate(loads)]
    heapq.heapify(heap)
    level: list[tuple[int, int]] = []  # (load, shard) of those within one size of each other, the next one first
    at = 0
    while at < count:
        if heap and (not level or heap[0] < level[0]):
            level.append(heapq.heappop(heap))
            level.sort()
            continue
        # How many items each takes while the shards outside are fuller: those that start before the first of them.
        edge = heap[0] if heap else None
        if edge is None:
            taken = count - at
        else:
            taken = min(count - at, sum((edge[0] - load + (size - 1 if j > edge[1] else size)) // size if (load, j) < edge else 0 for load, j in level))
        turns.append((at, [j for _, j in level]))
        whole, part = divmod(taken, len(level))
        for k, (load, j) in enumerate(level):
            n = whole + (k < part)
            dealt[j] += n
            level[k] = (load + n * size, j)
        level.sort()
        at += taken
    return turns, dealt


def schedule(classes: list[tuple[int, int, int]], loads: list[float]) -> tuple[dict[int, Turns], list[float]]:
    """Turns of each (class, count, bytes), largest class first, upon the shards' loads; and the loads after them."""
    found: dict[int, Turns] = {}
    for name, count, total in sorted(classes, reverse=True):
        mean = total / count
        found[name], dealt = deal([round(x) for x in loads], max(1, round(mean)), count)
        loads = [x + n * mean for x, n in zip(loads, dealt, strict=True)]
    return found, loads


def assign_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(gid, size) of each group to (gid, shard)."""
    spark = groups.sparkSession
    ranged = shared.written(
        groups.select("gid", "size", size_class(F.col("size")).alias("cls"))
        .repartitionByRange(shared.partitions(spark), F.desc("size"), "gid")
        .withColumn("pid", F.spark_partition_id()),
        "shard-groups",
    )
    counted = sorted(ranged.groupBy("cls", "pid").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect(), key=lambda r: r["pid"])
    classes: dict[int, list[int]] = {}
    for r in counted:
        total = classes.setdefault(r["cls"], [0, 0])
        total[0] += r["n"]
        total[1] += r["bytes"]

    def placed(turns: dict[int, Turns]) -> DataFrame:
        segments, before = [], dict.fromkeys(turns, 0)
        for r in counted:
            if r["cls"] in turns:
                segments.append((r["cls"], r["pid"], before[r["cls"]], turns[r["cls"]]))
                before[r["cls"]] += r["n"]
        known = spark.createDataFrame(segments, "cls long, pid int, base long, turns array<struct<first:long,shards:array<int>>>")
        rank = F.col("base") + F.row_number().over(Window.partitionBy("pid", "cls").orderBy(F.desc("size"), "gid")) - 1
        # A row for each class and for each partition's edge: bounded by the number of classes, so it can be broadcast.
        ranks = ranged.join(F.broadcast(known), ["cls", "pid"]).withColumn("rank", rank)
        run = F.element_at(F.filter("turns", lambda t: t["first"] <= F.col("rank")), -1)
        own = F.get(run["shards"], ((F.col("rank") - run["first"]) % F.size(run["shards"])).cast("int"))
        return ranks.select("gid", "size", own.alias("shard"))

    large = [(c, n, b) for c, (n, b) in classes.items() if c >= 1 << DIGITS]
    turns, _ = schedule(large, [0.0] * shards)
    loads = [0.0] * shards
    if large:
        for r in placed(turns).groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
            loads[r["shard"]] = float(r["bytes"])
    turns |= schedule([(c, n, b) for c, (n, b) in classes.items() if c < 1 << DIGITS], loads)[0]
    return placed(turns).select("gid", "shard")


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows of each shard from 0 in the given order, without one task for a shard."""
    spark = rows.sparkSession
    ranged = shared.written(rows.repartitionByRange(shared.partitions(spark), "shard", *order).withColumn("pid", F.spark_partition_id()), "shard-slots")
    counted = ranged.groupBy("shard", "pid").count().orderBy("shard", "pid").collect()
    bases, before = [], {}
    for r in counted:
        base = before.get(r["shard"], 0)
        bases.append((r["shard"], r["pid"], base))
        before[r["shard"]] = base + r["count"]
    known = spark.createDataFrame(bases, "shard int, pid int, base long")
    within = F.row_number().over(Window.partitionBy("shard", "pid").orderBy(*order))
    # At most a row for each partition and shard edge.
    return ranged.join(F.broadcast(known), ["shard", "pid"]).withColumn("slot", F.col("base") + within - 1).drop("pid", "base")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    base = shared.written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("gid"),
        ),
        "shard-rows",
    )
    groups = base.groupBy("gid").agg(F.sum("size").alias("size"))
    placed = base.join(assign_groups(groups, shards), "gid").select("doc_id", "size", "text_crc32", "shard")
    return slots(placed, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(shared.table(spark, sf_dir, "documents"))
