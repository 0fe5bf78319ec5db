"""Operator 13, conversation prefix trie: chained digests of prefixes, grouped to nodes, summed over subtrees.

A turn's digest is SHA-256 of role and text; a prefix's digest is SHA-256 of
the digest before it and the turn's, so two conversations share a node just if
their first turns agree. Only these 32 bytes travel, never the texts. Every
prefix is a row; rows of one (depth, digest) are a node.

Sums over subtrees send each node to all of its ancestors. Sent one by one,
that is the square of a conversation's length. So it is done by chains: the
nodes with one smallest member m lie below one another, on m's own way down.
Each chain goes once to every chain that m passes above it, at the deepest
place where it does, and a running sum from a chain's end upwards adds what
arrived below. That is at most a row for each turn of the conversations.

One place is sequential by definition: a conversation's digests, and the
SHA-256 of the ids that end at a node, which tasks stream in order from
strings of up to CHUNK ids that other tasks made.

Cases: turns are ordered by number, null first; turns of one number by their
digests. A null role or text is the empty string. Rows without a conv_id are
left out. Repeated rows are turns of their own. Other columns are ignored. An
empty table gives no rows. Ids below zero have c % 5 as Spark gives it (the
sign of c).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

ROOT = hashlib.sha256(b"").digest()
GROUP = 5
HEADS = 9
CHUNK = 5_000
PREFIXES = "conv_id long, depth int, digest binary, parent binary, text_bytes long, is_end boolean"


def head(conv_id: int, heads: int = HEADS) -> int:
    """How many of its first turns a conversation takes from the first of its group."""
    return zlib.crc32(str(conv_id).encode()) % heads


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, bytes of the text; within a task."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("said"), F.octet_length(text).cast("long").alias("text_bytes"))


def prefixes(said: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Every prefix of every rebuilt conversation, the textless one too.

    One shuffle by the group's first conversation, which comes first in its group. A task holds that one's
    first `heads` - 1 digests and the chain's last digest, however long a conversation is.
    """
    first = F.col("conv_id") - F.col("conv_id") % group
    ordered = said.withColumn("first", first).repartition("first").sortWithinPartitions("first", F.col("conv_id") != F.col("first"), "conv_id", "turn", "said").select("first", "conv_id", "said", "text_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha256, out = hashlib.sha256, []
        of_first, chain, now, skip = None, [], None, 0

        def said_next(turn: bytes, n: int) -> None:
            nonlocal last
            parent = last[2]
            last = [now, last[1] + 1, sha256(parent + turn).digest(), parent, n, False]
            out.append(last)

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "depth", "digest", "parent", "text_bytes", "is_end"])

        last = None
        for batch in batches:
            for base, conv, turn, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if base != of_first:
                    of_first, chain = base, []
                if conv != now:
                    if last is not None:
                        last[5] = True
                    now, skip = conv, 0
                    last = [conv, 0, ROOT, None, 0, False]
                    out.append(last)
                    if conv != base:
                        skip = head(conv, heads)
                        for x in chain[:skip]:
                            said_next(*x)
                if conv == base and len(chain) < heads - 1:
                    chain.append((turn, n))
                if skip:
                    skip -= 1
                else:
                    said_next(turn, n)
                if len(out) > 10_000:  # the last row waits: it may be an end
                    out.pop()
                    yield packed()
                    out[:] = [last]
        if last is not None:
            last[5] = True
            yield packed()

    return ordered.mapInArrow(run, PREFIXES)


def ends(rows: DataFrame) -> DataFrame:
    """digest, ends_sha256: of the ids of the conversations that end at each node, ascending.

    A range shuffle by node and id joins up to CHUNK ids to a string, so a node at which a third of all
    conversations end is dealt over tasks; the strings are then streamed through one hash for each node.
    """
    spark = rows.sparkSession
    ranged = rows.where("is_end").select("digest", "conv_id").repartitionByRange(shared.partitions(spark), "digest", "conv_id").sortWithinPartitions("digest", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        done: list[tuple] = []

        def packed() -> pa.RecordBatch:
            found = [list(x) for x in zip(*done, strict=True)] or [[], [], []]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string())], ["digest", "low", "ids"])

        for batch in batches:
            for digest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (digest != node or len(ids) >= CHUNK):
                    done.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = digest
                ids.append(conv)
            if done:
                yield packed()
        if ids:
            done.append((node, ids[0], ",".join(map(str, ids))))
            yield packed()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            found = []
            for digest, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest != node:
                    if state is not None:
                        found.append((node, state.hexdigest()))
                    node, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["digest", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])

    chunks = ranged.mapInArrow(join, "digest binary, low long, ids string")
    return chunks.repartition("digest").sortWithinPartitions("digest", "low").select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """A row for each node: see the module's docstring and the columns below."""
    spark = conversations.sparkSession
    with shared.scratch(spark) as kept:
        rows = shared.written(prefixes(turns(conversations), group, heads), "prefixes")
        grouped = rows.groupBy("depth", "digest").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("text_bytes").alias("text_bytes")
        )
        plain = shared.written(grouped, "grouped")
        children = plain.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
        nodes = shared.written(
            plain.join(children, "digest", "left").join(ends(rows), "digest", "left").select(
                "digest", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"), ((F.col("n_convs") - 1) * F.col("text_bytes")).alias("saved"),
                F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
            ),
            "nodes",
        )

        # A chain is named by its smallest member; `top` is the depth of its first node.
        chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
        chains = shared.written(chains, "chains")
        root = plain.where("depth = 0").select("conv_id").first()
        above = rows.where("depth > 0").join(chains.select("conv_id", "top"), "conv_id").where("depth < top").select(F.col("conv_id").alias("below"), "depth", "digest")
        passed = shared.looked_up(above, nodes.select("digest", F.col("conv_id").alias("chain")), "digest", "below").select("below", "chain", "depth")
        if root is not None:  # every other chain hangs below the textless node
            passed = passed.unionByName(chains.where("top > 0").select(F.col("conv_id").alias("below"), F.lit(root[0]).cast("long").alias("chain"), F.lit(0).alias("depth")))
        ancestors = shared.written(passed.groupBy("below", "chain").agg(F.max("depth").alias("depth")), "ancestors")

        sent = ancestors.join(chains.withColumnRenamed("conv_id", "below"), "below")
        arrived = sent.groupBy(F.col("chain").alias("conv_id"), "depth").agg(F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"))
        parents = sent.where(F.col("depth") == F.col("top") - 1).select(F.col("below").alias("conv_id"), F.col("top").alias("depth"), F.col("chain").alias("above"))
        upwards = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = nodes.join(arrived, ["conv_id", "depth"], "left").join(parents, ["conv_id", "depth"], "left").select(
            "conv_id", F.col("depth").cast("long").alias("depth"),
            F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"),
            "n_convs", "n_children",
            F.sum(F.col("leaf") + F.coalesce("leaves_below", F.lit(0))).over(upwards).alias("n_leaves"),
            F.sum(F.col("saved") + F.coalesce("saved_below", F.lit(0))).over(upwards).alias("saved_tokens"),
            "ends_sha256",
        )
        return kept(summed, "trie")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(shared.table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH RECURSIVE turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id AS c, conv_id - conv_id % {GROUP} AS base, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS register
    FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (
    SELECT c, base, xor(register, 4294967295) % {HEADS} AS h FROM convs
), rebuilt AS (
    SELECT c, k, t.role, t.text FROM heads JOIN turns AS t ON t.conv_id = base AND (k <= h OR c = base)
    UNION ALL SELECT c, k + 1000000 AS k, t.role, t.text FROM heads JOIN turns AS t ON t.conv_id = c AND k > h AND c <> base
), numbered AS (
    SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY k) AS depth FROM rebuilt
), lengths AS (
    SELECT heads.c, count(numbered.c) AS n FROM heads LEFT JOIN numbered ON numbered.c = heads.c GROUP BY heads.c
), prefixes AS (
    SELECT c, 0::BIGINT AS depth, sha256('') AS digest, NULL::VARCHAR AS parent, 0 AS size FROM heads
    UNION ALL
    SELECT p.c, p.depth + 1, sha256(p.digest || sha256(strlen(t.role)::VARCHAR || ':' || t.role || t.text)), p.digest, strlen(t.text)
    FROM prefixes AS p JOIN numbered AS t ON t.c = p.c AND t.depth = p.depth + 1
), nodes AS (
    SELECT depth, digest, min(c) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(size) AS size,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = n), '')) AS ends_sha256
    FROM prefixes JOIN lengths USING (c) GROUP BY depth, digest
), counted AS (
    SELECT v.*, u.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children
    FROM nodes AS v LEFT JOIN nodes AS u ON u.digest = v.parent LEFT JOIN (SELECT parent AS digest, count(*) AS n FROM nodes GROUP BY parent) AS k ON k.digest = v.digest
), sums AS (
    SELECT a.digest, sum((v.n_convs - 1) * v.size) AS saved, count(*) FILTER (WHERE v.n_children = 0) AS leaves
    FROM counted AS v JOIN prefixes AS a ON a.c = v.conv_id AND a.depth <= v.depth GROUP BY a.digest
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (digest)
"""
