"""What the corpus operators share: the shared folder, written tables and plain file access from tasks."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = 1000
HOT_ROWS = 2000
MOST_HOT = 1000
TURNS = 64

_OWN: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder stands in, but only with a local
    master, where driver and executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="marlstone-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written since the innermost scratch() of this thread began.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; within scratch() it is deleted at the end, unless kept.

    Cuts the lineage: a lost executor costs later stages nothing, and a table
    that is read twice is computed once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    scope = _SCOPE.get()
    if scope is not None and not keep:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that this thread writes within are deleted at its end, but for those of the function that it gives.

    The latter belong to the scratch() around it, if there is one.
    """
    paths: list[str] = []
    outer = _SCOPE.get()
    token = _SCOPE.set(paths)

    def kept(df: DataFrame, name: str) -> DataFrame:
        inner = _SCOPE.set(outer)
        try:
            return written(df, name)
        finally:
            _SCOPE.reset(inner)

    try:
        yield kept
    finally:
        _SCOPE.reset(token)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def modest_batches(spark: SparkSession) -> None:
    """Rows go to Python BATCH_ROWS at a time instead of 10,000, unless the session asks for fewer: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(uri: str):
    """pyarrow file system and path of a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    """A stream to a new file, for tasks. Names must hold the task attempt, so that no two attempts write one file."""
    system, path = file_system(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A seekable file, for tasks."""
    system, path = file_system(uri)
    return system.open_input_file(path)


def attempt_name() -> str:
    """Partition number and task attempt: a file name that no other attempt uses."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """rows left-joined with table, which is unique by key. Keys of HOT_ROWS rows or more are dealt over TURNS tasks by `spread`.

    The driver sees MOST_HOT keys at most; should there be more hot ones, the largest are dealt.
    """
    counted = rows.groupBy(key).count().where(F.col("count") >= HOT_ROWS).orderBy(F.desc("count")).limit(MOST_HOT)
    hot = [r[0] for r in counted.select(key).collect()]
    if not hot:
        return rows.join(table, key, "left")
    is_hot = F.col(key).isin(hot)
    dealt = rows.withColumn("_turn", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(TURNS))).otherwise(F.lit(0).cast("long")))
    copied = table.withColumn("_turn", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(TURNS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return dealt.join(copied, [key, "_turn"], "left").drop("_turn")
