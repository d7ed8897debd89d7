"""Shared by the operators: saved tables, let-binding in expressions, prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode alone, one of our own where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a batch that Python gets: batches are held several times, in the JVM and in each worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, for texts of any length; a bound that the session sets stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") == "1":  # not set
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def releasing(run: Callable) -> Callable:
    """The mapInArrow function run, with release() when a task's input ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def saved(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: cuts the lineage.

    The files survive the loss of executors; they go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of saved() that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def free(df: DataFrame, *names: str) -> None:
    """Refuses names that df has already."""
    if taken := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns exist already: {', '.join(sorted(taken))}")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


#: Elements that one step of prefix_sums handles.
_BLOCK = 256


def prefix_sums(lengths: Column) -> Column:
    """The sum of what stands before each element of an array<int>, as array<bigint>.

    Two levels of blocks keep it near linear: a plain fold copies its array at each step.
    """
    zero = F.lit(0).cast("bigint")

    def running(xs: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), zero.alias("sum"))

        def step(acc: Column, x: Column) -> Column:
            return F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + x).alias("sum"))

        return F.aggregate(xs, start, step, lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int"))
        parts = F.transform(starts, lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))
        sums = lambda ps: running(F.transform(ps, lambda p: F.aggregate(p, zero, lambda a, x: a + x)))
        joined = lambda ps, before: F.flatten(F.zip_with(ps, before, lambda p, at: F.transform(running(p), lambda x: x + at)))
        return let(parts, lambda ps: let(sums(ps), lambda before: joined(ps, before)))

    empty = F.array().cast("array<bigint>")
    return let(lengths, lambda xs: F.when(F.size(xs) > 0, blocks(xs)).otherwise(empty))


def whole(text: str = "text") -> Column:
    """The text, missing ones as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, modulo by; the fold rule of the learned operators."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(by))
