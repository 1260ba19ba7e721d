"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of the record batches that Python works on at a time.
SLICE_BYTES = 4 << 20
#: Bytes of documents that one file of a stage should hold.
FILE_BYTES = 128 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset (tests), a new local one.

    Raises where it is unset and the executors are other machines, which would not see a folder of the driver's.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioflow-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, where it is there, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def packed(df: DataFrame, source: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """df, to be written as few files: one for file_bytes of the source's files, and two a core at least. Nothing is shuffled."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // file_bytes))
    return df.coalesce(min(files, 1 << 30))  # a size that isn't known counts as the largest


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder: lineage ends there and a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, as after a cut, without waiting for its own turn.

    Beside the work that goes on: what a first look frees still holds the files, which a later look finds.
    """

    def look() -> None:
        for _ in range(3):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(1)

    threading.Thread(target=look, daemon=True).start()


def prefix_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `rank`, gapless from 0 within each combination of `keys`, without sorting a key in one task.

    df must be cut (its partitions fixed). Rows are numbered inside (partition, key); only one count per
    partition and key goes through a window.
    """
    at = df.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_mid", 33))
    counts = at.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = W.partitionBy("_pid", *keys).orderBy("_mid")
    numbered = at.withColumn("_rn", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["_pid", *keys]).withColumn(
        "rank", (F.col("_off") + F.col("_rn")).cast("long")
    ).drop("_off", "_rn", "_pid", "_mid")


def _free() -> None:
    """Gives what a finished task no longer needs back to the machine: a reused Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of SLICE_BYTES or so, a row at least."""
    for batch in batches:
        step = max(1, len(batch) * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
        if step >= len(batch):
            yield batch
        else:
            yield from (batch.slice(lo, step) for lo in range(0, len(batch), step))


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow over small batches; a task's memory goes back to the machine when it ends.

    The session's bound on the bytes of a batch sent to Python is lowered to SLICE_BYTES: by rows alone, long texts
    would make batches of any size.
    """
    spark = df.sparkSession
    ship(spark)
    held = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", (spark.conf.get(BATCH_BYTES, None) or "").strip().lower())  # unset: none
    if not held or not 0 < int(held[1]) << 10 * " kmgt".index(held[2] or " ") <= SLICE_BYTES:
        spark.conf.set(BATCH_BYTES, SLICE_BYTES)

    def sliced(batches):
        try:
            yield from run(slices(batches))
        finally:
            _free()

    return df.mapInArrow(sliced, schema)


def freeing(run):
    """run over whole groups, giving memory back after each."""

    def freed(*tables: pa.Table) -> pa.Table:
        try:
            return run(*tables)
        finally:
            _free()

    return freed


def own(name: str, *frames: DataFrame) -> str:
    """A column name that begins with `name` and is in none of the frames."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_key(rows: DataFrame, few: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of `few`, which has one row for each key of rows, null included, and the key's number of rows in `count`.

    Keys that hold a thousandth of all rows or more, of which there are 1,000 at most, come by broadcast; the rest
    meet in an equi-join, where no key has more than that thousandth. rows should be cut: it is read twice.
    """
    few = cut(few)
    total = few.agg(F.sum(count)).first()[0] or 0
    names = [c for c in few.columns if c not in (key, count)]
    held = few.select(F.col(key).alias("_key"), count, *names)
    hot, rest = held.where(F.col(count) * 1000 >= total), held.where(F.col(count) * 1000 < total)
    same = F.col(key).eqNullSafe(F.col("_key"))
    out = rows.join(F.broadcast(hot), same).unionByName(rows.join(F.broadcast(hot.select("_key")), same, "left_anti").join(rest, same))
    return out.select(*rows.columns, *names)
