"""Sinks: refused when stale, deterministic, complete or not there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import manifest_check, plan_hash
from .scratch import path_in, put_folder


#: Marks an output that was begun; Spark's own mark says that it was ended.
WRITING, WRITTEN = "_WRITING", "_SUCCESS"


def output_status(spark: SparkSession, path: str) -> str:
    """B2: absent; writing, where an output was begun and never ended; written; or foreign, where something else stands there."""
    names = path_in(spark, path).names()
    if WRITTEN in names:
        return "written"
    return "writing" if WRITING in names else "foreign" if path_in(spark, path).there() else "absent"


def materialize(plan: DataFrame, approved: str, path: str) -> None:
    """Writes a plan whose hash is the approved one to a path that isn't there yet; _SUCCESS marks it complete.

    The path is taken by a mark first. The plan is computed once, into a folder beside it; what stands there is hashed
    and, if approved, moved to the path. A plan that has changed leaves nothing. A write that fails leaves what it has
    written where it is and the path marked as being written, so that nothing takes it for an output, or its place.
    """
    spark = plan.sparkSession
    claim, staged = path_in(spark, path), path_in(spark, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}")
    mark = path_in(spark, f"{path.rstrip('/')}/{WRITING}")
    if claim.there() or not mark.files.createNewFile(mark.at):
        raise FileExistsError(path)
    plan.write.mode("errorifexists").parquet(staged.at.toString())
    if plan_hash(spark.read.parquet(staged.at.toString())).first()[0] != approved:
        staged.remove()
        claim.remove()
        raise ValueError("the plan has changed since it was approved")
    claim.remove()
    if not staged.rename(claim):
        raise FileExistsError(path)


def copy_approval(record: DataFrame, target: str) -> str:
    """The hash that approves copying what a record names to a target; it changes with either."""
    return plan_hash(record.select("path", "sha256", F.lit(target.rstrip("/")).alias("target"))).first()[0]


def copy_findings(record: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of a record (path, sha256) and the files (path, content) it should name: missing, hash, unexpected, or hidden, which a record may not name."""
    visible = ~F.col("path").rlike(r"(^|/)\.")
    present = files.where(visible).select("path", F.sha2("content", 256).alias("sha256"))
    hidden = record.where(~visible).select("path", F.lit("hidden").alias("problem"))
    return manifest_check(record.where(visible).select("path", "sha256"), present).unionByName(hidden)


def copy_recorded(record: DataFrame, files: DataFrame, target: str, approved: str) -> None:
    """Copies exactly the recorded files to a folder that isn't there yet, as rows (path, sha256, content).

    Refused where the copy isn't what was approved, or the files aren't what is recorded: one that is missing, differs,
    stands beside the record, or is hidden. The bytes that were written are hashed again before the folder gets its
    name, so a copy is whole and right, or not there.
    """
    if path_in(record.sparkSession, target).there():
        raise FileExistsError(target)
    if copy_approval(record, target) != approved:
        raise ValueError("the copy has changed since it was approved")
    if not copy_findings(record, files).isEmpty():
        raise ValueError("the files aren't those that are recorded")

    def check(written: DataFrame) -> None:
        if not written.where(~F.sha2("content", 256).eqNullSafe(F.col("sha256"))).isEmpty() or written.count() != record.count():
            raise ValueError("the files changed while they were copied")

    put_folder(files.join(record.select("path", "sha256"), "path").select("path", "sha256", "content"), target, "parquet", check)


def compile_json(rows: DataFrame, order: list[str]) -> DataFrame:
    """One JSON line a row in a fixed order with fixed fields, so that equal inputs give equal bytes."""
    return rows.orderBy(*order).select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def changed_only(new: DataFrame, old: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose bytes differ from the ones there, by hash."""
    a = new.withColumn("_h", F.sha2(text, 256))
    b = old.select(F.col(key).alias("_k"), F.sha2(text, 256).alias("_o"))
    return a.join(b, a[key] == b["_k"], "left").where(F.col("_o").isNull() | (F.col("_o") != F.col("_h"))).drop("_h", "_k", "_o")


def append_journal(events: DataFrame, path: str, batch: str) -> bool:
    """Appends a batch of events to the journal at path, in folders of batch, date and session; false if that batch is there already.

    A batch gets its name once it is whole, so a cut leaves none of it, and one that is given again adds nothing.
    """
    at = f"{path.rstrip('/')}/batch={batch}"
    if path_in(events.sparkSession, at).there():
        return False
    put_folder(events, at, by=["date", "session"])
    return True


def retained(before: DataFrame, after: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key) of files whose bytes aren't what they were."""
    a, b = (d.select(key, F.sha2(content, 256).alias(f"_{i}")) for i, d in enumerate((before, after)))
    return a.join(b, key, "left").where(F.col("_1").isNull() | (F.col("_0") != F.col("_1"))).select(key)
