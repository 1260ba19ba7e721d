"""Folds over the rows of a reading session: its status, its lifecycle, bursts of edits, and who acted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def status_history(runs: DataFrame, key: str = "session", order=("ts", "id"), outcome: str = "outcome") -> DataFrame:
    """Runs with `version` and `status` after each: compiling, ready, error before the first success, stale after it.

    outcome is started, succeeded or failed; version counts the successes so far. Other outcomes and null leave
    both as they are; before the first known outcome the status is idle.
    """
    so_far = W.partitionBy(key).orderBy(*order)
    version = F.count_if(F.col(outcome) == "succeeded").over(so_far)
    known = F.last(F.when(F.col(outcome).isin("started", "succeeded", "failed"), F.col(outcome)), ignorenulls=True).over(so_far)
    known_now = F.col("_known")
    status = F.when(known_now == "started", "compiling").when(known_now == "succeeded", "ready").when(
        known_now == "failed", F.when(F.col("version") == 0, "error").otherwise("stale")
    ).otherwise("idle")
    return runs.withColumns({"version": version, "_known": known}).withColumn("status", status).drop("_known")


def lifecycle(events: DataFrame, key: str = "session", instance: str = "instance", order=("ts", "id"), kind: str = "type") -> DataFrame:
    """The opened, rehydrated and closed rows that count: an instance is rehydrated once, and opened or closed only if it wasn't so before."""
    own = W.partitionBy(key, instance).orderBy(*order)
    rows = events.where(F.col(kind).isin("opened", "rehydrated", "closed"))
    again = F.row_number().over(W.partitionBy(key, instance, kind).orderBy(*order))
    rows = rows.withColumns({"_nth": again, "_before": F.lag(kind).over(own)})
    counts = F.when(F.col(kind) == "rehydrated", F.col("_nth") == 1).otherwise(
        F.col("_before").isNull() | (F.col("_before") != F.col(kind))
    )
    return rows.where(counts).drop("_nth", "_before")


def changed_notes(snapshots: DataFrame, version: str = "version", key: str = "note", digest: str = "sha256") -> DataFrame:
    """(version, key, change) of each note that a version changes: added, removed or changed against the version before.

    The first version changes nothing. One join of the snapshots with themselves, a version later; a row a change.
    """
    now = snapshots.select(version, key, F.col(digest).alias("_now"))
    before = snapshots.select((F.col(version) + 1).alias(version), key, F.col(digest).alias("_before"))
    ends = snapshots.agg(F.min(version).alias("_lo"), F.max(version).alias("_hi"))  # one row
    both = now.join(before, [version, key], "full").join(F.broadcast(ends)).where(
        (F.col(version) > F.col("_lo")) & (F.col(version) <= F.col("_hi"))
    )
    change = F.when(F.col("_now").isNull(), "removed").when(F.col("_before").isNull(), "added").when(F.col("_now") != F.col("_before"), "changed")
    return both.select(version, key, change.alias("change")).where("change is not null")


def content_changes(snapshots: DataFrame, version: str = "version", key: str = "note", digest: str = "sha256") -> DataFrame:
    """(version, notes, removed) as one row a version, as a journal has them: sorted keys new or changed, and gone. For versions of few changes; see changed_notes."""
    gone = F.col("change") == "removed"
    return changed_notes(snapshots, version, key, digest).groupBy(version).agg(
        F.array_sort(F.collect_set(F.when(~gone, F.col(key)))).alias("notes"), F.array_sort(F.collect_set(F.when(gone, F.col(key)))).alias("removed")
    )


def bursts(events: DataFrame, quiet_ms: int, key: str = "session", ts: str = "ts", order=("ts", "id")) -> DataFrame:
    """(key, first, last, n) of runs of events with at most quiet_ms between neighbours: one compile for each, after its last event."""
    own = W.partitionBy(key).orderBy(*order)
    gap = F.timestamp_diff("MILLISECOND", F.lag(ts).over(own), F.col(ts))
    rows = events.withColumn("_new", F.when(gap.isNull() | (gap > quiet_ms), 1).otherwise(0))
    rows = rows.withColumn("_burst", F.sum("_new").over(own))
    return rows.groupBy(key, "_burst").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("_burst")


def by_actor(events: DataFrame, actor: str = "actor") -> tuple[DataFrame, DataFrame]:
    """(what the student did, what the tutor did): the tutor's rows are journaled and count for nothing else. A missing actor is the student."""
    tutor = F.coalesce(F.col(actor), F.lit("student")) == "tutor"
    return events.where(~tutor), events.where(tutor)
