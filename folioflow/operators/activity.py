"""Operators over an append-only activity log: ordered by (time, id) within a key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _own(key, order):
    return W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([order] if isinstance(order, str) else order))


def gap_ms(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", earlier, later)


def capped_time(
    events: DataFrame, key: str = "user_id", ts: str = "ts", order=("ts", "event_id"), cap_ms: int = 600_000, counted: Column | None = None
) -> DataFrame:
    """(key, capped_ms): the time after each counted event to the key's next one, cap_ms at most; the last event adds 0."""
    e = events if counted is None else events.where(counted)
    nxt = F.lead(ts).over(_own(key, list(order)))
    spent = F.least(gap_ms(F.coalesce(nxt, F.col(ts)), F.col(ts)), F.lit(cap_ms))
    return e.select(key, spent.alias("ms")).groupBy(key).agg(F.sum("ms").alias("capped_ms"))


def last_state(
    events: DataFrame, key: str = "user_id", state: str = "event_type", order=("ts", "event_id"), ever: Column | None = None
) -> DataFrame:
    """(key, last_state, ever): the last state by order, and whether `ever` held at any time. One partial aggregation."""
    return events.groupBy(key).agg(
        F.max_by(state, F.struct(*order)).alias("last_state"),
        F.bool_or(F.coalesce(ever, F.lit(False)) if ever is not None else F.lit(False)).alias("ever")
    )


def first_only(events: DataFrame, keys=("user_id", "event_type"), order=("ts", "event_id")) -> DataFrame:
    """The first row of each key, by a partial aggregation instead of a sort."""
    row = F.struct(*order, *[c for c in events.columns if c not in order])
    return events.groupBy(*keys).agg(F.min(row).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in events.columns])


def running_max(events: DataFrame, key: str = "user_id", value: str = "value", order=("ts", "event_id")) -> DataFrame:
    """Rows whose value exceeds all earlier ones of the key."""
    before = F.max(value).over(_own(key, list(order)).rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(value) > F.col("_before"))).drop("_before")


def position_latest(events: DataFrame, keys, latest: str, order=("ts", "event_id")) -> DataFrame:
    """(keys, latest, visits)."""
    return events.groupBy(*keys).agg(F.max_by(latest, F.struct(*order)).alias("latest"), F.count(F.lit(1)).alias("visits"))


def tail(events: DataFrame, key: str = "user_id", n: int = 30, order=("ts", "event_id")) -> DataFrame:
    """The last n rows of each key with `omitted`, the number of earlier ones."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    counts = events.groupBy(key).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("omitted"))
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn").join(counts, key)


def after_cursor(events: DataFrame, cursor: int | Column, key: str = "user_id", order=("ts", "event_id")) -> DataFrame:
    """T4: rows past the cursor-th of their key, with their position from 1."""
    return events.withColumn("seq", F.row_number().over(_own(key, list(order)))).where(F.col("seq") > cursor)


def validate(events: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Every row with accepted and the first failing reason (null if none). A rule that is null fails."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    return events.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def clamp_time(events: DataFrame, now: Column, past_days: int, ts: str = "ts") -> DataFrame:
    """Ts stays if it isn't in the future nor more than past_days ago; else it becomes now. `clamped` says so."""
    good = F.coalesce((F.col(ts) <= now) & (F.col(ts) >= now - F.make_dt_interval(F.lit(past_days))), F.lit(False))
    return events.withColumn("clamped", ~good).withColumn(ts, F.when(good, F.col(ts)).otherwise(now))


def accepted_events(events: DataFrame, interval_ms: int, key: str = "user_id", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """T5: (key, ts, event_id) of each event since whose key's last accepted one interval_ms passed, in the order of (ts, id).

    A fold over sorted rows: a task holds one time, whatever the length of a key's log. Rows without a time are never accepted.
    """
    kinds = dict(events.dtypes)
    step = interval_ms * 1000

    def run(batches):
        name, last = None, None
        for batch in batches:
            keep = []
            for i, (k, when) in enumerate(zip(batch.column("key").to_pylist(), batch.column("micros").to_pylist())):
                if last is None or k != name or when - last >= step:
                    name, last = k, when
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep)).select(["key", "ts", "id"])

    rows = events.where(F.col(ts).isNotNull()).select(
        F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(event_id).alias("id"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("micros")
    )
    rows = rows.repartition("key").sortWithinPartitions("key", "micros", "id")
    return rows.mapInArrow(run, f"key {kinds[key]}, ts {kinds[ts]}, id {kinds[event_id]}").toDF(key, ts, event_id)


def rate_limited(events: DataFrame, interval_ms: int, key: str = "user_id", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """T5: (key, accepted, last_accepted): how many events of a key are accepted, and the last."""
    return accepted_events(events, interval_ms, key, ts, event_id).groupBy(key).agg(
        F.count(F.lit(1)).alias("accepted"), F.max_by(event_id, F.struct(ts, event_id)).alias("last_accepted")
    )


def asof_last(events: DataFrame, wanted: Column, marker: Column, value: str, key: str = "user_id", order=("ts", "event_id")) -> DataFrame:
    """Each wanted row with `found`: the value of the key's last marker row before it, null if none. One window, no self-join."""
    w = _own(key, list(order)).rowsBetween(W.unboundedPreceding, -1)
    return events.where(wanted | marker).withColumn("found", F.last(F.when(marker, F.col(value)), ignorenulls=True).over(w)).where(wanted)


def journal_folders(events: DataFrame, keys=("session", "layout"), ts: str = "ts", zone: str = "UTC") -> DataFrame:
    """(keys, folder): a session's journal for a layout lies in one folder, named by the local date of its first event; later days go on in it."""
    from ..functions.text import local_date

    first = events.groupBy(*keys).agg(F.min(ts).alias("_first"))
    day = local_date(F.col("_first").cast("timestamp"), zone).cast("string")
    return first.select(*keys, F.concat_ws("-", day, *[F.col(k).cast("string") for k in keys]).alias("folder"))


def link_counts(events: DataFrame, keys) -> DataFrame:
    """E5: (keys, n)."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def replay(events: DataFrame, cap_ms: int = 600_000) -> dict[str, DataFrame]:
    """Progress from events (seq, ts, type, actor, question, exercise, index, course, section, title, total, url, page).

    Tables questions, exercises, courses, sections, links and others (one row). Rows of the actor `tutor` count
    nowhere but in tutor_shows. Time goes to the event's question, else to its exercise, up to the session's next
    event; the log names its sessions, so that no task takes all of it.
    """
    if "session" not in events.columns:
        raise ValueError("the log has no column `session`")
    student = events.where(F.coalesce(F.col("actor"), F.lit("student")) != "tutor")
    nxt = F.lead("ts").over(W.partitionBy("session").orderBy("ts", "seq"))
    timed = student.withColumn("ms", F.least(gap_ms(F.coalesce(nxt, F.col("ts")), F.col("ts")), F.lit(cap_ms)))
    is_ = lambda *t: F.col("type").isin(*t)
    questions = timed.where("question is not null").groupBy("question").agg(
        F.coalesce(F.max(F.when(is_("hint_revealed"), F.col("index"))), F.lit(0)).alias("hints"),
        F.coalesce(F.bool_or(is_("correction_shown")), F.lit(False)).alias("correction_seen"),
        F.coalesce(
            F.max_by(is_("correction_shown"), F.when(is_("correction_shown", "correction_hidden"), F.struct("ts", "seq"))), F.lit(False)
        ).alias("correction"),
        F.count_if(
            is_("explanation_opened")
        ).alias("explanations"), F.count_if(is_("tutor_requested")).alias("tutor"), F.sum("ms").alias("ms"),
    )
    exercises = timed.where("exercise is not null").groupBy("exercise").agg(
        F.coalesce(F.sum(F.when(F.col("question").isNull(), F.col("ms"))), F.lit(0)).alias("ms"),
        F.bool_or(is_("exercise_started")).alias("started")
    )
    courses = student.where(is_("course_opened")).groupBy("course").agg(F.count(F.lit(1)).alias("opened"))
    sections = student.where(is_("course_section_opened")).groupBy("course", "section").agg(
        F.max_by("title", F.struct("ts", "seq")).alias("title"), F.max_by("total", F.struct("ts", "seq")).alias("total"),
        F.count(F.lit(1)).alias("visits")
    )
    links = link_counts(student.where(is_("link_opened", "pdf_opened")), ["type", "url", "page"])
    shows = events.agg(F.count_if((F.col("actor") == "tutor") & is_("tutor_show")).alias("tutor_shows"))
    return {"questions": questions, "exercises": exercises, "courses": courses, "sections": sections, "links": links, "others": shows}


def summary(progress: dict[str, DataFrame]) -> DataFrame:
    """(part, line) of a deterministic text that carries counts only."""
    from ..functions.text import escape_cell, minutes

    q, x = progress["questions"], progress["exercises"]
    return q.select(
        F.lit("question").alias("part"),
        F.concat_ws(
            " | ", escape_cell(F.col("question")), F.col("hints"), F.when(F.col("correction_seen"), "yes").otherwise("no"),
            F.col("explanations"), F.col("tutor"), minutes(F.col("ms"))
        ).alias("line")
    ).union(
        x.select(
            F.lit("exercise"),
            F.concat_ws(" | ", escape_cell(F.col("exercise")), F.when(F.col("started"), "started").otherwise("—"), minutes(F.col("ms")))
        )
    ).orderBy("part", "line")
