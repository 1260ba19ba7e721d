"""Sessions as streams: lifecycle, status and first rows by event time, in one stateful operator each.

Rows wait until the watermark has passed them and are then folded in the order of (ts, id), so what comes shuffled,
late (by less than the delay) or after a restart gives what the batch folds give over the whole log. The operators
need the RocksDB state store, which the caller's session has to name (see `stream_session`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB; the caller's own session stays as it is."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(PROVIDER, ROCKSDB)
    return own


def _ready(events: DataFrame) -> None:
    spark = events.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"{PROVIDER} must be {ROCKSDB}")
    ship(spark)


class _Waiting(StatefulProcessor):
    """Holds a key's rows (us, id, ...) until the watermark has passed them; `fold` gets them in order."""

    held = "array<struct<us:long,id:long,kind:string,instance:string,outcome:string>>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", f"rows {self.held}")
        self.timer = handle.getValueState("timer", "at long")

    def _set_timer(self, at: int | None) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if at == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802,N803
        held = list(self.pending.get()[0]) if self.pending.exists() else []
        held += [(r["us"], r["id"], r["kind"], r["instance"], r["outcome"]) for r in rows]
        self.pending.update(([tuple(r) for r in held],))
        self._next()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802,N803
        self.timer.clear()  # the one that fired is gone
        until = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.pending.get()[0]] if self.pending.exists() else []
        due = sorted((r for r in held if r[0] <= until * 1000), key=lambda r: r[:2])
        rest = [r for r in held if r[0] > until * 1000]
        if rest:
            self.pending.update((rest,))
        else:
            self.pending.clear()
        out = list(self.fold(key, due))
        self.forget(until)
        self._next()
        return iter(out)

    def _next(self) -> None:
        """One timer a key: where its next row is due, or something is to be forgotten."""
        held = self.pending.get()[0] if self.pending.exists() else []
        at = [-(-min(r[0] for r in held) // 1000)] if held else []
        self._set_timer(min(at + self.reminders(), default=None))

    def reminders(self) -> list[int]:
        return []

    def forget(self, until: int) -> None:
        pass

    def close(self) -> None:
        pass


class SessionFold(_Waiting):
    """Which lifecycle rows count, and the version and status after each row.

    State of a session: its successes and last known outcome, and for each instance the last of opened and closed and
    whether it was rehydrated. An instance that was silent for keep_ms of event time is forgotten, and the session's
    own state with its last instance or row; one that comes back later begins anew.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.status = handle.getValueState("status", "version long, known string, seen long")
        self.instances = handle.getMapState("instances", "instance string", "last string, rehydrated boolean, seen long")

    def fold(self, key, due) -> Iterator[Row]:
        version, known, seen = self.status.get() if self.status.exists() else (0, None, None)
        at: dict[str, tuple] = {}
        for us, id_, kind, instance, outcome in due:
            seen, counts = us // 1000, None
            if kind in ("opened", "rehydrated", "closed"):
                name = (instance or "", )
                if name[0] not in at:
                    at[name[0]] = tuple(self.instances.getValue(name)) if self.instances.containsKey(name) else (None, False, 0)
                last, rehydrated, _ = at[name[0]]
                counts = not rehydrated if kind == "rehydrated" else last != kind
                at[name[0]] = (kind, rehydrated or kind == "rehydrated", seen)
            if outcome in ("started", "succeeded", "failed"):
                known = outcome
                version += outcome == "succeeded"
            status = {"started": "compiling", "succeeded": "ready", "failed": "stale" if version else "error"}.get(known, "idle")
            yield Row(session=key[0], id=id_, ts=_EPOCH + timedelta(microseconds=us), counts=counts, version=version, status=status)
        if due:
            self.status.update((version, known, seen))
        for name, value in at.items():
            self.instances.updateValue((name,), value)

    def reminders(self) -> list[int]:
        seen = [v[2] for v in self.instances.values()] + ([self.status.get()[2]] if self.status.exists() else [])
        return [min(seen) + self.keep_ms] if seen else []

    def forget(self, until: int) -> None:
        for name in [tuple(k) for k, v in self.instances.iterator() if v[2] + self.keep_ms <= until]:
            self.instances.removeKey(name)
        if self.status.exists() and self.status.get()[2] + self.keep_ms <= until and not self.pending.exists():
            self.status.clear()


class FirstFold(_Waiting):
    """The first row of a key by (ts, id); the key is remembered for keep_ms of event time, and what comes then adds nothing."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.told = handle.getValueState("told", "seen long")

    def fold(self, key, due) -> Iterator[Row]:
        if due and not self.told.exists():
            us, id_, *_ = due[0]
            self.told.update((us // 1000,))
            yield Row(session=key[0], id=id_, ts=_EPOCH + timedelta(microseconds=us), counts=True, version=0, status="first")

    def reminders(self) -> list[int]:
        return [self.told.get()[0] + self.keep_ms] if self.told.exists() else []

    def forget(self, until: int) -> None:
        if self.told.exists() and self.told.get()[0] + self.keep_ms <= until:
            self.told.clear()


OUT = "session string, id long, ts timestamp, counts boolean, version long, status string"


def _folded(events: DataFrame, fold: StatefulProcessor, delay: str) -> DataFrame:
    _ready(events)
    own = [F.lit(None).cast("string").alias(c) if c not in events.columns else F.col(c).cast("string").alias(c) for c in ("kind", "instance", "outcome")]
    rows = events.where("ts is not null").withWatermark("ts", delay).select(
        F.coalesce(F.col("session").cast("string"), F.lit("")).alias("session"), F.col("id").cast("long").alias("id"), "ts",
        F.unix_micros("ts").alias("us"), *own
    )
    return rows.groupBy("session").transformWithState(
        statefulProcessor=fold, outputStructType=OUT, outputMode="Append", timeMode="EventTime"
    )


def session_stream(events: DataFrame, delay: str = "1 hour", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """Events (session, id, ts, and kind, instance, outcome as far as there) with `counts`, `version` and `status`.

    counts: whether a lifecycle row counts (null for others): see operators.sessions.lifecycle; version and status: see
    status_history. A row leaves once the watermark, `delay` behind the latest time, has passed it; what comes later
    than that is left out. A null session is the empty one; a null instance counts as one; null times are left out.
    """
    return _folded(events, SessionFold(keep_ms), delay)


def first_stream(events: DataFrame, delay: str = "1 hour", keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """(session, id, ts, …) of the first row of each session by (ts, id), not the first to arrive."""
    return _folded(events, FirstFold(keep_ms), delay)


def run_parts(parts: list[DataFrame], make, folder: str, schema: str) -> DataFrame:
    """Gives the parts to a stream one after another, each in a run of its own that goes on where the last one ended, and reads what came out.

    make: the streamed input to the stream; what a run can't deliver yet (an outage) comes with a later one.
    """
    spark = parts[0].sparkSession
    for part in parts:
        part.write.mode("append").json(f"{folder}/in")
        stream = make(spark.readStream.schema(schema).json(f"{folder}/in"))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").outputMode(
            "append"
        ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
