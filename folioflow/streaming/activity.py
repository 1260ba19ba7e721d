"""The activity operators over an unbounded log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship


def follow(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def first_only_stream(
    events: DataFrame, keys: list[str], delay: str = "1 hour", keep_ms: int = 7 * 86_400_000, ts: str = "ts", event_id: str = "event_id"
) -> DataFrame:
    """The first row of each key by (ts, id), not the first to arrive.

    A key's smallest row is held until the watermark, `delay` behind the latest time, has passed it; then it leaves,
    and the key is remembered for keep_ms more of event time, so that later rows of it add nothing. After that its
    state goes. What comes later than `delay` is left out by the watermark. State survives a restart.
    """
    ship(events.sparkSession)
    names, schema = events.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", _left boolean"
    at, id_at = names.index(ts), names.index(event_id)

    def micros(x) -> int:
        return int(pd.Timestamp(x).value // 1000)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            row = state.get
            if row[-1]:
                state.remove()
                return
            state.update((*row[:-1], True))
            state.setTimeoutTimestamp(max(micros(row[at]) // 1000, state.getCurrentWatermarkMs()) + keep_ms)
            yield pd.DataFrame([row[:-1]], columns=names)
            return
        best = state.get if state.exists else None
        for batch in batches:
            if best is not None and best[-1]:
                continue
            first = batch.sort_values([ts, event_id], kind="stable").iloc[0]
            row = (
                *(
                    None if pd.isna(first[c]) else first[c].item() if hasattr(first[c], "item") else first[c].to_pydatetime() if hasattr(
                        first[c], "to_pydatetime"
                    ) else first[c] for c in names
                ),
                False
            )
            if best is None or (micros(row[at]), row[id_at]) < (micros(best[at]), best[id_at]):
                best = row
        if best is not None and not best[-1]:
            state.update(best)
            state.setTimeoutTimestamp(max(micros(best[at]) // 1000, state.getCurrentWatermarkMs()) + 1)
        return
        yield

    return events.withWatermark(ts, delay).groupBy(*keys).applyInPandasWithState(
        step, schema, held, "append", GroupStateTimeout.EventTimeTimeout
    )


def rate_limit_stream(events: DataFrame, interval_ms: int, key: str = "user_id", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """T5: (key, event_id) of accepted events: interval_ms since the last accepted one of the key.

    One timestamp of state for each key; in a batch a key's rows are taken in order of (ts, id).
    """
    ship(events.sparkSession)
    kinds = dict(events.dtypes)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ts, event_id])
        out = []
        for when, what in zip(rows[ts].astype("datetime64[us]").astype("int64"), rows[event_id]):
            if last is None or when - last >= interval_ms * 1000:
                last = int(when)
                out.append(what)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [name[0]] * len(out), event_id: out})

    return events.select(key, ts, event_id).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {event_id} {kinds[event_id]}", "last long", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes what is there, once; the checkpoint's offsets are the cursor, so nothing is delivered twice."""
    query = stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    ).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
