from datetime import datetime, timedelta

from folioflow.operators import activity as A
from folioflow.streaming import activity as S

START = datetime(2024, 5, 1)
SCHEMA = "user_id long, event_id long, ts timestamp, event_type string"


def rows(spark, lo, hi):
    return spark.createDataFrame([(i % 3, i, START + timedelta(minutes=7 * i), f"t{i % 2}") for i in range(lo, hi)], SCHEMA)


def test_stream_is_batch(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    for lo, hi in ((0, 20), (20, 45)):  # the second run goes on where the first ended
        rows(spark, lo, hi).coalesce(1).write.mode("append").parquet(src)
        S.run_available(S.rate_limit_stream(S.follow(spark, src, SCHEMA), 3_600_000), out, at)
    got = spark.read.parquet(out)
    want = A.rate_limited(rows(spark, 0, 45), 3_600_000)
    assert sorted(
        (r.user_id, r["count"]) for r in got.groupBy("user_id").count().collect()
    ) == sorted((r.user_id, r.accepted) for r in want.collect())


def test_first_only(spark, tmp_path):
    """What comes late, but before the watermark, still is the first; what comes after it left adds nothing."""
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    late = [(0, 100, START - timedelta(minutes=30), "t0")]
    far = [(9, 900 + k, START + timedelta(days=1 + k), "end") for k in range(2)]
    parts = [
        rows(spark, 6, 20), spark.createDataFrame(late, SCHEMA), rows(spark, 0, 45), spark.createDataFrame(far[:1], SCHEMA),
        rows(spark, 0, 6), spark.createDataFrame(far[1:], SCHEMA)
    ]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        S.run_available(S.first_only_stream(S.follow(spark, src, SCHEMA), ["user_id", "event_type"], "6 hours"), out, at)
    got = {(r.user_id, r.event_type): r.event_id for r in spark.read.parquet(out).where("user_id < 9").collect()}
    assert spark.read.parquet(out).where("user_id < 9").count() == 6
    want = {(i % 3, f"t{i % 2}"): i for i in range(5, -1, -1)} | {(0, "t0"): 100}
    assert got == want
