import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.operators import sessions as B
from folioflow.streaming import sessions as S

SCHEMA = "session string, id long, ts timestamp, kind string, instance string, outcome string"
START = datetime(2024, 5, 1)


def log(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["opened", "rehydrated", "closed", "compile", None])
        out.append((rng.choice("abc"), i, START + timedelta(minutes=rng.randint(0, 600)), kind, rng.choice(["x", "y", None]) if kind else None,
                    rng.choice(["started", "succeeded", "failed", "other"]) if kind == "compile" else None))
    return sorted(out, key=lambda r: r[2])


def parts(rows, n, seed):
    """Shuffled parts in which rows come up to two hours late, and a last one that moves the watermark past all."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.randint(0, 119)))
    step = -(-len(late) // n)
    out = [late[k : k + step] for k in range(0, len(late), step)]
    for p in out:
        rng.shuffle(p)
    return out + [[("end", 10**6 + k, START + timedelta(days=5, hours=k), None, None, None)] for k in range(2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_batch_folds(spark, tmp_path, seed):
    own, rows = S.stream_session(spark), log(seed, 120)
    frames = [own.createDataFrame(p, SCHEMA) for p in parts(rows, 4, seed)]
    got = S.run_parts(frames, lambda e: S.session_stream(e, "2 hours"), f"file:{tmp_path}", SCHEMA).where("session <> 'end'").collect()
    all_ = spark.createDataFrame(rows, SCHEMA)
    want = {r.id: (r.version, r.status) for r in B.status_history(all_).collect()}
    assert {r.id: (r.version, r.status) for r in got} == want and len(got) == len(rows)
    counted = B.lifecycle(all_.withColumnRenamed("kind", "type").withColumn("instance", F.coalesce("instance", F.lit(""))))
    assert {r.id for r in got if r.counts} == {r.id for r in counted.collect()}
    assert {r.id for r in got if r.counts is None} == {r[1] for r in rows if r[3] in (None, "compile")}


def test_first_and_forgotten(spark, tmp_path):
    own = S.stream_session(spark)
    at = lambda m: START + timedelta(minutes=m)
    rows = [[("a", 5, at(60)), ("a", 9, at(30)), ("b", 1, at(50))], [("a", 7, at(20)), ("a", 2, at(60))], [("a", 8, at(500)), (None, 4, at(400))], [("a", 1, at(3000))],
            [("end", 0, at(5000))], [("end", 1, at(9000))]]
    schema = "session string, id long, ts timestamp"
    frames = [own.createDataFrame(p, schema) for p in rows]
    out = S.run_parts(frames, lambda e: S.first_stream(e, "1 hour", 24 * 3_600_000), f"file:{tmp_path}", schema)
    assert {(r.session, r.id) for r in out.where("session <> 'end'").collect()} == {("a", 7), ("b", 1), ("", 4), ("a", 1)}


def test_the_state_store_is_asked_for(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("a").alias("session"), F.col("value").alias("id"), F.col("timestamp").alias("ts"))
    if spark.conf.get(S.PROVIDER, "") != S.ROCKSDB:
        with pytest.raises(ValueError, match="RocksDB"):
            S.session_stream(stream)
