from datetime import datetime, timedelta

from folioflow.operators import aids as X
from folioflow.operators import publication as P
from folioflow.operators import sessions as S

START = datetime(2024, 5, 1, 9)


def test_status_keeps_the_last_good_version(spark):
    outcomes = [None, "failed", "started", "succeeded", "failed", "started", "succeeded"]
    d = spark.createDataFrame(
        [("s", i, START + timedelta(minutes=i), o) for i, o in enumerate(outcomes)], "session string, id int, ts timestamp, outcome string"
    )
    got = [(r.version, r.status) for r in S.status_history(d).orderBy("id").collect()]
    assert got == [(0, "idle"), (0, "error"), (0, "compiling"), (1, "ready"), (1, "stale"), (1, "compiling"), (2, "ready")]
    assert S.status_history(d.limit(0)).count() == 0


def test_lifecycle_rows_count_once(spark):
    kinds = ["opened", "opened", "rehydrated", "rehydrated", "closed", "closed", "opened", "rehydrated", "noise"]
    d = spark.createDataFrame(
        [("s", "c1", i, START + timedelta(minutes=i), k) for i, k in enumerate(kinds)],
        "session string, instance string, id int, ts timestamp, type string"
    )
    assert [r.id for r in S.lifecycle(d).orderBy("id").collect()] == [0, 2, 4, 6]


def test_content_changes_are_journaled_once(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (2, "a", "y"), (2, "c", "x"), (3, "a", "y"), (3, "c", "x")]
    got = [tuple(r) for r in S.content_changes(spark.createDataFrame(rows, "version int, note string, sha256 string")).collect()]
    assert got == [(2, ["a", "c"], ["b"])]


def test_bursts(spark):
    d = spark.createDataFrame(
        [("s", i, START + timedelta(seconds=x)) for i, x in enumerate((0, 1, 2, 10, 11, 30))], "session string, id int, ts timestamp"
    )
    assert sorted((r["first"].second, r["last"].second, r.n) for r in S.bursts(d, 2000).collect()) == [(0, 2, 3), (10, 11, 2), (30, 30, 1)]


def test_aid_rules(spark):
    aids = spark.createDataFrame(
        [("good", "q1", "r1"), ("lost", "q9", None), ("wrong", "q1", "r2"), ("none", "q1", "r9"), ("vague", "q2", None)],
        "aid string, question string, answer string"
    )
    answers = spark.createDataFrame([("r1", "q1"), ("r2", "q2")], "answer string, question string")
    questions = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "question string")
    links = spark.createDataFrame(
        [(a, "book", "^p") for a in ("good", "lost", "wrong", "none")] + [
            ("vague", "book", ""), ("vague", "book", "nope"), ("vague", "sheet", "^p")
        ],
        "aid string, target string, fragment string"
    )
    documents = spark.createDataFrame([("book", "mixed"), ("sheet", "exercise")], "target string, role string")
    places = spark.createDataFrame([("book", "^p"), ("sheet", "^p")], "target string, fragment string")
    got = {tuple(r) for r in X.aid_findings(aids, answers, questions, links, documents, places).collect()}
    assert got == {
        ("lost", "unknown question"), ("wrong", "answer to another question"), ("none", "unknown answer"),
        ("vague", "imprecise course link"), ("vague", "missing or ambiguous course place"), ("vague", "no precise course link")
    }
    assert [r.question for r in X.without_aid(questions, aids).collect()] == ["q3"]


def test_headings_and_pages(spark):
    heads = spark.createDataFrame(
        [("d", 1, 1, "A"), ("d", 3, 3, "deep"), ("d", 5, 2, "B"), ("e", 1, 2, "other")], "path string, line int, level int, text string"
    )
    at = spark.createDataFrame([("d", 0), ("d", 4), ("d", 6), ("f", 2)], "path string, line int")
    assert {
        (r.path, r.line): r.headings for r in X.preceding_headings(at, heads).collect()
    } == {("d", 0): [], ("d", 4): ["A", "deep"], ("d", 6): ["A", "B"], ("f", 2): []}
    pages = spark.createDataFrame([("d", 1, 7), ("d", 5, 8)], "path string, line int, page int")
    assert {
        (r.path, r.line): r.page for r in X.starting_page(at, pages).collect()
    } == {("d", 0): None, ("d", 4): 7, ("d", 6): 8, ("f", 2): None}


def test_publication_names(spark):
    from pyspark.sql import functions as F

    names = ["a/b.md", "/a.md", "a/../b", ".x/y", "a/.hidden", "a\\b", "c:d", "ok.pdf", "end./x", "a?"]
    d = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r.path for r in d.where(P.portable(F.col("path"))).collect()] == ["a/b.md", "ok.pdf"]


def test_a_journal_is_one_file_however_partitions_are_cut(spark, tmp_path):
    """Parts of a union that were coalesced apart gave a journal two files, the header in one of its own; ids go beyond 32 bits."""
    from pyspark.sql import functions as F

    from folioflow.plans import sessions

    big = 1 << 40
    spark.range(4000).select(
        (F.col("id") + big).alias("event_id"), (F.timestamp_seconds(F.col("id"))).alias("ts"), (F.col("id") % 60).alias("user_id"),
        F.lit("view").alias("event_type")
    ).write.parquet(f"{tmp_path}/events.parquet")
    cuts = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    kept = {k: spark.conf.get(k) for k in cuts}
    try:
        for k, v in cuts.items():
            spark.conf.set(k, v)
        got = sessions.session_journals(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = {(i % 20, i // 20 + 1, i + big) for i in range(4000)} - {(j, 200, 3980 + j + big) for j in range(0, 20, 5)}
    assert sorted((r.j, r.seq, r.page) for r in got) == sorted(want)
