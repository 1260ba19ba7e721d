from datetime import datetime, timedelta

from folioflow.operators import activity as A

START = datetime(2024, 5, 1, 9)
SCHEMA = "session string, seq long, ts timestamp, type string, actor string, question string, exercise string, index int, total int, course string, section int, title string, url string, page int"


def log(spark, rows):
    full = []
    for seq, (minute, kind, more) in enumerate(rows):
        row = dict(
            session="s", seq=seq, ts=START + timedelta(minutes=minute), type=kind, actor="student", question=None, exercise=None,
            index=None, total=None, course=None, section=None, title=None, url=None, page=None
        ) | more
        full.append(tuple(row[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(full, SCHEMA)


def test_replay(spark):
    q = {"question": "s#^q-1", "exercise": "s#^e-1"}
    rows = [
        (0, "exercise_started", {"exercise": "s#^e-1"}),
        (2, "hint_revealed", q | {"index": 1, "total": 2}),
        (5, "hint_revealed", q | {"index": 2, "total": 2}),
        (8, "tutor_show", q | {"actor": "tutor"}),
        (9, "correction_shown", q),
        (40, "correction_hidden", q),
        (41, "course_section_opened", {"course": "c", "section": 1, "title": "Old", "total": 3}),
        (42, "course_section_opened", {"course": "c", "section": 1, "title": "New", "total": 4}),
        (43, "course_opened", {"course": "c"}),
        (44, "link_opened", {"url": "x.pdf", "page": 2}),
        (45, "tutor_requested", {"question": "s#^q-2", "exercise": "s#^e-1"}),
    ]
    got = A.replay(log(spark, rows))
    one = {r.question: r for r in got["questions"].collect()}
    first = one["s#^q-1"]
    # 3 + 4 minutes of hints, 10 at most of the shown correction, 1 of the hidden one
    assert (first.hints, first.correction_seen, first.correction, first.ms) == (2, True, False, (3 + 4 + 10 + 1) * 60000)
    assert one["s#^q-2"].tutor == 1 and one["s#^q-2"].ms == 0
    e = got["exercises"].first()
    assert e.ms == 2 * 60000 and e.started
    s = got["sections"].first()
    assert (s.title, s.total, s.visits) == ("New", 4, 2)
    assert got["courses"].first().opened == 1 and got["links"].first().n == 1 and got["others"].first().tutor_shows == 1
    lines = [r.line for r in A.summary(got).collect()]
    assert any("~18 min" in x for x in lines) and not any("hint text" in x for x in lines)


def test_null_next_adds_nothing(spark):
    one = log(spark, [(0, "link_opened", {"url": "a"})]).withColumnRenamed("url", "user_id").withColumnRenamed("seq", "event_id")
    assert A.capped_time(one).first().capped_ms == 0


def test_validate_names_first_reason(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "a"), (None, "b"), (5, None)], "n int, s string")
    got = {r.s: (r.accepted, r.reason) for r in A.validate(d, [("n", F.col("n") > 0), ("s", F.col("s") == "a")]).collect()}
    assert got == {"a": (True, None), "b": (False, "n"), None: (False, "s")}


def test_rate_limit_counts_from_accepted(spark):
    t = [0, 5, 9, 11, 19, 22]
    d = spark.createDataFrame([(1, i, START + timedelta(minutes=m)) for i, m in enumerate(t)], "user_id long, event_id long, ts timestamp")
    assert tuple(A.rate_limited(d, 600_000).first()) == (1, 3, 5)


def test_empty_log(spark):
    empty = log(spark, [(0, "x", {})]).limit(0)
    got = A.replay(empty)
    assert got["questions"].count() == 0 and got["others"].first().tutor_shows == 0
