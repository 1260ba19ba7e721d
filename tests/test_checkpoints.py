import json

import pytest
from pyspark.sql import functions as F

from folioflow.sources import checkpoints as C
from folioflow.sources.scratch import path_in, put_folder


class Cut(Exception):
    pass


def plan(spark, n, mark="f"):
    return spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("call"), F.concat(F.lit(mark), F.col("id").cast("string")).alias("fingerprint"))


def answers(asked):
    def respond(calls):
        asked.append(sorted(r.call for r in calls.collect()))
        return calls.select("call", F.to_json(F.struct(F.col("call").alias("said"))).alias("payload"))

    return respond


def test_a_response_before_its_commit_is_taken_over(spark, tmp_path, monkeypatch):
    root, asked = f"file:{tmp_path}/j", []
    journal = C.Journal(spark, root)
    write = C.Journal._write

    def cut(self, rows, kind, batch):
        if kind == C.COMMIT and asked:
            raise Cut
        write(self, rows, kind, batch)

    monkeypatch.setattr(C.Journal, "_write", cut)
    with pytest.raises(Cut):
        journal.run(plan(spark, 3), answers(asked))
    monkeypatch.undo()
    assert {r.call: r.state for r in C.Journal(spark, root).state().collect()} == {f"c{i}": "recovered" for i in range(3)}
    got = C.Journal(spark, root).run(plan(spark, 5), answers(asked))
    assert {r.call: json.loads(r.payload)["said"] for r in got.collect()} == {f"c{i}": f"c{i}" for i in range(5)}
    assert asked == [["c0", "c1", "c2"], ["c3", "c4"]]
    C.Journal(spark, root).run(plan(spark, 5), answers(asked))
    assert asked[2] == []
    C.Journal(spark, root).run(plan(spark, 2, "other"), answers(asked))  # other requests under the same names
    assert asked[3] == ["c0", "c1"]


def test_a_cut_before_the_response_leaves_uncertain_calls(spark, tmp_path):
    journal = C.Journal(spark, f"file:{tmp_path}/j")

    def dies(calls):
        raise Cut

    with pytest.raises(Cut):
        journal.run(plan(spark, 2), dies)
    assert {r.state for r in journal.state().collect()} == {"uncertain"}
    assert journal.state().select("payload").distinct().first().payload is None
    got = C.accounting(journal.state(), plan(spark, 5)).first()
    assert (got.answered, got.uncertain, got.untouched, got.least, got.most) == (0, 2, 3, 3, 5)
    asked = []
    journal.run(plan(spark, 2), answers(asked))
    assert asked == [["c0", "c1"]]


def test_torn_and_changed_responses(spark, tmp_path):
    root = f"{tmp_path}/j"
    journal, asked = C.Journal(spark, f"file:{root}"), []
    journal.run(plan(spark, 2), answers(asked))
    torn = spark.createDataFrame([("c7", '{"said": ')], "call string, payload string")
    put_folder(plan(spark, 8).where("call = 'c7'"), f"file:{root}/{C.PENDING}/batch=000000900-x")
    put_folder(torn, f"file:{root}/{C.RESPONSE}/batch=000000900-x")
    assert {r.call: r.state for r in journal.state().collect()} == {"c0": "committed", "c1": "committed", "c7": "uncertain"}
    put_folder(spark.createDataFrame([("c0", '{"said": "by hand"}')], "call string, payload string"), f"file:{root}/{C.RESPONSE}/batch=000000901-x")
    assert {r.call: r.state for r in journal.state().collect()}["c0"] == "changed"
    with pytest.raises(ValueError, match="changed"):
        journal.run(plan(spark, 3), answers(asked))


def test_put_folder_is_whole_or_not_there(spark, tmp_path):
    at = f"file:{tmp_path}/a/b"
    boom = spark.range(1).select(F.raise_error(F.lit("boom")).alias("x"))
    with pytest.raises(Exception, match="boom"):
        put_folder(boom, at)
    assert not path_in(spark, at).there() and path_in(spark, f"file:{tmp_path}/a").names() == []
    put_folder(spark.range(3), at)
    with pytest.raises(FileExistsError):
        put_folder(spark.range(3), at)
    assert spark.read.json(at).count() == 3


def test_a_cut_while_a_changed_request_is_made_again(spark, tmp_path, monkeypatch):
    """The old commit doesn't make the new response a changed one."""
    root, asked = f"file:{tmp_path}/j", []
    C.Journal(spark, root).run(plan(spark, 2), answers(asked))
    write = C.Journal._write

    def cut(self, rows, kind, batch):
        if kind == C.COMMIT and len(asked) > 1:
            raise Cut
        write(self, rows, kind, batch)

    monkeypatch.setattr(C.Journal, "_write", cut)
    with pytest.raises(Cut):
        C.Journal(spark, root).run(plan(spark, 1, "new"), lambda calls: answers(asked)(calls).withColumn("payload", F.lit('"second"')))
    monkeypatch.undo()
    assert {r.call: r.state for r in C.Journal(spark, root).state().collect()} == {"c0": "recovered", "c1": "committed"}
    got = C.Journal(spark, root).run(plan(spark, 1, "new"), answers(asked))
    assert got.first().payload == '"second"' and asked == [["c0", "c1"], ["c0"], []]


def test_an_old_answer_is_none_to_a_new_request(spark, tmp_path):
    journal, asked = C.Journal(spark, f"file:{tmp_path}/j"), []
    journal.run(plan(spark, 1), answers(asked))

    def dies(calls):
        raise Cut

    with pytest.raises(Cut):
        journal.run(plan(spark, 1, "new"), dies)
    assert journal.state().first().state == "uncertain"
    assert journal.run(plan(spark, 1, "new"), answers(asked)).count() == 1 and asked == [["c0"], ["c0"]]
