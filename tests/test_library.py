import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import publication as P
from folioflow.operators import sessions as S
from folioflow.operators.integrity import plan_hash
from folioflow.sources import markdown as M
from folioflow.sources import records, sinks
from folioflow.sources.library import library
from folioflow.sources.scratch import path_in


def test_folder_index_and_files_are_equivalent(spark):
    paths = ["ch/Sheet/sheet.md", "ch/Answers/answers.md", "ch/course.md", "ch/index.md", "ch/.hidden/x.md", "ch/sources/raw.md", "other/a.md", "chapter/b.md"]
    texts = {p: "---\nid: x\n---\n" for p in paths}
    texts["ch/index.md"] += '[s](Sheet/sheet.md "S") [[answers]] [c](<./course.md>) [gone](none.md) [h](.hidden/x.md)\n'
    files = spark.createDataFrame([*texts.items()], "path string, text string")
    links = M.tables(M.parse_notes(files, want=("links",)))["links"]
    notes = files.withColumn("id", F.lit("x"))
    some = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    got = lambda *a, **k: sorted(r.path for r in library(notes, *a, **k).collect())
    want = sorted(paths[:3])
    assert got(indexes=some("ch/index.md"), links=links) == want
    assert got(files=some(*want, want[0], "nowhere.md", "ch/.hidden/x.md")) == want
    assert got(folders=some("ch/")) == sorted([*want, "ch/index.md"])
    assert got(some("ch", "ch/Sheet"), some("ch/index.md"), some("other/a.md"), links) == sorted([*want, "ch/index.md", "other/a.md"])
    assert got(folders=some("nowhere")) == [] and got(folders=some("")) == sorted(p for p in paths if "hidden" not in p and "sources" not in p)


def test_partial_questions_in_source_order(spark):
    questions = spark.createDataFrame([("n", 3, "q-1"), ("n", 9, "q-2"), ("n", 20, "q-3"), ("n", 40, "q-4"), ("m", 3, "q-1")], "path string, line int, anchor string")
    units = spark.createDataFrame([("n", "s", "section", 1, 50), ("n", "e-1", "exercise", 2, 10), ("n", "e-2", "exercise", 15, 30)], "path string, uid string, kind string, lo int, hi int")
    selected = spark.createDataFrame([("n", "q-2"), ("n", "q-1"), ("n", "q-2"), ("n", "q-4"), ("n", "none"), (None, "q-1")], "path string, anchor string")
    got = {(r.path, r.uid, r.lo, r.hi, tuple(r.questions)) for r in P.partial_questions(selected, questions, units).collect()}
    assert got == {("n", "e-1", 2, 10, ("q-1", "q-2")), ("n", None, None, None, ("q-4",))}


def test_only_what_is_recorded_is_copied(spark, tmp_path):
    files = spark.createDataFrame([("a.md", b"one"), ("aids/b.md", b"two"), (".private.md", b"x")], "path string, content binary")
    record = files.where("path not like '.%'").select("path", F.sha2("content", 256).alias("sha256"))
    at = f"file:{tmp_path}/out"
    approved = sinks.copy_approval(record, at)
    for bad in ("0" * 64, sinks.copy_approval(record, f"{at}2"), sinks.copy_approval(record.limit(1), at)):
        with pytest.raises(ValueError, match="approved"):
            sinks.copy_recorded(record, files, at, bad)
    changed = files.withColumn("content", F.when(F.col("path") == "a.md", F.lit("edited").cast("binary")).otherwise(F.col("content")))
    extra = files.union(spark.createDataFrame([("c.md", b"y")], "path string, content binary"))
    for other, problem in ((changed, ("a.md", "hash")), (extra, ("c.md", "unexpected")), (files.where("path <> 'a.md'"), ("a.md", "missing"))):
        assert [tuple(r) for r in sinks.copy_findings(record, other).collect()] == [problem]
        with pytest.raises(ValueError, match="recorded"):
            sinks.copy_recorded(record, other, at, approved)
    assert not path_in(spark, at).there()
    sinks.copy_recorded(record, files, at, approved)
    assert {(r.path, bytes(r.content)) for r in spark.read.parquet(at).collect()} == {("a.md", b"one"), ("aids/b.md", b"two")}
    with pytest.raises(FileExistsError):
        sinks.copy_recorded(record, files, at, approved)
    hidden = record.union(spark.createDataFrame([(".private.md", "z")], "path string, sha256 string"))
    assert [tuple(r) for r in sinks.copy_findings(hidden, files).collect()] == [(".private.md", "hidden")]


def test_journals_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 10)):
        rows = ['{"layout":"l"}'] + [json.dumps({"v": 1, "type": "t", "page": i}) if i % 10 else '{"torn' for i in range(1, n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        read = records.read_journal(spark, f"{tmp_path}/*.jsonl", "v int, type string, page long")
        assert read.rdd.getNumPartitions() >= 1 and spark.read.text(f"{tmp_path}/*.jsonl").rdd.getNumPartitions() > 8
        assert read.where("seq = page").count() == read.count() == 4000 - 400 + 9
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_changed_notes_are_rows(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (2, "a", "y"), (2, "c", "x"), (3, "a", "y"), (3, "c", "x")]
    got = {tuple(r) for r in S.changed_notes(spark.createDataFrame(rows, "version int, note string, sha256 string")).collect()}
    assert got == {(2, "a", "changed"), (2, "b", "removed"), (2, "c", "added")}


def test_guard_of_writes(spark):
    root = "/r/Vault"
    cases = [
        ("edit", '{"path": "/r/Vault/Maths/sheet.md"}', "tutor", ["/r/Vault/Maths/sheet.md"]), ("create", '{"path": "Vault/Activity/Layouts/nested/x.json"}', "Tutor", ["/r/Vault/Activity/Layouts/nested/x.json"]),
        ("create", '{"path": "/r/Vault/Activity/Layouts/new.json"}', "tutor", []), ("create", '{"path": "/r/outside.md"}', "tutor", []), ("view", '{"path": "/r/Vault/a.md"}', "tutor", []),
        ("send", '{"message": "edit /r/Vault/a.md"}', "tutor", []), ("apply_patch", '{"input": "*** Begin Patch\\n*** Update File: /r/Vault/a.md\\n@@\\n-a\\n+b\\n*** End Patch"}', "tutor", ["/r/Vault/a.md"]),
        ("move_file", '{"source": "/r/a.md", "destination": "Vault/x/../a.md"}', " tu_tor ", ["/r/Vault/a.md"]), ("edit", '{"path": "/r/Vault/a.md"}', "other", []), ("edit", '{"path": "/r/Vault/a.md"}', None, []),
        ("edit", '{"path": "/r/Vault-other/a.md"}', "tutor", []), ("edit", "no json", "tutor", []), ("edit", None, "tutor", []), ("edit", '["/r/Vault/a.md"]', "tutor", [])
    ]
    d = spark.createDataFrame([(i, t, a, "/r", g) for i, (t, a, g, _) in enumerate(cases)], "k int, tool string, arguments string, cwd string, agent string")
    got = {}
    for r in P.denied_writes(d, "k", root, "tutor", "Activity/Layouts").collect():
        got.setdefault(r.k, []).append(r.path)
    assert got == {i: x for i, (*_, x) in enumerate(cases) if x}
    one = spark.createDataFrame([('{"paths": ["a", 1, ""], "files": ["b"], "message": "c"}',)], "a string")
    assert one.select(P.target_paths(F.col("a")).alias("p")).first().p == ["a", "b"]


def test_batches_are_appended_once(spark, tmp_path):
    at = f"file:{tmp_path}/j"
    rows = spark.createDataFrame([(1, "2024-05-01", 3), (2, "2024-05-02", 3)], "event_id long, date string, session long")
    assert sinks.append_journal(rows, at, "a") and not sinks.append_journal(rows, at, "a") and sinks.append_journal(rows, at, "b")
    assert spark.read.json(at).count() == 4


def test_a_failed_write_keeps_its_place(spark, tmp_path):
    at = f"file:{tmp_path}/out"
    good = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    approved = plan_hash(good).first()[0]
    bad = good.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("torn"))).otherwise(F.col("v")))
    assert sinks.output_status(spark, at) == "absent"
    with pytest.raises(ValueError, match="approved"):
        sinks.materialize(good, "0" * 64, at)
    assert sinks.output_status(spark, at) == "absent"
    with pytest.raises(Exception, match="torn"):
        sinks.materialize(bad, approved, at)
    assert sinks.output_status(spark, at) == "writing"
    with pytest.raises(FileExistsError):
        sinks.materialize(good, approved, at)
    sinks.materialize(good, approved, f"{at}2")
    assert sinks.output_status(spark, f"{at}2") == "written" and spark.read.parquet(f"{at}2").count() == 2
    (tmp_path / "mine").mkdir()
    assert sinks.output_status(spark, f"file:{tmp_path}/mine") == "foreign"
