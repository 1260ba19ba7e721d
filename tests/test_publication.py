from test_sources import ANSWERS, SHEET, parsed

from folioflow.operators import publication as P


def test_fragments(spark):
    body = SHEET + "## Exercise 2\ntext\n```\ncode\ncode\n```\n# Exercise 2\n"
    t = parsed(spark, sheet=body, answers=ANSWERS)
    wanted = [("sheet.md", f) for f in ("^q-1", "^q-9", "Exercise%201", "Sheet", "Exercise 2", "L1-L3", "L22", "L20-L24", "")]
    got = {
        r.fragment: (r.lo, r.hi, r.status) for r in P.select_fragments(
            spark.createDataFrame(wanted, "path string, fragment string"), t
        ).collect()
    }
    assert got["^q-1"] == (13, 15, "ok") and got["^q-9"][2] == "missing" and got["Exercise 2"][2] == "ambiguous"
    assert got["Exercise%201"][2] == "ok" and got["Exercise%201"][0] == 11 and got["Sheet"][0] == 8
    assert got["L1-L3"] == (1, 3, "ok") and got["L22"][2] == "bisects" and got["L20-L24"][2] == "ok" and got[""][2] == "ok"
    u = P.layout_units(
        spark.createDataFrame([("sheet.md", 13, 15), ("sheet.md", 1, 99)], "path string, lo int, hi int"), t["units"]
    ).collect()
    assert [(r.path, r.uid) for r in u] == [("sheet.md", "ex-1")]
    w = P.worksheet(t["units"], t["blocks"]).where("path = 'sheet.md'").orderBy("position").collect()
    assert [r.kind for r in w][:2] == ["between", "unit"] and sum(r.kind == "unit" for r in w) == 1


def test_overrides(spark):
    d = spark.createDataFrame([("q1", ["c1"], ["h1"]), ("q2", ["c2"], [])], "q string, corrections array<string>, hints array<string>")
    o = spark.createDataFrame(
        [("q1", {"hints": []}), ("q2", {"odd": ["x"]}), ("q9", {"hints": ["y"]})], "q string, choices map<string,array<string>>"
    )
    got = {r.q: r for r in P.override(d, o, "q", ["corrections", "hints"]).collect()}
    assert got["q1"].hints == [] and got["q1"].corrections == ["c1"] and got["q1"].problem is None
    assert "odd" in got["q2"].problem and got["q9"].problem == "unpublished target"


def test_joins_and_counts(spark):
    ex = spark.createDataFrame([("e1", "d1"), ("e2", "d2"), ("e3", "d3")], "exercise string, doc string")
    links = spark.createDataFrame(
        [("p1", "d1", None), ("p1", "d1", "e2"), ("p1", "d1", "e1")], "passage string, doc string, exercise string"
    )
    assert sorted(r.exercise for r in P.related(ex, links).collect()) == ["e1", "e2"]
    f = spark.createDataFrame([("f1", [(1,), (1,)]), ("f2", [(1,), (2,)]), ("f3", [])], "id string, regions array<struct<pageNumber:int>>")
    assert {
        r.id: r.needs_review for r in P.figure_pages(f, "id", "regions", "pageNumber").collect()
    } == {"f1": False, "f2": True, "f3": True}
    m = P.remap(
        spark.createDataFrame([("a", "x"), ("b", "y")], "target string, label string"),
        spark.createDataFrame([("a", "c")], "target string, new string")
    )
    assert sorted((r.target, r.label) for r in m.collect()) == [("b", "y"), ("c", "x")]
    c = spark.createDataFrame([("r", s) for s in ("completed", "uncertain", "open", "open")], "run string, state string")
    assert tuple(P.resume_accounting(c, ["run"]).first()) == ("r", 1, 1, 2, 3)
    g = P.group_in_order(spark.createDataFrame([("e", 9, "b"), ("e", 2, "a")], "o string, line int, q string"), "o", "line", "q")
    assert g.first()["values"] == ["a", "b"]
    assert [r.accepted for r in P.within_limits(c, ["run"], 3).collect()] == [False]


def test_files(spark):
    a = spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "path string, text string")
    d = spark.createDataFrame([("A.md", "z"), ("c.md", "1"), ("C.md", "2"), ("d.md", "3")], "path string, text string")
    got = {r.path: r.problem for r in P.overlay(a, d).collect()}
    assert got == {"a.md": None, "b.md": None, "A.md": "overwrites", "c.md": "duplicate", "C.md": "duplicate", "d.md": None}
    p = {r.path: r.sha256 for r in P.proposal(a).collect()}
    rec = spark.createDataFrame([({"a.md": p["a.md"], "b.md": "0", "z.md": "0"},)], "files map<string,string>")
    assert {
        r.path: r.matches for r in P.published_files(rec, a.withColumnRenamed("text", "content")).collect()
    } == {"a.md": True, "b.md": False, "z.md": False}
    s = P.preflight(spark.createDataFrame([("k", None)], "key string, url string"), ["key", "url"], ["key"]).first()
    assert s.blockers == ["url is not set"] and s.key == "***"
    from pyspark.sql import functions as F

    w = spark.createDataFrame(
        [("edit", "/v/a", True), ("edit", "/vx", True), ("read", "/v/a", True), ("edit", "/v/a", False), ("edit", None, True)],
        "tool string, path string, tutor boolean"
    )
    assert [
        r.d for r in w.select(P.write_denied(F.col("tool"), F.col("path"), "/v", F.col("tutor")).alias("d")).collect()
    ] == [True, False, False, False, False]
    m = spark.createDataFrame(
        [("a", i, x) for i, x in enumerate(["> t", "> $$", "> x", "> $$", ">", "> t"])] + [("b", 1, "> $$")],
        "path string, line int, text string"
    )
    assert {(r.path, r.line): r.problem for r in P.math_spacing(m).collect()} == {("a", 1): "no blank line before", ("b", 1): "unpaired"}


def test_targets_that_are_gone_have_no_part_s_key(spark):
    """Parts with keys from a million on were taken for the targets that aren't there."""
    from folioflow.plans import notes

    keys = [0, 50, 1_000_000, 1_000_050]
    part = spark.createDataFrame([(k, f"B{k}", f"T{k}") for k in keys], "p_partkey long, p_brand string, p_type string")
    got = {tuple(r) for r in notes.part_overrides(lambda name: part).collect()}
    there = {(0, "", "T0", None), (50, "B50", "T50", None), (1_000_000, "B1000000", "T1000000", "unknown option nope"), (1_000_050, "", "T1000050", None)}
    assert got == there | {(k + 1_000_000, None, None, "unpublished target") for k in keys}
