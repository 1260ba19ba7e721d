from folioflow.operators import integrity as I


def test_page_ranges(spark):
    d = spark.createDataFrame([("a", x) for x in (7, 1, 3, 2, 2)] + [("b", None)], "k string, n int")
    assert [tuple(r) for r in I.page_ranges(d, ["k"], "n").collect()] == [("a", "1-3,7")]


def test_innermost(spark):
    units = spark.createDataFrame([("d", 1, 9, "out"), ("d", 3, 5, "in"), ("e", 1, 9, "other")], "doc string, lo int, hi int, uid string")
    rows = spark.createDataFrame([("d", 4), ("d", 8), ("d", 20), ("f", 1)], "doc string, line int")
    rows = rows.union(rows.limit(1))
    found = I.innermost(rows, units, ["doc"], "line").collect()
    assert len(found) == 5 and len(I.innermost(rows, units.where("doc = 'd'"), [], "line").collect()) == 5
    got = {(r.doc, r.line): r.owner for r in found}
    assert got == {("d", 4): "in", ("d", 8): "out", ("d", 20): None, ("f", 1): None}


def test_resolve(spark):
    links = spark.createDataFrame([("a",), ("b",), ("c",)], "l string")
    cands = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 2), ("b", "y", 2)], "l string, target string, priority int")
    assert {
        r.l: (r.status, r.target) for r in I.resolve(links, cands, "l", "target").collect()
    } == {"a": ("resolved", "x"), "b": ("ambiguous", None), "c": ("missing", None)}


def test_complete_sum_is_null_with_a_gap(spark):
    d = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    assert {r.k: (r.total, r.missing) for r in I.complete_sum(d, ["k"], "v").collect()} == {"a": (None, 1), "b": (2, 0)}


def test_overlaps_and_topmost(spark):
    r = spark.createDataFrame(
        [("d", 1, 5, "a"), ("d", 2, 3, "b"), ("d", 6, 7, "c"), ("d", 5, 5, "e")], "doc string, lo int, hi int, n string"
    )
    assert sorted(x.n for x in I.overlaps(r, "doc", "lo", "hi", "n").collect()) == ["b", "e"]
    p = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d/",), ("/c/d/e",)], "path string")
    assert sorted(x.path for x in I.topmost(p).collect()) == ["/a", "/ab", "/c/d"]


def test_plan_hash_ignores_order(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    h = I.plan_hash(d).first()[0]
    assert I.plan_hash(d.orderBy("k", ascending=False).repartition(3)).first()[0] == h
    assert I.plan_hash(d.na.fill("x")).first()[0] != h


def test_diff_and_manifest(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, sha256 string")
    b = spark.createDataFrame([("y", "1"), ("z", "2"), ("w", "1")], "path string, sha256 string")
    assert {r.path: r.change for r in I.snapshot_diff(a, b, "path", "sha256").collect()} == {"x": "removed", "z": "changed", "w": "added"}
    assert {r.path: r.problem for r in I.manifest_check(a, b).collect()} == {"x": "missing", "z": "hash", "w": "unexpected"}
    assert I.set_equality(a, a).count() == 0


def test_attempts_suffix(spark):
    d = spark.createDataFrame([("p", n, f"v{n}") for n in (1, 2, 3, 4)], "page string, attempt int, v string")
    assert tuple(I.latest_attempt(d, ["page"], "attempt", "v").first()) == ("p", 3, "v3")
    s = I.collision_suffix(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "base string, o int"), "base", "o")
    assert sorted(r.name for r in s.collect()) == ["a", "a-2", "b"]
