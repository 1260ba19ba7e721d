import random

import pytest

from folioflow.operators import intervals as V


def brute(units, at):
    held = [(lo, -hi, u) for lo, hi, u in units if lo is not None and hi is not None and lo <= at <= hi]
    return max(held)[2] if held else None


@pytest.mark.parametrize("seed", [1, 2])
def test_innermost_against_brute_force(spark, seed):
    rng = random.Random(seed)
    units, rows = [], []
    for doc in ("a", "b", "c"):
        for i in range(150):
            lo = rng.randint(-40, 400)
            units.append((doc, lo, lo + rng.choice([0, 1, 2, 7, 30, 300, -3]), f"{doc}{i}"))
    units += [("a", None, 5, "n"), ("a", 1, None, "n"), ("d", 1, 2, "d")]
    rows = [(rng.choice(["a", "b", "c", "x", None]), rng.choice([rng.randint(-60, 750), None]), i % 50) for i in range(400)] + [("a", 10, 1)] * 3
    u = spark.createDataFrame(units, "doc string, lo int, hi int, uid string")
    r = spark.createDataFrame(rows, "doc string, line int, level int")
    got = sorted(map(tuple, V.innermost(r, u, ["doc"], "line").collect()), key=str)
    of = lambda d, at: brute([x[1:] for x in units if x[0] == d], at) if d and at is not None else None
    assert got == sorted(((d, at, k, of(d, at)) for d, at, k in rows), key=str)
    alone = sorted(map(tuple, V.innermost(r, u.where("doc = 'a'"), [], "line").collect()), key=str)
    assert alone == sorted(((d, at, k, of("a", at) if at is not None else None) for d, at, k in rows), key=str)
    assert V.innermost(r, u.limit(0), [], "line").where("owner is null").count() == len(rows)
    assert V.innermost(r.limit(0), u, ["doc"], "line").count() == 0


def test_a_million_nested_units_without_a_key(spark):
    n = 1_000_000
    units = spark.range(n).selectExpr("id lo", f"{2 * n} - id hi", "id uid")
    rows = spark.range(0, 2 * n + 2, 997).selectExpr("id - 1 at")
    wrong = V.innermost(rows, units, [], "at").where(f"not owner <=> case when at between 0 and {2 * n} then least(at, {2 * n} - at, {n - 1}) end")
    assert wrong.count() == 0


def test_versions_leave_discarded_drafts_out(spark):
    rows = [
        ("d", 1, 1, "foo", "draft"), ("d", 1, 1, "bar", "only in the draft"), ("d", 1, 2, "foo", "x"), ("d", 3, 1, "foo", "y"), ("d", 3, 1, "baz", "z"),
        ("d", 5, 1, "foo", None), ("e", 2, 1, "foo", "other"), ("d", 7, 1, None, "nameless"), ("d", None, 1, "foo", "placeless")
    ]
    d = spark.createDataFrame(rows, "doc string, page int, attempt int, name string, value string")
    held = V.versions(d, ["doc"], "page", "name", "attempt")
    got = {(r.doc, r.name, r.value, r.since, r.until) for r in held.collect()}
    assert got == {("d", "foo", "x", 2, 3), ("d", "foo", "y", 4, 5), ("d", "foo", None, 6, None), ("d", "baz", "z", 4, None), ("e", "foo", "other", 3, None)}
    uses = spark.createDataFrame(
        [("d", p, "foo", 9) for p in range(1, 8)] + [("d", 3, "bar", 9), ("d", 9, "baz", 9), ("e", 3, "foo", 9), ("e", 2, "foo", 9), ("d", None, "foo", 9), ("d", 3, None, 9)],
        "doc string, page int, name string, _v int"
    )
    found = {(r.doc, r.page, r.name): r.found for r in V.in_force(uses, held, ["doc"], "page", "name", "value").collect()}
    assert found == {
        ("d", 1, "foo"): None, ("d", 2, "foo"): "x", ("d", 3, "foo"): "x", ("d", 4, "foo"): "y", ("d", 5, "foo"): "y", ("d", 6, "foo"): None,
        ("d", 7, "foo"): None, ("d", 3, "bar"): None, ("d", 9, "baz"): "z", ("e", 3, "foo"): "other", ("e", 2, "foo"): None, ("d", None, "foo"): None,
        ("d", 3, None): None
    }


def test_a_name_on_every_page_costs_its_rows(spark):
    d = spark.range(20_000).selectExpr("'k' doc", "id page", "'m' name", "id value")
    held = V.versions(d, ["doc"], "page", "name")
    uses = d.select("doc", "page", "name")
    assert held.count() == 20_000
    assert V.in_force(uses, held, ["doc"], "page", "name", "value").where("page > 0 and found <> page - 1 or page = 0 and found is not null").count() == 0
