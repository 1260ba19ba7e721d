import pytest
from pyspark.sql import functions as F

from folioflow.operators import hash_tree as H
from folioflow.sources.scratch import path_in


def test_changed_rows_are_named(spark, tmp_path):
    a, b, c, d = (f"file:{tmp_path}/{x}" for x in "abcd")
    rows = spark.range(3000).select((F.col("id") % 1500).alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("v"))
    H.store_tree(rows, ["k"], a)
    H.store_tree(rows.orderBy(F.desc("v")).repartition(7), ["k"], b)
    assert H.fingerprint(spark, a) == H.fingerprint(spark, b) and H.changed_rows(spark, a, b).count() == 0
    other = rows.where("k <> 9").withColumn("v", F.when(F.col("k") == 11, F.lit("x")).otherwise(F.col("v"))).union(spark.createDataFrame([(5000, None), (None, "n")], "k long, v string"))
    H.store_tree(other, ["k"], c)
    assert {(r.key, r.change) for r in H.changed_rows(spark, a, c).collect()} == {
        ('{"k":9}', "removed"), ('{"k":11}', "changed"), ('{"k":5000}', "added"), ('{"k":null}', "added")
    }
    H.store_tree(rows.union(rows.where("k = 3")), ["k"], d)  # a row more of a key
    assert {(r.key, r.change) for r in H.changed_rows(spark, a, d).collect()} == {('{"k":3}', "changed")}
    with pytest.raises(FileExistsError):
        H.store_tree(rows, ["k"], a)


def test_alike_trees_need_only_their_roots(spark, tmp_path):
    a, b = (f"file:{tmp_path}/{x}" for x in "ab")
    for at in (a, b):
        H.store_tree(spark.range(100), ["id"], at)
        for name in path_in(spark, at).names():
            if name != "level=0":
                path_in(spark, f"{at}/{name}").remove()
    assert H.changed_rows(spark, a, b).count() == 0


def test_only_branches_that_differ_are_read(spark, tmp_path):
    a, b = (f"file:{tmp_path}/{x}" for x in "ab")
    H.store_tree(spark.range(50_000), ["id"], a)
    H.store_tree(spark.range(50_000).where("id <> 77"), ["id"], b)
    got = H.changed_rows(spark, a, b)
    assert [(r.key, r.change) for r in got.collect()] == [('{"id":77}', "removed")]
    assert "PushedFilters: [In(" in got._jdf.queryExecution().toString() or "GreaterThanOrEqual(leaf" in got._jdf.queryExecution().toString()


def test_empty_trees(spark, tmp_path):
    a, b = (f"file:{tmp_path}/{x}" for x in "ab")
    H.store_tree(spark.range(0), ["id"], a)
    H.store_tree(spark.range(2), ["id"], b)
    assert H.fingerprint(spark, a) is None and H.changed_rows(spark, a, a).count() == 0
    assert {r.change for r in H.changed_rows(spark, a, b).collect()} == {"added"} and H.changed_rows(spark, b, a).count() == 2
