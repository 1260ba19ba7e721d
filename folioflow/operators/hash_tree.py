"""Stored trees of hashes: two versions of a table are compared from the root, reading only the branches that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import put_folder

#: Hex digits of the key's hash that name a branch at each level below the root; the last level's branches hold rows.
LEVELS = (0, 2, 4, 6)


def _joined(rows: DataFrame, by: list, order: str, digest: str) -> DataFrame:
    """The digest of the rows' digests in the order of a key, by branch."""
    held = F.array_sort(F.collect_list(F.struct(order, digest)))
    text = F.array_join(F.transform(held, lambda x: F.concat_ws("=", x[order], x[digest])), "\n")
    return rows.groupBy(*by).agg(F.sha2(text, 256).alias("digest"))


def store_tree(rows: DataFrame, keys: list[str], path: str) -> None:
    """Writes rows (any columns) as a tree of hashes to a folder that isn't there yet.

    A row's branch is given by its keys' hash alone, so a row that changes does so in one branch of each level. Rows
    lie in `rows`, in ranges of branches, and branches in `level=…`. There is a row a key; the rows of a key that
    repeats count together, whatever their order, and should be few. A branch holds 256 others, or a 16-millionth of
    all keys on the last level.
    """
    last = LEVELS[-1]
    text = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    each = rows.select(text(keys).alias("key"), F.sha2(text(sorted(rows.columns)), 256).alias("digest"))
    each = each.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"))
    same = F.array_sort(F.collect_list(F.concat_ws("*", "digest", F.col("n").cast("string"))))
    leaves = each.groupBy("key").agg(F.sha2(F.array_join(same, ""), 256).alias("digest")).withColumn("leaf", F.left(F.sha2("key", 256), F.lit(last)))
    # in ranges, so that a scan of some branches skips the files of others
    put_folder(leaves.repartitionByRange("leaf").sortWithinPartitions("leaf"), f"{path}/rows", "parquet")
    spark = rows.sparkSession
    held = spark.read.parquet(f"{path}/rows")
    level = _joined(held.select("leaf", "key", "digest"), [F.col("leaf").alias("branch")], "key", "digest")
    put_folder(level.select("branch", "digest").orderBy("branch"), f"{path}/level={last}", "parquet")
    for above, below in reversed(list(zip(LEVELS, LEVELS[1:]))):
        lower = spark.read.parquet(f"{path}/level={below}").withColumnRenamed("branch", "below").withColumnRenamed("digest", "held")
        up = _joined(lower.withColumn("branch", F.left("below", F.lit(above))), ["branch"], "below", "held").select("branch", "digest")
        put_folder(up.orderBy("branch"), f"{path}/level={above}", "parquet")


def fingerprint(spark: SparkSession, path: str) -> str | None:
    """A3: the root's digest; null for a tree of no rows."""
    root = spark.read.parquet(f"{path}/level={LEVELS[0]}").select("digest").first()
    return root["digest"] if root else None


def _differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    left, right = (d.select(key, F.col("digest").alias(c)) for d, c in ((a, "_a"), (b, "_b")))
    return left.join(right, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))


def changed_rows(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(key, change): the keys, as JSON, of rows added, removed or changed between two stored trees.

    The roots are compared first: trees that are alike are read no further. Below, only branches that differ are
    looked into; their names (256 at most on the second level) go to the scans as filters, which skip what is sorted
    elsewhere.
    """
    kind = "key string, change string"
    if fingerprint(spark, before) == fingerprint(spark, after):
        return spark.createDataFrame([], kind)
    level = lambda path, n: spark.read.schema("branch string, digest string").parquet(f"{path}/level={n}")
    first = [r["branch"] for r in _differing(level(before, LEVELS[1]), level(after, LEVELS[1]), "branch").collect()]
    some = lambda c: F.left(c, F.lit(LEVELS[1])).isin(first) & F.col(c).between(min(first), max(first) + "g")
    names = None
    for n in LEVELS[2:]:
        lower = [level(p, n).where(some("branch")) for p in (before, after)]
        if names is not None:
            above = names.select(F.col("branch").alias("_above"))
            lower = [d.join(above, F.left("branch", F.lit(n - 2)) == F.col("_above"), "left_semi") for d in lower]
        names = _differing(*lower, "branch")
    leaf = names.select(F.col("branch").alias("leaf"))
    read = lambda path: spark.read.parquet(f"{path}/rows").where(some("leaf")).join(leaf, "leaf", "left_semi")
    both = _differing(read(before), read(after), "key")
    return both.select("key", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))
