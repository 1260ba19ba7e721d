"""Integrity operators: references, ownership, identity, snapshots, completeness, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import innermost  # noqa: F401  D3, with the other checks


def dangling(rows: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a target."""
    return rows.join(targets.select(*on).distinct(), on, "left_anti")


def published_only(rows: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Rows with a target."""
    return rows.join(targets.select(*on), on, "left_semi")


def linked(answers: DataFrame, questions: DataFrame, on: list[str]) -> DataFrame:
    """Answers with their question's columns; unmatched ones stay, with nulls and matched = false."""
    return answers.join(questions.withColumn("matched", F.lit(True)), on, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def disagreement(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two owners are known and differ."""
    return rows.where(F.col(left) != F.col(right))


def ambiguity(rows: DataFrame, name: str, key: str) -> DataFrame:
    """(name, n, key, verdict): unique names give their key, ambiguous ones never do."""
    out = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("_key"))
    return out.select(
        name, "n", F.when(F.col("n") == 1, F.col("_key")).alias(key),
        F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("verdict")
    )


def resolve(links: DataFrame, candidates: DataFrame, on: str, target: str, priority: str = "priority") -> DataFrame:
    """The candidate of the best priority for each link; status resolved, ambiguous (several at that priority) or missing."""
    best = candidates.groupBy(on).agg(F.min(priority).alias("_p"))
    hits = candidates.join(best, on).where(F.col(priority) == F.col("_p")).groupBy(on).agg(
        F.count_distinct(target).alias("_n"), F.min(target).alias("_t")
    )
    out = links.join(hits, on, "left")
    return out.withColumn(
        "status", F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    ).withColumn(target, F.when(F.col("_n") == 1, F.col("_t"))).drop("_n", "_t")


def duplicates(rows: DataFrame, keys: list, least: int = 2) -> DataFrame:
    """(keys, n) of identities that several rows claim. Give lower(key) where case doesn't count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) with change added, removed or changed."""
    a, b = before.select(key, F.col(digest).alias("_a")), after.select(key, F.col(digest).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def manifest_check(recorded: DataFrame, present: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, problem): recorded but missing, hash differs, or present but not recorded."""
    d = snapshot_diff(recorded, present, key, digest)
    return d.select(
        key,
        F.when(F.col("change") == "removed", "missing").when(F.col("change") == "added", "unexpected").otherwise("hash").alias("problem")
    )


def set_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows) of what one side has more often than the other; nothing if they are equal."""
    left = a.exceptAll(b).select(F.lit("left").alias("side"), *a.columns)
    return left.unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), *b.columns))


def overlaps(ranges: DataFrame, doc: str, lo: str, hi: str, name: str) -> DataFrame:
    """Ranges of a document that begin at or before the end of an earlier one, with what they overlap. One window."""
    w = W.partitionBy(doc).orderBy(lo, hi, name).rowsBetween(W.unboundedPreceding, -1)
    seen = F.max(F.struct(F.col(hi), F.col(name))).over(w)
    return ranges.withColumn("_m", seen).where(
        F.col("_m").getField(hi) >= F.col(lo)
    ).withColumn("other", F.col("_m").getField(name)).drop("_m")


def status(rows: DataFrame, keys: list, errors: Column, reviews: Column) -> DataFrame:
    """(keys, errors, reviews, status, exit_code)."""
    out = rows.groupBy(*keys).agg(F.count_if(errors).alias("errors"), F.count_if(reviews).alias("reviews"))
    return out.withColumn(
        "status", F.when(F.col("errors") > 0, "invalid").when(F.col("reviews") > 0, "needs_review").otherwise("validated")
    ).withColumn("exit_code", F.when(F.col("errors") > 0, 1).when(F.col("reviews") > 0, 2).otherwise(0))


def complete_sum(rows: DataFrame, keys: list, value: str, out: str = "total") -> DataFrame:
    """A sum that is null as soon as one member is missing."""
    return rows.groupBy(*keys).agg(
        F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(value)).alias(out), F.count_if(F.col(value).isNull()).alias("missing")
    )


def size_verdict(size: Column, warn: float, limit: float) -> Column:
    """Review above warn, invalid above limit."""
    return F.when(size > limit, "invalid").when(size > warn, "review").otherwise("ok")


def page_ranges(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, ranges): distinct numbers as `1-3,7`."""
    one = rows.select(*keys, number).where(F.col(number).isNotNull()).distinct()
    island = one.withColumn("_g", F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number)))
    parts = island.groupBy(*keys, "_g").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    ordered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))).alias("p"))
    return ordered.select(*keys, F.array_join(F.transform("p", lambda x: x["t"]), ",").alias("ranges"))


def gaps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Distinct numbers more than one above the previous one of their key."""
    one = rows.select(*keys, number).distinct()
    return one.withColumn("previous", F.lag(number).over(W.partitionBy(*keys).orderBy(number))).where(F.col(number) > F.col("previous") + 1)


def sections(rows: DataFrame, key: str, order, starts: Column) -> DataFrame:
    """Rows with `section`, the number of starts up to them (0 before the first)."""
    return rows.withColumn("section", F.sum(F.when(starts, 1).otherwise(0)).over(W.partitionBy(key).orderBy(*order)))


def navigation(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with previous, next, position and total."""
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumns(
        {
            "previous": F.lag(order).over(w), "next": F.lead(order).over(w), "position": F.row_number().over(w).cast("long"),
            "total": F.count(F.lit(1)).over(W.partitionBy(key))
        }
    )


def collision_suffix(rows: DataFrame, base: str, order: str, out: str = "name") -> DataFrame:
    """The second row of a base gets `-2`, and so on."""
    n = F.row_number().over(W.partitionBy(base).orderBy(order))
    return rows.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))


def latest_attempt(rows: DataFrame, keys: list[str], attempt: str, value: str, most: int = 3) -> DataFrame:
    """(keys, attempts, value): the last of at most `most` attempts."""
    return rows.where(F.col(attempt) <= most).groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.max_by(value, attempt).alias(value))


def plan_hash(rows: DataFrame) -> DataFrame:
    """One row with a hash of all rows, whatever their order.

    A tree of hashes: digests of rows are sorted and hashed by their first six digits, those by the first three, and
    the rest as a whole, so no task sees more than a small share of the digests.
    """
    level = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("d"))
    level = level.groupBy(F.left("d", F.lit(6)).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    for digits in (3, 0):
        whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("d")
        level = level.groupBy(F.left("p", F.lit(digits)).alias("q")).agg(whole).withColumnRenamed("q", "p") if digits else level.agg(whole)
    return level.select(F.col("d").alias("plan_sha256"))


def topmost(paths: DataFrame, path: str = "path") -> DataFrame:
    """C11: the minimal roots that cover all paths: each path is joined with its own ancestors by equality."""
    p = paths.select(F.regexp_replace(path, "/+$", "").alias(path)).distinct()
    parts = F.split(path, "/")
    up = p.select(
        path,
        F.explode(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        ).alias("_up")
    ).where(F.col("_up") != F.col(path))
    covered = up.join(p.select(F.col(path).alias("_up")), "_up", "left_semi").select(path).distinct()
    return p.join(covered, path, "left_anti")
