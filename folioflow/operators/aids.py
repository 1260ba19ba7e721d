"""Aids: notes that help with one question, by its course passages. And where a passage stands: its headings, its page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def aid_findings(
    aids: DataFrame, answers: DataFrame, questions: DataFrame, links: DataFrame, documents: DataFrame, places: DataFrame
) -> DataFrame:
    """(aid, problem), one row for each rule that an aid breaks.

    aids (aid, question, answer or null); answers (answer, question); questions (question); links (aid, target,
    fragment); documents (target, role); places (target, fragment), what fragments name in a document.
    unknown question; unknown answer; answer to another question; imprecise course link (no heading or block);
    missing or ambiguous course place; no precise course link. Only documents of the role course or mixed count.
    """
    found = [
        aids.join(
            questions.select("question").distinct(), "question", "left_anti"
        ).select("aid", F.lit("unknown question").alias("problem"))
    ]
    known = answers.groupBy("answer").agg(F.max("question").alias("_asked"))
    named = aids.where("answer is not null").join(known, "answer", "left")
    found.append(named.where("_asked is null").select("aid", F.lit("unknown answer").alias("problem")))
    found.append(named.where("_asked <> question").select("aid", F.lit("answer to another question").alias("problem")))
    course = links.join(documents.where(F.col("role").isin("course", "mixed")).select("target").distinct(), "target", "left_semi")
    imprecise = F.coalesce(F.col("fragment"), F.lit("")) == ""
    found.append(course.where(imprecise).select("aid", F.lit("imprecise course link").alias("problem")))
    hits = places.groupBy("target", "fragment").agg(F.count(F.lit(1)).alias("_n"))
    precise = course.where(~imprecise).join(hits, ["target", "fragment"], "left")
    found.append(precise.where("coalesce(_n, 0) <> 1").select("aid", F.lit("missing or ambiguous course place").alias("problem")))
    found.append(
        aids.join(precise.where("_n = 1").select("aid"), "aid", "left_anti").select("aid", F.lit("no precise course link").alias("problem"))
    )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def without_aid(questions: DataFrame, aids: DataFrame) -> DataFrame:
    """Questions that no aid is for."""
    return questions.join(aids.select("question").distinct(), "question", "left_anti")


def preceding_headings(passages: DataFrame, headings: DataFrame, on: str = "path", line: str = "line") -> DataFrame:
    """Passages with `headings`, the texts of the headings that they stand under, from the outermost.

    A heading counts up to the next one of its level or above. headings: (on, line, level 1 to 6, text). One window
    over both; a heading on a passage's own line counts for it.
    """
    rows = headings.select(on, line, "level", "text", F.lit(0).alias("_what")).unionByName(
        passages.withColumn("_what", F.lit(1)), allowMissingColumns=True
    )
    so_far = W.partitionBy(on).orderBy(line, "_what").rowsBetween(W.unboundedPreceding, 0)
    at = lambda k: F.last(
        F.when(F.col("level") == k, F.struct(F.col(line).alias("line"), "text")), ignorenulls=True
    ).over(so_far)
    rows = rows.withColumns({f"_{k}": at(k) for k in range(1, 7)}).where("_what = 1")
    kept = [
        F.when(
            F.col(f"_{k}.line") > F.greatest(F.lit(-1), *[F.coalesce(F.col(f"_{j}.line"), F.lit(-1)) for j in range(1, k)], F.lit(-1)),
            F.col(f"_{k}.text")
        ) for k in range(1, 7)
    ]
    return rows.withColumn("headings", F.array_compact(F.array(*kept))).select(*passages.columns, "headings")


def starting_page(units: DataFrame, pages: DataFrame, on: str = "path", line: str = "line", page: str = "page") -> DataFrame:
    """Units with `page`: that of the last page mark at or before their line; null before the first. One window over both."""
    rows = pages.select(on, line, page, F.lit(0).alias("_what")).unionByName(units.withColumn("_what", F.lit(1)), allowMissingColumns=True)
    so_far = W.partitionBy(on).orderBy(line, "_what").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(
        page, F.last(F.when(F.col("_what") == 0, F.col(page)), ignorenulls=True).over(so_far)
    ).where("_what = 1").select(*units.columns, page)
