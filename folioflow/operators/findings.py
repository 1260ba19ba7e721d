"""Findings over parsed notes: (code, severity, path, line, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normal_heading, page_fragment, safe_scheme
from . import integrity as I
from .links import resolve_links

QUESTION, ANSWER = "question", "reponse"
#: Words with which the heading of something that should be a unit or a callout begins.
UNIT_WORDS = ["theorem", "definition", "lemma", "proposition", "property", "corollary", "exercise", "example", "remark", "proof", "method"]
#: A relationship footer: one link, and after ` · ` at most one to a PDF; nothing else in the line.
FOOTER = r"^\[(?:Question|Exercise|Correction)\]\([^()\s]+\)(?: · \[PDF[^\]]*\]\([^()\s]+\.pdf(?:#[^()\s]*)?\))?$"


def _rows(df: DataFrame, code: str, severity: str, line, detail) -> DataFrame:
    line = F.col(line) if isinstance(line, str) else line
    return df.select(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), "path", line.cast("int").alias("line"),
        detail.cast("string").alias("detail")
    )


def check_notes(t: dict[str, DataFrame], pages: DataFrame | None = None) -> DataFrame:
    """All findings of parsed notes (see sources.markdown.tables). pages: (target, page_count) of PDFs.

    Every rule is an equi-join on the document, an anti-join or one window; none pairs documents with each other.
    """
    notes, links, callouts, headings = t["notes"], t["links"], t["callouts"], t["headings"]
    found = [_rows(notes.where("error is not null"), "front-matter", "error", F.lit(1), F.col("error"))]
    problems = t["problems"]
    found.append(
        _rows(
            problems.withColumn("k", F.col("code")), "structure", "error", "line", F.concat_ws(": ", "k", "detail")
        ).withColumn("code", F.split("detail", ": ")[0])
    )
    twice = I.duplicates(t["anchors"], ["path", "anchor"])
    found.append(_rows(t["anchors"].join(twice, ["path", "anchor"]), "duplicate-anchor", "error", "line", F.col("anchor")))
    found.append(
        _rows(
            links.where(~safe_scheme(F.when(F.col("target") != "", F.col("target")).otherwise("x"))), "unsafe-link", "error", "line",
            F.col("target")
        )
    )

    local = links.where(
        F.col("target").rlike(r"(?i)\.md$") | (F.col("target") == "") | (F.col("form") == "wiki")
    ).where(~F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))
    local = resolve_links(local, notes).withColumnRenamed("to", "found").drop("status")
    found.append(_rows(local.where("found is null"), "missing-link", "error", "line", F.concat_ws("#", "target", "fragment")))
    anchors = t["anchors"].select(F.col("path").alias("found"), F.concat(F.lit("^"), "anchor").alias("fragment")).distinct()
    at_block = local.where("found is not null and fragment like '^%'")
    found.append(_rows(at_block.join(anchors, ["found", "fragment"], "left_anti"), "missing-anchor", "error", "line", F.col("fragment")))
    at_heading = local.where("found is not null and fragment <> '' and fragment not like '^%'").withColumn(
        "h", normal_heading(F.coalesce(F.try_url_decode("fragment"), F.col("fragment")))
    )
    hs = headings.groupBy(F.col("path").alias("found"), normal_heading(F.col("text")).alias("h")).agg(F.count(F.lit(1)).alias("hits"))
    found.append(
        _rows(
            at_heading.join(hs, ["found", "h"], "left").where("hits is null or hits > 1"), "missing-heading", "error", "line",
            F.col("fragment")
        )
    )
    if pages is not None:
        pdf = links.where(F.col("target").rlike(r"(?i)\.pdf$")).withColumn("page", page_fragment(F.concat(F.lit("#"), "fragment")))
        found.append(
            _rows(
                pdf.join(pages, "target").where("page is not null and (page < 1 or page > page_count)"), "pdf-page", "error", "line",
                F.col("fragment")
            )
        )

    jump = headings.withColumn("previous", F.lag("level").over(W.partitionBy("path").orderBy("line")))
    found.append(_rows(jump.where("level > previous + 1"), "heading-gap", "review", "line", F.col("text")))
    units = t["units"].select("path", F.col("lo"), F.col("hi"), F.struct("uid", "kind").alias("unit"))
    blocks = callouts.where(F.col("kind").isin(QUESTION, ANSWER)).select("path", "line", "kind", "anchor")
    owned = I.innermost(blocks, units, ["path"], "line", name="unit")
    right = F.when(F.col("kind") == QUESTION, "exercise").otherwise("correction")
    found.append(_rows(owned.where(F.coalesce(F.col("owner.kind"), F.lit("")) != right), "unit-owner", "error", "line", F.col("anchor")))
    answers, _ = answer_links(t)
    found.append(_rows(answers.where("not matched"), "unmatched-answer", "review", "line", F.col("anchor")))
    lines = callouts.select(
        "path", F.col("line").alias("at"), F.posexplode(F.split("body", "\n")).alias("n", "text")
    ).withColumn("line", F.col("at") + F.col("n") + 1)
    footers = lines.where(F.trim("text").rlike(r"^\[(?:Question|Exercise|Correction)\]\("))
    found.append(_rows(footers.where(~F.trim("text").rlike(FOOTER)), "malformed-field", "error", "line", F.trim("text")))
    held = callouts.where(F.col("anchor").isNotNull() & (F.col("kind") != QUESTION)).select(
        F.regexp_replace("path", r"^.*/", "").alias("file"), F.col("anchor").alias("question"), F.col("kind").alias("other")
    ).distinct()
    found.append(_rows(answers.where("not matched").join(held, ["file", "question"]), "relationship-kind", "error", "line", F.col("other")))
    titled = headings.where(F.lower(F.trim(F.col("text"))).rlike(r"^[*_]*(?:" + "|".join(UNIT_WORDS) + r")\s+[0-9]"))
    owner = I.innermost(titled, units, ["path"], "line", name="unit")
    found.append(
        _rows(
            owner.where(F.coalesce(F.col("owner.kind"), F.lit("section")) == "section"), "unclassified-unit", "review", "line",
            F.col("text")
        )
    )
    asked = callouts.where(F.col("kind") == QUESTION).select("path").distinct()
    items = t["blocks"].where("kind = 'item'").join(
        notes.where("role = 'exercise'").select("path"), "path"
    ).join(asked, "path", "left_anti")
    found.append(_rows(items, "unclassified-item", "review", "start", F.col("text")))
    return reduce(DataFrame.unionByName, found)


def answer_links(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers with the question their own footer names, matched; questions). Never matched by number."""
    c = t["callouts"]
    questions = c.where(F.col("kind") == QUESTION).select(F.col("path").alias("question_path"), F.col("anchor").alias("question"))
    answers = c.where(F.col("kind") == ANSWER).select("path", "line", "hi", "anchor")
    footers = t["links"].where("fragment like '^%' and lower(label) like 'question%'").select(
        "path", F.col("line").alias("at"),
        F.when(F.col("target") == "", F.col("path")).otherwise(F.regexp_replace("target", r"^.*/", "")).alias("file"),
        F.substring("fragment", 2, 1 << 20).alias("question")
    )
    named = answers.join(footers, "path", "left").where("at is null or at between line and hi").groupBy("path", "line", "hi", "anchor").agg(
        F.max_by(F.struct("file", "question"), "at").alias("q")
    )
    # an answer whose document has footers, but none of its own, stays
    named = answers.join(named, ["path", "line", "hi", "anchor"], "left").select(
        "path", "line", "hi", "anchor", F.regexp_replace("q.file", r"^.*/", "").alias("file"), "q.question"
    )
    keys = questions.select(F.regexp_replace("question_path", r"^.*/", "").alias("file"), "question", "question_path")
    return I.linked(named, keys, ["file", "question"]), questions


def counts(t: dict[str, DataFrame]) -> DataFrame:
    """One row of documents, questions, answers, hints and explanations."""
    kinds = t["callouts"].select("kind").union(t["notes"].where("type = 'document'").select(F.lit("#document")))
    n = lambda k: F.count_if(F.col("kind") == k)
    return kinds.agg(
        n(QUESTION).alias("questions"), n(ANSWER).alias("answers"), n("hint").alias("hints"), n("explanation").alias("explanations"),
        n("#document").alias("documents")
    )


def inventory(t: dict[str, DataFrame]) -> DataFrame:
    """(path, id, json): a note's units, blocks with the unit that owns them, and headings, in source order, as one JSON object."""
    units = t["units"].select("path", "lo", "hi", "uid", "kind")
    owned = I.innermost(t["callouts"].where("anchor is not null").select("path", "line", "anchor", "kind"), units, ["path"], "line")
    of = lambda rows, name, order, *cols: rows.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("line"), *cols))).alias(name)
    )
    parts = [
        of(units, "units", "lo", "uid", "kind"), of(owned, "blocks", "line", "anchor", "kind", "owner"),
        of(t["headings"], "headings", "line", "level", "text")
    ]
    out = t["notes"].where("error is null").select("path", "id")
    for p in parts:
        out = out.join(p, "path", "left")
    return out.select(
        "path", "id",
        F.to_json(
            F.struct(
                *[
                    F.coalesce(F.col(c), F.array()).alias(c) if c != "headings" else F.coalesce(
                        F.transform("headings", lambda h: h["text"]), F.array().cast("array<string>")
                    ).alias(c) for c in ("units", "blocks", "headings")
                ]
            ),
            {"ignoreNullFields": "false"}
        ).alias("json")
    )
