"""Document edits: a closed set of insertions that can be taken back exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The only operations; each inserts whole lines, or appends to one, and never changes what a source line says.
OPERATIONS = ("unit", "callout", "anchor", "heading")
EDIT = "doc string, op string, start int, end int, id string, kind string, title string, level int, links string, pdf string"


def insertions(edits: DataFrame) -> DataFrame:
    """M2 as rows: (doc, gap, side, seq, lines, open): what goes between two source lines, in the order (side, seq).

    gap n lies after source line n. What ends a block at line n (side 0) comes before what begins one at line n + 1
    (side 1); beginnings stand in the order of `_ranked`, ends in reverse. open is 1 where a callout begins to quote
    lines, -1 where it stops.
    """
    r, none = F.col("rank"), F.array().cast("array<string>")
    begin = F.when(F.col("op") == "unit", F.concat_ws(" ", F.lit("%% unit"), "kind", "id", F.lit("%%"))).when(
        F.col("op") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), F.coalesce("title", F.lit("")))
    ).when(F.col("op") == "callout", F.rtrim(F.concat(F.lit("> [!"), F.coalesce("kind", F.lit("")), F.lit("] "), F.coalesce("title", F.lit("")))))
    parts = F.filter(F.concat(F.split(F.coalesce("links", F.lit("")), "\n"), F.array(F.coalesce("pdf", F.lit("")))), lambda x: x != "")
    foot = F.when(F.size(parts) > 0, F.array(F.lit(">"), F.concat(F.lit("> "), F.array_join(parts, " · ")))).otherwise(none)
    anchor = F.when(F.coalesce("id", F.lit("")) != "", F.array(F.concat(F.lit("> ^"), "id"))).otherwise(none)
    end = F.when(F.col("op") == "unit", F.array(F.concat(F.lit("%% /unit "), "id", F.lit(" %%")))).when(
        F.col("op") == "anchor", F.array(F.concat(F.lit("^"), "id"))
    ).when(F.col("op") == "callout", F.concat(foot, anchor))
    open_ = F.when(F.col("op") == "callout", 1).otherwise(0)
    rows = _ranked(edits).where(F.col("op").isin(*OPERATIONS)).select(
        "doc",
        F.explode(
            F.array(
                F.struct((F.col("start") - 1).alias("gap"), F.lit(1).alias("side"), r.alias("seq"), F.array(begin).alias("lines"), open_.alias("open")),
                F.struct(F.coalesce("end", "start").alias("gap"), F.lit(0).alias("side"), (-r).alias("seq"), end.alias("lines"), (-open_).alias("open"))
            )
        ).alias("x")
    ).select("doc", "x.*")
    return rows.where(F.col("lines").isNotNull() & F.get("lines", F.lit(0)).isNotNull() | (F.col("open") != 0))


def _ranked(edits: DataFrame) -> DataFrame:
    """edits with `rank` in their document: by start, operation, end from the last, then by what they say."""
    op = F.coalesce(F.array_position(F.array(*map(F.lit, OPERATIONS)), F.col("op")), F.lit(0))
    order = ["start", F.when(op == 0, len(OPERATIONS) + 1).otherwise(op), F.desc(F.coalesce("end", "start")), "id", "kind", "title", "level", "links", "pdf"]
    return edits.withColumn("rank", F.row_number().over(W.partitionBy("doc").orderBy(*order)))


def review_lines(reviews: DataFrame) -> DataFrame:
    """M5: (doc, appendix) of reviews (doc, seq, note): a comment a note, in order; newlines become spaces and comment delimiters are escaped. Null notes go."""
    note = F.replace(F.regexp_replace("note", r"[\r\n]+", " "), F.lit("%%"), F.lit("% %"))
    line = F.concat(F.lit("%% review: "), note, F.lit(" %%"))
    rows = reviews.where("note is not null").select("doc", F.struct("seq", line.alias("line")).alias("x"))
    return rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("appendix"))


def _problem(n_lines: Column) -> Column:
    """The first of a document's edits, by rank, that can't be made, in words; checks: (rank, op, known, lo, hi, overlaps)."""
    bad = F.filter("_checks", lambda e: ~e["known"] | ~((e["lo"] >= 1) & (e["lo"] <= e["hi"]) & (e["hi"] <= n_lines)) | e["overlaps"])
    first = F.get(bad, F.lit(0))
    return F.when(first.isNull(), F.lit(None)).when(~first["known"], F.concat(F.lit("unknown operation "), F.coalesce(first["op"], F.lit("null")))).when(
        ~((first["lo"] >= 1) & (first["lo"] <= first["hi"]) & (first["hi"] <= n_lines)),
        F.concat(F.lit("lines "), first["lo"].cast("string"), F.lit("-"), first["hi"].cast("string"), F.lit(" aren't in the document"))
    ).otherwise("callouts overlap")


def _checks(edits: DataFrame) -> DataFrame:
    rows = _ranked(edits).withColumn("hi", F.coalesce("end", "start"))
    known = F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False))
    before = F.max(F.when(F.col("op") == "callout", F.col("hi"))).over(
        W.partitionBy("doc").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    )
    overlaps = F.coalesce((F.col("op") == "callout") & (before >= F.col("start")), F.lit(False))
    one = F.struct("rank", "op", known.alias("known"), F.coalesce("start", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(0)).alias("hi"), overlaps.alias("overlaps"))
    return rows.select("doc", one.alias("e")).groupBy("doc").agg(F.array_sort(F.collect_list("e")).alias("_checks"))


def newline_of(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r\n")), "\r\n").when(F.contains(text, F.lit("\r")), "\r").otherwise("\n")


def assemble(documents: DataFrame, edits: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """M1, M2, M5, M6: (doc, source, text, added, error) of documents (doc, text): texts with their edits, and what was added: (line, what) from 1.

    Edits meet as rows with order keys: what stands in a gap is one sorted aggregation, a document's gaps another, and
    the text is put together in one pass over its lines, in proportion to its length. what is the inserted
    line, or `> ` where a source line was quoted. Appendices stand after everything else. A document with an edit that
    can't be made has an error and no text. Null texts are an error, too. The source's own newline is used throughout.
    """
    gaps = insertions(edits).groupBy("doc", "gap").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("side", "seq", "lines"))), lambda x: x["lines"])).alias("lines"), F.sum("open").alias("open")
    )
    until = W.partitionBy("doc").orderBy("gap").rowsBetween(W.unboundedPreceding, -1)
    gaps = gaps.withColumns(
        {"quoted": F.coalesce(F.sum("open").over(until), F.lit(0)) > 0, "shift": F.coalesce(F.sum(F.size("lines")).over(until), F.lit(0)).cast("int")}
    )
    held = gaps.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("gap", "lines", "quoted", "shift"))).alias("_gaps"))
    rows = documents.select("doc", F.col("text").alias("source")).join(held, "doc", "left").join(_checks(edits), "doc", "left")
    rows = rows.join(review_lines(reviews), "doc", "left") if reviews is not None else rows.withColumn("appendix", F.lit(None).cast("array<string>"))
    some = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    rows = rows.withColumns(
        {
            "_gaps": some("_gaps", "array<struct<gap:int,lines:array<string>,quoted:boolean,shift:int>>"), "appendix": some("appendix", "array<string>")
        }
    )
    pair = lambda line, what: F.struct(line.cast("int").alias("line"), what.alias("what"))
    none, nothing = F.array().cast("array<struct<line:int,what:string>>"), F.array().cast("array<string>")
    since = lambda i: F.when(i > 0, F.get("_gaps", i - 1)["gap"]).otherwise(-1)
    entry = lambda x, lines: F.struct(lines.alias("lines"), x["quoted"].alias("quoted"), x["shift"].alias("shift"))
    # an entry for each gap up to the last, so that a line finds its own by index; those between have no lines
    dense = F.flatten(
        F.transform("_gaps", lambda x, i: F.concat(F.array_repeat(entry(x, nothing), x["gap"] - since(i) - 1), F.array(entry(x, x["lines"]))))
    )

    def whole(lines: Column, gaps: Column) -> Column:
        at = lambda n: F.coalesce(F.get(gaps, n)["lines"], nothing)
        mark = lambda line, n: F.when(F.get(gaps, n)["quoted"], F.concat(F.lit("> "), line)).otherwise(line)
        parts = F.transform(lines, lambda line, i: F.concat(F.array(mark(line, i + 1)), at(i + 1)))
        return F.concat(at(F.lit(0)), F.flatten(parts), F.col("appendix"))

    def added(lines: Column, gaps: Column) -> Column:
        at = F.transform(
            gaps,
            lambda x, n: F.concat(
                F.when(x["quoted"] & (n > 0), F.array(pair(n + x["shift"], F.lit("> ")))).otherwise(none),
                F.transform(x["lines"], lambda line, k: pair(n + x["shift"] + k + 1, line))
            )
        )
        before = F.size(lines) + F.aggregate("_gaps", F.lit(0), lambda a, x: a + F.size(x["lines"]))
        end = F.transform(F.array(before), lambda n: F.transform("appendix", lambda line, k: pair(n + k + 1, line)))[0]
        return F.concat(F.flatten(at), end)

    def made(lines: Column) -> Column:
        error = F.when(F.col("source").isNull(), "no text").otherwise(_problem(F.size(lines)))
        text = lambda gaps: F.call_function("array_join", whole(lines, gaps), newline_of(F.col("source")))
        both = F.transform(F.array(dense), lambda gaps: F.struct(text(gaps).alias("text"), added(lines, gaps).alias("added")))[0]
        return F.transform(
            F.array(error),
            lambda e: F.struct(F.when(e.isNull(), both).alias("of"), e.alias("error"))
        )[0]

    # lines are cut once a row, however often they are looked at
    cut = F.split(F.coalesce("source", F.lit("")), "\\r\\n|\\r|\\n")
    rows = rows.select("doc", "source", F.transform(F.array(cut), made)[0].alias("_made"))
    return rows.select("doc", "source", "_made.of.text", "_made.of.added", "_made.error")


def take_back(texts: DataFrame, added: DataFrame) -> DataFrame:
    """M3: (doc, text, problem) of texts (doc, text) without what was added to them (doc, line, what), and nothing else taken away.

    Lines meet the additions by (doc, line): inserted lines go, quoted ones lose their mark, the others stay. Where a
    line isn't what was added there, or isn't there at all, the text is null and the first such line is the problem.
    doc names one text.
    """
    whole = texts.select("doc", "text", newline_of(F.col("text")).alias("newline"))  # looked at once a text, not once a line
    lines = whole.select("doc", "newline", F.posexplode(F.split("text", "\\r\\n|\\r|\\n")).alias("at", "text"))
    lines = lines.select("doc", (F.col("at") + 1).alias("line"), "newline", "text")
    met = lines.join(added.select("doc", "line", "what"), ["doc", "line"], "full")
    marked = (F.col("what") == "> ") & F.startswith("text", F.lit("> "))
    bad = F.col("what").isNotNull() & ~(F.coalesce(marked, F.lit(False)) | F.col("text").eqNullSafe(F.col("what")))
    kept = F.when(F.col("what").isNull(), F.col("text")).when(marked, F.substring("text", 3, 1 << 30))
    rows = met.select("doc", "line", "newline", kept.alias("kept"), bad.alias("bad"))
    out = rows.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("line", "kept")))).alias("kept"), F.max("newline").alias("newline"),
        F.min(F.when(F.col("bad"), F.col("line"))).alias("wrong")
    )
    text = F.call_function("array_join", F.transform("kept", lambda x: x["kept"]), F.col("newline"))
    problem = F.when(F.col("wrong").isNotNull(), F.concat(F.lit("line "), F.col("wrong").cast("string"), F.lit(" isn't what was inserted")))
    return out.select("doc", F.when(F.col("wrong").isNull(), text).alias("text"), problem.alias("problem"))


def compile_documents(documents: DataFrame, edits: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """(doc, text, faithful, error): documents (doc, text) with their edits and review notes; faithful: taking them back gives the source's bytes.

    Rows alike in doc and text are compiled once and stand as often as before. Documents without edits are their own
    text; edits of documents that aren't there do nothing. A text that mixes newlines isn't given back as it was, and
    so isn't faithful.
    """
    made = assemble(documents, edits, reviews).withColumn("key", F.concat_ws("/", F.sha2("source", 256), "doc"))
    one = made.where("error is null").select(F.col("key").alias("doc"), "text", "added", "source").dropDuplicates(["doc"])
    back = take_back(one.select("doc", "text"), one.select("doc", F.explode("added").alias("x")).select("doc", "x.*"))
    back = back.select(F.col("doc").alias("key"), F.sha2("text", 256).alias("sha"))
    out = made.join(back, "key", "left")
    return out.select("doc", "text", F.coalesce(F.sha2("source", 256) == F.col("sha"), F.lit(False)).alias("faithful"), "error")
