"""Links of notes: paths, resolution, and rewriting of targets in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import integrity as I


def fold_path(path: Column) -> Column:
    """A relative path without `.`, empty parts and `..`; null where it leaves the root."""
    text = F.array().cast("array<string>")
    state = F.struct(text.alias("parts"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        parts = F.when(up, F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))).when(
            part.isin("", "."), acc["parts"]
        ).otherwise(F.concat(acc["parts"], F.array(part)))
        return F.struct(parts.alias("parts"), (acc["out"] | (up & (F.size(acc["parts"]) == 0))).alias("out"))

    # folded once, however often it is looked at
    return F.transform(
        F.array(F.aggregate(F.split(path, "/"), state, step)), lambda x: F.when(~x["out"], F.array_join(x["parts"], "/"))
    )[0]


def wanted_path(origin: Column, target: Column) -> Column:
    """The path that a link in `origin` names: relative to its folder, with .md where no extension is given; the note itself where the target is empty."""
    file = F.when(target.rlike(r"(?i)\.md$"), target).otherwise(F.concat(target, F.lit(".md")))
    return F.when(target == "", origin).otherwise(fold_path(F.concat(F.regexp_replace(origin, r"[^/]*$", ""), file)))


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links (path, target and others) with `to` and `status`, against notes (path, id).

    The path relative to the link's own note counts first, then a file name that only one note has. status: resolved;
    ambiguous, where several notes have the name; id, where only a note's id is like the target, which is no way to
    name it; or missing. `to` is null unless resolved. Folders may go up with `..`, not beyond the root. Links that
    name the same file are looked up once, and a name that many notes share counts as one row. Null targets are missing.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    file = F.when(F.col("target").rlike(r"(?i)\.md$"), F.col("target")).otherwise(F.concat("target", F.lit(".md")))
    asked = links.withColumns(
        {
            "_near": wanted_path(F.col("path"), F.col("target")), "_name": F.when(F.col("target") != "", name(file)),
            "_id": F.regexp_replace("target", r"(?i)\.md$", "")
        }
    )
    # near is null beyond the root, which still leaves the name
    key = F.concat_ws("\n", F.coalesce("_near", F.lit("")), F.coalesce("_name", F.lit("")), F.coalesce("_id", F.lit("")))
    asked = asked.withColumn("_key", key)
    keys = asked.groupBy("_key").agg(*(F.first(c).alias(c) for c in ("_near", "_name", "_id")))
    paths = notes.select("path").distinct()
    names = paths.groupBy(name(F.col("path")).alias("_name")).agg(F.min("path").alias("a"), F.max("path").alias("b"))
    near = keys.join(paths.select(F.col("path").alias("_near")), "_near").select("_key", F.col("_near").alias("to"), F.lit(1).alias("priority"))
    named = keys.join(names, "_name").select("_key", F.explode(F.array("a", "b")).alias("to"), F.lit(2).alias("priority"))
    ids = notes.where("id is not null").select(F.col("id").alias("_id"), F.lit(True).alias("_known")).distinct()
    found = I.resolve(keys.join(ids, "_id", "left").select("_key", "_known"), near.unionByName(named), "_key", "to")
    status = F.when((F.col("status") == "missing") & F.col("_known"), "id").otherwise(F.col("status"))
    return asked.join(found.select("_key", "to", status.alias("status")), "_key").drop("_key", "_near", "_name", "_id")


def remap_text(texts: DataFrame, spans: DataFrame, moves: DataFrame) -> DataFrame:
    """Texts (path, text and others) with the targets of their links replaced where they moved, and `remapped`, how many.

    spans: (path, line, off_lo, off_hi, target, fragment) of links and definitions, see sources.markdown; moves:
    (path, target, fragment, new_target, new_fragment), one for each (path, target, fragment). A move with a fragment
    counts before one without (null), which keeps what fragment the link has. Labels, titles, brackets and newlines
    stay as they are, and a text without moved links stays byte for byte. Where a new target would need brackets, it
    has to bring them.

    Links meet moves by equality. A text is cut into its lines once and put together in one pass over them, so the work
    is in proportion to the text, however many links it has.
    """
    on = ["path", "target"]
    exact = moves.where("fragment is not null").select(*on, "fragment", F.struct("new_target", "new_fragment").alias("_exact"))
    any_ = moves.where("fragment is null").select(*on, F.struct("new_target", "new_fragment").alias("_any"))
    met = spans.join(exact, [*on, "fragment"], "left").join(any_, on, "left").withColumn("_to", F.coalesce("_exact", "_any")).where("_to is not null")
    fragment = F.coalesce(F.col("_to.new_fragment"), F.col("fragment"))
    new = F.concat(F.col("_to.new_target"), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    lines = met.groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("off_lo", "off_hi", new.alias("new")))).alias("spans"))
    held = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "spans"))).alias("_lines"))

    def spliced(text: Column, spans: Column) -> Column:
        """A line with its spans replaced: before each, what stands since the one before."""
        since = lambda i: F.when(i > 0, F.get(spans, i - 1)["off_hi"]).otherwise(0)
        pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, since(i) + 1, s["off_lo"] - since(i)), s["new"]))
        last = F.element_at(spans, -1)["off_hi"]
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    # an entry for each line up to the last with links, so that a line finds its own by index
    before = lambda i: F.when(i > 0, F.get("_lines", i - 1)["line"]).otherwise(0)
    blank = F.lit(None).cast("array<struct<off_lo:int,off_hi:int,new:string>>")
    dense = F.flatten(F.transform("_lines", lambda x, i: F.concat(F.array_repeat(blank, x["line"] - before(i) - 1), F.array(x["spans"]))))

    def rebuilt(all_: Column) -> Column:
        own = lambda line, spans: F.when(spans.isNull(), line).otherwise(spliced(line, spans))
        return F.transform(F.array(dense), lambda d: F.array_join(F.transform(all_, lambda line, i: own(line, F.get(d, i))), ""))[0]

    cut = F.split("text", r"(?<=\n)|(?<=\r)(?!\n)")  # lines with the newline that ends each
    out = texts.join(held, "path", "left")
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.transform(F.array(cut), rebuilt)[0])
    n = F.coalesce(F.aggregate("_lines", F.lit(0), lambda a, x: a + F.size(x["spans"])), F.lit(0))
    return out.withColumns({"text": text, "remapped": n}).drop("_lines")
