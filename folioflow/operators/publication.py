"""Operators that select, overlay and publish parsed notes (see sources.markdown.tables for their columns)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normal_heading, visible
from .intervals import innermost
from .links import fold_path


def select_fragments(wanted: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Wanted (path, fragment) with lo, hi, status: block (`^anchor`), heading (up to the next of its level or above), `L3-L9`, or all of it.

    status: ok, missing, ambiguous, or bisects where a line range cuts a code, math, table or quote block.
    Every case is an equi-join on the path; headings end by one window.
    """
    w = wanted.select("path", "fragment").distinct().withColumn(
        "h", normal_heading(F.coalesce(F.try_url_decode("fragment"), F.col("fragment")))
    )
    kind = F.when(F.col("fragment") == "", "all").when(F.col("fragment").startswith("^"), "block").when(
        F.col("fragment").rlike(r"^L\d+(-L\d+)?$"), "lines"
    ).otherwise("heading")
    w = w.withColumn("kind", kind)
    last = t["notes"].select("path", F.size(F.split("body", "\n")).alias("n"), F.size(F.split("body", "\n")).alias("body_lines"))
    whole = w.where("kind = 'all'").join(last, "path").select("path", "fragment", F.lit(1).alias("lo"), F.col("n").alias("hi"))
    spans = t["callouts"].where("anchor is not null").select(
        "path", F.concat(F.lit("^"), "anchor").alias("fragment"), F.col("line").alias("lo"), "hi"
    )
    plain = t["anchors"].select(
        "path", F.concat(F.lit("^"), "anchor").alias("fragment"), F.col("line").alias("lo"), F.col("line").alias("hi")
    ).join(spans.select("path", "fragment"), ["path", "fragment"], "left_anti")
    blocks = w.where("kind = 'block'").select("path", "fragment").join(spans.unionByName(plain), ["path", "fragment"])
    # a heading ends where the next one of its level or above begins: for each level, the first later line
    later = W.partitionBy("path").orderBy("line").rowsBetween(1, W.unboundedFollowing)
    end = F.least(
        *[
            F.when(
                F.col("level") >= k, F.first(F.when(F.col("level") == k, F.col("line")), ignorenulls=True).over(later)
            ) for k in range(1, 7)
        ]
    )
    heads = t["headings"].withColumn("end", end).select(
        "path", normal_heading(F.col("text")).alias("h"), F.col("line").alias("lo"),
        F.coalesce(F.col("end") - 1, F.lit(2**31 - 1)).alias("hi")
    )
    headings = w.where("kind = 'heading'").select("path", "fragment", "h").join(heads, ["path", "h"]).drop("h")
    lines = w.where("kind = 'lines'").select(
        "path", "fragment", F.regexp_extract("fragment", r"^L(\d+)", 1).cast("int").alias("lo"),
        F.coalesce(
            F.nullif(F.regexp_extract("fragment", r"-L(\d+)$", 1), F.lit("")), F.regexp_extract("fragment", r"^L(\d+)", 1)
        ).cast("int").alias("hi")
    )
    shut = t["blocks"].where(F.col("kind").isin("code", "math_block", "table", "quote")).select(
        "path", F.col("start").alias("s"), (F.col("end") - 1).alias("e")
    )
    cuts = lines.join(shut, "path").where(
        "(s < lo and lo <= e) or (s <= hi and hi < e)"
    ).select("path", "fragment").distinct().withColumn("bisects", F.lit(True))
    hits = whole.unionByName(blocks).unionByName(headings).unionByName(lines).groupBy("path", "fragment").agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi")
    )
    out = w.select("path", "fragment").join(hits, ["path", "fragment"], "left").join(cuts, ["path", "fragment"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(
        F.col("bisects") | (F.col("lo") > F.col("hi")), "bisects"
    ).otherwise("ok")
    return out.withColumn("status", status).select(
        "path", "fragment", F.when(F.col("status") == "ok", F.col("lo")).alias("lo"),
        F.when(F.col("status") == "ok", F.col("hi")).alias("hi"), "status"
    )


def layout_units(selected: DataFrame, units: DataFrame, kind: str = "exercise") -> DataFrame:
    """Units of a kind that selected ranges (path, lo, hi) hold or lie in, each once, in source order."""
    u = units.where(F.col("kind") == kind).select("path", "uid", F.col("lo").alias("ulo"), F.col("hi").alias("uhi"))
    hit = selected.select("path", "lo", "hi").join(u, "path").where("(ulo >= lo and uhi <= hi) or (lo >= ulo and hi <= uhi)")
    return hit.select("path", "uid", F.col("ulo").alias("lo"), F.col("uhi").alias("hi")).distinct().orderBy("path", "lo")


def partial_questions(selected: DataFrame, questions: DataFrame, units: DataFrame) -> DataFrame:
    """(path, uid, lo, hi, questions): the exercises of single questions that were chosen, each once, with the chosen ones in source order.

    selected: (path, anchor) in any order, repeated or not; questions: (path, line, anchor); units: (path, uid, kind, lo,
    hi). uid is null for questions outside all exercises. Choices that no question has leave nothing.
    """
    chosen = questions.join(selected.select("path", "anchor").distinct(), ["path", "anchor"], "left_semi").select("path", "line", "anchor")
    held = units.where("kind = 'exercise'").select("path", "lo", "hi", F.struct("uid", "lo", "hi").alias("unit"))
    owned = innermost(chosen, held, ["path"], "line", name="unit")
    one = owned.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("line", "anchor"))).alias("q"))
    return one.select("path", "owner.uid", "owner.lo", "owner.hi", F.transform("q", lambda x: x["anchor"]).alias("questions"))


def override(defaults: DataFrame, overrides: DataFrame, key: str, options: list[str]) -> DataFrame:
    """Defaults with each option replaced where an override names it; problem: unknown option or unpublished target.

    overrides: (key, choices map<string,array<string>>); an empty array suppresses.
    """
    o = overrides.select(key, F.col("choices"))
    out = defaults.join(o, key, "full_outer")
    extra = F.array_except(F.map_keys("choices"), F.array(*map(F.lit, options)))
    gone = ~F.greatest(*[F.col(c).isNotNull() for c in options])
    problem = F.when(gone, F.lit("unpublished target")).when(
        F.size(extra) > 0, F.concat(F.lit("unknown option "), F.array_join(extra, ", "))
    )
    return out.select(
        key, *[F.coalesce(F.try_element_at("choices", F.lit(c)), F.col(c)).alias(c) for c in options], problem.alias("problem")
    )


def group_in_order(rows: DataFrame, owner: str, order: str, value: str) -> DataFrame:
    """(owner, values) in source order, whatever the order asked for."""
    return rows.groupBy(owner).agg(
        F.array_sort(F.collect_list(F.struct(order, value))).alias("x")
    ).select(owner, F.transform("x", lambda s: s[value]).alias("values"))


def worksheet(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Units and what lies between them, once each, in source order: (path, position, kind, uid, lo)."""
    top = units.where("depth = 0").select("path", F.col("lo"), F.col("hi"), "uid")
    seen = F.max("hi").over(W.partitionBy("path").orderBy("lo", F.desc("uid")).rowsBetween(W.unboundedPreceding, 0))
    rows = top.select("path", "lo", "hi", "uid").unionByName(
        blocks.select("path", F.col("start").alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit(None).cast("string").alias("uid"))
    )
    rows = rows.withColumn("_to", seen).where(F.col("uid").isNotNull() | F.col("_to").isNull() | (F.col("lo") > F.col("_to")))
    return rows.select(
        "path", F.row_number().over(W.partitionBy("path").orderBy("lo")).alias("position"),
        F.when(F.col("uid").isNotNull(), "unit").otherwise("between").alias("kind"), "uid", "lo"
    )


def related(exercises: DataFrame, links: DataFrame, passage: str = "passage", exercise: str = "exercise", doc: str = "doc") -> DataFrame:
    """(passage, exercise): of the same source document, or explicitly linked; never inferred otherwise.

    exercises: (exercise, doc); links: (passage, doc, exercise or null).
    """
    same = links.select(passage, doc).distinct().join(exercises.select(exercise, doc), doc).select(passage, exercise)
    return same.union(links.where(F.col(exercise).isNotNull()).select(passage, exercise)).distinct()


def figure_pages(figures: DataFrame, figure: str, regions: str, page: str) -> DataFrame:
    """(figure, pages, needs_review): one that spans several pages isn't classified."""
    one = figures.select(figure, F.explode_outer(regions).alias("r")).select(figure, F.col(f"r.{page}").alias("p"))
    return one.groupBy(figure).agg(F.array_sort(F.collect_set("p")).alias("pages")).withColumn("needs_review", F.size("pages") != 1)


def remap(links: DataFrame, moves: DataFrame, target: str = "target", new: str = "new") -> DataFrame:
    """Links with targets replaced where they moved; label and title stay."""
    m = moves.select(F.col(target), F.col(new).alias("_new"))
    return links.join(m, target, "left").withColumn(target, F.coalesce("_new", target)).drop("_new")


def resume_accounting(calls: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """(keys, completed, uncertain, remaining_minimum, remaining_maximum): an uncertain call may have to be made again."""
    out = calls.groupBy(*keys).agg(
        F.count_if(F.col(state) == "completed").alias("completed"), F.count_if(F.col(state) == "uncertain").alias("uncertain"),
        F.count_if(F.col(state) == "open").alias("_open")
    )
    return out.select(
        *keys, "completed", "uncertain", F.col("_open").alias("remaining_minimum"),
        (F.col("_open") + F.col("uncertain")).alias("remaining_maximum")
    )


def overlay(chapter: DataFrame, drafts: DataFrame, key: str = "path") -> DataFrame:
    """Chapter and drafts as one, with problem where a draft is there twice or would overwrite; keys count without case."""
    both = chapter.withColumn("draft", F.lit(False)).unionByName(drafts.withColumn("draft", F.lit(True)))
    w = W.partitionBy(F.lower(key))
    problem = F.when(
        F.col("draft") & (F.count_if(~F.col("draft")).over(w) > 0), "overwrites"
    ).when(F.col("draft") & (F.count_if(F.col("draft")).over(w) > 1), "duplicate")
    return both.withColumn("problem", problem)


def preflight(settings: DataFrame, required: list[str], secret: list[str]) -> DataFrame:
    """Settings with blockers, a list of what is missing; secrets show as ***."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c} is not set")) for c in required]))
    return settings.withColumn("blockers", missing).withColumns({c: F.when(F.col(c).isNotNull(), "***") for c in secret})


def write_denied(
    tool: Column, path: Column, root: str, tutor: Column, writers: tuple[str, ...] = ("create", "edit", "write", "move")
) -> Column:
    """A tutor's tool call that writes under root."""
    return F.coalesce(tutor & tool.isin(*writers) & ((path == root) | path.startswith(root.rstrip("/") + "/")), F.lit(False))


#: Arguments of a tool call that name files, tools that write, and how a patch names what it works on.
PATH_ARGUMENTS = ("path", "paths", "file", "files", "source", "destination", "target")
WRITERS = ("create", "edit", "write", "move", "move_file", "delete", "apply_patch")
PATCHED = r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+?)[ \t\r]*$"


def target_paths(arguments: Column) -> Column:
    """The paths that a tool call's arguments (JSON) name, in the order of PATH_ARGUMENTS: strings and strings in arrays, and the files of a patch in `input`. Empty ones and what isn't a string don't count; none for null and for what isn't JSON."""
    whole = F.try_parse_json(arguments)
    kind = lambda v: F.schema_of_variant(v)
    text = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    none = F.array().cast("array<string>")

    def named(name: str) -> Column:
        v = F.try_variant_get(whole, f"$.{name}", "variant")
        return F.when(kind(v) == "STRING", F.array(text(v))).when(
            kind(v).startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), text)
        ).otherwise(none)

    patch = F.coalesce(F.regexp_extract_all(F.try_variant_get(whole, "$.input", "string"), F.lit(PATCHED), F.lit(1)), none)
    return F.coalesce(F.filter(F.concat(*map(named, PATH_ARGUMENTS), patch), lambda x: x.isNotNull() & (x != "")), none)


def is_agent(agent: Column, name: str) -> Column:
    """Whether an agent goes by a name, whatever the case, blanks, hyphens and underscores; null doesn't."""
    bare = F.regexp_replace(F.lower(agent), r"[\s_-]+", "")
    return F.coalesce(bare == "".join(c for c in name.lower() if c not in " _-"), F.lit(False))


def denied_writes(calls: DataFrame, key: str, root: str, tutor: str, open_folder: str | None = None) -> DataFrame:
    """(key, path) of what a tutor's calls (key, tool, arguments, cwd, agent) would write under root; a call with any such path is denied.

    Paths are taken from the call's folder where they aren't absolute, with `.` and `..` folded. JSON files that lie
    directly in open_folder, below root, may be written. Other agents, and tools that only read, are denied nothing.
    """
    rows = calls.where(is_agent(F.col("agent"), tutor) & F.col("tool").isin(*WRITERS))
    rows = rows.select(key, "cwd", F.explode(target_paths(F.col("arguments"))).alias("_p"))
    from_here = F.when(F.startswith("_p", F.lit("/")), F.col("_p")).otherwise(F.concat_ws("/", "cwd", "_p"))
    rows = rows.select(key, F.concat(F.lit("/"), fold_path(from_here)).alias("path"))
    top = root.rstrip("/")
    inside = (F.col("path") == top) | F.startswith("path", F.lit(f"{top}/"))
    if open_folder:
        rest = F.substring("path", F.lit(len(top) + len(open_folder.strip("/")) + 3), F.length("path"))
        inside = inside & ~(F.startswith("path", F.lit(f"{top}/{open_folder.strip('/')}/")) & rest.rlike(r"(?i)^[^/]+\.json$"))
    return rows.where(inside).distinct()


def published_files(record: DataFrame, files: DataFrame) -> DataFrame:
    """Exactly the recorded files, with content, and whether each hash matches. record has files map<path, sha256>."""
    r = record.select(F.explode("files").alias("path", "recorded"))
    return r.join(files.select("path", "content"), "path", "left").withColumn(
        "matches", F.coalesce(F.sha2("content", 256) == F.col("recorded"), F.lit(False))
    )


def within_limits(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, n, accepted): a batch of more than `most` rows is refused whole, never cut."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("accepted", F.col("n") <= most)


def proposal(rows: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(path, sha256, bytes) of what is proposed."""
    return rows.select(key, F.sha2(text, 256).alias("sha256"), F.octet_length(text).alias("bytes"))


def math_spacing(lines: DataFrame, path: str = "path", line: str = "line", text: str = "text") -> DataFrame:
    """quoted `$$` lines without a blank quoted line on their outer side, and `unpaired` where a document's `$$` don't pair."""
    w = W.partitionBy(path).orderBy(line)
    bare = F.trim(F.regexp_replace(text, r"^\s*>\s?", ""))
    d = lines.withColumns({"_m": bare == "$$", "_b": bare == ""}).withColumns(
        {
            "_k": F.sum(F.when(F.col("_m"), 1).otherwise(0)).over(w), "_p": F.lag("_b").over(w), "_n": F.lead("_b").over(w),
            "_all": F.count_if(F.col("_m")).over(W.partitionBy(path))
        }
    )
    opening = F.col("_k") % 2 == 1
    problem = F.when(F.col("_all") % 2 == 1, "unpaired").when(
        opening & ~F.coalesce("_p", F.lit(True)), "no blank line before"
    ).when(~opening & ~F.coalesce("_n", F.lit(True)), "no blank line after")
    return d.where("_m").withColumn("problem", problem).where("problem is not null").select(path, line, "problem")


def publication_findings(
    recorded: DataFrame, present: DataFrame, documents: DataFrame, notes: DataFrame, warn: int, limit: int, before: DataFrame | None = None
) -> DataFrame:
    """(code, severity, path) of a published folder against its record.

    recorded (path, sha256); present (path, sha256, bytes); documents (id, path) as recorded; notes (path, id) as
    they are; before (path, sha256): the record that this one replaces. published-file: missing or other bytes;
    published-inventory: visible and not recorded; published-manifest: a recorded name that isn't portable;
    document-identity: a recorded document isn't at its path; file-size: beyond limit (error) or warn (review);
    republish-replaces: a recorded file that isn't a note gets other bytes (review).
    """
    row = lambda rows, code, severity="error": rows.select(
        F.lit(code).alias("code"), F.lit(severity).alias("severity") if isinstance(severity, str) else severity.alias("severity"), "path"
    )
    p = present.select("path", F.col("sha256").alias("_there"))
    found = [row(recorded.join(p, "path", "left").where(~F.coalesce(F.col("_there") == F.col("sha256"), F.lit(False))), "published-file")]
    found.append(row(present.where(visible(F.col("path"))).join(recorded.select("path"), "path", "left_anti"), "published-inventory"))
    found.append(row(recorded.where(~F.coalesce(portable(F.col("path")), F.lit(False))), "published-manifest"))
    here = notes.select("path", F.col("id").alias("_id")).distinct()
    found.append(
        row(documents.join(here, "path", "left").where(~F.coalesce(F.col("_id") == F.col("id"), F.lit(False))), "document-identity")
    )
    found.append(row(present.where(F.col("bytes") > warn), "file-size", F.when(F.col("bytes") > limit, "error").otherwise("review")))
    if before is not None:
        old = before.select("path", F.col("sha256").alias("_old"))
        found.append(
            row(
                recorded.join(old, "path").where((F.col("_old") != F.col("sha256")) & ~F.col("path").rlike(r"(?i)\.md$")),
                "republish-replaces", "review"
            )
        )
    return reduce(DataFrame.unionByName, found)


def portable(path: Column) -> Column:
    """A recorded name that every file system takes: relative, without `..`, hidden parts, backslashes or reserved characters."""
    return ~path.rlike(r'(^|/)(\.|$)|^/|[\\\\:*?"<>|\x00-\x1F]|[. ](/|$)')


def refuse_existing(rows: DataFrame, exists: str = "exists", overwrite: bool = False, rendered: str = "error") -> DataFrame:
    """Outputs with `action`: write, refuse (there already and not to be overwritten) or keep (rendering failed: the old bytes stay)."""
    there = F.coalesce(F.col(exists), F.lit(False))
    return rows.withColumn(
        "action", F.when(F.col(rendered).isNotNull(), "keep").when(there & F.lit(not overwrite), "refuse").otherwise("write")
    )
