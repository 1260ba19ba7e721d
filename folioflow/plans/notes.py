"""Queries over notes, edits and publications that are written out of the driver's tables.

Each row of a table becomes a note, a path or a record by a formula in its keys and its whole text; the SQL says by
the same formula what the operator must find in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import edits as E
from ..operators import findings as N
from ..operators import integrity as I
from ..operators import links as K
from ..operators import publication as P
from ..operators import text_lines as X
from ..sources import library as L
from ..sources import markdown as M
from ..sources import records as R
from ..sources import sinks as S
from ..sources.scratch import scratch
from .catalog import query

LINES_SQL = "(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))"
#: What code and math protect, as the operators have it.
PROTECTED_SQL = T.PROTECTED[4:]
PATH_SQL = "'n/d' || doc_id || '.md'"
#: Notes that can be read, by path, with the number in their name and the newlines of their text.
GOOD_SQL = f"(select doc_id, {PATH_SQL} path, {LINES_SQL}::int more from documents where doc_id % 11 <> 0)"


def _text():
    """The whole text."""
    return F.coalesce("text", F.lit(""))


def _notes(t) -> DataFrame:
    """A note of 30 lines a document. Every eleventh has no front matter; headings jump in every fourth; every fifth has an answer, every tenth with a bad footer."""
    i, d = F.col("doc_id").cast("string"), F.col("doc_id")
    after = (d + 1).cast("string")
    fifth = d % 5 == 0
    lines = [
        F.when(d % 11 == 0, "x").otherwise("---"), F.concat(F.lit("id: d"), i), F.lit("type: document"), F.when(
            d % 3 == 0, "role: course"
        ).otherwise("role: exercise"),
        F.concat(F.lit('title: "Note '), i, F.lit('"')), F.concat(
            F.lit("source_pages: [1, "), (d % 7 + 1).cast("string"), F.lit("]")
        ), F.lit("---"),
        F.concat(F.lit("# Note "), i), F.lit(""), F.concat(
            F.lit("%% unit exercise e-"), i, F.lit(" %%")
        ), F.concat(F.lit("## Exercise "), i), F.lit(""),
        F.concat(F.lit("> [!question] Question "), i), F.lit("> How many?"), F.concat(F.lit("> ^q-"), i), F.lit(""), F.concat(
            F.lit("%% /unit e-"), i, F.lit(" %%")
        ), F.lit(""),
        F.concat(F.lit("See [next](d"), after, F.lit(".md#^q-"), after, F.lit(") and [[d"), i, F.lit("|itself]].")), F.lit(""),
        F.concat(F.when(d % 4 == 0, "#### Deep ").otherwise("## Section "), i), F.lit(""),
        F.when(fifth, "> [!reponse] Answer").otherwise("> [!hint] Hint"), F.lit("> It is so."),
        F.when(
            fifth, F.concat(F.lit("> [Question](d"), i, F.lit(".md#^q-"), i, F.when(d % 10 == 5, ") trailing").otherwise(")"))
        ).otherwise("> Think."),
        F.concat(F.lit("> ^a-"), i), F.lit(""), F.concat(F.lit("Text "), _text()), F.lit(""), F.concat(
            F.lit("- item "), i, F.lit(" ^same")
        ),
    ]
    return t("documents").select(F.concat(F.lit("n/d"), i, F.lit(".md")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


def _tables(t, *want: str) -> dict[str, DataFrame]:
    return M.tables(M.parse_notes(_notes(t), want=want or tuple(M.PARTS)))


FIRST_SQL, LAST_SQL = (f"coalesce(nullif(regexp_extract(lower(text), '{x}', 1), ''), 'none')" for x in ("([a-z]+)", "([a-z]+)[^a-z]*$"))
#: Documents as notes named after their first word, in folders of language and source; of several, the one of the smallest id.
NAMED_SQL = f"""(select *, lang || '/' || source || '/' || first || '.md' path from (select doc_id, coalesce(lang, 'x') lang, coalesce(source, 'x') source, {FIRST_SQL} first, {LAST_SQL} last, length(coalesce(text, '')) % 5 form, text from documents) qualify row_number() over (partition by path order by doc_id) = 1)"""


def _named(t) -> DataFrame:
    """(doc_id, lang, source, first, last, form, text, path) as NAMED_SQL; the rows that share a path meet as minima."""
    word = lambda x: F.coalesce(F.nullif(F.regexp_extract(F.lower("text"), x, 1), F.lit("")), F.lit("none"))
    d = t("documents").select(
        "doc_id", F.coalesce("lang", F.lit("x")).alias("lang"), F.coalesce("source", F.lit("x")).alias("source"), "text",
        word("([a-z]+)").alias("first"), word("([a-z]+)[^a-z]*$").alias("last"), (F.length(F.coalesce("text", F.lit(""))) % 5).alias("form")
    ).withColumn("path", F.concat("lang", F.lit("/"), "source", F.lit("/"), "first", F.lit(".md")))
    return d.join(d.groupBy("path").agg(F.min("doc_id").alias("doc_id")), ["path", "doc_id"], "left_semi")


@query(f"""with n as {NAMED_SQL}, l as (select *, case form when 2 then path when 3 then lang || '/' || source || '/d' || doc_id || '.md' when 4 then null else lang || '/' || source || '/' || last || '.md' end near,
case form when 2 then first when 3 then 'd' || doc_id else last end || '.md' name from n), names as (select first || '.md' name, count(*) k, min(path) lone from n group by all)
select l.path, case form when 0 then '../' || source || '/' || last || '.md' when 1 then last when 2 then '../../' || lang || '/./' || source || '/' || first || '.md' when 3 then 'd' || doc_id else '../../../' || last || '.md' end target,
case when p.path is not null then p.path when k = 1 then lone end "to", case when p.path is not null or k = 1 then 'resolved' when k > 1 then 'ambiguous' when form = 3 then 'id' else 'missing' end status
from l left join (select path from n) p on p.path = near left join names on names.name = l.name""")
def doc_references(t):
    """A link of each note to the name that its own last word gives: up and down folders, by name alone, in brackets, by id, and beyond the root"""
    n = _named(t)
    f, up = F.col("form"), F.lit("../")
    link = F.when(f == 0, F.concat(F.lit("[next]("), up, "source", F.lit("/"), "last", F.lit('.md "Next")'))).when(
        f == 1, F.concat(F.lit("[["), "last", F.lit("|next]]"))
    ).when(f == 2, F.concat(F.lit("[self](<../../"), "lang", F.lit("/./"), "source", F.lit("/"), "first", F.lit(".md#^q-1> 'It')"))).when(
        f == 3, F.concat(F.lit("[[d"), F.col("doc_id").cast("string"), F.lit("]]"))
    ).otherwise(F.concat(F.lit("[far](../../../"), "last", F.lit(".md)")))
    head = F.concat(F.lit("---\nid: d"), F.col("doc_id").cast("string"), F.lit("\n---\nSee "), link, F.lit(".\n\n"))
    got = M.parse_notes(n.select("path", F.concat(head, F.coalesce("text", F.lit(""))).alias("text")), want=("links",))
    links = M.tables(got)["links"]
    return K.resolve_links(links, n.select("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))).select("path", "target", "to", "status")


@query(f"""with n as (select *, case doc_id % 3 when 0 then chr(10) when 1 then chr(13) || chr(10) else chr(13) end nl, case when form in (1, 3) then '' else 'source/' end folder from {NAMED_SQL})
select path, '---' || nl || 'id: d' || doc_id || nl || '---' || nl || '[Part](' || case when form = 0 then '#^thm' else '#Part%20one' end || ') and [PDF](' || folder || last || '.pdf#page=' || form || ' "Caption"), [again](<' || folder || last || '.pdf>).' || nl || nl ||
'[pdf]: <' || folder || last || '.pdf> "Original title"' || nl || nl || coalesce(text, '') "text", case when form in (1, 3) then 3 when form = 0 then 1 else 0 end remapped from n""")
def doc_remapped(t):
    """Where a note's text is of some lengths, its PDF moved beside it, or its heading became a block; the texts go on whole"""
    n, f = _named(t), F.col("form")
    nl = F.when(F.col("doc_id") % 3 == 0, "\n").when(F.col("doc_id") % 3 == 1, "\r\n").otherwise("\r")
    pdf = F.concat(F.lit("source/"), "last", F.lit(".pdf"))
    text = F.concat(
        F.lit("---"), nl, F.lit("id: d"), F.col("doc_id").cast("string"), nl, F.lit("---"), nl, F.lit("[Part](#Part%20one) and [PDF]("), pdf,
        F.lit("#page="), f.cast("string"), F.lit(' "Caption"), [again](<'), pdf, F.lit(">)."), nl, nl, F.lit("[pdf]: <"), pdf,
        F.lit('> "Original title"'), nl, nl, F.coalesce("text", F.lit(""))
    )
    texts = n.select("path", text.alias("text"))
    none = F.lit(None).cast("string")
    moves = n.where(f.isin(1, 3)).select(
        "path", pdf.alias("target"), none.alias("fragment"), F.concat("last", F.lit(".pdf")).alias("new_target"), none.alias("new_fragment")
    ).unionByName(
        n.where(f == 0).select(
            "path", F.lit("").alias("target"), F.lit("Part%20one").alias("fragment"), F.lit("").alias("new_target"), F.lit("^thm").alias("new_fragment")
        )
    )
    found = M.tables(M.parse_notes(texts, want=("links", "definitions")))
    at = ["path", "line", "off_lo", "off_hi", "target", "fragment"]
    spans = found["links"].where("form <> 'reference'").select(*at).unionByName(found["definitions"].select(*at))
    return K.remap_text(texts, spans, moves)


@query(f"""select {PATH_SQL} path, doc_id % 11 <> 0 readable, case when doc_id % 11 <> 0 then 'd' || doc_id end id, case when doc_id % 11 <> 0 then case when doc_id % 3 = 0 then 'course' else 'exercise' end end role,
case when doc_id % 11 <> 0 then 'Note ' || doc_id end title, case when doc_id % 11 <> 0 then '1,' || (doc_id % 7 + 1) end pages, (23 + case when doc_id % 11 = 0 then 7 else 0 end + {LINES_SQL})::int lines from documents""")
def note_front_matter(t):
    """A5"""
    n = M.tables(M.parse_notes(_notes(t), want=()))["notes"]
    return n.select(
        "path", F.col("error").isNull().alias("readable"), "id", "role", "title", F.array_join("source_pages", ",").alias("pages"),
        F.size(F.split("body", "\n")).alias("lines")
    )


@query(f"""select path, 19 line, 'inline' form, 'next' label, 'd' || (doc_id + 1) || '.md' target, '^q-' || (doc_id + 1) fragment from {GOOD_SQL} union all select path, 19, 'wiki', 'itself', 'd' || doc_id, '' from {GOOD_SQL}
union all select path, 25, 'inline', 'Question', 'd' || doc_id || '.md', '^q-' || doc_id from {GOOD_SQL} where doc_id % 5 = 0""")
def note_links(t):
    """A4, F5"""
    return _tables(t, "links")["links"].select("path", "line", "form", "label", "target", "fragment")


@query(f"""with n as {GOOD_SQL} select 'front-matter' code, 'error' severity, {PATH_SQL} path, 1 line from documents where doc_id % 11 = 0
union all select 'missing-link', 'error', path, 19 from n where doc_id + 1 not in (select doc_id from documents) union all select 'missing-anchor', 'error', path, 19 from n where (doc_id + 1) % 11 = 0 and doc_id + 1 in (select doc_id from documents)
union all select 'heading-gap', 'review', path, 21 from n where doc_id % 4 = 0 union all select 'unit-owner', 'error', path, 23 from n where doc_id % 5 = 0 union all select 'malformed-field', 'error', path, 25 from n where doc_id % 10 = 5""")
def note_findings(t):
    """D1, D3, D4, D6, S5, W4 and the codes of footers, as one report"""
    return N.check_notes(_tables(t)).select("code", "severity", "path", "line")


@query(f"""select path, 'd' || doc_id id, '{{"units":[{{"line":10,"uid":"e-' || doc_id || '","kind":"exercise"}}],"blocks":[{{"line":13,"anchor":"q-' || doc_id || '","kind":"question","owner":"e-' || doc_id || '"}},{{"line":23,"anchor":"a-' || doc_id || '","kind":"'
|| case when doc_id % 5 = 0 then 'reponse' else 'hint' end || '","owner":null}}],"headings":["Note ' || doc_id || '","Exercise ' || doc_id || '","' || case when doc_id % 4 = 0 then 'Deep ' else 'Section ' end || doc_id || '"]}}' json from {GOOD_SQL}""")
def note_inventory(t):
    """A8"""
    return N.inventory(_tables(t, "units", "callouts", "headings"))


@query(
    """select count(*) filter (where doc_id % 11 <> 0) questions, count(*) filter (where doc_id % 11 <> 0 and doc_id % 5 = 0) answers, count(*) filter (where doc_id % 11 <> 0 and doc_id % 5 <> 0) hints, 0::bigint explanations, count(*) filter (where doc_id % 11 <> 0) documents from documents"""
)
def note_counts(t):
    """E2"""
    return N.counts(_tables(t, "callouts"))


@query(f"""with d as (select doc_id, {PATH_SQL} path, doc_id % 11 <> 0 good, {LINES_SQL}::int more from documents)
select path, '^q-' || doc_id fragment, case when good then 13 end lo, case when good then 15 end hi, case when good then 'ok' else 'missing' end status from d
union all select path, 'Exercise%20' || doc_id, case when good then 11 end, case when good then case when doc_id % 4 = 0 then 2147483646 + 1 else 20 end end, case when good then 'ok' else 'missing' end from d
union all select path, 'L8-L9', 8, 9, 'ok' from d union all select path, '', 1, case when good then 23 else 30 end + more, 'ok' from d union all select path, '^nope', null, null, 'missing' from d
union all select path, 'L14-L20', case when not good then 14 end, case when not good then 20 end, case when good then 'bisects' else 'ok' end from d""")
def note_fragments(t):
    """A block, a heading, two ranges of lines, all, and nothing, of each note"""
    i = F.regexp_extract("path", r"d(\d+)\.md$", 1)
    wanted = _notes(t).select(
        "path",
        F.explode(
            F.array(
                F.concat(F.lit("^q-"), i), F.concat(F.lit("Exercise%20"), i), F.lit("L8-L9"), F.lit(""), F.lit("^nope"), F.lit("L14-L20")
            )
        ).alias("fragment")
    )
    return P.select_fragments(wanted, _tables(t))


@query(
    f"select path, unnest([1, 2, 3, 4, 5, 6, 7]) \"position\", unnest(['between', 'unit', 'between', 'between', 'between', 'between', 'between']) kind, unnest([null, 'e-' || doc_id, null, null, null, null, null]) uid, unnest([8, 10, 19, 21, 23, 28, 30 + more]) lo from {GOOD_SQL}"
)
def note_worksheet(t):
    """W8"""
    n = _tables(t, "units", "blocks")
    return P.worksheet(n["units"], n["blocks"])


@query(f"select path, 'e-' || doc_id uid, 10 lo, 17 hi from {GOOD_SQL} where doc_id % 2 = 0 or doc_id % 3 = 0")
def note_layout(t):
    """Ranges that hold a unit, and ranges within one"""
    n = _tables(t, "units")
    i = F.regexp_extract("path", r"d(\d+)\.md$", 1).cast("long")
    some = n["notes"].select("path", i.alias("i"))
    ranges = some.where("i % 2 = 0").select("path", F.lit(8).alias("lo"), F.lit(20).alias("hi")).unionByName(
        some.where("i % 3 = 0").select("path", F.lit(12).alias("lo"), F.lit(13).alias("hi"))
    ).unionByName(some.select("path", F.lit(15).alias("lo"), F.lit(19).alias("hi")))
    return P.layout_units(ranges, n["units"])


@query(f"""with d as (select doc_id, case doc_id % 3 when 0 then chr(10) when 1 then chr(13) || chr(10) else chr(13) end nl, coalesce(text, '') body from documents)
select 'd' || doc_id doc, case when doc_id % 7 <> 0 then replace(array_to_string(['%% unit exercise u-' || doc_id || ' %%', '## T ' || doc_id, 'Intro ' || doc_id, '> [!question] Q', '> ' || replace(body, chr(10), chr(1) || '> '), '>', '> [x](y) · [p](p.pdf)', '> ^q-' || doc_id, 'End', '^z-' || doc_id, '%% /unit u-' || doc_id || ' %%'], chr(1)), chr(1), nl) end "text",
doc_id % 7 <> 0 faithful, case when doc_id % 7 = 0 then 'unknown operation move' end "error" from d""")
def doc_edits(t):
    """M1, M2, M3, M4, M6: a unit, a heading, a callout with its footer and an anchor in each document; every seventh asks for an operation that isn't one"""
    d, i = F.col("doc_id"), F.col("doc_id").cast("string")
    newline = F.when(d % 3 == 0, "\n").when(d % 3 == 1, "\r\n").otherwise("\r")
    docs = t("documents").select(
        F.concat(F.lit("d"), i).alias("doc"), F.concat(F.lit("Intro "), i, newline, F.replace(_text(), F.lit("\n"), newline), newline, F.lit("End")).alias("text")
    )
    none, more = F.lit(None).cast("string"), F.size(F.split(_text(), "\n")) - 1

    def op(kind, start, end, id_=none, what=none, title=none, level=F.lit(None).cast("int"), links=none, pdf=none):
        return t("documents").select(
            F.concat(F.lit("d"), i).alias("doc"), kind.alias("op"), start.alias("start"), (end + more).cast("int").alias("end"), id_.alias("id"),
            what.alias("kind"), title.alias("title"), level.alias("level"), links.alias("links"), pdf.alias("pdf")
        )

    edits = op(F.lit("unit"), F.lit(1), F.lit(3), F.concat(F.lit("u-"), i), F.lit("exercise"))
    edits = edits.unionByName(op(F.lit("heading"), F.lit(1), 1 - more, title=F.concat(F.lit("T "), i), level=F.lit(2)))
    edits = edits.unionByName(
        op(F.lit("callout"), F.lit(2), F.lit(2), F.concat(F.lit("q-"), i), F.lit("question"), F.lit("Q"), links=F.lit("[x](y)"), pdf=F.lit("[p](p.pdf)"))
    )
    edits = edits.unionByName(op(F.when(d % 7 == 0, "move").otherwise("anchor"), 3 + more, F.lit(3), F.concat(F.lit("z-"), i)))
    return E.compile_documents(docs, edits)


@query(f"select doc_id, regexp_replace(coalesce(text, '') || ' %%hidden ' || doc_id || '%% `kept %%code%%` $a %%b%% c$ end', '(?s)({PROTECTED_SQL})|%%.*?%%', '\\1', 'g') shown from documents")
def doc_comments(t):
    """F4"""
    x = F.concat(_text(), F.lit(" %%hidden "), F.col("doc_id").cast("string"), F.lit("%% `kept %%code%%` $a %%b%% c$ end"))
    return t("documents").select("doc_id", T.hide_comments(x).alias("shown"))


LEAKS_SQL = ", ".join(f"('{c}')" for c in T.LATEX)


@query(rf"""with x as (select doc_id, regexp_replace(regexp_replace(coalesce(text, '') || case when doc_id % 2 = 0 then ' \quad \textbf{{x}}' else '' end || ' `\item` $\begin$ \quadrant <b \ref> C:\section\x', '(?s){PROTECTED_SQL}', ' ', 'g'), '<[^>]*>|[A-Za-z]:\\\S+', ' ', 'g') m from documents),
f as (select doc_id, string_agg(c, ',' order by strpos(m, '\' || c)) leaks from x, (values {LEAKS_SQL}) t(c) where regexp_matches(m, '(^|[^A-Za-z\\])\\' || c || '([^A-Za-z]|$)') group by doc_id) select doc_id, coalesce(leaks, '') leaks from x left join f using (doc_id)""")
def doc_latex_leaks(t):
    """commands in the text, and look-alikes in code, math, tags, paths and longer names"""
    x = F.concat(
        _text(), F.when(F.col("doc_id") % 2 == 0, " \\quad \\textbf{x}").otherwise(""),
        F.lit(" `\\item` $\\begin$ \\quadrant <b \\ref> C:\\section\\x")
    )
    return t("documents").select("doc_id", F.array_join(T.latex_leaks(x), ",").alias("leaks"))


@query("select doc_id, case doc_id % 3 when 0 then 'U+0007,U+007F' when 1 then 'U+0085' else '' end controls from documents")
def doc_controls(t):
    """F7"""
    d = F.col("doc_id") % 3
    x = F.concat(F.lit("a\tb\r\n"), _text(), F.when(d == 0, "\x07 \x7f \x07").when(d == 1, "\x85").otherwise(""))
    return t("documents").select("doc_id", F.array_join(T.control_characters(x), ",").alias("controls"))


@query(rf"""with x as (select doc_id, regexp_extract_all(regexp_replace(coalesce(text, '') || ' $a_' || doc_id || '$ and $$b$$ not `$c$` nor ![$d$](e)', '(?s)```.*?```|``.*?``|`[^`\n]*`|!\[[^\]]*\]', ' ', 'g'), '(?s)(\$\$.+?\$\$|\$[^$\n]+\$)') m from documents)
select doc_id, array_to_string(list_transform(m, lambda e: case when starts_with(e, '$$') then substr(e, 3, length(e) - 4) else substr(e, 2, length(e) - 2) end), '|') tex, array_to_string(list_transform(m, lambda e: starts_with(e, '$$')::varchar), '|') display from x""")
def doc_math(t):
    """F8"""
    x = T.math_expressions(F.concat(_text(), F.lit(" $a_"), F.col("doc_id").cast("string"), F.lit("$ and $$b$$ not `$c$` nor ![$d$](e)")))
    return t("documents").select("doc_id", x.alias("x")).select(
        "doc_id", F.array_join(F.transform("x", lambda m: m["tex"]), "|").alias("tex"),
        F.array_join(F.transform("x", lambda m: m["display"].cast("string")), "|").alias("display")
    )


@query(
    "select doc_id, case when length(text) >= 24 then substr(text, 1, 8) || chr(10) || substr(text, 21, 4) end spans, null::varchar \"overlapping\" from documents"
)
def doc_spans(t):
    """Two spans that touch and one further on; spans that overlap give nothing"""
    at = lambda *x: F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(n).alias("length")) for o, n in x])
    return t("documents").select(
        "doc_id", T.span_text(F.col("text"), at((0, 5), (5, 3), (20, 4))).alias("spans"),
        T.span_text(F.col("text"), at((0, 5), (4, 3))).alias("overlapping")
    )


@query(
    f"""select doc_id::varchar path, unnest([2, 4]) + {LINES_SQL}::int line, unnest(['no blank line before', 'no blank line after']) problem from documents where doc_id % 2 = 0 and doc_id % 5 <> 0 union all select doc_id::varchar, 2 + {LINES_SQL}::int, 'unpaired' from documents where doc_id % 5 = 0"""
)
def doc_math_spacing(t):
    """quoted math after each whole text"""
    d = F.col("doc_id")
    some = lambda *x: F.array(*map(F.lit, x))
    body = F.transform(F.split(_text(), "\n"), lambda line: F.concat(F.lit("> "), line, F.lit("a")))
    lines = F.when(d % 5 == 0, F.concat(body, some("> $$", "> b"))).when(
        d % 2 == 0, F.concat(body, some("> $$", "> x", "> $$", "> b"))
    ).otherwise(F.concat(body, some(">", "> $$", "> x", "> $$", ">", "> b")))
    return P.math_spacing(
        t("documents").select(
            d.cast("string").alias("path"), F.posexplode(lines).alias("at", "text")
        ).select("path", (F.col("at") + 1).alias("line"), "text")
    )


@query(
    """select page_id, case page_id % 4 when 0 then 12 when 1 then 7 end page, case page_id % 4 when 2 then 'hint' when 3 then 'note' end kind, case page_id % 4 when 2 then '-' when 3 then '' end fold, case page_id % 4 when 2 then 'About ' || page_id when 3 then '' end title, page_id % 3 = 0 labelled from pages"""
)
def page_marks(t):
    """F9, F12, F13"""
    p = F.col("page_id")
    target = F.concat(F.lit("a b.pdf"), F.when(p % 4 == 0, "#page=12").when(p % 4 == 1, "%23page%3D7").otherwise("#top"))
    header = F.when(
        p % 4 == 2, F.concat(F.lit("> [!Hint]- About "), p.cast("string"))
    ).when(p % 4 == 3, F.lit(">[!note]")).otherwise("> no header")
    wiki = F.when(
        p % 3 == 0, F.concat(F.lit("[["), F.col("url"), F.lit("|shown]]"))
    ).when(p % 3 == 1, F.concat(F.lit("[["), F.col("url"), F.lit("| ]]"))).otherwise(F.concat(F.lit("[["), F.col("url"), F.lit("]]")))
    c = T.callout(header)
    return t("pages").select(
        "page_id", T.page_fragment(target).alias("page"), c["kind"].alias("kind"), c["fold"].alias("fold"), c["title"].alias("title"),
        T.has_label(wiki).alias("labelled")
    )


URL_PATH_SQL = "regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1)"


def _url_path():
    return F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1)


@query(f"""with p as (select page_id, case page_id % 4 when 0 then '.git' when 1 then 'sources' when 2 then 'a/sources' else 'a' end || {URL_PATH_SQL} path from pages)
select page_id, not regexp_matches(path, '(^|/)(\\.|sources/)') visible, path = 'a' or starts_with(path, 'a/') inside from p""")
def page_visible(t):
    """C5, C11"""
    p = F.col("page_id") % 4
    path = F.concat(F.when(p == 0, ".git").when(p == 1, "sources").when(p == 2, "a/sources").otherwise("a"), _url_path())
    return t("pages").select("page_id", T.visible(path).alias("visible"), T.inside(path, F.lit("a/")).alias("inside"))


@query(f"""with p as (select distinct regexp_replace(path, '/+$', '') path from (select {URL_PATH_SQL} path from pages union all select regexp_extract({URL_PATH_SQL}, '^(/[^/]+)', 1) from pages where page_id % 40 = 0))
select path from p where not exists (select 1 from p q where starts_with(p.path, q.path || '/') and q.path <> '')""")
def page_topmost(t):
    """C11: the paths of pages and, of every fortieth, its first folder"""
    paths = t("pages").select(_url_path().alias("path"))
    some = t("pages").where("page_id % 40 = 0").select(F.regexp_extract(_url_path(), "^(/[^/]+)", 1).alias("path"))
    return I.topmost(paths.unionByName(some))


@query("""with p as (select distinct 'r/' || split_part(path, '/', 2) || case when n % 3 = 0 then '/deep/' || n else '' end root from (select regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) path, page_id n from pages)),
q as (select root from p where not exists (select 1 from p x where starts_with(p.root, x.root || '/'))) select root, len(string_split(root, '/')) > 2 omitted from q""")
def page_chapters(t):
    """An index in a folder for each language, and deeper ones, some of them inside another chapter"""
    n = F.col("page_id")
    root = F.concat(
        F.lit("r/"), F.split_part(_url_path(), F.lit("/"), F.lit(2)),
        F.when(n % 3 == 0, F.concat(F.lit("/deep/"), n.cast("string"))).otherwise("")
    )
    return R.list_chapters(t("pages").select(F.concat(root, F.lit("/index.md")).alias("path")), 2)


@query("""select p_partkey, replace(p_name || '|"' || p_brand || chr(92), '|', chr(92) || '|') cell, '"' || replace(replace(p_name || '|"' || p_brand || chr(92), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' yaml,
p_name || ' x ' || lower(replace(p_brand, '#', '')) heading, 'last ' || p_partkey failure, chr(39) || p_name || chr(39) || chr(92) || chr(39) || chr(39) || 's' || chr(39) shell, 'key=' || replace(p_type, 'SMALL', '***') redacted from part""")
def part_texts(t):
    """F15, F20, F21, F23"""
    odd = F.concat("p_name", F.lit('|"'), "p_brand", F.lit("\\"))
    title = F.concat(F.lit("**"), "p_name", F.lit("**  [x](y) \\$"), "p_brand")
    log = F.concat(F.lit("start\nGenerate error: "), "p_name", F.lit("\nmore\nGenerate error:  last "), F.col("p_partkey").cast("string"))
    return t("part").select(
        "p_partkey", T.escape_cell(odd).alias("cell"), T.quote_yaml(odd).alias("yaml"), T.normal_heading(title).alias("heading"),
        T.explain_failure(log).alias("failure"), T.shell_quote(F.concat("p_name", F.lit("'s"))).alias("shell"),
        T.redact(F.concat(F.lit("key="), "p_type"), "SMALL").alias("redacted")
    )


@query(
    """select p_partkey, case p_partkey % 4 when 0 then 'no manifest' when 1 then 'unreadable manifest' when 2 then 'unrecognised version' end reason, p_partkey % 4 = 3 owned from part"""
)
def part_markers(t):
    """A2"""
    k = F.col("p_partkey") % 4
    text = F.when(k == 1, F.concat(F.lit('{"schema_version": 3, "name": '), "p_name")).when(
        k == 2, F.concat(F.lit('{"schema_version": 2, "name": "'), "p_name", F.lit('"}'))
    ).when(k == 3, F.concat(F.lit('{"schema_version": 3, "name": "'), "p_name", F.lit('"}')))
    return R.bundle_marker(t("part").select("p_partkey", text.alias("text"))).select("p_partkey", "reason", "owned")


@query("""select p_partkey + case when gone then 1000000 else 0 end p_partkey, case when gone then null when p_partkey % 3 = 0 then '' else p_brand end hints, case when gone then null else p_type end aids, case when gone then 'unpublished target' when p_partkey % 3 = 1 then 'unknown option nope' end problem
from (select *, false gone from part union all select *, true from part where p_partkey % 50 = 0)""")
def part_overrides(t):
    """Every third part's hints are suppressed, every third names an option that isn't one, and some targets aren't there"""
    part, k = t("part"), F.col("p_partkey")
    target = lambda gone: F.struct(F.lit(gone).alias("gone"), k).alias("target")  # noqa: E731  whatever keys there are, no part is one that's gone
    defaults = part.select(target(False), F.array("p_brand").alias("hints"), F.array("p_type").alias("aids"))
    none = F.array().cast("array<string>")
    choices = part.where("p_partkey % 3 < 2").select(
        target(False),
        F.when(k % 3 == 0, F.create_map(F.lit("hints"), none)).otherwise(F.create_map(F.lit("nope"), F.array(F.lit("x")))).alias("choices")
    )
    gone = part.where("p_partkey % 50 = 0").select(target(True), F.create_map(F.lit("hints"), none).alias("choices"))
    out = P.override(defaults, choices.unionByName(gone), "target", ["hints", "aids"])
    at = lambda c: F.when(
        F.col("problem").eqNullSafe(F.lit("unpublished target")), F.lit(None)
    ).otherwise(F.array_join(c, ","))
    shown = F.col("target.p_partkey") + F.when(F.col("target.gone"), 1_000_000).otherwise(0)
    return out.select(shown.alias("p_partkey"), at("hints").alias("hints"), at("aids").alias("aids"), "problem")


@query(
    """select p_partkey, p_partkey % 2 = 0 or p_partkey % 3 = 0 changed, p_partkey % 2 = 0 lost, '{"p_name":"' || p_name || '","p_partkey":' || p_partkey || '}' json from part"""
)
def part_sinks(t):
    """The parts' names written again, changed in every second, and gone in every third"""
    part, k = t("part").select("p_partkey", "p_name"), F.col("p_partkey")
    old = part.where("p_partkey % 3 <> 0").withColumn("p_name", F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    changed = S.changed_only(part, old, "p_partkey", "p_name").select("p_partkey", F.lit(True).alias("changed"))
    now = part.withColumn("p_name", F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    lost = S.retained(part, now, "p_partkey", "p_name").withColumn("lost", F.lit(True))
    json = S.compile_json(part, ["p_partkey"]).select(
        F.get_json_object("value", "$.p_partkey").cast("long").alias("p_partkey"), F.col("value").alias("json")
    )
    out = part.select("p_partkey").join(changed, "p_partkey", "left").join(lost, "p_partkey", "left").join(json, "p_partkey")
    return out.select(
        "p_partkey", F.coalesce("changed", F.lit(False)).alias("changed"), F.coalesce("lost", F.lit(False)).alias("lost"), "json"
    )


@query(
    """select n_name path, sha256('file ' || n_name) = case when n_nationkey % 4 = 0 then 'other' else sha256('file ' || n_name) end and n_nationkey % 5 <> 0 matches, case when n_nationkey % 5 <> 0 then 'file ' || n_name end content from nation"""
)
def nation_published(t):
    """One record of all nations' files; every fourth has other bytes, every fifth isn't there"""
    n = F.col("n_nationkey")
    content = F.concat(F.lit("file "), "n_name")
    files = t("nation").withColumn("sha", F.when(n % 4 == 0, "other").otherwise(F.sha2(content, 256)))
    record = files.agg(F.map_from_entries(F.collect_list(F.struct("n_name", "sha"))).alias("files"))  # a record is one row
    return P.published_files(
        record, t("nation").where(n % 5 != 0).select(F.col("n_name").alias("path"), content.alias("content"))
    ).select("path", "matches", "content")


@query("""with d as (select doc_id, case when doc_id % 23 = 0 then '.x/' else 'd/' end || doc_id || case when doc_id % 6 = 0 then '.pdf' else '.md' end path, coalesce(strlen(text), 0) bytes from documents)
select 'published-file' code, 'error' severity, path from d where doc_id % 10 <> 0 and (doc_id % 17 = 0 or doc_id % 19 = 0) union all select 'published-inventory', 'error', path from d where doc_id % 10 = 0 and doc_id % 23 <> 0 and doc_id % 19 <> 0
union all select 'published-manifest', 'error', path from d where doc_id % 10 <> 0 and doc_id % 23 = 0 union all select 'document-identity', 'error', path from d where doc_id % 10 <> 0 and doc_id % 6 <> 0 and (doc_id % 19 = 0 or doc_id % 29 = 0)
union all select 'file-size', case when bytes > 20000 then 'error' else 'review' end, path from d where doc_id % 19 <> 0 and bytes > 5000 union all select 'republish-replaces', 'review', path from d where doc_id % 10 <> 0 and doc_id % 4 = 0 and doc_id % 6 = 0""")
def doc_publication(t):
    """Every document as a file: some not recorded, changed, lost, hidden, renamed, large, or replacing another"""
    d = F.col("doc_id")
    path = F.concat(F.when(d % 23 == 0, ".x/").otherwise("d/"), d.cast("string"), F.when(d % 6 == 0, ".pdf").otherwise(".md"))
    body = F.coalesce("text", F.lit(""))
    all_ = t("documents").select(d, path.alias("path"), F.sha2(body, 256).alias("sha"), F.octet_length(body).alias("bytes"))
    kept = all_.where(d % 10 != 0)
    recorded = kept.select("path", F.when(d % 17 == 0, "other").otherwise(F.col("sha")).alias("sha256"))
    present = all_.where(d % 19 != 0).select("path", F.col("sha").alias("sha256"), "bytes")
    documents = kept.where(d % 6 != 0).select(F.concat(F.lit("n"), d.cast("string")).alias("id"), "path")
    notes = all_.where((d % 19 != 0) & (d % 6 != 0)).select(
        "path", F.concat(F.lit("n"), F.when(d % 29 == 0, d + 1).otherwise(d).cast("string")).alias("id")
    )
    before = all_.where(d % 4 == 0).select("path", F.lit("older").alias("sha256"))
    return P.publication_findings(recorded, present, documents, notes, 5_000, 20_000, before)


@query(
    """select o_orderkey, case when o_orderkey % 13 = 0 then 'keep' when o_orderstatus = 'F' then 'refuse' else 'write' end action, case when o_orderstatus = 'O' then 2 * (o_orderkey % 50) else o_orderkey % 50 end low, case when o_orderstatus = 'O' then 6 * (o_orderkey % 50) else o_orderkey % 50 end high from orders"""
)
def order_outputs(t):
    """B5, C14"""
    bounds = T.call_bounds(F.col("o_orderkey") % 50, F.col("o_orderstatus") == "O")
    rows = t("orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("exists"), F.when(F.col("o_orderkey") % 13 == 0, "failed").alias("error"),
        bounds.alias("b")
    )
    return P.refuse_existing(rows).select("o_orderkey", "action", F.col("b.minimum").alias("low"), F.col("b.maximum").alias("high"))


@query("""select o_orderkey, case when o_orderkey % 13 = 0 then 'unreadable' when o_orderkey % 11 = 0 then 'path leaves the root' when o_orderkey % 2 = 0 and o_orderkey % 8 = 6 then 'source changed' when o_orderkey % 2 = 0 and o_orderkey % 16 = 4 then 'artefact missing'
when o_orderkey % 2 = 0 and o_orderstatus <> 'F' and o_orderstatus <> 'P' then 'incomplete output' end reason, case when reason is not null then 'blocked' when o_orderkey % 2 = 0 and o_orderstatus = 'F' then 'already_converted' when o_orderkey % 2 = 0 and o_orderstatus = 'P' then 'resume' else 'convert' end classification from orders""")
def order_plans(t):
    """C15, C17"""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    entries = t("orders").select(
        "o_orderkey", F.when(k % 13 == 0, "unreadable").alias("error"), (k % 11 == 0).alias("traversal"), (k % 2 == 0).alias("exists"),
        (s == "F").alias("complete"), (k % 8 != 6).alias("hash_matches"), (k % 16 == 4).alias("artefacts_missing"),
        (s == "P").alias("checkpoint")
    )
    return R.classify(entries).select("o_orderkey", "reason", "classification")


@query(
    """select c_custkey, case c_custkey % 3 when 0 then 'endpoint is not set' when 1 then 'endpoint is not set' else '' end blockers, '***' secret from customer"""
)
def customer_preflight(t):
    """A setting that is missing, blank or there, and a secret that never shows"""
    k = F.col("c_custkey") % 3
    rows = t("customer").select(
        "c_custkey", F.when(k == 1, " ").when(k == 2, F.col("c_mktsegment")).alias("endpoint"), F.col("c_name").alias("secret")
    )
    return P.preflight(rows, ["endpoint", "secret"], ["secret"]).select(
        "c_custkey", F.array_join("blockers", ",").alias("blockers"), "secret"
    )


@query(f"""with n as {NAMED_SQL}, p as (select path, case when doc_id % 4 = 0 then 'folder' when form = 1 then 'index' when form = 2 then 'files' end kind, form, lang, source from n),
f as (select distinct lang || '/' || source folder from n where doc_id % 4 = 0) select path, count(*) ways from (
select path from n join f on starts_with(path, folder || '/') union all select path from n where form = 1 union all select path from n where form in (1, 2)) group by path""")
def doc_library(t):
    """Notes by the folders of every fourth, by index notes that link to those of some length, and by files; the three together hold each note once"""
    n = _named(t)
    notes = n.select("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    folders = n.where("doc_id % 4 = 0").select(F.concat("lang", F.lit("/"), "source").alias("path"))
    # an index in each folder and for each first letter, with relative links
    listed = n.where("form = 1").withColumn("at", F.concat("lang", F.lit("/"), "source", F.lit("/index-"), F.substring("first", 1, 1), F.lit(".md")))
    line = F.concat(F.lit("- [n](./../"), "source", F.lit("/"), "first", F.lit('.md "'), "first", F.lit('")'))
    text = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    indexes = listed.groupBy(F.col("at").alias("path")).agg(F.concat(F.lit("---\nid: i\n---\n"), text).alias("text"))
    links = M.tables(M.parse_notes(indexes, want=("links",)))["links"]
    files = n.where("form in (1, 2)").select("path")
    ways = [L.library(notes, folders=folders), L.library(notes, indexes=indexes, links=links), L.library(notes, files=files.union(files))]
    each = ways[0].select("path").unionByName(ways[1].select("path")).unionByName(ways[2].select("path"))
    whole = L.library(notes, folders, indexes, files, links).select("path")
    return each.groupBy("path").agg(F.count(F.lit(1)).alias("ways")).join(whole, "path")


QUIZ_SQL = """(select doc_id, 'z/' || doc_id || '.md' path, length(coalesce(text, '')) % 4 form, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) more from documents)"""


def _quiz(t) -> DataFrame:
    """A note a document: an exercise of two questions with the whole text between them, another of one, and a question outside."""
    i = F.col("doc_id").cast("string")
    q = lambda k: [F.lit("> [!question] Q"), F.lit("> Why?"), F.lit(f"> ^q-{k}"), F.lit("")]
    lines = [
        F.lit("---"), F.concat(F.lit("id: z"), i), F.lit("---"), F.lit("%% unit section s %%"), F.lit("# Part one"), F.lit(""), F.lit("%% unit exercise e-1 %%"), F.lit(""),
        *q(1), F.concat(F.lit("Text "), _text()), F.lit(""), *q(2), F.lit("%% /unit e-1 %%"), F.lit(""), F.lit("%% unit exercise e-2 %%"), F.lit(""), *q(3),
        F.lit("%% /unit e-2 %%"), F.lit("%% /unit s %%"), F.lit(""), *q(4)
    ]
    return t("documents").select(
        "doc_id", F.concat(F.lit("z/"), i, F.lit(".md")).alias("path"), F.concat_ws("\n", *lines).alias("text"), (F.length(_text()) % 4).alias("form")
    )


@query(f"""with z as {QUIZ_SQL} select path, 'e-1' uid, 7 lo, (19 + more)::int hi, case when form = 1 then 'q-2' else 'q-1,q-2' end questions from z where form in (1, 2, 3)
union all select path, 'e-2', (21 + more)::int, (27 + more)::int, 'q-3' from z where form = 3 union all select path, null, null, null, 'q-4' from z where form = 0""")
def note_partial_questions(t):
    """Single questions, asked for backwards and twice, grouped by the exercise that holds them"""
    z = _quiz(t)
    n = M.tables(M.parse_notes(z.select("path", "text"), want=("units", "callouts")))
    want = F.when(F.col("form") == 0, F.array(F.lit("q-4"), F.lit("nope"))).when(F.col("form") == 1, F.array(F.lit("q-2"))).when(
        F.col("form") == 2, F.array(F.lit("q-2"), F.lit("q-1"), F.lit("q-2"))
    ).otherwise(F.array(F.lit("q-3"), F.lit("q-2"), F.lit("q-1")))
    questions = n["callouts"].where("kind = 'question'").select("path", "line", "anchor")
    out = P.partial_questions(z.select("path", F.explode(want).alias("anchor")), questions, n["units"])
    return out.withColumn("questions", F.array_join("questions", ","))


@query(f"""with z as (select *, form + 2 pages, more % 7 page from {QUIZ_SQL}) select 'pdf-page' code, path, 4 line, 'page=' || page detail from z where page < 1 or page > pages
union all select 'missing-heading', path, 4, 'Part%20' || case form when 2 then 'two' else 'twice' end from z where form > 1""")
def note_page_links(t):
    """Links to pages of a PDF that has as many as the text's length says, to a heading that is there, to one that isn't, and to one that is there twice"""
    d = t("documents").select("doc_id", _text().alias("text"), (F.length(_text()) % 4).alias("form"))
    more, i = F.size(F.split("text", "\n")) - 1, F.col("doc_id").cast("string")
    pdf = F.concat(F.lit("s"), i, F.lit(".pdf"))
    to = F.when(F.col("form") == 2, "two").when(F.col("form") == 3, "twice").otherwise("one")
    link = F.concat(F.lit("See [p]("), pdf, F.lit("#page="), (more % 7).cast("string"), F.lit(' "Page") and [h](#Part%20'), to, F.lit(")."))
    lines = [F.lit("---"), F.concat(F.lit("id: z"), i), F.lit("---"), link, F.lit(""), F.lit("# Part one"), F.lit("# Part twice"), F.lit("# Part twice"), F.lit(""), F.col("text")]
    notes = d.select(F.concat(F.lit("z/"), i, F.lit(".md")).alias("path"), F.concat_ws("\n", *lines).alias("text"))
    pages = d.select(pdf.alias("target"), (F.col("form") + 2).alias("page_count"))
    return N.check_notes(M.tables(M.parse_notes(notes)), pages).select("code", "path", "line", "detail")


@query("""with x as (select page_id, length(url) % 130 a, length(html) % 9 b from pages) select page_id, array_to_string(list_concat(case when a < 1 or a > 100 then [a::varchar] else [] end, case when b = 0 then ['0'] when b > 6 then [b || 'x'] else [] end), ',') bad,
41000 + ('0x' || substr(sha256(url || chr(10) || 'reader'), 1, 8))::bigint % 8000 port from pages join x using (page_id)""")
def page_spans(t):
    """column and row spans by the lengths of a page's address and text, and the port that its address gives"""
    a, b = F.length("url") % 130, F.length("html") % 9
    cell = F.concat(F.lit('<td colspan="'), a.cast("string"), F.lit('" rowspan='), b.cast("string"), F.when(b > 6, "x").otherwise(""), F.lit(">"))
    return t("pages").select("page_id", F.array_join(T.bad_spans(cell), ",").alias("bad"), T.session_port(F.col("url"), F.lit("reader")).cast("long").alias("port"))


@query("""select doc_id, sha256(coalesce(text, '')) sha256, strlen(coalesce(text, ''))::bigint bytes, case when length(text) % 3 = 0 then 'refused' else 'copied' end outcome from documents""")
def doc_copied(t):
    """Every document as a file, in two chapters: one whose files are as recorded is copied whole; in the other some were changed since, and nothing is"""
    d = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.length("text") % 3 == 0, F.lit(False)).alias("odd"))
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md"))
    files = d.select("doc_id", "odd", path.alias("path"), F.col("text").cast("binary").alias("content"))
    record = files.select("odd", "path", F.sha2("content", 256).alias("sha256"))
    spark, at, done = d.sparkSession, scratch(d.sparkSession), []
    for odd in (False, True):
        mine, now = record.where(F.col("odd") == odd).drop("odd"), files.where(F.col("odd") == odd).select("path", "content")
        if odd:
            now = now.withColumn("content", F.concat("content", F.lit("!").cast("binary")))
        try:
            S.copy_recorded(mine, now, f"{at}/{odd}", S.copy_approval(mine, f"{at}/{odd}"))
            done.append(spark.read.schema("path string, sha256 string, content binary").parquet(f"{at}/{odd}").select("path", F.sha2("content", 256).alias("copied")))
        except ValueError:
            pass
    copied = done[0]
    for x in done[1:]:
        copied = copied.unionByName(x)
    out = files.join(copied, "path", "left")
    return out.select(
        "doc_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"),
        F.when(F.col("copied") == F.sha2("content", 256), "copied").otherwise("refused").alias("outcome")
    )


BLANK_SQL = "array_to_string(list_transform(regexp_extract_all(x, '(?s)({0}|[^`$!]+|.)'), lambda e: case when length(e) > 1 and substr(e, 1, 1) in ('`', '$', '!') then regexp_replace(e, '[^' || chr(10) || ']', ' ', 'g') else e end), '')"


@query(rf"""with t as (select doc_id, coalesce(text, '') || chr(10) || 'one \item' || chr(10) || '`\end`' || chr(10) || 'two \ref \quad \ref' x from documents), b as (select doc_id, {BLANK_SQL.format(PROTECTED_SQL)} x from t),
l as (select doc_id, unnest(string_split(x, chr(10))) s, generate_subscripts(string_split(x, chr(10)), 1) line from b), m as (select doc_id, line::int line, regexp_replace(s, '<[^>]*>|[A-Za-z]:\\\S+', ' ', 'g') m from l)
select doc_id, line, c command from m, (values {LEAKS_SQL}) t(c) where regexp_matches(m, '(^|[^A-Za-z\\])\\' || c || '([^A-Za-z]|$)')""")
def doc_latex_lines(t):
    """commands after each whole text, with their lines, as far as the text's own signs don't protect them"""
    x = F.concat(_text(), F.lit("\none \\item\n`\\end`\ntwo \\ref \\quad \\ref"))
    return X.latex_lines(t("documents").select("doc_id", x.alias("text")), "doc_id")


@query(rf"""with t as (select doc_id, 'a $x' || chr(10) || 'y$ $$b' || chr(10) || 'c$$ ![$d$](e) `$f$` ' || coalesce(text, '') || chr(10) || '$g$' x from documents), b as (select doc_id, {BLANK_SQL.format(X.NO_MATH)} x from t),
p as (select doc_id, regexp_extract_all(x, '(?s)({X.MATH}|[^$]+|\$)') p from b), u as (select doc_id, unnest(p) e, generate_subscripts(p, 1) k from p),
n as (select *, (length(e) - length(replace(e, chr(10), '')))::int n from u), r as (select *, (1 + coalesce(sum(n) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0))::int lo from n)
select doc_id, case when starts_with(e, '$$') then substr(e, 3, length(e) - 4) else substr(e, 2, length(e) - 2) end tex, starts_with(e, '$$') display, lo, lo + n hi from r where starts_with(e, '$') and length(e) > 1""")
def doc_math_lines(t):
    """F8: math before, in and after each whole text, with its lines"""
    x = F.concat(F.lit("a $x\ny$ $$b\nc$$ ![$d$](e) `$f$` "), _text(), F.lit("\n$g$"))
    return X.math_lines(t("documents").select("doc_id", x.alias("text")), "doc_id")


@query(f"""with d as (select doc_id, {LINES_SQL}::int more, length(coalesce(text, '')) % 3 form from documents) select doc_id, 1 line, 'U+0007' controls from d where form = 0 union all select doc_id, more + 2, 'U+007F,U+0085' from d where form < 2""")
def doc_control_lines(t):
    """control characters before and after each whole text, with their lines"""
    form = F.length(_text()) % 3
    x = F.concat(F.when(form == 0, "\x07\t").otherwise(""), _text(), F.lit("\r\n"), F.when(form < 2, "\x7f\x85\x7f").otherwise(""))
    out = X.control_lines(t("documents").select("doc_id", x.alias("text")), "doc_id")
    return out.withColumn("controls", F.array_join("controls", ","))
