"""Scalar functions over text, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points whose letters and marks are taken apart: Latin, Greek, Cyrillic and their extended blocks.
ACCENT_BLOCKS = ((0x00C0, 0x0250), (0x0340, 0x0345), (0x0374, 0x0530), (0x1E00, 0x2000), (0x212A, 0x212C))
#: Marks that stand by themselves after a letter.
MARKS = (*range(0x0300, 0x0370), *range(0x0483, 0x0488), *range(0x1AB0, 0x1ACF), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x20F1), *range(0xFE20, 0xFE30))


def _accents() -> tuple[str, str]:
    """(letters with marks and marks alone, the letters without them): canonical decomposition, of which the first letter stays; marks come last and have no letter."""
    letters = {}
    for lo, hi in ACCENT_BLOCKS:
        for c in map(chr, range(lo, hi)):
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x) and unicodedata.category(x) != "Mn")
            if bare != c and len(bare) == 1:
                letters[c] = bare
    return "".join([*letters, *(chr(m) for m in MARKS if unicodedata.category(chr(m)) == "Mn")]), "".join(letters.values())


ACCENTED, PLAIN = _accents()
#: Named character references; &amp; is decoded last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©"}
BLOCK_END = r"(?i)</(?:p|div|h[1-6]|li|ul|ol|tr|table|article|nav|section|title|header|footer)\s*>|<br\s*/?>"
#: Layout commands that are a leak when they stand in ordinary text.
LATEX = [
    "quad", "qquad", "hspace", "vspace", "textbf", "textit", "emph", "item", "begin", "end", "section", "subsection", "label", "ref",
    "cite", "noindent", "newline", "linebreak", "par"
]


def slugify(c: Column) -> Column:
    """accents off (marks of Latin, Greek and Cyrillic letters, composed or apart), lower case, runs of other than a-z0-9 to `-`, trimmed; `publication` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, ACCENTED, PLAIN)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", F.lit("publication")).otherwise(s)


def once(c: Column, use) -> Column:
    """use(c), where c is computed once a row, however often `use` names it."""
    return F.transform(F.array(c), use)[0]


def _numbers(c: Column, pattern: str, base: int) -> Column:
    """Numeric character references of a base, decoded: what stands between them is kept, each reference replaced once."""

    def decode(x: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))
        char = lambda r: F.decode(
            F.unhex(F.lpad(F.hex(F.conv(F.regexp_extract(r, pattern, 1), base, 10).cast("long")), 8, "0")), "UTF-32"
        )
        return F.aggregate(found, x, lambda text, r: F.replace(text, r, char(r)))

    return once(c, lambda x: F.when(F.contains(x, F.lit("&#")), decode(x)).otherwise(x))


def decode_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal character references."""
    c = reduce(lambda x, e: F.replace(x, F.lit(e), F.lit(ENTITIES[e])), ENTITIES, c)
    c = _numbers(_numbers(c, r"&#([0-9]{1,7});", 10), r"&#[xX]([0-9A-Fa-f]{1,6});", 16)
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def html_text(c: Column, most: int | None = None) -> Column:
    """scripts, styles and comments off, block ends to newlines, tags off, references decoded; cut to `most` with an ellipsis."""
    c = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    c = F.regexp_replace(F.regexp_replace(c, BLOCK_END, "\n"), r"<[^>]*>", "")
    c = decode_entities(c)
    return c if most is None else once(c, lambda x: excerpt(x, most))


def excerpt(c: Column, most: int) -> Column:
    """The first code points and `…` where the text is longer."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def split_address(c: Column) -> Column:
    """struct(doc, fragment) of `doc#fragment`; a missing fragment is ''."""
    p = F.split(c, "#", 2)
    return F.struct(p[0].alias("doc"), F.coalesce(F.get(p, 1), F.lit("")).alias("fragment"))


#: Code spans, fences and math: what stands there is neither a comment, a link nor a command.
PROTECTED = r"(?s)```.*?```|``.*?``|`[^`\n]*`|\$\$.*?\$\$|\$[^$\n]+\$"


def mask_protected(c: Column) -> Column:
    """Protected spans replaced by nothing but their newlines' count of spaces, so that they match nothing."""
    return F.regexp_replace(c, PROTECTED, " ")


def hide_comments(c: Column) -> Column:
    """`%%…%%` removed outside protected spans; what is protected stands for itself."""
    return F.when(F.contains(c, F.lit("%%")), F.regexp_replace(c, f"(?s)({PROTECTED})|%%.*?%%", "$1")).otherwise(c)


def math_expressions(c: Column) -> Column:
    """F8: array of struct(tex, display) of `$…$` and `$$…$$` outside code."""
    bare = F.regexp_replace(c, r"(?s)```.*?```|``.*?``|`[^`\n]*`|!\[[^\]]*\]", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?s)(\$\$.+?\$\$|\$[^$\n]+\$)"), F.lit(1))
    display = lambda x: F.startswith(x, F.lit("$$"))
    return F.transform(
        found,
        lambda x: F.struct(
            F.when(display(x), F.substring(x, F.lit(3), F.length(x) - 4)).otherwise(F.substring(x, F.lit(2), F.length(x) - 2)).alias("tex"),
            display(x).alias("display")
        )
    )


def latex_leaks(c: Column) -> Column:
    """distinct known commands outside protected spans, HTML tags and paths."""
    bare = F.regexp_replace(mask_protected(c), r"<[^>]*>|[A-Za-z]:\\\S+", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z\\])\\(" + "|".join(LATEX) + r")(?![A-Za-z])"), F.lit(1)))


def control_characters(c: Column) -> Column:
    """`U+XXXX` of each distinct control character other than tab, newline and carriage return."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F])"), F.lit(1)))
    return F.transform(
        found, lambda x: F.concat(F.lit("U+"), F.lpad(F.hex(F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")), 4, "0"))
    )


def page_fragment(c: Column) -> Column:
    """N of a `#page=N`, after URL decoding; null without one."""
    n = F.regexp_extract(F.coalesce(F.try_url_decode(c), c), r"#page=([0-9]+)", 1)
    return F.when(n != "", n.cast("int"))


def safe_scheme(c: Column) -> Column:
    """relative targets, http, https and mailto."""
    scheme = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return scheme.isin("", "http", "https", "mailto")


#: The tags of the static-table subset.
TABLE_TAGS = ["table", "caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr", "th", "td", "p", "br"]


def tags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))


def table_violations(c: Column) -> Column:
    """distinct tags outside the subset."""
    return F.array_sort(F.array_except(F.transform(tags(c), F.lower), F.array(*map(F.lit, TABLE_TAGS))))


def bad_spans(c: Column) -> Column:
    """colspan and rowspan values that aren't integers from 1 to 100."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\b(?:col|row)span\s*=\s*[\"']?([^\"'\s>]*)"), F.lit(1))
    return F.filter(found, lambda x: ~F.coalesce(F.try_to_number(x, F.lit("999")).between(1, 100) & x.rlike("^[0-9]+$"), F.lit(False)))


def callout(c: Column) -> Column:
    """struct(kind, fold, title) of a `> [!kind]- title` line; null otherwise."""
    p = r"^>\s*\[!([A-Za-z]+)\]([+-]?)\s*(.*)$"
    return F.when(
        c.rlike(p),
        F.struct(
            F.lower(F.regexp_extract(c, p, 1)).alias("kind"), F.regexp_extract(c, p, 2).alias("fold"),
            F.regexp_extract(c, p, 3).alias("title")
        )
    )


def has_label(c: Column) -> Column:
    """a wikilink `[[target|label]]` shows a label that isn't blank."""
    return F.trim(F.regexp_extract(c, r"^\[\[[^\]|]*\|([^\]]*)\]\]$", 1)) != ""


def escape_cell(c: Column) -> Column:
    """`|` escaped for a table cell."""
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def quote_yaml(c: Column) -> Column:
    """a double-quoted YAML string; `|` stays."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def minutes(ms: Column) -> Column:
    """F16: `—` for 0, `<1 min` below a minute, else `~n min`."""
    return F.when(ms <= 0, "—").when(ms < 60000, "<1 min").otherwise(
        F.concat(F.lit("~"), F.floor((ms + 30000) / 60000).cast("string"), F.lit(" min"))
    )


def local_date(ts: Column, zone: str) -> Column:
    """the calendar day of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def reader_id(*parts: Column) -> Column:
    """a stable id of 12 hex digits."""
    return F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(12))


def session_port(*parts: Column) -> Column:
    """a stable port in [41000, 49000)."""
    return (
        F.lit(41000) + F.pmod(F.conv(F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(8)), 16, 10).cast("long"), F.lit(8000))
    ).cast("int")


def explain_failure(c: Column) -> Column:
    """what follows the last `Generate error:`; the text itself if there is none."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^.*Generate error:[ \t]*(.*)$"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), c)


def normal_heading(c: Column) -> Column:
    """heading text without markup, TeX escapes and doubled spaces, in lower case."""
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"\\([\\`*_{}\[\]()#+\-.!$%&])", "$1")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[*_`$#]", ""), r"\s+", " ")))


def shell_quote(c: Column) -> Column:
    """a single-quoted POSIX word."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def redact(c: Column, *secrets: str) -> Column:
    """values that must not show, replaced by ***."""
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("***")), [s for s in secrets if s], c)


def fence(c: Column) -> Column:
    """A fence longer than any run of backticks within, three at least."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def selected_pages(spec: Column, count: Column) -> Column:
    """Ascending distinct pages of `7,1-3,2`; null means all; null for an invalid spec."""
    part = r"\s*[0-9]{1,6}\s*(?:-\s*[0-9]{1,6}\s*)?"
    bounds = F.transform(
        F.split(spec, ","),
        lambda p: F.struct(
            F.regexp_extract(p, r"^\s*([0-9]+)", 1).cast("int").alias("lo"),
            F.coalesce(
                F.nullif(F.regexp_extract(p, r"-\s*([0-9]+)\s*$", 1), F.lit("")), F.regexp_extract(p, r"^\s*([0-9]+)", 1)
            ).cast("int").alias("hi")
        )
    )
    good = spec.rlike(f"^{part}(?:,{part})*$") & F.forall(bounds, lambda b: (b.lo >= 1) & (b.lo <= b.hi) & (b.hi <= count))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(bounds, lambda b: F.sequence(b.lo, F.greatest(b.lo, b.hi))))))
    return F.when(spec.isNull(), F.sequence(F.lit(1), count)).when(good, pages)


def page_ranges(pages: Column) -> Column:
    """`1-3,7` of ascending distinct pages 1, 2, 3, 7; null of null."""

    def ranges(p: Column) -> Column:
        first = F.filter(p, lambda x: ~F.array_contains(p, x - 1))
        last = F.filter(p, lambda x: ~F.array_contains(p, x + 1))
        return F.array_join(
            F.zip_with(
                first, last,
                lambda lo, hi: F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string")))
            ),
            ","
        )

    return F.transform(F.array(pages), ranges)[0]  # pages are computed once, not for each element


def span_text(text: Column, spans: Column) -> Column:
    """Code points of struct(offset, length) spans in order; contiguous ones join with nothing, others with a newline; null if a span is negative, overlaps or overflows."""
    ends = F.transform(spans, lambda s: s["offset"] + s["length"])
    before = F.concat(F.array(F.lit(0).cast("long")), F.transform(ends, lambda e: e.cast("long")))
    good = F.forall(spans, lambda s: (s["offset"] >= 0) & (s["length"] >= 0) & (s["offset"] + s["length"] <= F.length(text))) & F.forall(
        F.arrays_zip(F.transform(spans, lambda s: s["offset"]).alias("o"), F.slice(before, 1, F.size(spans)).alias("e")),
        lambda z: z.o >= z.e
    )
    joined = F.aggregate(
        F.transform(
            spans,
            lambda s, i: F.struct(
                F.substring(text, s["offset"].cast("int") + 1, s["length"].cast("int")).alias("t"),
                ((i > 0) & (F.get(before, i) != s["offset"])).alias("gap")
            )
        ),
        F.lit(""), lambda acc, p: F.concat(acc, F.when(p.gap, "\n").otherwise(""), p.t),
    )
    return F.when(good, joined)


def inside(path: Column, root: Column) -> Column:
    """C11: path is root or lies under it, by whole components."""
    root = F.regexp_replace(root, "/+$", "")
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def visible(path: Column) -> Column:
    """No dot folder or file, nothing under sources/."""
    return ~path.rlike(r"(^|/)(\.|sources/)")


def watched(path: Column, layout: str) -> Column:
    """A10: what a change of makes a reader compile again: its layout, and notes outside dot folders and the activity records."""
    return (path == layout) | (path.rlike(r"(?i)\.md$") & ~path.rlike(r"(^|/)(\.|Activity/)"))


def role_folder(role: Column, base: Column) -> Column:
    """C4: the folder of a document by its role."""
    return F.when(role == "course", F.concat(F.lit("Course-"), base)).when(role == "exercise", F.concat(F.lit("Exercise-"), base)).when(
        role == "correction", F.concat(F.lit("Correction-"), base)
    ).otherwise(base)


def call_bounds(pages: Column, review: Column) -> Column:
    """C14: struct(minimum, maximum) of model calls."""
    return F.struct(
        F.when(review, pages * 2).otherwise(pages).alias("minimum"), F.when(review, pages * 6).otherwise(pages).alias("maximum")
    )
