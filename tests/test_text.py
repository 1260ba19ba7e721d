import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T


def value(spark, f, *args, kinds=None):
    cols = [f"c{i}" for i in range(len(args))]
    schema = ", ".join(f"{c} {k}" for c, k in zip(cols, kinds or ["string"] * len(args)))
    return spark.createDataFrame([args], schema).select(f(*[F.col(c) for c in cols]).alias("v")).first().v


@pytest.mark.parametrize(
    "raw, want", [("Théorème d'été", "theoreme-d-ete"), ("  --  ", "publication"), ("", "publication"), ("A/B  c", "a-b-c"), (None, None)]
)
def test_slugify(spark, raw, want):
    assert value(spark, T.slugify, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<p>a</p><p>b &amp;lt; c</p>", "a\nb &lt; c\n"), ("&#937;&#x3a9;&copy;", "ΩΩ©"), ("<style>x</style>&#128512;<br>z", "😀\nz"),
        (None, None)
    ]
)
def test_html_text(spark, raw, want):
    assert value(spark, T.html_text, raw) == want


def test_excerpt_and_address(spark):
    assert value(spark, lambda c: T.excerpt(c, 3), "😀bcd") == "😀bc…"
    assert tuple(value(spark, T.split_address, "a.md#^b#c")) == ("a.md", "^b#c")
    assert tuple(value(spark, T.split_address, "a.md")) == ("a.md", "")


@pytest.mark.parametrize(
    "spec, want",
    [
        ("7,1-3,2", [1, 2, 3, 7]), (None, list(range(1, 10))), ("", None), ("0", None), ("3-1", None), ("10", None), ("1,,2", None),
        ("a", None), ("1-", None)
    ]
)
def test_selected_pages(spark, spec, want):
    assert value(spark, T.selected_pages, spec, 9, kinds=["string", "int"]) == want


@pytest.mark.parametrize(
    "spec, want", [("7,1-3,2", "1-3,7"), (None, "1-9"), ("9", "9"), ("8-9,1,3", "1,3,8-9"), ("0", None), ("3-1", None)]
)
def test_page_ranges(spark, spec, want):
    assert value(spark, lambda s, n: T.page_ranges(T.selected_pages(s, n)), spec, 9, kinds=["string", "int"]) == want


SPANS = "array<struct<offset:int,length:int>>"


@pytest.mark.parametrize(
    "spans, want",
    [
        ([(0, 1), (1, 1)], "😀b"), ([(0, 1), (2, 1)], "😀\nc"), ([], ""), ([(-1, 1)], None), ([(3, 2)], None), ([(0, 2), (1, 1)], None),
        ([(0, -1)], None)
    ]
)
def test_span_text(spark, spans, want):
    assert value(spark, T.span_text, "😀bcd", spans, kinds=["string", SPANS]) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a \\quad b", ["quad"]), ("$\\quad$ `\\quad`", []), ("\\quadx", []), ("C:\\item", []), ("```\n\\emph\n```\n\\item", ["item"]),
        ("<a title='\\quad'>", [])
    ]
)
def test_latex(spark, raw, want):
    assert value(spark, T.latex_leaks, raw) == want


def test_controls(spark):
    assert value(spark, T.control_characters, "a\x08\x1b\t\n\r\x85") == ["U+0008", "U+001B", "U+0085"]


def test_math(spark):
    got = value(spark, T.math_expressions, "$a$ `$b$` $$c\nd$$ ![x $e$](y)")
    assert [(r.tex, r.display) for r in got] == [("a", False), ("c\nd", True)]


def test_comments(spark):
    assert value(spark, T.hide_comments, "a %%x%% b `%%y%%` $%%z%%$") == "a  b `%%y%%` $%%z%%$"
    assert value(spark, T.hide_comments, "plain") == "plain"


@pytest.mark.parametrize("raw, want", [("javascript:x", False), ("https://a", True), ("a.md#b", True), ("DATA:x", False)])
def test_scheme(spark, raw, want):
    assert value(spark, T.safe_scheme, raw) is want


@pytest.mark.parametrize("ms, want", [(0, "—"), (59999, "<1 min"), (60000, "~1 min"), (170000, "~3 min")])
def test_minutes(spark, ms, want):
    assert value(spark, T.minutes, ms, kinds=["long"]) == want


def test_others(spark):
    assert value(spark, T.page_fragment, "a.pdf%23page=12") == 12 and value(spark, T.page_fragment, "a.pdf#page=x") is None
    assert tuple(value(spark, T.callout, "> [!Question]- Two words")) == ("question", "-", "Two words")
    assert value(spark, T.has_label, "[[a| ]]") is False and value(spark, T.has_label, "[[a|b]]") is True
    assert value(spark, T.fence, "a ```` b") == "`````" and value(spark, T.fence, "a") == "```"
    assert value(spark, T.normal_heading, "**Th\\_m** [x](y)  $z$") == "thm x z"
    assert value(spark, T.explain_failure, "x\nGenerate error: one\nGenerate error: two\n") == "two"
    assert value(spark, T.shell_quote, "it's") == "'it'\\''s'" and value(spark, lambda c: T.redact(c, "key"), "a key") == "a ***"
    assert value(spark, T.table_violations, "<table><tr><td><b>") == ["b"] and value(
        spark, T.bad_spans, '<td colspan="0"><td rowspan=3>'
    ) == ["0"]
    assert value(spark, T.inside, "/a/bc", "/a/b") is False and value(spark, T.inside, "/a/b/c", "/a/b/") is True
    assert value(spark, T.visible, "a/.x/b") is False and value(
        spark, T.visible, "a/sources/b"
    ) is False and value(spark, T.visible, "a/b.md") is True
    assert value(spark, T.escape_cell, "a|b") == "a\\|b" and value(spark, T.quote_yaml, 'a|"b"') == '"a|\\"b\\""'
    assert len(value(spark, lambda c: T.reader_id(c), "x")) == 12 and 41000 <= value(spark, lambda c: T.session_port(c), "x") < 49000


def test_accents_are_canonical_decomposition(spark):
    """All of Latin, Greek and Cyrillic, composed and with marks apart, against the interpreter's own tables."""
    import unicodedata

    chars = [chr(c) for lo, hi in ((0x20, 0x0530), (0x1E00, 0x2000)) for c in range(lo, hi)]
    texts = ["".join(chars[k : k + 64]) for k in range(0, len(chars), 64)] + ["Šárka ł Nguyễn tế", "e\u0301a\u0308\u0323", "Ёлка Άλφα"]
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.translate("t", T.ACCENTED, T.PLAIN).alias("b"), T.slugify(F.col("t")).alias("s"))
    got = {r.k: (r.b, r.s) for r in d.collect()}
    assert all(got[k][0] == bare(t) for k, t in enumerate(texts))
    assert got[len(texts) - 3][1] == "sarka-nguyen-te" and got[len(texts) - 2][1] == "ea"


def test_comments_span_lines_and_spare_what_is_protected(spark):
    cases = {
        "a %%x\ny%% b": "a  b", "`%%c%%` %%d%%": "`%%c%%` ", "$a %%b%% c$": "$a %%b%% c$", "%%%": "%%%", "%%%%": "", "```\n%%x%%\n``` %%y%%$1": "```\n%%x%%\n``` $1",
        "a %% alone": "a %% alone", "": "", None: None
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in d.select("t", T.hide_comments(F.col("t")).alias("s")).collect()} == cases
