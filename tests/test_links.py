from pyspark.sql import functions as F

from folioflow.operators import findings
from folioflow.operators import links as K
from folioflow.sources import markdown as M


def test_fold_path(spark):
    cases = {
        "a/./b//c": "a/b/c", "a/../b": "b", "../a": None, "a/../../b": None, "a/b/../../c/d": "c/d", "": "", "x.md": "x.md", None: None, "a/..": "", "./../a/../..": None
    }
    d = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.f for r in d.select("p", K.fold_path(F.col("p")).alias("f")).collect()} == cases


def test_resolution_prefers_the_origins_own_folder(spark):
    notes = spark.createDataFrame(
        [("one/Sheet/sheet.md", "sheet-id"), ("two/Sheet/sheet.md", None), ("one/Answers/answers.md", "ans"), ("one/course.md", None), ("ans2.md", "x"), ("ans2.md", "x")],
        "path string, id string"
    )
    at = "one/Answers/answers.md"
    cases = [
        (at, "../Sheet/sheet.md", "one/Sheet/sheet.md", "resolved"), ("two/a/b.md", "../Sheet/sheet.md", "two/Sheet/sheet.md", "resolved"),
        (at, "sheet.md", None, "ambiguous"), (at, "sheet", None, "ambiguous"), (at, "course", "one/course.md", "resolved"),
        (at, "../course", "one/course.md", "resolved"), (at, "", at, "resolved"), (at, "sheet-id", None, "id"), (at, "nope", None, "missing"),
        (at, "../../../ans2", "ans2.md", "resolved"), (at, "../../../sheet.md", None, "ambiguous"), (at, None, None, "missing"), (at, "Sheet/../answers.MD", None, "missing")
    ]
    links = spark.createDataFrame([(p, t, i) for i, (p, t, *_) in enumerate(cases)], "path string, target string, k int")
    got = {r.k: (r.to, r.status) for r in K.resolve_links(links, notes).collect()}
    assert got == {i: (to, s) for i, (_, _, to, s) in enumerate(cases)}
    assert K.resolve_links(links, notes.limit(0)).where("status in ('missing')").count() == len(cases) - 0


def spans(spark, texts):
    t = M.tables(M.parse_notes(texts, want=("links", "definitions")))
    at = ["path", "line", "off_lo", "off_hi", "target", "fragment"]
    return t["links"].where("form <> 'reference'").select(*at).unionByName(t["definitions"].select(*at))


def test_targets_are_spliced_byte_for_byte(spark):
    head = "---\nid: x\n---\n"
    texts = {
        "links": head + '## Rule 1\n\nIt holds.\n\n[It](#Rule%201) and [PDF](source/links.pdf#page=1 "Caption").\n',
        "reference": head.replace("\n", "\r\n") + '[Original][pdf]\r\n\r\n[pdf]: <source/reference.pdf> "Original title"\r\n',
        "mixed": head + "é😀 [a](<source/p q.pdf> 'T'), ![b](source/x.png)[c](source/x.png (t))\r`[a](source/x.png)`\r\n[[source/x.png|d]]\n\n$[a](source/x.png)$",
        "plain": head + "no links\r\n\r at all\n\n", "empty": "", "other": head + "[x](elsewhere.pdf)"
    }
    frame = spark.createDataFrame([*texts.items()], "path string, text string")
    moves = spark.createDataFrame(
        [
            ("links", "source/links.pdf", None, "links.pdf", None), ("links", "", "Rule%201", "", "^rule"),
            ("reference", "source/reference.pdf", None, "reference.pdf", None), ("mixed", "source/x.png", None, "../fig/longer name.png", ""),
            ("mixed", "source/p q.pdf", None, "p.pdf", None), ("other", "nothing", None, "x", None)
        ],
        "path string, target string, fragment string, new_target string, new_fragment string"
    )
    got = {r.path: (r.text, r.remapped) for r in K.remap_text(frame, spans(spark, frame), moves).collect()}
    assert got["links"] == (texts["links"].replace("source/links.pdf", "links.pdf").replace("#Rule%201", "#^rule"), 2)
    assert got["reference"] == (texts["reference"].replace("source/", ""), 1)
    assert got["mixed"][0] == (
        head + "é😀 [a](<p.pdf> 'T'), ![b](../fig/longer name.png)[c](../fig/longer name.png (t))\r`[a](source/x.png)`\r\n[[../fig/longer name.png|d]]\n\n$[a](source/x.png)$"
    )
    assert all(got[k] == (texts[k], 0) for k in ("plain", "empty", "other"))
    assert K.remap_text(frame.limit(0), spans(spark, frame), moves).count() == 0
    null = spark.createDataFrame([("links", None)], "path string, text string")
    assert K.remap_text(null, spans(spark, null), moves).first().text is None


def test_many_links_take_work_in_proportion(spark):
    text = "---\nid: x\n---\n" + "".join(f"line {i} [a](t{i}.md \"x\") and [b](same.md)\n" for i in range(20_000))
    frame = spark.createDataFrame([("p", text)], "path string, text string")
    moves = spark.createDataFrame([("p", "same.md", None, "moved/one.md", None)], "path string, target string, fragment string, new_target string, new_fragment string")
    got = K.remap_text(frame, spans(spark, frame), moves).first()
    assert got.text == text.replace("same.md", "moved/one.md") and got.remapped == 20_000


def test_findings_see_titled_bracketed_and_upward_links(spark):
    sheet = "---\nid: {0}\n---\n# S\n\nItem ^q-1\n"
    notes = [
        ("one/Sheet/sheet.md", sheet.format("a")), ("two/Sheet/sheet.md", sheet.format("b")),
        ("one/Answers/a.md", '---\nid: c\n---\n# A\n\n[x](javascript:alert "t") [Q](../Sheet/sheet.md#^q-1 "fine") [R](<../Sheet/none.md>)\n\n[S](../Sheet/sheet.md#^q-2)\n')
    ]
    t = M.tables(M.parse_notes(spark.createDataFrame(notes, "path string, text string")))
    got = sorted((r.code, r.path, r.line, r.detail) for r in findings.check_notes(t).collect())
    assert got == [
        ("missing-anchor", "one/Answers/a.md", 8, "^q-2"), ("missing-link", "one/Answers/a.md", 6, "../Sheet/none.md#"),
        ("unsafe-link", "one/Answers/a.md", 6, "javascript:alert")
    ]
