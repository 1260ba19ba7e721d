import json

import pytest

from folioflow.operators.edits import EDIT, compile_documents
from folioflow.operators.findings import answer_links, check_notes, counts, inventory
from folioflow.operators.integrity import plan_hash
from folioflow.sources import markdown, records, sinks

SHEET = """---
id: sheet
type: document
role: exercise
source_pages: [1, 2]
title: "Sheet \\"one\\""
---
# Sheet

%% unit exercise ex-1 %%
## Exercise 1

> [!question] First
> What is $a$?
> ^q-1

%% /unit ex-1 %%
"""
ANSWERS = """---
id: answers
type: document
role: correction
title: Answers
---
# Answers

%% unit correction c-1 %%
> [!reponse] One
> It is b.
>
> [Question](sheet.md#^q-1) · [PDF](answers.pdf#page=2)
> ^a-1

%% /unit c-1 %%

> [!reponse] Two
> Nobody asked. ^x
> ^a-2

See [[sheet#Exercise 1|there]] and `[not](a-link.md)`.
"""


def parsed(spark, **files):
    rows = [(k.replace("__", "/") + ".md", v) for k, v in files.items()]
    return markdown.tables(markdown.parse_notes(spark.createDataFrame(rows, "path string, text string")))


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_notes_parse_alike_under_any_newline(spark, newline):
    t = parsed(spark, sheet=SHEET.replace("\n", newline), answers=ANSWERS.replace("\n", newline))
    n = {r.path: r for r in t["notes"].collect()}
    assert n["sheet.md"].source_pages == [1, 2] and n["sheet.md"].title == 'Sheet "one"' and n["sheet.md"].error is None
    assert [(r.uid, r.kind, r.lo, r.hi) for r in t["units"].where("path = 'sheet.md'").collect()] == [("ex-1", "exercise", 10, 17)]
    assert {(r.path, r.kind, r.anchor) for r in t["callouts"].collect()} == {
        ("sheet.md", "question", "q-1"), ("answers.md", "reponse", "a-1"), ("answers.md", "reponse", "a-2")
    }
    assert {(r.target, r.fragment) for r in t["links"].collect()} == {
        ("sheet.md", "^q-1"), ("answers.pdf", "page=2"), ("sheet", "Exercise 1")
    }


def test_findings(spark):
    t = parsed(spark, sheet=SHEET, answers=ANSWERS)
    pages = spark.createDataFrame([("answers.pdf", 1)], "target string, page_count int")
    found = {(r.code, r.detail) for r in check_notes(t, pages).collect()}
    assert found == {("unit-owner", "a-2"), ("unmatched-answer", "a-2"), ("pdf-page", "page=2")}
    c = counts(t).first()
    assert (c.documents, c.questions, c.answers, c.hints) == (2, 1, 2, 0)
    a = {r.anchor: r.matched for r in answer_links(t)[0].collect()}
    assert a == {"a-1": True, "a-2": False}


@pytest.mark.parametrize(
    "before, after, code",
    [
        ("#^q-1)", "#^q-9)", "missing-anchor"), ("(sheet.md", "(shoot.md", "missing-link"),
        ("[[sheet#Exercise 1", "[[sheet#Exercise 2", "missing-heading"), ("answers.pdf#page=2", "javascript:x", "unsafe-link"),
        ("> ^a-2", "> ^a-1", "duplicate-anchor"), ("%% /unit c-1 %%", "", "structural-marker"),
        ("# Answers", "# Answers\n### Deep", "heading-gap"), ("See [[", "See [x][nowhere] [[", "undefined-reference")
    ],
)
def test_one_mutation_one_code(spark, before, after, code):
    assert before in ANSWERS
    t = parsed(spark, sheet=SHEET, answers=ANSWERS.replace(before, after))
    assert code in {r.code for r in check_notes(t).collect()}


@pytest.mark.parametrize(
    "before, after, code",
    [
        (" · [PDF](answers.pdf#page=2)", " · [PDF](answers.pdf#page=2) and more", "malformed-field"),
        ("sheet.md#^q-1) ·", "answers.md#^a-2) ·", "relationship-kind"), ("# Answers", "# Answers\n## Theorem 9", "unclassified-unit")
    ],
)
def test_footers_and_headings(spark, before, after, code):
    assert before in ANSWERS
    t = parsed(spark, sheet=SHEET, answers=ANSWERS.replace(before, after, 1))
    assert code in {r.code for r in check_notes(t).collect()} and code not in {
        r.code for r in check_notes(parsed(spark, sheet=SHEET, answers=ANSWERS)).collect()
    }


def test_items_without_questions(spark):
    t = parsed(spark, list="---\nid: l\ntype: document\nrole: exercise\n---\n1. A question.\n\n2. Another.\n")
    assert [
        (r.code, r.severity, r.line) for r in check_notes(t).orderBy("line").collect()
    ] == [("unclassified-item", "review", 6), ("unclassified-item", "review", 8)]


def test_inventory(spark):
    got = {r.id: json.loads(r.json) for r in inventory(parsed(spark, sheet=SHEET, answers=ANSWERS)).collect()}
    assert got["sheet"]["headings"] == ["Sheet", "Exercise 1"] and [b["owner"] for b in got["sheet"]["blocks"]] == ["ex-1"]
    assert [u["uid"] for u in got["answers"]["units"]] == ["c-1"] and [b["owner"] for b in got["answers"]["blocks"]] == ["c-1", None]


def test_broken_notes_are_rows(spark):
    t = parsed(spark, a="no front matter", b="---\nid: x\n", c="")
    assert {r.path: bool(r.error) for r in t["notes"].collect()} == {"a.md": True, "b.md": True, "c.md": True}
    assert check_notes(t).where("code = 'front-matter'").count() == 3


def test_read_notes_skips_hidden(spark, tmp_path):
    for p in ("a/x.md", "a/.y/z.md", "a/sources/s.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(SHEET)
    got = markdown.read_notes(spark, f"file:{tmp_path}").select("path").collect()
    assert len(got) == 1 and got[0].path.endswith("x.md")


def test_journal(spark, tmp_path):
    f = tmp_path / "activity.jsonl"
    f.write_text(
        '{"layout":"l"}\n{"v":1,"ts":"2024-05-01T09:00:00.000Z","type":"a"}\n{"v":1,"ts":"2024\n{"v":1,"ts":"2024-05-01T09:01:00.000Z","type":"b"}'
    )
    assert [(r.seq, r.type) for r in records.read_journal(spark, str(f)).orderBy("seq").collect()] == [(1, "a"), (3, "b")]
    f.write_text('{"v":1,"type":"a"}\n')
    with pytest.raises(ValueError):
        records.read_journal(spark, str(f))


def test_records(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 3, "status": "extracted", "pages": [{"number": 1}]}))
    assert records.read_records(spark, str(tmp_path / "m.json"), records.MANIFEST).first().pages[0].number == 1
    d = spark.createDataFrame([('{"status": 1, "odd": 2}',), ('{"status": 1}',)], "text string")
    assert [r.unknown for r in records.unknown_fields(d, records.MANIFEST).collect()] == [["odd"]]
    b = spark.createDataFrame([('{"schema_version": 3}',), ('{"schema_version": 2}',), ("{",), (None,)], "text string")
    assert [r.reason for r in records.bundle_marker(b).collect()] == [None, "unrecognised version", "unreadable manifest", "no manifest"]
    c = spark.createDataFrame([("a/index.md",), ("a/b/index.md",), ("c/d/e/index.md",)], "path string")
    assert {r.root: r.omitted for r in records.list_chapters(c, 2).collect()} == {"a": False, "c/d/e": True}


def test_discover_and_classify(spark, tmp_path):
    for p, body in (("x/a.pdf", b"%PDF-1.7"), ("x/out/b.pdf", b"%PDF-1.7"), ("c.pdf", b"hello")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(body)
    owned = spark.createDataFrame([(f"file:{tmp_path}/x/out",)], "path string")
    got = {r.path.rsplit("/", 1)[1]: (r.is_pdf, r.owned) for r in records.discover(spark, f"file:{tmp_path}", owned).collect()}
    assert got == {"a.pdf": (True, False), "b.pdf": (True, True), "c.pdf": (False, False)}
    cols = "error string, traversal boolean, exists boolean, complete boolean, hash_matches boolean, artefacts_missing boolean, checkpoint boolean"
    rows = [
        (None,) * 7, (None, None, True, True, True, None, None), (None, None, True, False, True, None, True), ("unreadable",) + (None,) * 6,
        (None, None, True, True, False, None, None)
    ]
    assert [
        r.classification for r in records.classify(spark.createDataFrame(rows, cols)).collect()
    ] == ["convert", "already_converted", "resume", "blocked", "blocked"]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    h = plan_hash(d).first()[0]
    with pytest.raises(ValueError):
        sinks.materialize(d, "0" * 64, str(tmp_path / "out"))
    sinks.materialize(d, h, str(tmp_path / "out"))
    with pytest.raises(Exception):
        sinks.materialize(d, h, str(tmp_path / "out"))
    assert [r.value for r in sinks.compile_json(d, ["k"]).collect()] == ['{"k":1,"v":"a"}', '{"k":2,"v":null}']
    assert [r.k for r in sinks.changed_only(d, spark.createDataFrame([(1, "a")], "k int, v string"), "k", "v").collect()] == [2]


def test_edits(spark):
    docs = spark.createDataFrame([("d", "# A\r\ntext\r\n\r\n> q\r\nlast"), ("e", "x")], "doc string, text string")
    ops = [
        ("d", "unit", 1, 5, "u", "exercise", None, None, None, None),
        ("d", "callout", 2, 3, "q-1", "question", "Q", None, "[x](y)", "[p](p.pdf#page=1)"),
        ("d", "heading", 5, 5, None, None, "T", 2, None, None), ("d", "anchor", 5, 5, "z", None, None, None, None, None)
    ]
    got = {r.doc: r for r in compile_documents(docs, spark.createDataFrame(ops, EDIT)).collect()}
    assert got["d"].faithful and "[x](y) · [p](p.pdf#page=1)" in got["d"].text and "\r\n" in got["d"].text and got["e"].text == "x"
    bad = spark.createDataFrame([("d", "replace", 1, 1, None, None, None, None, None, None)], EDIT)
    assert "unknown operation" in {r.doc: r.error for r in compile_documents(docs, bad).collect()}["d"]
    from plain_edits import edited, projected

    text, added = edited("a\nb", [dict(op="anchor", start=1, end=1, id="q", kind=None, title=None, level=None, links=None, pdf=None)])
    with pytest.raises(ValueError):
        projected(text.replace("^q", "^r"), added)
