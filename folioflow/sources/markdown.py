"""Notes: a documented subset of Markdown, parsed into typed rows.

The subset: front matter of `key: value` lines with quoted strings and `[1, 2]` lists; ATX headings; fenced code;
`$$` math; block quotes with `> [!kind] title` callouts; list items; tables; unit comments; `^anchor` ends; links
`[label](target "title")`, `[label][ref]` with `[ref]: target "title"`, and `[[target|label]]`, where a target may
stand in `<>`. LF, CRLF and CR end lines; lines count from 1. What stands in code, math or tables has no interior
anchors, links or markers. Offsets of links count characters of their line from 0 and hold the target alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..shipping import ship
from .scratch import scratch

#: What a note gives, by the table that it goes to; a parsed note has these as arrays and the columns of HEAD.
PARTS = {
    "blocks": "id string, kind string, start int, end int, text string", "headings": "line int, level int, text string",
    "units": "uid string, kind string, lo int, hi int, depth int",
    "callouts": "line int, hi int, kind string, fold string, title string, anchor string, body string",
    "anchors": "line int, anchor string",
    "links": "line int, form string, label string, target string, fragment string, off_lo int, off_hi int",
    "definitions": "line int, label string, target string, fragment string, off_lo int, off_hi int",
    "problems": "code string, line int, detail string"
}
HEAD = "error string, meta map<string,string>, source_pages array<int>, body string, sha256 string, newline string"

_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_UNIT = re.compile(r"^%%\s*(?:\w+:)?unit\s+(\S+)\s+(\S+)\s*%%$")
_END = re.compile(r"^%%\s*/(?:\w+:)?unit\s+(\S+)\s*%%$")
_CALLOUT = re.compile(r"^>\s*\[!([A-Za-z]+)\]([+-]?)\s*(.*)$")
_ANCHOR = re.compile(r"(?:^|\s)\^([A-Za-z0-9-]+)\s*$")
_TITLE = r"""(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*"""
_LINK = re.compile(
    r"!?\[\[(?P<wiki>[^\]|]+)(?:\|(?P<wlabel>[^\]]*))?\]\]"
    r"|!?\[(?P<label>[^\]]*)\]\(\s*(?:<(?P<angle>[^<>]*)>|(?P<target>[^()\s]*(?:\([^()]*\)[^()\s]*)*))" + _TITLE + r"\)"
    r"|\[(?P<rlabel>[^\]]+)\]\[(?P<ref>[^\]]*)\]"
)
_REFERENCE = re.compile(r"^\s{0,3}\[(?P<label>[^\]]+)\]:\s*(?:<(?P<angle>[^<>]*)>|(?P<target>\S+))")
_PROTECTED = re.compile(r"`+[^`]*`+|\$\$.*?\$\$|\$[^$\n]+\$")
KINDS = ("section", "exercise", "correction")


def split_lines(text: str) -> tuple[list[str], str]:
    """(lines, the newline that the text uses)."""
    newline = "\r\n" if "\r\n" in text else "\r" if "\r" in text else "\n"
    return re.split(r"\r\n|\r|\n", text), newline


def front_matter(lines: list[str]) -> tuple[dict[str, str], int, str | None]:
    """(values, lines of the header, problem)."""
    if not lines or lines[0].strip() != "---":
        return {}, 0, "missing front matter"
    meta: dict[str, str] = {}
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            return meta, i + 1, None
        if not line.strip():
            continue
        key, colon, value = line.partition(":")
        if not colon:
            return {}, 0, f"malformed front matter in line {i + 1}"
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] == '"':
            value = value[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        elif len(value) > 1 and value[0] == value[-1] == "'":
            value = value[1:-1].replace("''", "'")
        meta[key.strip()] = value
    return {}, 0, "front matter without an end"


def _at(m: re.Match) -> str:
    """The group that holds a link's target."""
    return "target" if m["angle"] is None else "angle"


def _defined(n: int, m: re.Match) -> dict:
    doc, _, fragment = m[_at(m)].partition("#")
    lo, hi = m.span(_at(m))
    return {"line": n + 1, "label": m["label"], "target": doc, "fragment": fragment, "off_lo": lo, "off_hi": hi}


def parse(text: str | None) -> dict:
    """The rows of one note. A note that can't be read has `error`; problems of its structure are listed."""
    text = text or ""
    lines, newline = split_lines(text)
    meta, at, error = front_matter(lines)
    out: dict = {
        "error": error, "meta": meta, "source_pages": None, "sha256": hashlib.sha256(text.encode()).hexdigest(), "newline": newline,
        "body": "\n".join(lines[at:])
    }
    if "source_pages" in meta:
        pages = re.fullmatch(r"\[\s*(\d+(?:\s*,\s*\d+)*)?\s*\]", meta["source_pages"])
        if not pages:
            out["error"] = error or "source_pages isn't a list of integers"
        else:
            out["source_pages"] = [int(x) for x in (pages[1] or "").split(",") if x.strip()]
    blocks, headings, units, callouts, anchors, problems, open_units = [], [], [], [], [], [], []
    defined = [(n, m) for n, line in enumerate(lines[at:], at) if (m := _REFERENCE.match(line))]
    refs = {m["label"].lower(): m[_at(m)] for _, m in defined}
    reference_lines: set[int] = set()
    visible: list[str | None] = [None] * len(lines)
    i = at

    def block(kind: str, start: int, end: int) -> None:
        blocks.append({"id": f"b-{len(blocks) + 1}", "kind": kind, "start": start + 1, "end": end + 1, "text": "\n".join(lines[start:end])})

    while i < len(lines):
        line, start = lines[i], i
        if fence := _FENCE.match(line):
            i += 1
            while i < len(lines) and not re.match(rf"^\s{{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[i]):
                i += 1
            i = min(i + 1, len(lines))
            block("code", start, i)
        elif line.strip().startswith("$$"):
            if line.strip() == "$$" or line.count("$$") == 1:
                i += 1
                while i < len(lines) and "$$" not in lines[i]:
                    i += 1
                if i >= len(lines):
                    problems.append({"code": "unpaired-math", "line": start + 1, "detail": line})
            i = min(i + 1, len(lines))
            block("math_block", start, i)
        elif m := _UNIT.match(line.strip()):
            kind, uid = m[1], m[2]
            if kind not in KINDS or (open_units and open_units[-1]["kind"] != "section"):
                problems.append({"code": "structural-marker", "line": i + 1, "detail": line})
            open_units.append({"uid": uid, "kind": kind, "lo": i + 1, "depth": len(open_units)})
            i += 1
        elif m := _END.match(line.strip()):
            if open_units and open_units[-1]["uid"] == m[1]:
                units.append(open_units.pop() | {"hi": i + 1})
            else:
                problems.append({"code": "structural-marker", "line": i + 1, "detail": line})
            i += 1
        elif m := _HEADING.match(line):
            headings.append({"line": i + 1, "level": len(m[1]), "text": _ANCHOR.sub("", m[2])})
            visible[i] = line
            i += 1
            block("heading", start, i)
        elif line.lstrip().startswith(">"):
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                visible[i] = lines[i]
                i += 1
            block("quote", start, i)
            if m := _CALLOUT.match(line):
                body, anchor = [re.sub(r"^\s*>\s?", "", x) for x in lines[start + 1 : i]], None
                if body and (a := re.fullmatch(r"\^([A-Za-z0-9-]+)", body[-1].strip())):
                    anchor = a[1]
                    body = body[:-1]
                elif i < len(lines) and (a := re.fullmatch(r"\^([A-Za-z0-9-]+)", lines[i].strip())):
                    anchor = a[1]
                elif i + 1 < len(lines) and not lines[i].strip() and (a := re.fullmatch(r"\^([A-Za-z0-9-]+)", lines[i + 1].strip())):
                    anchor = a[1]
                callouts.append(
                    {
                        "line": start + 1, "hi": i, "kind": m[1].lower(), "fold": m[2], "title": m[3].strip(), "anchor": anchor,
                        "body": "\n".join(body)
                    }
                )
        elif line.lstrip().startswith("|"):
            while i < len(lines) and lines[i].lstrip().startswith("|"):
                i += 1
            block("table", start, i)
        elif _REFERENCE.match(line):
            reference_lines.add(i)
            i += 1
            block("reference", start, i)
        elif not line.strip():
            i += 1
        else:
            kind = "item" if re.match(r"^\s*(?:[-*+]|\d+[.)])\s", line) else "paragraph"
            visible[i] = line
            i += 1
            if kind == "paragraph":
                while i < len(lines) and lines[i].strip() and not re.match(
                    r"^\s{0,3}(?:#{1,6}\s|>|\||`{3,}|~{3,}|\$\$|%%)|^\s*(?:[-*+]|\d+[.)])\s", lines[i]
                ):
                    visible[i] = lines[i]
                    i += 1
            block(kind, start, i)
    problems += [{"code": "structural-marker", "line": u["lo"], "detail": f"unit {u['uid']} has no end"} for u in open_units]
    links = []
    for n, line in enumerate(visible):
        if line is None:
            continue
        bare = _PROTECTED.sub(lambda m: " " * len(m[0]), line)
        if a := _ANCHOR.search(bare):
            anchors.append({"line": n + 1, "anchor": a[1]})
        for m in _LINK.finditer(bare):
            form = "wiki" if m["wiki"] is not None else "inline" if m["label"] is not None else "reference"
            label = m["wlabel"] if form == "wiki" else m["label"] if form == "inline" else m["rlabel"]
            target = m["wiki"] if form == "wiki" else m[_at(m)] if form == "inline" else refs.get((m["ref"] or m["rlabel"]).lower())
            if target is None:
                problems.append({"code": "undefined-reference", "line": n + 1, "detail": m[0]})
                continue
            doc, _, fragment = target.partition("#")
            lo, hi = m.span("wiki") if form == "wiki" else m.span(_at(m)) if form == "inline" else m.span()
            links.append({"line": n + 1, "form": form, "label": label, "target": doc, "fragment": fragment, "off_lo": lo, "off_hi": hi})
    seen = {a["anchor"] for a in anchors}
    anchors += [{"line": c["hi"], "anchor": c["anchor"]} for c in callouts if c["anchor"] and c["anchor"] not in seen]
    return out | {
        "blocks": blocks, "headings": headings, "units": units, "callouts": callouts, "anchors": anchors, "links": links,
        "definitions": [_defined(n, m) for n, m in defined if n in reference_lines], "problems": problems
    }


def parse_notes(files: DataFrame, text: str = "text", want: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """files with a struct column `note` that has the columns of HEAD and an array for each table in `want`.

    Python over Arrow batches, notes with null texts like empty ones; parsing is the one step that SQL can't do.
    """
    ship(files.sparkSession)
    kind = StructType.fromDDL(", ".join([HEAD, *(f"{k} array<struct<{_colons(PARTS[k])}>>" for k in want)]))
    arrow = to_arrow_type(kind)
    names = kind.names

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                rows = batch.slice(lo, ROWS)
                notes = [parse(t) for t in rows.column(text).to_pylist()]
                note = pa.array([{k: list(x[k].items()) if k == "meta" else x[k] for k in names} for x in notes], arrow)
                yield pa.RecordBatch.from_arrays([*rows.columns, note], names=[*rows.schema.names, "note"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("note", kind)]))


#: Notes that are parsed before a batch of them leaves.
ROWS = 256


def _colons(columns: str) -> str:
    return ", ".join(f"`{c.split()[0]}`:{c.split()[1]}" for c in columns.split(", "))


def tables(notes: DataFrame, path: str = "path") -> dict[str, DataFrame]:
    """notes (one row a document), and blocks, units and so on, as far as they were asked for, each with its document's path.

    To parse is dearer than all that follows, and every table reads the same parsed notes. So where several were
    asked for, these are written once to the scratch folder, and each table reads its own columns there.
    """
    found = [f.name for f in notes.schema["note"].dataType.fields if f.name in PARTS]
    if len(found) > 1:
        folder = f"{scratch(notes.sparkSession)}/notes-{uuid.uuid4().hex}"
        notes.select(path, "note").write.parquet(folder)
        notes = notes.sparkSession.read.schema(notes.select(path, "note").schema).parquet(folder)
    good = notes.where(F.col("note.error").isNull())
    out = {
        "notes": notes.select(
            path, F.col("note.meta")["id"].alias("id"), F.col("note.meta")["type"].alias("type"), F.col("note.meta")["role"].alias("role"),
            F.col("note.meta")["title"].alias("title"), F.col("note.meta")["source_pdf"].alias("source_pdf"), "note.source_pages",
            "note.body", "note.sha256", "note.newline", "note.error", "note.meta"
        )
    }
    for name in found:
        out[name] = good.select(path, F.explode(f"note.{name}").alias("x")).select(path, "x.*")
    return out


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Every visible note under root (dot folders and sources/ left out), parsed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    rel = F.expr("substring(path, instr(path, '{0}') + length('{0}') + 1)".format(root.rstrip("/").replace("'", "\\'")))
    files = files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text")).where(~F.col("path").rlike(r"(^|/)(\.|sources/)"))
    return parse_notes(files)
