"""Edits of one text, line by line: what the operators are held against."""

from __future__ import annotations

from folioflow.operators.edits import OPERATIONS
from folioflow.sources.markdown import split_lines


def footer(links: str | None, pdf: str | None) -> list[str]:
    """M4: relationships first, the PDF last, after one blank quoted line; nothing if there is neither."""
    parts = [x for x in [*(links or "").split("\n"), pdf or ""] if x]
    return [">", "> " + " · ".join(parts)] if parts else []


def edited(text: str, edits: list[dict]) -> tuple[str, list[tuple[int, str]]]:
    """M1, M2, M6: (the text with the edits, the inserted lines as (line from 1, what was added)).

    start and end are lines of the source from 1, both included. Insertions at a line go in the order unit,
    heading, callout, anchor; ends close in reverse. The source's own newline is used.
    """
    lines, newline = split_lines(text)
    before: dict[int, list] = {}
    after: dict[int, list] = {}
    quoted: set[int] = set()
    for e in sorted(edits, key=lambda e: (e["start"], OPERATIONS.index(e["op"]) if e["op"] in OPERATIONS else 9, -(e["end"] or 0))):
        if e["op"] not in OPERATIONS:
            raise ValueError(f"unknown operation {e['op']}")
        lo, hi = e["start"], e["end"] or e["start"]
        if not 1 <= lo <= hi <= len(lines):
            raise ValueError(f"lines {lo}-{hi} aren't in the document")
        if e["op"] == "unit":
            before.setdefault(lo, []).append(f"%% unit {e['kind']} {e['id']} %%")
            after.setdefault(hi, []).insert(0, f"%% /unit {e['id']} %%")
        elif e["op"] == "heading":
            before.setdefault(lo, []).append("#" * (e["level"] or 1) + " " + (e["title"] or ""))
        elif e["op"] == "callout":
            if quoted & set(range(lo, hi + 1)):
                raise ValueError("callouts overlap")
            quoted |= set(range(lo, hi + 1))
            before.setdefault(lo, []).append(f"> [!{e['kind']}] {e['title'] or ''}".rstrip())
            after.setdefault(hi, []).insert(0, [*footer(e["links"], e["pdf"]), *([f"> ^{e['id']}"] if e["id"] else [])])
        else:
            after.setdefault(hi, []).insert(0, f"^{e['id']}")
    out, added = [], []

    def add(x) -> None:
        for line in x if isinstance(x, list) else [x]:
            out.append(line)
            added.append((len(out), line))

    for n, line in enumerate(lines, 1):
        for x in before.get(n, []):
            add(x)
        out.append("> " + line if n in quoted else line)
        if n in quoted:
            added.append((len(out), "> "))
        for x in after.get(n, []):
            add(x)
    return newline.join(out), added


def projected(text: str, added: list[tuple[int, str]]) -> str:
    """M3: the text without the recorded additions, and nothing else taken away."""
    lines, newline = split_lines(text)
    gone = dict(added)
    out = []
    for n, line in enumerate(lines, 1):
        if n in gone and gone[n] == "> " and line.startswith("> ") and line != gone[n]:
            out.append(line[2:])
        elif n in gone and line == gone[n] == "> ":
            out.append("")
        elif n in gone:
            if line != gone[n]:
                raise ValueError(f"line {n} isn't what was inserted")
        else:
            out.append(line)
    return newline.join(out)
