import random

from plain_edits import edited, projected
from pyspark.sql import functions as F

from folioflow.operators import edits as E

FIELDS = [c.split()[0] for c in E.EDIT.split(", ")]


def random_edits(rng, n_lines):
    out, line = [], 1
    if rng.random() < 0.7:
        out.append(dict(op="unit", start=1, end=n_lines, id="u", kind="section"))
    while line <= n_lines:
        hi = min(n_lines, line + rng.randint(0, 3))
        if rng.random() < 0.5:
            out.append(dict(op="callout", start=line, end=hi, id=rng.choice([f"q{line}", None, ""]), kind="question", title=rng.choice(["T", None]),
                            links=rng.choice([None, "[a](b)", "[a](b)\n[c](d)"]), pdf=rng.choice([None, "[p](p.pdf)"])))
        if rng.random() < 0.4:
            out.append(dict(op="unit", start=line, end=hi, id=f"u{line}", kind="exercise"))
        if rng.random() < 0.3:
            out.append(dict(op="heading", start=line, end=None, title=f"H{line}", level=rng.choice([None, 3])))
        if rng.random() < 0.3:
            out.append(dict(op="anchor", start=line, end=hi, id=f"z{line}"))
        line = hi + 1
    if rng.random() < 0.3:
        out.append(rng.choice([dict(op="move", start=2, end=2), dict(op="anchor", start=n_lines, end=n_lines + 1, id="x"), dict(op="anchor", start=0, end=1, id="x"),
                               dict(op="callout", start=1, end=n_lines, id="o", kind="k")]))
    return [{f: e.get(f) for f in FIELDS} | {"doc": "d"} for e in out]


def test_rows_give_what_line_by_line_gives(spark):
    rng = random.Random(4)
    docs, ops, want = [], [], {}
    for k in range(60):
        newline = rng.choice(["\n", "\r\n", "\r"])
        text = newline.join(rng.choice(["", "> quoted", "> ", "text é", "# H", "%% x %%"]) for _ in range(rng.randint(1, 9)))
        edits = random_edits(rng, len(text.split(newline)))
        docs.append((f"d{k}", text))
        ops += [tuple((e | {"doc": f"d{k}"})[f] for f in FIELDS) for e in edits]
        try:
            out, added = edited(text, edits)
            want[f"d{k}"] = (out, projected(out, added) == text, None)
        except ValueError as x:
            want[f"d{k}"] = (None, False, str(x))
    frame, edits = spark.createDataFrame(docs, "doc string, text string"), spark.createDataFrame(ops, E.EDIT)
    got = {r.doc: (r.text, r.faithful, r.error) for r in E.compile_documents(frame, edits).collect()}
    assert got == want
    assert sum(x[2] is None for x in want.values()) > 20 and {x[2].split()[0] for x in want.values() if x[2]} >= {"unknown", "lines", "callouts"}


def test_appendix_stands_after_all_units(spark):
    docs = spark.createDataFrame([("d", "a\r\nb"), ("e", "x"), ("e", "x"), ("n", None)], "doc string, text string")
    ops = spark.createDataFrame([("d", "unit", 1, 2, "u", "section", None, None, None, None)], E.EDIT)
    reviews = spark.createDataFrame([("d", 2, "second %% delimiter\r\nline"), ("d", 1, "first"), ("d", 3, None), ("z", 1, "nowhere")], "doc string, seq int, note string")
    got = sorted(map(tuple, E.compile_documents(docs, ops, reviews).collect()))
    assert got[0] == (
        "d", "%% unit section u %%\r\na\r\nb\r\n%% /unit u %%\r\n%% review: first %%\r\n%% review: second % % delimiter line %%", True, None
    )
    assert got[1:] == [("e", "x", True, None)] * 2 + [("n", None, False, "no text")]
    assert E.compile_documents(docs.limit(0), ops, reviews).count() == 0


def test_only_what_was_added_is_taken_back(spark):
    docs = spark.createDataFrame([("d", "a\nb"), ("e", "c\nd"), ("f", "g")], "doc string, text string")
    ops = spark.createDataFrame([(d, "anchor", 1, 1, "q", None, None, None, None, None) for d in "def"], E.EDIT)
    made = E.assemble(docs, ops)
    added = made.select("doc", F.explode("added").alias("x")).select("doc", "x.*")
    texts = made.select("doc", F.when(F.col("doc") == "e", F.replace("text", F.lit("^q"), F.lit("^r"))).when(F.col("doc") == "f", F.lit("g")).otherwise(F.col("text")).alias("text"))
    got = {r.doc: (r.text, r.problem) for r in E.take_back(texts, added).collect()}
    assert got == {"d": ("a\nb", None), "e": (None, "line 2 isn't what was inserted"), "f": (None, "line 2 isn't what was inserted")}


def test_a_long_document_with_many_edits(spark):
    n = 30_000
    docs = spark.createDataFrame([("d", "\n".join(f"line {i}" for i in range(n)))], "doc string, text string")
    ops = spark.range(1, n + 1, 3).select(
        F.lit("d").alias("doc"), F.lit("anchor").alias("op"), F.col("id").cast("int").alias("start"), F.col("id").cast("int").alias("end"), F.concat(F.lit("a"), "id").alias("id"),
        *(F.lit(None).cast(k).alias(c) for c, k in (("kind", "string"), ("title", "string"), ("level", "int"), ("links", "string"), ("pdf", "string")))
    )
    got = E.compile_documents(docs, ops).first()
    assert got.faithful and got.text.count("\n") == n - 1 + n // 3
