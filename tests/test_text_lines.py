import random
import re

from pyspark.sql import functions as F

from folioflow.operators import text_lines as X


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string")


def test_blanked_keeps_places(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["`", "``", "```", "$", "$$", "a", "\n", " b ", "!"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got = {r.k: r.b for r in frame(spark, *texts, None).select("k", X.blanked(F.col("text"), X.PROTECTED[4:]).alias("b")).collect()}
    plain = lambda t: re.sub(X.PROTECTED, lambda m: re.sub(r"[^\n]", " ", m[0]), t)
    assert got == {k: plain(t) for k, t in enumerate(texts)} | {300: None}


def test_commands_by_line(spark):
    d = frame(spark, "ok\n\\quad x \\quad \\textbf{b}\r\n$\\item$ `\\end`\rC:\\ref\\x <b \\ref> \\quadrant \\\\par\n\\par", "$$\n\\label\n$$ \\label", None, "")
    assert sorted(map(tuple, X.latex_lines(d, "k").collect())) == [(0, 2, "quad"), (0, 2, "textbf"), (0, 5, "par"), (1, 3, "label")]


def test_controls_by_line(spark):
    d = frame(spark, "a\tb\n\x07x\x07\x9f\r\nfine\n\x00", None, "clean")
    assert [(r.k, r.line, r.controls) for r in X.control_lines(d, "k").orderBy("line").collect()] == [(0, 2, ["U+0007", "U+009F"]), (0, 4, ["U+0000"])]


def test_math_by_line(spark):
    d = frame(spark, "a $x$\n$$y\nz$$ ![$n$](p) `$c$`\n```\n$d$\n```\n$e$ $ alone\n", None, "", "$x$")
    got = sorted(map(tuple, X.math_lines(d.union(d), "k").collect()))
    assert got == [(0, "e", False, 7, 7), (0, "x", False, 1, 1), (0, "y\nz", True, 2, 3), (3, "x", False, 1, 1)]
