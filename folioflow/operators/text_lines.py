"""Findings in texts by their lines: commands, control characters and math, where code and math keep their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import LATEX, PROTECTED

#: What no math stands in: code, and what an image is called.
NO_MATH = r"```.*?```|``.*?``|`[^`\n]*`|!\[[^\]]*\]"
MATH = r"\$\$.+?\$\$|\$[^$\n]+\$"


def blanked(c: Column, pattern: str) -> Column:
    """c with a space for each character of what the pattern matches, newlines kept, so that places and lines stay. The pattern's matches begin with a backquote, `$` or `!`, and are longer than that."""
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s)({pattern}|[^`$!]+|.)"), F.lit(1))
    held = lambda x: (F.length(x) > 1) & F.left(x, F.lit(1)).isin("`", "$", "!")
    return F.array_join(F.transform(pieces, lambda x: F.when(held(x), F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)), "")


def _lines(rows: DataFrame, key: str, text: Column) -> DataFrame:
    whole = rows.select(key, text.alias("_text"))  # worked on once a text, then cut
    return whole.select(key, F.posexplode(F.split("_text", "\\r\\n|\\r|\\n")).alias("_at", "_line")).select(key, (F.col("_at") + 1).alias("line"), "_line")


def latex_lines(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, command) of known commands in ordinary text, once a line each: not in code, math, tags or paths, nor as part of longer names. Null texts have none."""
    lines = _lines(rows, key, blanked(F.col(text), PROTECTED[4:]))
    bare = F.regexp_replace("_line", r"<[^>]*>|[A-Za-z]:\\\S+", " ")
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z\\])\\(" + "|".join(LATEX) + r")(?![A-Za-z])"), F.lit(1)))
    return lines.where(F.contains("_line", F.lit("\\"))).select(key, "line", F.explode(found).alias("command"))


def control_lines(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, controls): the distinct control characters of a line other than tabs, as `U+XXXX`, where it has any."""
    some = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
    lines = _lines(rows, key, F.col(text)).where(F.col("_line").rlike(some))
    found = F.array_distinct(F.regexp_extract_all("_line", F.lit(f"({some})"), F.lit(1)))
    code = lambda x: F.concat(F.lit("U+"), F.lpad(F.hex(F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")), 4, "0"))
    return lines.select(key, "line", F.transform(found, code).alias("controls"))


def math_lines(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """F8: (key, tex, display, lo, hi): each `$…$` and `$$…$$` outside code and image names, with its first and last line. key names one text; a repeated row is one text.

    A text is cut into math and what lies between; the lines before a piece are a running sum over the text's pieces.
    """
    whole = rows.select(key, blanked(F.col(text), NO_MATH).alias("_text")).distinct()
    pieces = whole.select(key, F.posexplode(F.regexp_extract_all("_text", F.lit(rf"(?s)({MATH}|[^$]+|\$)"), F.lit(1))).alias("_at", "_x"))
    n = F.length("_x") - F.length(F.replace("_x", F.lit("\n"), F.lit("")))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.withColumn("_n", n).withColumn("lo", (F.coalesce(before, F.lit(0)) + 1).cast("int"))
    pieces = pieces.where(F.startswith("_x", F.lit("$")) & (F.length("_x") > 1)).withColumn("display", F.startswith("_x", F.lit("$$")))
    cut = F.when(F.col("display"), F.substring("_x", F.lit(3), F.length("_x") - 4)).otherwise(F.substring("_x", F.lit(2), F.length("_x") - 2))
    return pieces.select(key, cut.alias("tex"), "display", "lo", (F.col("lo") + F.col("_n")).cast("int").alias("hi"))
