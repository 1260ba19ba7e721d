"""Line dedup over overlapping windows of consecutive lines. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own


def once(value: Column, use) -> Column:
    """use(value), where the value is computed once a row, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def repeated_windows(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, pos) of each window of `window` lines that occurs earlier in the table; pos counts from 0.

    Occurrences are ordered by (id, version, pos); version is a hash of the text, so that rows that share an
    id but not a text keep apart. Rows alike in both are one document. Windows of blank lines don't count.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    hashes = F.transform(
        F.split("t", "\n"),
        lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(window), x).alias("b"), (F.trim(x) != "").alias("full"))
    )

    def runs(lines: Column) -> Column:
        at = F.when(F.size(lines) >= window, F.sequence(F.lit(0), F.size(lines) - window)).otherwise(F.array().cast("array<int>"))
        each = lambda i, c: [F.get(lines, i + k)[c] for k in range(window)]
        some = lambda i: reduce(lambda x, y: x | y, each(i, "full"))
        return F.transform(
            at,
            lambda i: F.struct(
                i.alias("pos"), F.xxhash64(*each(i, "a")).alias("h1"), F.xxhash64(*each(i, "b")).alias("h2"), some(i).alias("full")
            )
        )

    occ = base.select("id", F.xxhash64("t").alias("version"), F.explode(once(hashes, runs)).alias("w")).where("w.full")
    occ = occ.select("id", "version", "w.pos", "w.h1", "w.h2")
    first = occ.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "version", "pos")).alias("first")
    ).where("n > 1").drop("n")
    return occ.join(first, ["h1", "h2"]).where(F.struct("id", "version", "pos") > F.col("first")).select("id", "version", "pos")


def line_dedup(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text without the lines of later occurrences, and n_lines and n_removed (replaced if there).

    The covered positions of all later occurrences in a document are merged, so overlapping ones go once; the
    first occurrence of a window stays unless a later occurrence of another window covers it. Null texts stay
    null with 0 lines; an empty text is one empty line; shorter documents than a window stay as they are. A
    document all of whose lines go keeps its row with an empty text. Every other column stays, whatever its name.
    """
    later = repeated_windows(docs, window, id_col, text_col)
    docs = docs.drop("n_lines", "n_removed")
    version, gone_id, gone_version, lost = (own(c, docs) for c in ("_version", "_id", "_of", "_gone"))
    gone = later.select(
        "id", "version", F.explode(F.sequence("pos", F.col("pos") + window - 1)).alias("pos")
    ).groupBy(F.col("id").alias(gone_id), F.col("version").alias(gone_version)).agg(F.collect_set("pos").alias(lost))
    docs = docs.withColumn(version, F.xxhash64(text_col))
    # one row a document on the right: hashed there, the texts need no sort
    out = docs.join(
        gone.hint("shuffle_hash"), docs[id_col].eqNullSafe(gone[gone_id]) & (docs[version] == gone[gone_version]), "left"
    ).drop(gone_id, gone_version, version)
    lines = F.split(F.col(text_col), "\n")
    kept = once(
        lines,
        lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(lost)), lambda i: F.get(x, i)), "\n")
    )
    out = out.withColumns(
        {
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(
                F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
            ),
            "n_removed": F.coalesce(F.size(lost), F.lit(0))
        }
    )
    return out.withColumn(text_col, F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(kept)).drop(lost)
