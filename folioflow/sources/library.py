"""A library of notes, named by folders, by index notes or by files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import visible
from ..operators.links import resolve_links


def library(
    notes: DataFrame, folders: DataFrame | None = None, indexes: DataFrame | None = None, files: DataFrame | None = None, links: DataFrame | None = None
) -> DataFrame:
    """The visible ones of notes (path, id and others) that are named in any of three ways, each once.

    folders (path): all below them; indexes (path): index notes, that is what their links (path, target) resolve to,
    not the index itself; files (path): these. A folder meets the notes' own ancestors by equality, so any number of
    folders, indexes and files may be named, and nested or repeated ones count once. Names of nothing add nothing.
    """
    shown = notes.where(visible(F.col("path")))
    found = []
    if folders is not None:
        parts = F.split("path", "/")
        up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
        named = folders.select(F.regexp_replace("path", "/+$", "").alias("up")).distinct()
        found.append(shown.select("path", F.explode(up).alias("up")).join(named, "up", "left_semi").select("path"))
    if indexes is not None:
        own = links.join(indexes.select("path").distinct(), "path", "left_semi").where("target <> ''")
        found.append(resolve_links(own.select("path", "target"), shown.select("path", "id")).where("status = 'resolved'").select(F.col("to").alias("path")))
        found[-1] = found[-1].join(indexes.select("path"), "path", "left_anti")
    if files is not None:
        found.append(files.select("path"))
    named = found[0]
    for x in found[1:]:
        named = named.unionByName(x)
    return shown.join(named.distinct(), "path", "left_semi")
