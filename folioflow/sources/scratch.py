"""Folders: one that lives as long as the driver, and folders that get their name once they are whole."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's URI in spark.checkpoint.dir, which all machines share; where that is unset, a local one, and only for a local master. Removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"{named or 'file:' + tempfile.mkdtemp(prefix='folioflow-')}/scratch-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


class path_in:  # noqa: N801  a helper of the store's own paths
    """A path in whatever store it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.at.getFileSystem(spark._jsc.hadoopConfiguration())

    def there(self) -> bool:
        return self.files.exists(self.at)

    def names(self) -> list[str]:
        """Names in the folder; none if it isn't there."""
        return [s.getPath().getName() for s in self.files.listStatus(self.at)] if self.there() else []

    def remove(self) -> None:
        self.files.delete(self.at, True)

    def rename(self, to: path_in) -> bool:
        to.files.mkdirs(to.at.getParent())
        return self.files.rename(self.at, to.at)


def put_folder(rows: DataFrame, path: str, fmt: str = "json", check: Callable[[DataFrame], None] | None = None, by: list[str] | None = None) -> None:
    """Writes rows beside the path and gives them its name once they are whole; raises where something is there already.

    The staged folder's name begins with a dot, so readers of the parent never see it. check gets what was written and
    may raise; then nothing gets the name. by: columns that name folders within.
    """
    spark = rows.sparkSession
    parent, _, name = path.rstrip("/").rpartition("/")
    staged, target = path_in(spark, f"{parent}/.staged-{uuid.uuid4().hex}"), path_in(spark, path)
    if target.there():
        raise FileExistsError(path)
    try:
        rows.write.format(fmt).partitionBy(*(by or [])).save(staged.at.toString())
        if check:
            check(spark.read.schema(rows.schema).format(fmt).load(staged.at.toString()))
        if target.there() or not staged.rename(target):
            raise FileExistsError(path)
    finally:
        staged.remove()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path_in(spark, folder).remove()
    except Exception:  # the session is gone, and with it the way to the store
        pass
