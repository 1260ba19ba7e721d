"""Readers of records and journals, and the scan of a tree of files. Schemas are fixed and strict."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "v int, ts timestamp, type string, actor string, question string, exercise string, index int, total int, course string, section int, title string, url string, page int, instance string, notes array<struct<id:string>>, removed array<string>, layout boolean"
MANIFEST = "schema_version int, status string, document string, source struct<name:string,path:string,sha256:string,page_count:int>, pages array<struct<number:int,raw_image:string,raw_response:string>>, figures array<struct<asset:string,decision:string>>, issues array<string>"
PUBLISHED = "kind string, chapter struct<id:string,title:string>, documents array<struct<id:string,path:string,role:string>>, files map<string,string>"
REVIEW = "findings array<struct<category:string,location:string,description:string,source_evidence:string,instruction:string>>"
LAYOUT = "pages array<struct<pageNumber:int,width:double,height:double,unit:string,spans:array<struct<offset:int,length:int>>>>, figures array<struct<id:string,caption:string,boundingRegions:array<struct<pageNumber:int,polygon:array<double>>>>>"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record a file; a malformed record fails the read. `path` names the file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.input_file_name())


def unknown_fields(texts: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """Records with top-level fields that the schema doesn't name, which strict readers reject."""
    known = F.array(*[F.lit(f.name) for f in T.StructType.fromDDL(schema).fields])
    extra = F.array_except(F.json_object_keys(text), known)
    return texts.withColumn("unknown", extra).where(F.size("unknown") > 0)


def read_journal(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Events of one JSON line each, with `seq` by line; torn lines are left out; a journal without its header line fails.

    seq is the line's place in its file, empty lines not counted: lines are numbered in the split that they were read
    in, and splits by the lines of those before, so no task sees more of a file than a split.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("mid"),
        F.col("value").alias("line")
    )
    until = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a split
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("before")
    )
    own = F.row_number().over(W.partitionBy("file", "block").orderBy("mid"))
    lines = lines.withColumn("own", own).join(splits, ["file", "block"]).withColumn("seq", (F.col("before") + F.col("own") - 1).cast("long"))
    lines = lines.withColumn("ok", F.expr("try_parse_json(line)").isNotNull())
    heads = lines.where("seq = 0").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("line", "$.layout").isNotNull() & F.col("ok")).alias("good")
    ).first()
    if not heads.n or heads.n != heads.good:
        raise ValueError(f"{path}: a journal has no header")
    events = lines.where("seq > 0 and ok").select("file", "seq", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("e"))
    return events.select("file", "seq", "e.*").where("type is not null")


def first_bytes(paths: DataFrame, n: int = 5) -> DataFrame:
    """(path, head): the first n bytes of each file, and no more of it; for file systems that Arrow knows (file, hdfs, s3, gs)."""

    def run(batches):
        for batch in batches:
            heads = []
            for path in batch.column("path").to_pylist():
                files, at = fs.FileSystem.from_uri(
                    path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
                )
                with files.open_input_stream(at) as f:
                    heads.append(f.read(n))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(heads, pa.binary())], names=["path", "head"])

    return paths.select("path").mapInArrow(run, "path string, head binary")


def discover(spark: SparkSession, root: str, owned: DataFrame | None = None, glob: str = "*.pdf") -> DataFrame:
    """Files under root (path, length, is_pdf, owned): those under a folder of `owned` (path) are marked, not hidden.

    A path meets its own ancestors by equality, so the check is an equi-join at any number of roots. Files are
    listed without their content; is_pdf looks at the first bytes.
    """
    files = spark.read.format("binaryFile").option(
        "recursiveFileLookup", True
    ).option("pathGlobFilter", glob).load(root).select("path", "length")
    heads = first_bytes(files).select("path", (F.decode("head", "ISO-8859-1") == "%PDF-").alias("is_pdf"))
    files = files.join(heads, "path")
    if owned is None:
        return files.withColumn("owned", F.lit(False))
    parts = F.split("path", "/")
    up = files.select(
        "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up")
    )
    held = up.join(
        owned.select(F.regexp_replace("path", "/+$", "").alias("up")).distinct(), "up", "left_semi"
    ).select("path").distinct().withColumn("owned", F.lit(True))
    return files.join(held, "path", "left").withColumn("owned", F.coalesce("owned", F.lit(False)))


def bundle_marker(texts: DataFrame, text: str = "text") -> DataFrame:
    """A2: (…, owned, reason): a manifest of the known version is owned; anything else says why not."""
    version = F.get_json_object(text, "$.schema_version")
    reason = F.when(F.col(text).isNull(), "no manifest").when(
        F.expr(f"try_parse_json({text})").isNull(), "unreadable manifest"
    ).when(F.coalesce(version, F.lit("")) != "3", "unrecognised version")
    return texts.withColumn("reason", reason).withColumn("owned", F.col("reason").isNull())


def list_chapters(paths: DataFrame, depth: int, path: str = "path") -> DataFrame:
    """Chapter folders (those with an index.md) at most `depth` folders down, not inside another chapter, and what is deeper as omitted."""
    roots = paths.where(F.col(path).rlike(r"(^|/)index\.md$")).select(F.regexp_replace(path, r"/?index\.md$", "").alias("root")).distinct()
    parts = F.split("root", "/")
    up = roots.where(F.size(parts) > 1).select(
        "root",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up")
    )
    nested = up.join(roots.select(F.col("root").alias("up")), "up", "left_semi").select("root").distinct()
    return roots.join(nested, "root", "left_anti").withColumn("omitted", F.size(parts) > depth)


def classify(entries: DataFrame) -> DataFrame:
    """Convert, already_converted, resume or blocked, with the reason; rows with an error are blocked, never skipped.

    Wants error, traversal, exists, complete, hash_matches, artefacts_missing, checkpoint (booleans, error string).
    """
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(ok("traversal"), "path leaves the root").when(
            ok("exists") & ~ok("hash_matches"), "source changed"
        )
        .when(ok("exists") & ok("artefacts_missing"), "artefact missing").when(
            ok("exists") & ~ok("complete") & ~ok("checkpoint"), "incomplete output"
        )
    )
    out = entries.withColumn("reason", reason)
    return out.withColumn(
        "classification",
        F.when(F.col("reason").isNotNull(), "blocked").when(
            ok("exists") & ok("complete"), "already_converted"
        ).when(ok("exists") & ok("checkpoint"), "resume").otherwise("convert")
    )
