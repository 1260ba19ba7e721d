"""A training corpus from raw documents: quality, line dedup, near duplicates, decontamination, token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_fm
from folioflow.llm.common import packed, remove, shared_dir, table
from folioflow.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones among docs, predicts bad.

    Null and empty texts are scored like others, as empty; without labels every score is 0.5 and all rows stay.
    Rows that repeat and rows without an id are judged each for itself.
    """
    model = quality_fm.fit_quality(docs, table(spark, sf_dir, "labels"))
    return packed(quality_fm.score_quality(docs, model).where("predicted = 1").select(*COLUMNS), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows; a document all of whose lines go is dropped.

    n_chars is that of what is left, where lines went. Null texts and texts of fewer than three lines stay as they
    are. Rows alike in id and text are one document, so they lose the same lines; null ids come first.
    """
    out = line_dedup.line_dedup(docs).where("n_removed = 0 or n_removed < n_lines")
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return packed(out.select(*COLUMNS), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of similar documents the one with the smallest id, of equal ids that whose text's hash is smallest.

    Rows alike in id and text stay or go together; null and empty texts and rows without an id stay.
    """
    return packed(jaccard_join.keep_first(docs).select(*COLUMNS), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or an edited copy of one. Null and empty texts stay; rows that share only an id are apart."""
    return packed(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left, a row for each row: number and digest of the ids, and digest of the text decoded from them. Null counts as empty: no ids."""
    return packed(bpe.bpe_digests(docs, vocabulary("byte_bpe_50k.json")), docs)


STAGES = [
    ("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark), ("BPE encoding and decoding", tokens)
]

#: SQL can't express the classifier and the vocabulary's merges; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written to the shared folder and read again by the next, then removed. The last one's rows stay there."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
