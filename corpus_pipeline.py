"""A training-data pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Language identification drops what it rejects, near-dedup keeps one document
of each group, decontamination drops documents that hold benchmark passages,
secret scans mask secrets in the text, and mixing takes each source to its
target share.  All stages but the last return the columns of ``documents``.

Every stage judges rows, not ids: the first three number the rows first, and
drop those whose number is found wanting.  So rows that share an id, or have
none, are judged each by their own text.

Edge cases, in every stage: a null text, or one without words, has no near copy
and no benchmark passage or secret, but no language either; a null source is a
source; repeated rows are near copies of each other where they have words; very
long texts are whole; ties of near copies go to the smallest id, a null id being
larger than others, and then to the first row; columns beyond those of
``documents`` are handed on by all stages but the last, whatever their names,
except ``__row``, ``__file`` and ``__place``; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, langid, mixing, neardup, queries, secrets
from quillstone.llm.common import join_heavy, materialise, shared_folder, table

#: Rows whose numbers may be broadcast: 8 bytes each, so some MiB.
FEW = 500_000
ROW = "__row"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; texts without letters or of no learned language go."""
    return _by_row(docs, lambda rows: langid.predict(rows, (ROW,)).where("rejected").select(ROW))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8 or more), that of the smallest id."""

    def others(rows: DataFrame) -> DataFrame:
        found = neardup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"))
        groups = materialise(found.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group")).join(rows.select(ROW, "doc_id"), ROW))
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))
        kept = groups.groupBy("group").agg(first[ROW].alias(ROW), F.count("*").alias("rows")).where("rows > 1")
        large = kept.select(F.col(ROW).alias("kept"), "rows", "group")
        return join_heavy(groups, materialise(large), ["group"], "rows", groups.count()).where(F.col(ROW) != F.col("kept")).select(ROW)

    return _by_row(docs, others)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark passage."""
    tests = table(spark, sf_dir, "benchmark")
    return _by_row(docs, lambda rows: decontaminate.decontaminate(rows.select(F.col(ROW).alias("doc_id"), "text"), tests).where("contaminated").select(F.col("doc_id").alias(ROW)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked in the text."""
    return secrets.redact(docs, queries.secret_model(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: how many words of each row the mix takes."""
    return mixing.mix(docs)[1]


def _by_row(docs: DataFrame, unwanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows whose numbers ``unwanted`` finds.

    Up to FEW numbers go to where the texts are; for more, Spark joins by
    shuffling.
    """
    rows = numbered(docs)
    gone = materialise(unwanted(rows).select(ROW))
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row that is the same whenever it is made.

    Rows of a table of files are numbered by their file and their place in it;
    the driver, which lists the files anyway, numbers those.  Other rows are
    stored with their numbers.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    except AnalysisException:
        return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()))
    names = sorted(r[0] for r in placed.select("__file").distinct().collect())
    files = docs.sparkSession.createDataFrame([(n, i << 40) for i, n in enumerate(names)], "__file string, __first long")
    return placed.join(F.broadcast(files), "__file").select(*docs.columns, (F.col("__first") + F.col("__place")).alias(ROW))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
]

#: SQL can't express the models and hashed draws of the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is in the cluster's shared folder, and deleted when it has been read."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{at}/{name}"
    return docs
