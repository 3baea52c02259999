"""Input files: listing, validation and loading as rows, with errors as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.config import DEFAULTS
from quillstone.errors import MissingFileError, UnsupportedFileTypeError
from quillstone.functions.files import basename, extension, file_type

EXTENSIONS = tuple(DEFAULTS["input"]["supported_extensions"])


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, is_file) of a file or of a folder's files, by the file system that the path names."""
    at, fs = _hadoop(spark, path)
    if not fs.exists(at):
        raise MissingFileError(path)
    found = []
    it = fs.listFiles(at, recursive) if fs.getFileStatus(at).isDirectory() else None
    if it is None:
        s = fs.getFileStatus(at)
        found.append((s.getPath().toString(), s.getLen(), True))
    while it is not None and it.hasNext():
        s = it.next()
        found.append((s.getPath().toString(), s.getLen(), s.isFile()))
    return spark.createDataFrame(sorted(set(found)), "path string, length long, is_file boolean")


def validated(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Adds filename, file_type and error: a listed file may be of another kind or hold nothing.

    Works on the listing, since a scan drops files without content unseen.
    """
    wrong = F.when(~F.col("is_file"), "not a file").when(~extension("path").isin(*extensions), F.concat(F.lit("unsupported file type: "), extension("path"))).when(F.col("length") == 0, "file is empty")
    return files.select("path", basename("path").alias("filename"), file_type("path").alias("file_type"), "length", wrong.alias("error"))


def enumerate_inputs(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = False) -> DataFrame:
    """The usable files in order.  A single file of another kind is an error; in a folder such files are left out."""
    rows = validated(listing(spark, path, recursive), extensions)
    at, fs = _hadoop(spark, path)
    if fs.getFileStatus(at).isFile() and rows.where("error like 'unsupported%'").take(1):
        raise UnsupportedFileTypeError(path, extensions)
    return rows.where(F.coalesce("error", F.lit("")).rlike("^$|empty")).orderBy("path")


def load(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = False) -> DataFrame:
    """One row a file with its content; files that can't be used are rows with ``success`` false and the reason.

    The scan names and checks its own files, so content meets no join; only
    paths are compared to find what the scan did not give.
    """
    wanted = "*.{" + ",".join(sorted({v for e in extensions for v in (e[1:], e[1:].upper(), e[1:].capitalize())})) + "}"
    scan = spark.read.format("binaryFile").option("pathGlobFilter", wanted).option("recursiveFileLookup", str(recursive).lower()).load(path)
    meta = F.create_map(F.lit("original_filename"), basename("path"), F.lit("file_size_bytes"), F.col("length").cast("string"), F.lit("file_type"), extension("path"))

    def rows(df: DataFrame, when: Column, content: Column, error: Column) -> DataFrame:
        return df.select("path", basename("path").alias("filename"), file_type("path").alias("file_type"), "length", when.alias("modification_time"), content.alias("content"), meta.alias("metadata"), error.isNull().alias("success"), error.alias("error"))

    good = rows(scan, F.col("modificationTime"), F.col("content"), F.lit(None).cast("string"))
    listed = validated(listing(spark, path, recursive), extensions).withColumn("__same", _same(F.col("path")))
    unread = listed.where("error is null").join(scan.select(_same(F.col("path")).alias("__same")), "__same", "left_anti")
    bad = listed.where("error is not null").unionByName(unread.withColumn("error", F.lit("file could not be read")).select(*listed.columns))
    return good.unionByName(rows(bad, F.lit(None).cast("timestamp"), F.lit(None).cast("binary"), F.col("error")))


def _same(path):
    """Paths without the slashes that authorities may or may not add."""
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def quarantine(rows: DataFrame) -> DataFrame:
    """What could not be loaded, without content."""
    return rows.where(~F.col("success")).drop("content")


def first_page(pages: DataFrame) -> DataFrame:
    return pages.where("page_idx = 0")


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages of each file as the backend counted them, else the pages that were rendered; at least 1."""
    told = F.max(F.try_element_at("metadata", F.lit("total_pages")).try_cast("int")) if "metadata" in pages.columns else F.lit(None).cast("int")
    return pages.groupBy("path").agg(F.greatest(F.coalesce(told, F.count("page_idx").cast("int")), F.lit(1)).alias("page_count"))
