"""Streams into the store: arrivals are admitted batch by batch, each batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.store import admit


def files_stream(spark: SparkSession, path: str, glob: str = "*.{pdf,png,jpg,jpeg,tiff,bmp}", per_batch: int = 1000) -> DataFrame:
    """New files of a folder with their content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(path)


def admit_batch(table: str, order: list[str], number: str = "invoice_number", vendor: str = "vendor_name"):
    """A ``foreachBatch`` function: rows that may enter go to ``table`` under ``batch=<id>``.

    A batch that is tried again overwrites its own folder and is not counted
    as already stored, so a failure between write and commit changes nothing.
    """

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        existing = spark.read.parquet(table).where(F.col("batch") != batch).drop("batch") if there else None
        rows = rows.persist()
        try:
            admit(rows, order, existing, number, vendor).write.mode("overwrite").parquet(f"{table}/batch={batch}")
        finally:
            rows.unpersist()

    return run


def start(rows: DataFrame, table: str, checkpoint: str, order: list[str], once: bool = True, **names: str) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(admit_batch(table, order, **names)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_arrivals(rows: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Arrivals without repeats of their keys within the time that late rows may take."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def arrival_counts(rows: DataFrame, time: str, group: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Arrivals by window and group; rows later than ``late`` are left out."""
    counted = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), group).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")
