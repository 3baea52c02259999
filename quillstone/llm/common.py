"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank characters that separate words: space and the controls 0x09-0x0D.
BLANK = r"[\x20\x09-\x0D]+"


def blank_ends(text: Column) -> tuple[Column, Column]:
    """1 where a text that is not empty begins with a blank, and where it ends with one: so many empty words has its split by BLANK."""
    of = lambda c: F.when((text != "") & (F.instr(F.lit("\x20\x09\x0a\x0b\x0c\x0d"), c) > 0), 1).otherwise(0)
    return of(F.left(text, F.lit(1))), of(F.right(text, F.lit(1)))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one is made only where none is named and all runs on this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillstone-"))
    return (named or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and read it back.

    A lost executor costs nothing that was written, and lineage ends here.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The same for tables with texts, as compressed Parquet in the shared folder, and its path, for :func:`discard` once it was read."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def discard(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that are joined by broadcast at most, 3 MB of them, and rows of a key that never need it.
HEAVY_KEYS = 100_000
LIGHT_ROWS = 1000


def join_heavy(big: DataFrame, small: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join where one key may hold any share of ``big``.

    ``small`` has one row a key, which says in ``rows`` how many rows of
    ``big`` have it, ``total`` in all.  At most HEAVY_KEYS keys can have more
    than total / HEAVY_KEYS rows, whatever the tables: those meet their rows
    where these are, by broadcast, and only the others are shuffled.
    """
    if total <= LIGHT_ROWS:
        return big.join(small, keys)
    most = max(LIGHT_ROWS, total // HEAVY_KEYS)
    heavy = small.where(F.col(rows) > most)
    light = big.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(small.where(F.col(rows) <= most), keys)
    return big.join(F.broadcast(heavy), keys).unionByName(light)


#: Bytes that cross to Python together, so that long texts don't add up in a batch.
ARROW_BYTES = 8 << 20
_ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes; a smaller bound of the session stays."""
    conf = df.sparkSession.conf
    now = conf.get(_ARROW_CONF).rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        conf.set(_ARROW_CONF, str(ARROW_BYTES))
    return df.mapInArrow(function, schema)


def held_out(doc_id: str | Column, buckets: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``, equals ``rest`` (false for null ids)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % buckets == rest, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
