"""Ground truth in JSON (three layouts), CSV and workbooks, as one schema of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.config import FIELDS
from quillstone.errors import ConfigurationError
from quillstone.functions.files import extension
from quillstone.operators.store import with_ids

_RECORD = "struct<source_file:string,filename:string," + ",".join(f"{f}:string" for f in FIELDS) + ">"
_NESTED = "struct<filename:string,source_file:string,fields:struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"


def _flat(r: Column) -> Column:
    return F.struct(F.coalesce(F.nullif(r.source_file, F.lit("")), r.filename).alias("source_file"), *[r[f].alias(f) for f in FIELDS])


def _finish(df: DataFrame) -> DataFrame:
    """Adds idx, the place in the file."""
    return df.select(F.col("idx").cast("long").alias("idx"), "r.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, ``{"records": [...]}``, ``{"invoices": [{"filename", "fields"}]}``, or records by file name."""
    return parse_json(spark.read.text(path, wholetext=True))


def parse_json(text: DataFrame) -> DataFrame:
    """The records of each row's JSON in ``value``."""
    text = text.select("value")
    is_list = F.col("value").rlike(r"^\s*\[")
    top = F.when(~is_list, F.from_json("value", "map<string,string>"))
    parsed = text.select(
        F.when(is_list, F.from_json("value", f"array<{_RECORD}>")).alias("listed"),
        F.from_json(F.try_element_at(top, F.lit("records")), f"array<{_RECORD}>").alias("records"),
        F.from_json(F.try_element_at(top, F.lit("invoices")), f"array<{_NESTED}>").alias("invoices"),
        F.map_entries(F.map_filter(top, lambda k, v: ~F.startswith(k, F.lit("_")) & v.rlike(r"^\s*\{"))).alias("keyed"),
    )
    nested = F.transform("invoices", lambda x: F.struct(F.coalesce(F.nullif(x.source_file, F.lit("")), x.filename).alias("source_file"), *[x.fields[f].alias(f) for f in FIELDS]))
    plain = F.transform(F.coalesce("listed", "records"), _flat)

    def by_name(e: Column) -> Column:
        r = F.from_json(e.value, _RECORD)
        return F.struct(e.key.alias("source_file"), *[r[f].alias(f) for f in FIELDS])

    return _finish(parsed.select(F.posexplode(F.coalesce(plain, nested, F.transform("keyed", by_name))).alias("idx", "r")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header row, all columns text, quotes doubled inside quotes, line breaks allowed in values."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    name = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("source_file", "filename") if c in df.columns] or [F.lit(None).cast("string")])
    r = F.struct(name.alias("source_file"), *[(F.col(f) if f in df.columns else F.lit(None).cast("string")).alias(f) for f in FIELDS])
    numbered = df.select(r.alias("r"), F.monotonically_increasing_id().alias("at"))
    return _finish(with_ids(numbered, ["at"], start=-1).select(F.col("id").alias("idx"), "r"))


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook; its first row names the columns, a blank name being ``col_<place>``."""
    from quillstone.sources.workbook import read_sheet

    rows = read_sheet(path)
    header = [str(h) if h not in (None, "") else f"col_{i}" for i, h in enumerate(rows[0])] if rows else []
    records = [dict(zip(header, r, strict=False)) for r in rows[1:]]
    data = [(i, r.get("source_file") or r.get("filename"), *[None if r.get(f) is None else str(r.get(f)) for f in FIELDS]) for i, r in enumerate(records)]
    return spark.createDataFrame(data, "idx long, source_file string, " + ", ".join(f"{f} string" for f in FIELDS))


def read(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .json, .csv, .xlsx or .xls."""
    suffix = spark.range(1).select(extension(F.lit(path))).first()[0]
    reader = {".json": read_json, ".csv": read_csv, ".xlsx": read_workbook, ".xls": read_workbook}.get(suffix)
    if reader is None:
        raise ConfigurationError(f"unsupported ground truth format: {path}")
    return reader(spark, path)


def sample(spark: SparkSession) -> DataFrame:
    """A few records to start a ground truth file from."""
    rows = [(i, f"sample_invoice_{i + 1:03}.pdf", f"INV-2024-{i + 1:03}", f"2024-01-{10 + i}", "Example Supplies Ltd", "Sample Trading Inc", f"{1000 + 50 * i}.00", f"2024-02-{10 + i}") for i in range(3)]
    return spark.createDataFrame(rows, "idx long, source_file string, " + ", ".join(f"{f} string" for f in FIELDS))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record a line, in the flat layout."""
    df.orderBy("idx").drop("idx").write.json(path)
