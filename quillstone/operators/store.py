"""The store of header records: admission under a uniqueness rule, search, statistics and deletion.

Admission replays what happens when rows arrive one by one: a row whose number
was stored before, with the same vendor or (if it names no vendor) with any,
is skipped; a row without a number is only kept out by the uniqueness of
(number, vendor).  Two minima by key say the same for whole batches.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.config import FIELDS
from quillstone.functions.text import col
from quillstone.schema import STORED
from quillstone.session import materialise


def admission(df: DataFrame, order: list[str], number: str = "invoice_number", vendor: str = "vendor_name", avoid_duplicates: bool = True) -> DataFrame:
    """Adds ``stored`` (the row is in the table afterwards) and ``counted`` (it is reported as inserted).

    The first row of each (number, vendor), and of each number, is a minimum
    that partitions take before they shuffle, so no key is hot.  Rows that are
    equal in ``order`` are told apart by a number that is stored with them; ties
    go to either.
    """
    rows = materialise(df.withColumn("__tie", F.monotonically_increasing_id()))
    slim = rows.select(F.coalesce(F.col(number).cast("string"), F.lit("")).alias("n"), F.coalesce(F.col(vendor).cast("string"), F.lit("")).alias("v"), F.struct(*order, "__tie").alias("at"))
    pairs = slim.groupBy("n", "v").agg(F.min("at").alias("at"))
    if avoid_duplicates:
        # a row without a number, or with a vendor, only has to be the first of its pair
        free = pairs.where("n = '' or v <> ''")
        bare = pairs.where("n <> ''").groupBy("n").agg(F.min_by(F.struct("v", "at"), "at").alias("f")).where("f.v = ''").select(F.col("f.at").alias("at"))
        first = free.select("at").unionByName(bare)
    else:
        first = pairs.select("at")
    marked = rows.join(first.select(F.col("at.__tie").alias("__tie"), F.lit(True).alias("stored")), "__tie", "left")
    stored = F.coalesce("stored", F.lit(False))
    counted = stored | (F.coalesce(F.col(number).cast("string"), F.lit("")) == "") if avoid_duplicates else F.lit(True)
    return marked.select(*df.columns, stored.alias("stored"), counted.alias("counted"))


def admit(new: DataFrame, order: list[str], existing: DataFrame | None = None, number: str = "invoice_number", vendor: str = "vendor_name") -> DataFrame:
    """The rows of ``new`` that enter a table holding ``existing``: those count as arrived before."""
    if existing is None:
        return admission(new, order, number, vendor).where("stored").drop("stored", "counted")
    old = existing.select(*[F.col(c) if c in existing.columns else F.lit(None).alias(c) for c in new.columns], F.lit(0).alias("__batch"))
    both = old.unionByName(new.withColumn("__batch", F.lit(1)))
    return admission(both, ["__batch", *order], number, vendor).where("stored and __batch = 1").drop("stored", "counted", "__batch")


def admission_counts(df: DataFrame, order: list[str], **names: str) -> DataFrame:
    """One row: rows, stored, inserted and skipped."""
    marked = admission(df, order, **names)
    return marked.agg(F.count("*").alias("rows"), F.count_if("stored").alias("stored"), F.count_if("counted").alias("inserted"), F.count_if(~F.col("counted")).alias("skipped"))


def to_stored(df: DataFrame, created_at: str | Column | None = None) -> DataFrame:
    """Extractions as rows of the store without ``id``: null text is empty, success is 0 or 1."""
    from quillstone.operators.extract import flat

    rows = flat(df).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if created_at is None else col(created_at) if isinstance(created_at, Column) else F.lit(created_at))
    missing = [f for f in STORED.fieldNames() if f not in rows.columns and f != "id"]
    rows = rows.withColumns({f: F.lit(None) for f in missing})
    text = {"source_file", "extraction_timestamp", "model_name", *FIELDS}
    return rows.select(*[(F.coalesce(f.name, F.lit("")) if f.name in text else F.coalesce(F.col(f.name).cast(f.dataType), F.lit(1 if f.name == "success" else 0).cast(f.dataType)) if f.name != "created_at" else F.col(f.name)).alias(f.name) for f in STORED if f.name != "id"])


def with_ids(df: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Adds ``id``, dense in ``order``: ranges are sorted in parallel and offset by the rows before them.

    The sorted rows are stored with their places, as ranges that were made
    twice need not be the same.
    """
    at = F.monotonically_increasing_id()
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
    spread = materialise(spread.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1)))
    sizes = spread.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row a partition
    offsets = F.broadcast(sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")))
    return spread.join(offsets, "__part").withColumn("id", F.lit(start + 1) + F.col("__before") + F.col("__at")).drop("__at", "__part", "__before")


def exists(store: DataFrame, candidates: DataFrame, number: str = "invoice_number", vendor: str = "vendor_name") -> DataFrame:
    """The candidates whose number is stored, with the same vendor where they name one."""
    named = candidates.where(F.coalesce(vendor, F.lit("")) != "").join(store.select(number, vendor).distinct(), [number, vendor], "left_semi")
    unnamed = candidates.where(F.coalesce(vendor, F.lit("")) == "").join(store.select(number).distinct(), number, "left_semi")
    return named.unionByName(unnamed)


def recent(store: DataFrame, limit: int | None = None) -> DataFrame:
    """The latest rows first; no limit, or 0, gives all."""
    rows = store.orderBy(F.desc("id"))
    return rows.limit(limit) if limit else rows


def by_number(store: DataFrame, number: str) -> DataFrame:
    """At most one row, the first that was stored."""
    return store.where(F.col("invoice_number") == number).orderBy("id").limit(1)


def real(c: str | Column) -> Column:
    """The number that text begins with, else 0, as a lenient cast reads it."""
    lead = F.regexp_extract(col(c), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(lead.try_cast("double"), F.lit(0.0))


_CAPITALS, _SMALL = string.ascii_uppercase, string.ascii_lowercase


def like(c: str | Column, pattern: str) -> Column:
    """Whether text fits a pattern with % and _, in any case of A-Z; all other characters stand for themselves."""
    plain = pattern.translate(str.maketrans(_CAPITALS, _SMALL)).replace("\\", "\\\\")
    return F.translate(col(c), _CAPITALS, _SMALL).like(plain)


def search(store: DataFrame, vendor_name: str | None = None, date_from: str | None = None, date_to: str | None = None, min_amount: float | None = None, max_amount: float | None = None, ordered: bool = True) -> DataFrame:
    """Rows that meet all given conditions, the latest invoice date first.

    The vendor may stand anywhere in the name, in any ASCII case, with % and _
    as wildcards; dates are compared as text, amounts as the numbers that the
    text begins with.
    """
    tests = []
    if vendor_name:
        tests.append(like("vendor_name", f"%{vendor_name}%"))
    if date_from:
        tests.append(F.col("invoice_date") >= date_from)
    if date_to:
        tests.append(F.col("invoice_date") <= date_to)
    if min_amount is not None:
        tests.append(real("total_amount") >= min_amount)
    if max_amount is not None:
        tests.append(real("total_amount") <= max_amount)
    found = store.where(reduce(lambda a, b: a & b, tests, F.lit(True)))
    return found.orderBy(F.desc("invoice_date")) if ordered else found


def find(store: DataFrame, invoice_number: str | None = None, vendor_name: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """By number where one is given, else by the other conditions."""
    return by_number(store, invoice_number) if invoice_number else search(store, vendor_name, date_from, date_to)


def statistics(store: DataFrame) -> DataFrame:
    """One row: total_records, success_rate, avg_confidence of successes, unique_vendors; 0 where there is nothing."""
    n = F.count("*")
    return store.agg(
        n.alias("total_records"),
        F.coalesce(F.try_divide(F.count_if(F.col("success") == 1), n), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.when(F.col("success") == 1, F.col("average_confidence"))), F.lit(0.0)).alias("avg_confidence"),
        F.count_distinct("vendor_name").alias("unique_vendors"),
    )


def delete(store: DataFrame, number: str) -> DataFrame:
    """The store without the rows of a number."""
    return store.where(~F.col("invoice_number").eqNullSafe(number))
