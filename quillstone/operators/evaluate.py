"""Evaluation against ground truth: lookup by file name, field comparison and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.config import FIELDS
from quillstone.functions.compare import by_kind, exact_match, partial_match, plain
from quillstone.functions.files import basename
from quillstone.functions.text import is_empty


def index(truth: DataFrame, order: str = "idx", name: str = "source_file") -> DataFrame:
    """(key, record): by full name and by base name; the last record with a key wins."""
    return _keys(truth, order, name).join(truth.select(F.col(order).alias("__at"), F.struct(*truth.columns).alias("record")), F.col("place") == F.col("__at")).select("key", "record")


def _keys(truth: DataFrame, order: str, name: str) -> DataFrame:
    """(key, place) of the last record with each key."""
    keys = truth.where(~is_empty(name)).select(F.explode(F.array_distinct(F.array(F.col(name), basename(name)))).alias("key"), F.col(order).alias("place"))
    return keys.groupBy("key").agg(F.max("place").alias("place"))


def lookup(predictions: DataFrame, truth: DataFrame, order: str = "idx", name: str = "source_file", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Each prediction with ``gt_<field>`` of its record: by its full name, else its base name, else empty.

    Names are joined to places, and the record of a place is fetched once.
    Spark picks the joins: a side is broadcast where its measured size allows.
    """
    by_key = _keys(truth, order, name)
    full = by_key.select(F.col("key").alias("__full"), F.col("place").alias("__a"))
    base = by_key.select(F.col("key").alias("__base"), F.col("place").alias("__b"))
    found = predictions.withColumn("__name", basename(name)).join(full, F.col(name) == F.col("__full"), "left").join(base, F.col("__name") == F.col("__base"), "left")
    records = truth.select(F.col(order).alias("__at"), F.struct(*fields).alias("__record"))
    joined = found.join(records, F.coalesce("__a", "__b") == F.col("__at"), "left")
    record = F.col("__record")
    return joined.select(*[F.col(c) for c in predictions.columns], *[F.coalesce(record[f], F.lit("")).alias(f"gt_{f}") for f in fields], record.isNotNull().alias("gt_found"))


def by_index(truth: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """The record at a place; none for places that do not exist."""
    return truth.where(F.col(order) == n)


def completeness(truth: DataFrame, required: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row: total, valid and invalid records, and how often each field is missing."""
    bad = None
    for f in required:
        bad = is_empty(f) if bad is None else bad | is_empty(f)
    return truth.agg(F.count("*").alias("total_records"), F.count_if(~bad).alias("valid_records"), F.count_if(bad).alias("invalid_records"), *[F.count_if(is_empty(f)).alias(f"missing_{f}") for f in required])


def compared(pairs: DataFrame, keys: list[str], threshold: float = 0.8, fields: tuple[str, ...] = FIELDS, case_sensitive: bool = False, squeeze_blanks: bool = True) -> DataFrame:
    """One row a field: predicted and true value, confidence, extracted, exact and partial match."""
    parts = []
    for f in fields:
        conf = F.coalesce(F.col(f"{f}_confidence"), F.lit(0.0)) if f"{f}_confidence" in pairs.columns else F.lit(0.0)
        parts.append(F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("")).alias("predicted"), F.coalesce(f"gt_{f}", F.lit("")).alias("truth"), conf.alias("confidence")))
    # raw values first, so that the comparison stands once in the code, whatever the number of fields
    rows = pairs.select(*keys, F.explode(F.array(*parts)).alias("c")).select(*keys, "c.*")
    rows = rows.withColumns({"__p": plain("predicted", case_sensitive, squeeze_blanks), "__t": plain("truth", case_sensitive, squeeze_blanks)})
    rows = rows.withColumns({c: by_kind(F.col("field"), F.col(c)) for c in ("__p", "__t")})
    p, t = F.col("__p"), F.col("__t")
    return rows.select(*keys, "field", "predicted", "truth", "confidence", (~is_empty("predicted")).alias("extracted"), exact_match("truth", p, t).alias("exact"), partial_match("truth", p, t, threshold).alias("partial"))


def confidences(pairs: DataFrame, order: str = "idx", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, place, confidence) alone, for running confidence without comparing anything."""
    each = [F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f"{f}_confidence"), F.lit(0.0)) if f"{f}_confidence" in pairs.columns else F.lit(0.0)).alias("confidence")) for f in fields]
    return pairs.select(order, F.explode(F.array(*each)).alias("c")).select("c.field", order, "c.confidence")


def field_metrics(rows: DataFrame, order: str = "idx", scores: DataFrame | None = None) -> DataFrame:
    """Counts and rates by field.  Matches count only where something was extracted; rates are of all samples.

    ``scores``, as :func:`confidences` gives them, spares a second comparison.
    """
    hit = lambda c: F.count_if(F.col(c) & F.col("extracted"))
    n = F.count("*")
    counted = rows.groupBy("field").agg(n.alias("total_samples"), F.count_if("extracted").alias("extracted_count"), F.count_if(~F.col("extracted")).alias("missing_count"), hit("exact").alias("correct_count"), hit("partial").alias("partial_match_count"))
    rate = lambda c: F.col(c) / F.col("total_samples")
    counted = counted.withColumns({"extraction_rate": rate("extracted_count"), "missing_rate": rate("missing_count"), "accuracy": rate("correct_count"), "partial_accuracy": rate("partial_match_count")})
    return counted.join(running_confidence(rows if scores is None else scores, order), "field", "left").withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(0.0)))


def running_confidence(rows: DataFrame, order: str = "idx") -> DataFrame:
    """(field, avg_confidence) of the rule avg = (avg * i + c) / (i + 1), applied in order where c > 0.

    A row with c = 0 leaves the average as it is, so this is no mean: solved
    for the end, a score at place i weighs 1 / (i + 1) times the product of
    j / (j + 1) over the later scored places.  The logarithms of those factors
    are summed, so no list of a field's rows is ever gathered.
    """
    # rows without a score weigh 0 and pass the average on, so fields without any score still have a row
    scored = rows.select("field", F.col(order).cast("long").alias("i"), F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(0.0).alias("confidence"))
    # prefix sums by block of places and then over the blocks; a field is no single task
    block = F.floor(F.col("i") / 8192)
    scored = scored.withColumn("block", block).withColumn("log", F.when((F.col("i") > 0) & (F.col("confidence") > 0), F.log(F.col("i") / (F.col("i") + 1))).otherwise(F.lit(0.0)))
    after = Window.partitionBy("field", "block").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("field").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # place 0 would forget what came before it, which is nothing
    inner = scored.withColumn("tail", F.coalesce(F.sum("log").over(after), F.lit(0.0)))
    blocks = inner.groupBy("field", "block").agg(F.sum("log").alias("sum"), F.sum(F.col("confidence") / (F.col("i") + 1) * F.exp("tail")).alias("part"))
    ends = blocks.withColumn("tail", F.coalesce(F.sum("sum").over(later), F.lit(0.0)))
    return ends.groupBy("field").agg(F.sum(F.col("part") * F.exp("tail")).alias("avg_confidence"))


def overall(metrics: DataFrame) -> DataFrame:
    """Unweighted means over the fields."""
    return metrics.agg(F.avg("accuracy").alias("overall_accuracy"), F.avg("extraction_rate").alias("overall_extraction_rate"), F.avg("avg_confidence").alias("avg_confidence"), F.coalesce(F.max("total_samples"), F.lit(0)).alias("total_samples"))


def evaluate(predictions: DataFrame, truth: DataFrame, order: str = "idx", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(field metrics, overall) of predictions looked up by file name."""
    metrics = field_metrics(compared(lookup(predictions, truth, order), [order], threshold), order, confidences(predictions, order))
    return metrics, overall(metrics)


def zipped(predictions: DataFrame, truth: DataFrame, order: str = "idx", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Predictions and truth by place; both must have as many rows."""
    a, b = predictions.count(), truth.count()
    if a != b:
        raise ValueError(f"predictions ({a}) and ground truth ({b}) differ in length")
    return predictions.join(truth.select(order, *[F.coalesce(f, F.lit("")).alias(f"gt_{f}") for f in fields]), order)


def band(c: str) -> Column:
    return F.when(F.col(c) >= 0.9, "good").when(F.col(c) >= 0.7, "medium").otherwise("poor")
