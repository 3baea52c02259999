"""Post-processing: normalise dates, amounts and text, validate, and flag what is missing, in one projection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import amounts, dates, text
from quillstone.functions.validate import missing_fields, validation

DATES = ("invoice_date", "payment_due_date")
NAMES = ("vendor_name", "customer_name")


def _kept(source: str, made: Column) -> tuple[Column, Column]:
    """The made value or else the original, and a warning where nothing could be made."""
    given = ~text.is_empty(source)
    said = F.when(given & made.isNull(), F.concat(F.lit(f"Could not normalize {source}: "), F.col(source)))
    return F.when(given, F.coalesce(made, F.col(source))).otherwise(F.col(source)), said


def postprocess(
    df: DataFrame,
    required: tuple[str, ...] = ("invoice_number", "total_amount"),
    threshold: float = 0.5,
    flag_missing: bool = True,
    default_date: dt.date | None = None,
) -> DataFrame:
    """The six fields normalised, ``warnings`` extended and ``validation`` added.

    With ``default_date``, dates that no format fits go to the fuzzy parser;
    all other rows pass it a null.
    """
    made: dict[str, Column] = {}
    said: list[Column] = []
    for f in DATES:
        value = F.col(f"__{f}")
        df = dates.with_normalized_date(df, f, f"__{f}", default_date)
        made[f], w = _kept(f, value)
        said.append(w)
    made["total_amount"], w = _kept("total_amount", amounts.normalize_amount("total_amount"))
    said.append(w)
    made["invoice_number"] = text.clean_text("invoice_number")
    made |= {f: text.clean_name(f) for f in NAMES}
    warnings = F.coalesce("warnings", F.array().cast("array<string>")) if "warnings" in df.columns else F.array().cast("array<string>")
    warnings = F.concat(warnings, F.filter(F.array(*said), lambda x: x.isNotNull()))
    columns = [c for c in df.columns if not c.startswith("__")]
    out = df.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns if c != "warnings"], warnings.alias("warnings"))
    scores = "confidence_scores" if "confidence_scores" in columns else None
    out = out.withColumn("validation", validation(required, threshold, scores))
    if flag_missing:
        out = out.withColumn("warnings", F.concat("warnings", F.transform(missing_fields(required), lambda f: F.concat(F.lit("Missing required field: "), f))))
    return out


def summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """How many rows each field changed in, by a join on the key."""
    both = before.alias("a").join(after.alias("b"), key)
    fields = (*DATES, "total_amount", "invoice_number", *NAMES)
    return both.agg(*[F.count_if(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"changed_{f}") for f in fields])
