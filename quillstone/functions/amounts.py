"""Amounts: normalisation to text with two decimals, extraction and predicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.functions.text import bind, col

#: Patterns of amounts inside text, in the order in which they are tried.
IN_TEXT = (
    r"(?i)[\$€£¥₹]?\s*[\d,]+\.?\d*",
    r"(?i)[\d,]+\.?\d*\s*(?:USD|EUR|GBP|INR)?",
)
NUMBER = r"^-?(\d+\.?\d*|\.\d+)$"


def clean_amount(c: str | Column) -> Column:
    """Only digits, commas, points and minus signs: symbols, codes and prefixes hold none of them."""
    return F.regexp_replace(col(c), r"[^\d,.\-]", "")


def plain_number(c: str | Column) -> Column:
    """Text of a number with a decimal point.  One comma before one or two last digits, after any point, is decimal."""
    s = clean_amount(c)
    # points go and the comma becomes one, or only the commas go
    return F.when(s.rlike(r"^[^,]*,\d{1,2}$"), F.translate(s, ",.", ".")).otherwise(F.translate(s, ",", ""))


def normalize_amount(c: str | Column) -> Column:
    """Text with two decimals, else null.

    Ties are rounded to even on the decimal digits; the binary value behind
    more than two decimals may round otherwise, see :func:`strict_amount`.
    """
    return bind(plain_number(c), _two_places)


def _two_places(s: Column) -> Column:
    rounded = F.bround(s.try_cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string")
    large = F.format_string("%.2f", s.try_cast("double"))
    text = F.coalesce(rounded, large)
    signed = F.when(F.startswith(s, F.lit("-")) & ~F.startswith(text, F.lit("-")), F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(s.rlike(NUMBER), signed)


@F.pandas_udf(StringType())
def _two_decimals(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda s: None if s is None else f"{float(s):.2f}").astype(object)


def strict_amount(c: str | Column) -> Column:
    """Like :func:`normalize_amount`, rounding the binary value; an Arrow function for inputs with more decimals."""
    s = plain_number(c)
    return _two_decimals(F.when(s.rlike(NUMBER), s))


def amount_value(c: str | Column) -> Column:
    """The normalised amount as a double, else null."""
    return normalize_amount(c).try_cast("double")


def is_valid_amount(c: str | Column) -> Column:
    return F.coalesce(amount_value(c) >= 0, F.lit(False))


def extract_amount(c: str | Column) -> Column:
    """The first positive amount that a pattern finds in text, else the whole text as one."""
    s = col(c)
    found = [F.get(F.filter(F.transform(F.regexp_extract_all(s, F.lit(p), 0), normalize_amount), lambda x: x.try_cast("double") > 0), F.lit(0)) for p in IN_TEXT]
    return F.coalesce(*found, normalize_amount(s))
