"""Comparison of predicted and true values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import bind, col, is_empty, squeeze, strip


def float_text(c: Column) -> Column:
    """Decimal text as Python prints the float: no exponent, at least one decimal, no trailing zeros."""
    plain = c.try_cast("decimal(38,10)").cast("string")
    short = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    return F.regexp_replace(short, r"^(-?)\.", "${1}0.")


def plain(c: str | Column, case_sensitive: bool = False, squeeze_blanks: bool = True) -> Column:
    """The value without blanks at its ends; small letters and single blanks unless told otherwise."""
    s = F.coalesce(col(c), F.lit(""))
    s = s if case_sensitive else F.lower(s)
    return squeeze(s) if squeeze_blanks else strip(s)


def by_kind(field: str | Column, s: Column) -> Column:
    """A plain value as it is compared: amounts as numbers, dates as digits.  The field's name is text, or a column of names."""
    amount = F.translate(F.regexp_replace(s, r"[^\d.,]", ""), ",", ".")
    date = F.regexp_replace(s, r"[^\d]", "")
    if isinstance(field, str):
        return bind(amount, _as_number) if "amount" in field.lower() else date if "date" in field.lower() else s
    name = F.lower(field)
    return F.when(F.contains(name, F.lit("amount")), bind(amount, _as_number)).when(F.contains(name, F.lit("date")), date).otherwise(s)


def _as_number(s: Column) -> Column:
    return F.when(s.rlike(r"^(\d+\.?\d*|\.\d+)$"), F.coalesce(float_text(s), s)).otherwise(s)


def comparable(field: str | Column, c: str | Column, case_sensitive: bool = False, squeeze_blanks: bool = True) -> Column:
    """The value of a field as it is compared."""
    s = plain(c, case_sensitive, squeeze_blanks)
    return by_kind(field, s) if isinstance(field, str) else bind(s, lambda s: by_kind(field, s))


def similarity(a: str | Column, b: str | Column) -> Column:
    """1 - edit distance / longer length; 0 where either is empty."""
    a, b = col(a), col(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(is_empty(a) | is_empty(b), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def exact_match(truth: str | Column, p: Column, t: Column) -> Column:
    """Comparable values are equal, and there is a truth."""
    return ~is_empty(truth) & (p == t)


def partial_match(truth: str | Column, p: Column, t: Column, threshold: float = 0.8) -> Column:
    """Comparable values are equal or similar enough, and there is a truth."""
    return ~is_empty(truth) & ((p == t) | (similarity(p, t) >= threshold))


def match(field: str | Column, predicted: str | Column, truth: str | Column, threshold: float = 0.8, case_sensitive: bool = False, squeeze_blanks: bool = True) -> Column:
    """Struct of exact and partial.  An empty truth matches nothing; an exact match is partial too."""
    both = F.struct(*[comparable(field, x, case_sensitive, squeeze_blanks).alias(n) for n, x in (("p", predicted), ("t", truth))])
    return bind(both, lambda b: F.struct(exact_match(truth, b.p, b.t).alias("exact"), partial_match(truth, b.p, b.t, threshold).alias("partial")))
