"""Dates: normalisation to ISO text, extraction and predicates.

Explicit formats are tried in order, natively.  Text that none fits can go
through a fuzzy parser, as an Arrow function on the residue alone, with a
given default date so that reruns agree.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.functions.text import bind, col, squeeze

#: What a date may be introduced by, each dropped in turn.
DATE_PREFIXES = ("date:", "dated:", "invoice date:", "due date:", "on")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_FULL = "|".join(MONTHS)
_SHORT = "|".join(m[:3] for m in MONTHS)

_M, _D, _Y = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])", r"((?!0000)\d{4})"

#: Fixed values: (format, pattern, group of year, month, day) in the order in which they are tried.
FORMATS = (
    ("%m/%d/%Y", rf"^{_M}/{_D}/{_Y}$", 3, 1, 2),
    ("%d/%m/%Y", rf"^{_D}/{_M}/{_Y}$", 3, 2, 1),
    ("%Y-%m-%d", rf"^{_Y}-{_M}-{_D}$", 1, 2, 3),
    ("%B %d, %Y", rf"^({_FULL}) {_D}, {_Y}$", 3, 1, 2),
    ("%b %d, %Y", rf"^({_SHORT}) {_D}, {_Y}$", 3, 1, 2),
    ("%d %B %Y", rf"^{_D} ({_FULL}) {_Y}$", 3, 2, 1),
    ("%d-%m-%Y", rf"^{_D}-{_M}-{_Y}$", 3, 2, 1),
    ("%m-%d-%Y", rf"^{_M}-{_D}-{_Y}$", 3, 1, 2),
    ("%d.%m.%Y", rf"^{_D}\.{_M}\.{_Y}$", 3, 2, 1),
)
#: Frequent forms that would otherwise go to the fuzzy parser, with the result that it gives.
MORE_FORMATS = (
    ("%d %b %Y", rf"^{_D} ({_SHORT}) {_Y}$", 3, 2, 1),
    ("%b %d %Y", rf"^({_FULL}|{_SHORT}) {_D} {_Y}$", 3, 1, 2),
    ("ISO", rf"^{_Y}-{_M}-{_D}[T ]\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?$", 1, 2, 3),
)
#: Patterns of dates inside text, in the order in which they are tried.
IN_TEXT = (
    r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b",
    r"\b(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})\b",
    r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{2,4})\b",
    r"\b(\d{1,2})(?:st|nd|rd|th)?\s+((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*)\s+(\d{2,4})\b",
)


def clean_date(c: str | Column) -> Column:
    """Squeezed, without introducing prefixes and without st, nd, rd, th after digits."""
    # each prefix may go once, in this order, with the blank after it; possessive, as none is given back
    lead = "".join(rf"(?:{p} ?)?+" for p in DATE_PREFIXES)
    return F.btrim(F.regexp_replace(F.regexp_replace(squeeze(c), f"(?i)^{lead}", ""), r"(?i)(\d+)(st|nd|rd|th)", "$1"))


def _month(c: Column) -> Column:
    """Month number of digits or of a name's first three letters."""
    at = F.instr(F.lit("".join(m[:3].lower() for m in MONTHS)), F.lower(F.substring(c, 1, 3)))
    return F.when(c.rlike(r"^\d"), F.lpad(c, 2, "0")).otherwise(F.lpad(F.floor((at + 2) / 3).cast("string"), 2, "0"))


def _parsed(s: Column, pattern: str, year: int, month: int, day: int) -> Column:
    part = lambda g: F.regexp_extract(s, f"(?i){pattern}", g)
    # failed conversions are slow, so only text that fits is converted; days like 30 February remain
    return F.when(part(year) != "", F.try_to_date(F.concat_ws("-", part(year), _month(part(month)), F.lpad(part(day), 2, "0")), "yyyy-MM-dd"))


def explicit_date(s: Column, formats: tuple = FORMATS) -> Column:
    """The date of the first format that fits cleaned text."""
    return F.coalesce(*[_parsed(s, *f[1:]) for f in formats])


def normalize_date(c: str | Column, more: bool = False) -> Column:
    """ISO text of a date in one of the formats, else null; ``more`` adds :data:`MORE_FORMATS`."""
    formats = FORMATS + MORE_FORMATS if more else FORMATS
    return bind(clean_date(c), lambda s: F.date_format(explicit_date(s, formats), "yyyy-MM-dd"))


def fuzzy_date(default: dt.date):
    """An Arrow function from cleaned text to ISO text: month first, then day first, missing parts from ``default``."""

    @F.pandas_udf(StringType())
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from dateutil import parser

        base = dt.datetime(default.year, default.month, default.day)

        def one(s: str | None) -> str | None:
            if not s:
                return None
            for day_first in (False, True):
                try:
                    return parser.parse(s, dayfirst=day_first, fuzzy=True, default=base).strftime("%Y-%m-%d")
                except (ValueError, OverflowError, TypeError):
                    continue
            return None

        for batch in batches:
            yield batch.map(one, na_action="ignore").astype(object).where(lambda s: s.notna(), None)

    return parse


def with_normalized_date(df: DataFrame, source: str, target: str, default: dt.date | None = None) -> DataFrame:
    """Adds ``target``.  With ``default``, text that no format fits goes to the fuzzy parser; other rows send it a null."""
    native = normalize_date(source, more=True)
    if default is None:
        return df.withColumn(target, native)
    residue = F.when(native.isNull() & F.col(source).isNotNull(), clean_date(source))
    return df.withColumn(target, native).withColumn(target, F.coalesce(F.col(target), fuzzy_date(default)(residue)))


def extract_date(c: str | Column, more: bool = False) -> Column:
    """The first date that a pattern finds in text and that can be read, else the whole text as one."""
    s = col(c)
    tried = F.array(*[F.regexp_extract(s, f"(?i){p}", 0) for p in IN_TEXT], s)
    return F.get(F.filter(F.transform(tried, lambda x: normalize_date(x, more)), lambda x: x.isNotNull()), F.lit(0))


def with_extracted_date(df: DataFrame, source: str, target: str, default: dt.date | None = None) -> DataFrame:
    """Adds ``target``, the date found in text.  With ``default``, text that gives none goes whole to the fuzzy parser."""
    found = df.withColumn(target, extract_date(source, more=True))
    if default is None:
        return found
    return found.withColumn(target, F.coalesce(F.col(target), fuzzy_date(default)(F.when(F.col(target).isNull(), clean_date(source)))))


def is_valid_date(c: str | Column) -> Column:
    return normalize_date(c).isNotNull()


def strict_iso(c: str | Column) -> Column:
    """The date of ``yyyy-M-d`` text, else null."""
    return _parsed(col(c), FORMATS[2][1], 1, 2, 3)


def is_future(c: str | Column, as_of: Column | None = None) -> Column:
    now = F.current_timestamp() if as_of is None else as_of
    return F.coalesce(strict_iso(c).cast("timestamp") > now, F.lit(False))


def is_past(c: str | Column, as_of: Column | None = None) -> Column:
    now = F.current_timestamp() if as_of is None else as_of
    return F.coalesce(strict_iso(c).cast("timestamp") < now, F.lit(False))
