"""Cleaning of text, names and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as Unicode has them, with the separators 0x1C-0x1F and NEL.
WS = r"[\s\x1C-\x1F\x85\p{Z}]"

#: What a name may be introduced by; the first that fits goes.
NAME_PREFIXES = ("vendor:", "customer:", "bill to:", "ship to:", "from:", "to:")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without blanks at the ends."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")


def squeeze(c: str | Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.btrim(F.regexp_replace(col(c), rf"{WS}+", " "))


def is_empty(c: str | Column) -> Column:
    """Null or without a character."""
    return F.coalesce(col(c), F.lit("")) == ""


def bind(value: Column, make) -> Column:
    """``make(value)`` with the value computed once, however often ``make`` names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def clean_text(c: str | Column) -> Column:
    """Squeezed, and without full stops, commas, semicolons and colons at the ends."""
    return F.btrim(squeeze(c), F.lit(".,;:"))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first and small letters after it."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def clean_name(c: str | Column) -> Column:
    """Squeezed, without one introducing prefix; names of over 5 capitals in title case."""
    bare = F.btrim(F.regexp_replace(squeeze(c), f"(?i)^(?:{'|'.join(NAME_PREFIXES)})", ""))

    def cased(name: Column) -> Column:
        capitals = (name == F.upper(name)) & (name != F.lower(name)) & (F.length(name) > 5)
        return F.when(capitals, title_case(name)).otherwise(name)

    return bind(bare, cased)


def clean_answer(c: str | Column) -> Column:
    """Without blanks, colons, hyphens, full stops and commas at the ends."""
    edge = r"[\s\x1C-\x1F\x85\p{Z}:\-.,]"
    return F.regexp_replace(col(c), rf"^{edge}+|{edge}+\z", "")


def is_scanned(page_text: str | Column, least: int = 50) -> Column:
    """A page with so little text that it must be an image."""
    return F.coalesce(F.length(strip(page_text)), F.lit(0)) < least
