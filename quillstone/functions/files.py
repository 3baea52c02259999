"""File names, types and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import col

PDF = (".pdf",)
IMAGES = (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp")
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def basename(c: str | Column) -> Column:
    return F.regexp_extract(F.regexp_replace(col(c), r"/+$", ""), r"[^/]*$", 0)


def extension(c: str | Column) -> Column:
    """The last suffix in small letters; names that begin with their only point have none."""
    return F.lower(F.regexp_extract(basename(c), r"(?s)(?<=.)(\.[^.]+)$", 1))


def file_type(c: str | Column) -> Column:
    e = extension(c)
    return F.when(e.isin(*PDF), "pdf").when(e.isin(*IMAGES), "image")


def safe_filename(c: str | Column, replacement: str = "_") -> Column:
    r"""``< > : " / \ | ? *`` and controls replaced, no spaces or points at the ends, ``unnamed`` if nothing is left."""
    s = F.btrim(F.regexp_replace(col(c), r'[<>:"/\\|?*\x00-\x1F]', replacement), F.lit(". "))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unnamed"))


def format_size(c: str | Column) -> Column:
    """Bytes in steps of 1024 with one decimal."""
    n = col(c).cast("double")
    out = None
    for k, unit in enumerate(UNITS):
        text = F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**k, 1))
        last = k == len(UNITS) - 1
        test = F.lit(True) if last else n < 1024.0 ** (k + 1)
        out = F.when(test, text) if out is None else out.when(test, text)
    return F.when(n.isNotNull(), out)


def timestamp_text(ts: str | Column, pattern: str = "yyyyMMdd_HHmmss") -> Column:
    return F.date_format(col(ts), pattern)
