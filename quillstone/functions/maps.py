"""Maps: merging with the later value winning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import col


def merge_maps(base: str | Column, over: str | Column) -> Column:
    """All keys of both maps; where both have one, the value of ``over``.  A null map is empty."""
    a, b = col(base), col(over)
    return F.coalesce(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x)), b, a)
