"""Words, lines and boxes of recognised pages.

The working form is one row a word; pages and lines are groups of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import col, strip

PAGE = ["page_id"]


def words_from_engine(df: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One row a word from parallel arrays text, left, top, width, height, conf and line_num.

    Blank text and boxes without area are skipped, negative confidence is 0,
    and words are numbered densely in the order of the arrays.
    """
    names = [c for c in ("text", "left", "top", "width", "height", "conf", "block_num", "par_num", "line_num") if c in df.columns]
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("pos", "w")).select(*keys, "pos", *[F.col(f"w.{n}").alias(n) for n in names])
    rows = rows.where((F.coalesce(strip("text"), F.lit("")) != "") & (F.col("width") > 0) & (F.col("height") > 0))
    more = [F.col(c).cast("int").alias(c) for c in ("block_num", "par_num") if c in names]
    return rows.select(
        *keys,
        (F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1).alias("word_index"),
        strip("text").alias("text"),
        F.col("left").cast("int").alias("x1"),
        F.col("top").cast("int").alias("y1"),
        (F.col("left") + F.col("width")).cast("int").alias("x2"),
        (F.col("top") + F.col("height")).cast("int").alias("y2"),
        F.greatest(F.col("conf").cast("double"), F.lit(0.0)).alias("confidence"),
        F.col("line_num").cast("int").alias("line_index"),
        *more,
    )


def quad_box(quad: str | Column) -> Column:
    """The upright box around a list of points (x, y)."""
    q = col(quad)
    x, y = F.transform(q, lambda p: F.get(p, F.lit(0))), F.transform(q, lambda p: F.get(p, F.lit(1)))
    as_int = lambda c: c.cast("int")
    return F.struct(as_int(F.array_min(x)).alias("x1"), as_int(F.array_min(y)).alias("y1"), as_int(F.array_max(x)).alias("x2"), as_int(F.array_max(y)).alias("y2"))


def width(b: str = "") -> Column:
    return F.col(f"{b}x2") - F.col(f"{b}x1")


def height(b: str = "") -> Column:
    return F.col(f"{b}y2") - F.col(f"{b}y1")


def center(b: str = "") -> Column:
    """Middle of a box, rounded down."""
    mid = lambda p, q: F.floor((F.col(f"{b}{p}") + F.col(f"{b}{q}")) / 2).cast("int")
    return F.struct(mid("x1", "x2").alias("x"), mid("y1", "y2").alias("y"))


def normalized(value: str | Column, size: str | Column, scale: int = 1000) -> Column:
    """A coordinate scaled to 0..scale; unchanged where the page has no size."""
    v, n = col(value), col(size)
    return F.when(n > 0, F.greatest(F.lit(0), F.least(F.lit(scale), (v * scale / n).cast("int")))).otherwise(v)


def normalize_boxes(words: DataFrame, width_col: str = "image_width", height_col: str = "image_height", scale: int = 1000) -> DataFrame:
    """Adds nx1, ny1, nx2, ny2."""
    both = (F.col(width_col) > 0) & (F.col(height_col) > 0)
    of = lambda c, n: F.when(both, normalized(c, n, scale))
    return words.withColumns({"nx1": of("x1", width_col), "ny1": of("y1", height_col), "nx2": of("x2", width_col), "ny2": of("y2", height_col)})


def lines(words: DataFrame, keys: list[str] = PAGE, by_block: bool = False) -> DataFrame:
    """One row a line: its words from left to right as text, mean confidence, box and number of words.

    Words of one line number belong together on the whole page, unless
    ``by_block`` also tells blocks and paragraphs apart.
    """
    group = [*keys, *(["block_num", "par_num"] if by_block else []), "line_index"]
    inner = F.array_sort(F.collect_list(F.struct("x1", "word_index", "text")))
    return words.groupBy(*group).agg(
        F.array_join(F.transform(inner, lambda w: w.text), " ").alias("text"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
        F.min("x1").alias("x1"),
        F.min("y1").alias("y1"),
        F.max("x2").alias("x2"),
        F.max("y2").alias("y2"),
        F.count("*").alias("word_count"),
    )


def page_text(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One row a page: text of its lines, numbers of words and lines, and mean confidence."""
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "x1", "word_index", "text")))
    rows = words.groupBy(*keys, "line_index").agg(F.array_join(F.transform(ordered, lambda w: w.text), " ").alias("line"), F.sum("confidence").alias("conf"), F.count("*").alias("n"))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda x: x.line), "\n").alias("text"),
        F.sum("n").alias("word_count"),
        F.count("*").alias("line_count"),
        (F.sum("conf") / F.sum("n")).alias("average_confidence"),
    )


def confident(words: DataFrame, threshold: float) -> DataFrame:
    return words.where(F.col("confidence") >= threshold)


def model_input(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Parallel lists of words and normalised boxes, in the order of the words; unknown boxes are zeros."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    w = F.array_sort(F.collect_list(F.struct("word_index", "text", F.array(*[zero(c) for c in ("nx1", "ny1", "nx2", "ny2")]).alias("box"))))
    rows = words.groupBy(*keys).agg(w.alias("w"))
    return rows.select(*keys, F.transform("w", lambda x: x.text).alias("words"), F.transform("w", lambda x: x.box).alias("boxes"))


def nested(words: DataFrame, keys: list[str] = PAGE, pages: DataFrame | None = None) -> DataFrame:
    """One row a page with its words as an array of structs, and whether it is empty.

    Pages without words only have a row where ``pages`` names them.
    """
    fields = [c for c in words.columns if c not in keys]
    first = ["word_index", *[c for c in fields if c != "word_index"]]
    rows = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*first))).alias("words"))
    if pages is not None:
        kind = rows.schema["words"].dataType
        rows = pages.select(*keys).distinct().join(rows, keys, "left").withColumn("words", F.coalesce("words", F.array().cast(kind)))
    return rows.withColumn("is_empty", F.size("words") == 0)


def serialised(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One row a page: its text, counts, mean confidence, words and lines as JSON.  A page without words has no row."""
    word = F.struct("word_index", "text", F.struct("x1", "y1", "x2", "y2").alias("bbox"), "confidence", "line_index")
    line = F.struct("line_index", "text", F.struct("x1", "y1", "x2", "y2").alias("bbox"), "average_confidence", "word_count")
    of = lambda df, s, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(s)).alias(name))
    pages = page_text(words, keys).join(of(words, word, "words"), keys).join(of(lines(words, keys), line, "lines"), keys)
    return pages.select(*keys, F.to_json(F.struct("text", "word_count", "line_count", "average_confidence", "words", "lines")).alias("json"))


def resized(w: str | Column, h: str | Column, max_w: int = 2480, max_h: int = 3508) -> Column:
    """Size after shrinking to the limits with the aspect kept, rounded down; never larger."""
    w, h = col(w), col(h)
    ratio = F.least(F.lit(float(max_w)) / w, F.lit(float(max_h)) / h)
    fits = (w <= max_w) & (h <= max_h)
    return F.struct(F.when(fits, w).otherwise(F.floor(w * ratio)).cast("int").alias("width"), F.when(fits, h).otherwise(F.floor(h * ratio)).cast("int").alias("height"))


def too_small(w: str | Column, h: str | Column, min_w: int = 500, min_h: int = 500) -> Column:
    return (col(w) < min_w) | (col(h) < min_h)
