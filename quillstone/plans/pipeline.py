"""The extraction pipeline as one plan: files to pages, words, answers, clean headers, and admitted rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.config import Settings
from quillstone.operators import layout, postprocess, store
from quillstone.operators.extract import from_answers, with_fallback
from quillstone.session import materialise
from quillstone.sources import backends, files


@dataclass
class Stages:
    """Frames of a run; ``errors`` has a row for everything that failed, by stage."""

    files: DataFrame
    pages: DataFrame
    words: DataFrame
    headers: DataFrame
    errors: DataFrame


@dataclass(frozen=True)
class Choice:
    """Backends and switches of a run."""

    pdf: str = "pymupdf"
    image: Callable = backends.prepare_image
    ocr: backends.Backend | None = None
    qa: backends.Backend | None = None
    fallback: bool = True
    strict_patterns: bool = False
    #: Dates that no format fits go to the fuzzy parser, which takes missing parts from this day (today if not given).
    fuzzy_dates: bool = True
    default_date: dt.date | None = None
    extensions: tuple[str, ...] = field(default=files.EXTENSIONS)


def extract(spark: SparkSession, path: str, settings: Settings | None = None, choice: Choice | None = None, recursive: bool = False, keep: Callable[[DataFrame], DataFrame] = materialise) -> Stages:
    """All stages over a file or folder.

    ``keep`` is applied after the model stages, whose results are costly and
    need not be the same twice: by default they are stored in the shared
    checkpoint folder, so a model sees a page once, whatever reads its result.
    Pixels are dropped before anything is shuffled, but for a question
    answering model that looks at them.
    """
    settings, choice = settings or Settings(), choice or Choice()
    ocr = choice.ocr or backends.OCR.resolve(settings.get("ocr.engine", "tesseract"))
    qa = choice.qa
    loaded = files.load(spark, path, choice.extensions, recursive)
    pages = keep(backends.render_pages(loaded, settings, choice.pdf, choice.image))
    good = pages.where("success")
    read = keep(backends.recognise(good, ocr, settings))
    words = layout.words_from_engine(backends.engine_arrays(read), ["path", "page_idx"])
    text = layout.page_text(words, ["path", "page_idx"]).select("path", "page_idx", F.col("text").alias("ocr_text"))
    if qa is not None:
        # a page's text is small beside its pixels, so the text is what moves where its size allows
        asked = good.select("path", "page_idx", "image").join(text.withColumnRenamed("ocr_text", "text"), ["path", "page_idx"], "left")
        answers = keep(backends.answer(asked, qa, settings))
    else:
        nothing = F.lit(None).cast("map<string,struct<question:string,answer:string,confidence:double>>")
        answers = read.select("path", "page_idx", nothing.alias("answers"), F.lit(0.0).alias("processing_time"), "success", "error")
    rows = from_answers(answers.join(text, ["path", "page_idx"], "left"))
    if choice.fallback:
        rows = with_fallback(rows, "ocr_text", choice.strict_patterns)
    rows = rows.withColumn("source_file", F.col("path")).withColumn("model_name", F.lit(qa.name if qa else "patterns"))
    rows = rows.withColumn("errors", F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("extraction_timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    get = settings.get
    headers = postprocess.postprocess(
        rows,
        tuple(get("postprocessing.validation.required_fields", [])),
        get("postprocessing.validation.confidence_threshold", 0.5),
        get("postprocessing.validation.flag_missing", True),
        (choice.default_date or dt.date.today()) if choice.fuzzy_dates else None,
    )
    failed = lambda df, stage: df.where("not success").select("path", F.lit(stage).alias("stage"), "error")
    errors = failed(loaded, "load").unionByName(failed(pages, "render")).unionByName(failed(read, "recognise")).unionByName(failed(answers, "answer"))
    return Stages(loaded, pages, words, headers, errors)


def admitted(headers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Headers as rows of the store that may enter it, in the order of their files and pages."""
    rows = store.to_stored(headers)
    return store.admit(rows, ["source_file", "invoice_number"], existing)
