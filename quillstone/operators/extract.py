"""Field extraction: answers, regex fallback and the derived properties of an extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.config import FIELDS
from quillstone.functions.text import clean_answer, col, is_empty, strip
from quillstone.schema import EXTRACTION

_DAY = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
#: Fallback patterns by field, in the order in which they are tried.
FALLBACK = {
    "invoice_number": (
        r"Invoice\s*(?:#|No\.?|Number)?\s*[:\s]?\s*([A-Z0-9-]+)",
        r"INV[:\s-]?\s*([A-Z0-9-]+)",
        r"Bill\s*(?:#|No\.?)?\s*[:\s]?\s*([A-Z0-9-]+)",
    ),
    "total_amount": (
        r"Total\s*(?:Amount|Due)?\s*[:\s]?\s*\$?\s*([\d,]+\.?\d*)",
        r"Grand\s*Total\s*[:\s]?\s*\$?\s*([\d,]+\.?\d*)",
        r"Amount\s*Due\s*[:\s]?\s*\$?\s*([\d,]+\.?\d*)",
    ),
    "invoice_date": (
        rf"(?:Invoice\s*)?Date\s*[:\s]?\s*({_DAY})",
        rf"Dated?\s*[:\s]?\s*({_DAY})",
        r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})",
    ),
    "payment_due_date": (
        rf"Due\s*Date\s*[:\s]?\s*({_DAY})",
        rf"Pay(?:ment)?\s*(?:Due\s*)?By\s*[:\s]?\s*({_DAY})",
    ),
}
#: Whole words only, for texts where ``Subtotal`` or ``Invoice Date`` must not answer for something else.
STRICT = {
    "invoice_number": (r"\bInvoice\s*(?:#|No\.?|Number)\s*:?\s*([A-Z0-9][A-Z0-9/-]*)", r"\b(INV[-\s]?[A-Z0-9-]*\d[A-Z0-9-]*)"),
    "total_amount": (r"\b(?:Grand\s+)?Total(?:\s+(?:Amount|Due))*\s*:?\s*\$?\s*([\d,]+\.?\d*)", r"\bAmount\s+Due\s*:?\s*\$?\s*([\d,]+\.?\d*)"),
    "invoice_date": (rf"\b(?<!Due )(?:Invoice\s+)?Dated?\s*:?\s*({_DAY})", FALLBACK["invoice_date"][2]),
    "payment_due_date": (rf"\bDue\s+Date\s*:?\s*({_DAY})", rf"\bPay(?:ment)?\s+(?:Due\s+)?By\s*:?\s*({_DAY})"),
}
FALLBACK_CONFIDENCE = 0.3
#: Fixed value: the warning of a field that a pattern filled, after its name.
FALLBACK_WARNING = "extracted via regex fallback"


def regex_field(field: str, text: str | Column, strict: bool = False) -> Column:
    """What the first pattern with a non-empty group finds; null for fields without patterns."""
    patterns = (STRICT if strict else FALLBACK).get(field, ())
    found = [F.nullif(strip(F.regexp_extract(col(text), f"(?i){p}", 1)), F.lit("")) for p in patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def with_fallback(df: DataFrame, text: str = "ocr_text", strict: bool = False) -> DataFrame:
    """Missing fields filled by patterns, with their confidence and a warning; the other columns as they were."""
    found = {f: F.when(is_empty(f) & ~is_empty(text), regex_field(f, text, strict)) for f in FALLBACK}
    scores = F.map_filter(F.create_map(*[x for f, v in found.items() for x in (F.lit(f), F.when(v.isNotNull(), FALLBACK_CONFIDENCE))]), lambda _, v: v.isNotNull())
    said = F.filter(F.array(*[F.when(v.isNotNull(), F.lit(f"{f} {FALLBACK_WARNING}")) for f, v in found.items()]), lambda x: x.isNotNull())
    old = F.coalesce("confidence_scores", F.create_map().cast("map<string,double>"))
    merged = F.map_zip_with(old, scores, lambda _, a, b: F.coalesce(b, a))
    return df.select(
        *[
            F.coalesce(found[c], F.col(c)).alias(c) if c in found else merged.alias(c) if c == "confidence_scores" else F.concat(F.coalesce("warnings", F.array().cast("array<string>")), said).alias(c) if c == "warnings" else F.col(c)
            for c in df.columns
        ]
    )


def fields_map(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])


def extracted_fields(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.map_filter(fields_map(fields), lambda _, v: F.coalesce(v, F.lit("")) != "")


def missing(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.filter(F.array(*[F.when(is_empty(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def extraction_rate(fields: tuple[str, ...] = FIELDS) -> Column:
    """Per cent of the fields that have a value."""
    n = sum((~is_empty(f)).cast("int") for f in fields)
    return n / F.lit(len(fields)) * 100


def average_confidence(scores: str = "confidence_scores", fields: tuple[str, ...] = FIELDS) -> Column:
    """Mean over the fields that have both a value and a score; 0 without any."""
    score = {f: F.when(~is_empty(f), F.try_element_at(scores, F.lit(f))) for f in fields}
    n = sum(s.isNotNull().cast("int") for s in score.values())
    return F.when(n == 0, 0.0).otherwise(sum(F.coalesce(s, F.lit(0.0)) for s in score.values()) / n)


def confidence_of(field: str, scores: str = "confidence_scores") -> Column:
    return F.coalesce(F.try_element_at(scores, F.lit(field)), F.lit(0.0))


def positive_scores(scores: Column) -> Column:
    """Only scores over 0 are kept."""
    return F.map_filter(scores, lambda _, v: v > 0)


def from_answers(df: DataFrame, answers: str = "answers") -> DataFrame:
    """Fields, scores and raw answers from a map of field to (question, answer, confidence); null answers only warn."""
    raw = F.col(answers)
    value = lambda f: F.nullif(clean_answer(F.try_element_at(raw, F.lit(f)).answer), F.lit(""))
    scores = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.when(value(f).isNotNull(), F.try_element_at(raw, F.lit(f)).confidence))])
    warned = F.filter(F.array(*[F.when(value(f).isNull(), F.lit(f"{f} not found")) for f in FIELDS]), lambda x: x.isNotNull())
    return df.select("*", *[value(f).alias(f) for f in FIELDS], positive_scores(F.map_filter(scores, lambda _, v: v.isNotNull())).alias("confidence_scores"), raw.alias("raw_extractions"), warned.alias("warnings"))


def to_json() -> Column:
    """The extraction as JSON, with the derived properties."""
    return F.to_json(F.struct(*FIELDS, "confidence_scores", "source_file", extraction_rate().alias("extraction_rate"), average_confidence().alias("average_confidence")))


def from_json(c: str | Column) -> Column:
    """An extraction from JSON; what is not given gets its default."""
    r = F.from_json(col(c), EXTRACTION)
    text = lambda name: F.coalesce(r[name], F.lit("")).alias(name)
    listed = lambda name: F.coalesce(r[name], F.array().cast("array<string>")).alias(name)
    return F.struct(
        *[r[f].alias(f) for f in FIELDS],
        F.coalesce(r.confidence_scores, F.create_map().cast("map<string,double>")).alias("confidence_scores"),
        r.raw_extractions.alias("raw_extractions"),
        text("source_file"),
        r.extraction_timestamp.alias("extraction_timestamp"),
        text("model_name"),
        F.coalesce(r.processing_time, F.lit(0.0)).alias("processing_time"),
        F.coalesce(r.success, F.lit(True)).alias("success"),
        listed("errors"),
        listed("warnings"),
    )


def flat(df: DataFrame, scores: str = "confidence_scores") -> DataFrame:
    """One column a field and a score; nulls are empty text and 0."""
    others = [c for c in ("source_file", "extraction_timestamp", "model_name", "processing_time", "success") if c in df.columns]
    return df.select(
        *[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS],
        *others,
        extraction_rate().alias("extraction_rate"),
        average_confidence(scores).alias("average_confidence"),
        *[confidence_of(f, scores).alias(f"{f}_confidence") for f in FIELDS],
    )
