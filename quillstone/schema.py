"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

from quillstone.config import FIELDS

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


BOX = _struct(x1=_I, y1=_I, x2=_I, y2=_I)
WORD = _struct(text=_S, bbox=BOX, confidence=_D, nbox=BOX, word_index=_I, line_index=_I)
RAW_ANSWER = _struct(question=_S, answer=_S, confidence=_D)
VERDICT = _struct(ok=T.BooleanType(), msg=_S)
VALIDATION = _struct(is_valid=T.BooleanType(), errors=T.ArrayType(_S), warnings=T.ArrayType(_S), field_results=T.MapType(_S, VERDICT))

INPUT = _struct(path=_S, filename=_S, file_type=_S, length=_L, modification_time=T.TimestampType(), content=T.BinaryType(), metadata=T.MapType(_S, _S), success=T.BooleanType(), error=_S)
PAGE = _struct(path=_S, page_idx=_I, image=T.BinaryType(), width=_I, height=_I, text=_S, metadata=T.MapType(_S, _S), success=T.BooleanType(), error=_S)
OCR_PAGE = _struct(path=_S, page_idx=_I, words=T.ArrayType(WORD), image_width=_I, image_height=_I, language=_S, engine=_S, processing_time=_D, success=T.BooleanType(), error=_S)

EXTRACTION = T.StructType(
    [T.StructField(f, _S) for f in FIELDS]
    + list(
        _struct(
            confidence_scores=T.MapType(_S, _D),
            raw_extractions=T.MapType(_S, RAW_ANSWER),
            source_file=_S,
            extraction_timestamp=_S,
            model_name=_S,
            processing_time=_D,
            success=T.BooleanType(),
            errors=T.ArrayType(_S),
            warnings=T.ArrayType(_S),
        )
    )
)

#: One row of the store: dates and amounts stay text.
STORED = T.StructType(
    [T.StructField("id", _L)]
    + [T.StructField(f, _S) for f in (*FIELDS, "source_file", "extraction_timestamp", "model_name")]
    + [T.StructField("processing_time", _D), T.StructField("success", _I), T.StructField("extraction_rate", _D), T.StructField("average_confidence", _D)]
    + [T.StructField(f"{f}_confidence", _D) for f in FIELDS]
    + [T.StructField("created_at", _S)]
)

GROUND_TRUTH = T.StructType([T.StructField("source_file", _S)] + [T.StructField(f, _S) for f in FIELDS])
