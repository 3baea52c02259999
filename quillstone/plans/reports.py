"""Evaluation reports as text, JSON or HTML, and detailed results as JSON lines."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.config import FIELDS
from quillstone.errors import OutputError
from quillstone.operators.evaluate import band, compared


def with_bands(metrics: DataFrame) -> DataFrame:
    """Adds band, good from 0.9 and medium from 0.7 accuracy."""
    return metrics.withColumn("band", band("accuracy"))


def _collected(metrics: DataFrame, overall: DataFrame) -> tuple[list[dict], dict]:
    """One row a field and one overall."""
    rows = {r["field"]: r.asDict() for r in with_bands(metrics).collect()}
    ordered = [rows[f] for f in (*[f for f in FIELDS if f in rows], *sorted(set(rows) - set(FIELDS)))]
    return ordered, overall.first().asDict()


def _percent(x: float) -> str:
    return f"{100 * x:.1f}%"


def text_report(metrics: DataFrame, overall: DataFrame) -> str:
    rows, total = _collected(metrics, overall)
    lines = ["EVALUATION REPORT", f"Samples: {total['total_samples']}", f"Accuracy: {_percent(total['overall_accuracy'])}", f"Extraction rate: {_percent(total['overall_extraction_rate'])}", f"Average confidence: {total['avg_confidence']:.2f}", ""]
    for r in rows:
        lines += [f"{r['field']}", f"  accuracy {_percent(r['accuracy'])}, partial {_percent(r['partial_accuracy'])}, extracted {r['extracted_count']}/{r['total_samples']}, missing rate {_percent(r['missing_rate'])}, confidence {r['avg_confidence']:.2f}"]
    return "\n".join(lines)


def json_report(metrics: DataFrame, overall: DataFrame) -> str:
    rows, total = _collected(metrics, overall)
    return json.dumps({**total, "field_metrics": {r.pop("field"): r for r in rows}}, indent=2)


def html_report(metrics: DataFrame, overall: DataFrame) -> str:
    rows, total = _collected(metrics, overall)
    cells = lambda r: (html.escape(r["field"]), _percent(r["accuracy"]), _percent(r["extraction_rate"]), _percent(r["partial_accuracy"]), f"{r['extracted_count']}/{r['total_samples']}", str(r["correct_count"]), f"{r['avg_confidence']:.2f}")
    body = "".join(f'<tr class="{r["band"]}">' + "".join(f"<td>{c}</td>" for c in cells(r)) + "</tr>" for r in rows)
    head = "".join(f"<th>{h}</th>" for h in ("Field", "Accuracy", "Extraction rate", "Partial", "Extracted", "Correct", "Confidence"))
    style = ".good{color:green}.medium{color:orange}.poor{color:red}td,th{padding:4px 12px;text-align:left}"
    summary = f"<p>{total['total_samples']} samples, accuracy {_percent(total['overall_accuracy'])}, extraction rate {_percent(total['overall_extraction_rate'])}, confidence {total['avg_confidence']:.2f}</p>"
    return f"<!DOCTYPE html><html><head><title>Evaluation</title><style>{style}</style></head><body><h1>Evaluation</h1>{summary}<table><tr>{head}</tr>{body}</table></body></html>"


FORMATS = {"txt": text_report, "json": json_report, "html": html_report}


def report(metrics: DataFrame, overall: DataFrame, kind: str = "txt", path: str | None = None) -> str:
    """The report, or the path that it was written to."""
    if kind not in FORMATS:
        raise OutputError(f"unsupported report format: {kind}")
    made = FORMATS[kind](metrics, overall)
    if path is None:
        return made
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(made, encoding="utf-8")
    return path


def detailed(pairs: DataFrame, order: str = "idx", threshold: float = 0.8) -> DataFrame:
    """One row a sample: its place, file, and a map of field to comparison; ready for ``write.json``."""
    rows = compared(pairs, [order, "source_file"], threshold)
    each = F.struct("field", F.struct("predicted", F.col("truth").alias("ground_truth"), F.col("exact").alias("exact_match"), F.col("partial").alias("partial_match"), "confidence", "extracted").alias("value"))
    return rows.groupBy(order, "source_file").agg(F.map_from_entries(F.array_sort(F.collect_list(each))).alias("comparison")).withColumnRenamed(order, "sample_index")
