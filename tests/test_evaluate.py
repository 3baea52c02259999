import json

import pytest

from quillstone.config import FIELDS
from quillstone.operators import evaluate
from quillstone.plans import reports

SCHEMA = "idx long, source_file string, " + ", ".join(f"{f} string" for f in FIELDS)


def rows(*values):
    return [(i, name, number, None, "Acme Ltd", None, amount, None) for i, (name, number, amount) in enumerate(values)]


def test_lookup_and_metrics(spark):
    predictions = spark.createDataFrame(rows(("a/x.pdf", "1", "$10.00"), ("y.pdf", None, "7"), ("z.pdf", "3", "1")), SCHEMA)
    truth = spark.createDataFrame(rows(("x.pdf", "1", "10"), ("b/y.pdf", "2", "8"), ("y.pdf", "9", "7")), SCHEMA)
    found = {r.source_file: r for r in evaluate.lookup(predictions, truth).collect()}
    assert found["a/x.pdf"].gt_invoice_number == "1"
    assert found["y.pdf"].gt_invoice_number == "9"
    assert not found["z.pdf"].gt_found and found["z.pdf"].gt_vendor_name == ""
    metrics, overall = evaluate.evaluate(predictions, truth)
    by = {r.field: r for r in metrics.collect()}
    assert (by["invoice_number"].correct_count, by["invoice_number"].missing_count) == (1, 1)
    assert by["total_amount"].correct_count == 2
    assert by["vendor_name"].accuracy == pytest.approx(2 / 3)
    assert overall.first().total_samples == 3
    assert json.loads(reports.report(metrics, overall, "json"))["total_samples"] == 3
    assert "total_amount" in reports.report(metrics, overall, "txt") and "<table>" in reports.report(metrics, overall, "html")
    with pytest.raises(Exception, match="unsupported"):
        reports.report(metrics, overall, "pdf")


@pytest.mark.parametrize("scores,want", [([0.8, 0.0, 0.4], 2 / 3), ([0.0, 0.0], 0.0), ([0.0, 0.5, 0.0, 0.25], 0.25), ([1.0], 1.0)])
def test_running_confidence(spark, scores, want):
    avg = 0.0
    for i, c in enumerate(scores):
        avg = (avg * i + c) / (i + 1) if c > 0 else avg
    df = spark.createDataFrame([("f", i, c) for i, c in enumerate(scores)], "field string, idx long, confidence double")
    assert evaluate.running_confidence(df).first().avg_confidence == pytest.approx(avg)
    assert avg == pytest.approx(want)


def test_zip_needs_equal_lengths(spark):
    a = spark.createDataFrame(rows(("a", "1", "1"), ("b", "2", "2")), SCHEMA)
    assert evaluate.zipped(a, a).count() == 2
    with pytest.raises(ValueError):
        evaluate.zipped(a, a.limit(1))


def test_completeness(spark):
    full = [(0, "a", *["x"] * 6), (1, "b", "", None, *["x"] * 4)]
    got = evaluate.completeness(spark.createDataFrame(full, SCHEMA)).first()
    assert (got.total_records, got.valid_records, got.missing_invoice_number, got.missing_invoice_date, got.missing_vendor_name) == (2, 1, 1, 1, 0)
