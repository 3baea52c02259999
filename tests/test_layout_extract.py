import json

from pyspark.sql import functions as F

from quillstone.config import FIELDS
from quillstone.operators import extract, layout, postprocess


def test_words_lines_and_pages(spark):
    page = [(1, ["b", " ", "a", "c", "z"], [50, 0, 10, 10, 0], [0, 0, 0, 40, 0], [20, 5, 20, 20, 0], [30] * 5, [80.0, 1.0, -1.0, 60.0, 9.0], [0, 0, 0, 1, 1])]
    df = spark.createDataFrame(page, "page_id int, text array<string>, left array<int>, top array<int>, width array<int>, height array<int>, conf array<double>, line_num array<int>")
    words = layout.words_from_engine(df)
    assert [(r.word_index, r.text, r.confidence) for r in words.orderBy("word_index").collect()] == [(0, "b", 80.0), (1, "a", 0.0), (2, "c", 60.0)]
    lines = {r.line_index: r for r in layout.lines(words).collect()}
    assert lines[0].text == "a b" and (lines[0].x1, lines[0].x2) == (10, 70) and lines[0].average_confidence == 40.0
    assert layout.page_text(words).first().text == "a b\nc"
    boxes = layout.normalize_boxes(words.withColumns({"image_width": F.lit(100), "image_height": F.lit(0)}))
    assert boxes.first().nx1 is None
    r = layout.model_input(layout.normalize_boxes(words.withColumns({"image_width": F.lit(100), "image_height": F.lit(100)}))).first()
    assert r.words == ["b", "a", "c"] and r.boxes[0] == [500, 0, 700, 300]
    assert layout.nested(words).first().words[0].word_index == 0
    page = json.loads(layout.serialised(words).first().json)
    assert page["text"] == "a b\nc" and page["word_count"] == 3 and page["lines"][0]["bbox"] == {"x1": 10, "y1": 0, "x2": 70, "y2": 30}
    assert [w["text"] for w in page["words"]] == ["b", "a", "c"]


def test_box_scaling(spark):
    df = spark.createDataFrame([(100, 50, 200, 80, 2480, 3508)], "x1 int, y1 int, x2 int, y2 int, image_width int, image_height int")
    r = layout.normalize_boxes(df).first()
    assert (r.nx1, r.ny1, r.nx2, r.ny2) == (40, 14, 80, 22)


def test_fallback_quirks(one):
    number = lambda c: extract.regex_field("invoice_number", c)
    assert one(number, ["Invoice Number: INV-7", "Invoice Date: x", "Bill To: ACME", "Invoice", "none"]) == ["INV-7", "Date", "To", "oice", None]
    total = lambda c: extract.regex_field("total_amount", c)
    assert one(total, ["Subtotal: 90.00 Total: 100.00", "Total Amount Due: $5"]) == ["90.00", "5"]
    strict = lambda c: extract.regex_field("total_amount", c, strict=True)
    assert one(strict, ["Subtotal: 90.00 Total: 100.00", "Total Amount Due: $5"]) == ["100.00", "5"]


def _rows(spark):
    kinds = ", ".join(f"{f} string" for f in FIELDS)
    rows = [("INV-1.", "15/01/2024", "ACME HOLDINGS", "", "€ 1.234,50", "2023-01-01", {"invoice_number": 0.9, "vendor_name": 0.2, "customer_name": 0.7}), (None, "nonsense", None, None, " ", None, {})]
    return spark.createDataFrame(rows, f"{kinds}, confidence_scores map<string,double>")


def test_postprocess(spark):
    a, b = postprocess.postprocess(_rows(spark)).collect()
    assert (a.invoice_number, a.invoice_date, a.vendor_name, a.total_amount) == ("INV-1", "2024-01-15", "Acme Holdings", "1234.50")
    assert a.validation.is_valid and a.validation.warnings == ["Low confidence: vendor_name (0.20)", "Due date is before invoice date"]
    assert b.invoice_date == "nonsense" and not b.validation.is_valid
    assert "Could not normalize invoice_date: nonsense" in b.warnings and "Missing required field: total_amount" in b.warnings


def test_derived_properties(spark):
    df = _rows(spark)
    r = df.select(extract.extraction_rate().alias("rate"), extract.average_confidence().alias("c"), extract.missing().alias("m"), extract.extracted_fields().alias("e")).collect()
    assert round(r[0].rate, 4) == 83.3333 and abs(r[0].c - 0.55) < 1e-9 and r[0].m == ["customer_name"] and len(r[0].e) == 5
    assert r[1].c == 0.0
    back = df.withColumn("source_file", F.lit("f")).select(extract.to_json().alias("j")).select(extract.from_json("j").alias("x")).first().x
    assert back.invoice_number == "INV-1." and back.success and back.errors == []
