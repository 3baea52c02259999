import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import amounts, compare, dates, files, maps, text, validate


def test_dates(one):
    cases = {
        "01/15/2026": "2026-01-15",
        "January 15, 2026": "2026-01-15",
        "15/01/2024": "2024-01-15",
        "Jan 15, 2024": "2024-01-15",
        "2024-01-15": "2024-01-15",
        "01/02/2024": "2024-01-02",
        "01-02-2024": "2024-02-01",
        "01.02.2024": "2024-02-01",
        "Invoice Date: 5th March 2024": "2024-03-05",
        " DATE:  3/4/2024 ": "2024-03-04",
        "on 2024-1-5": "2024-01-05",
        "": None,
        "2024-02-30": None,
        "0000-01-01": None,
        "junk": None,
        None: None,
        "5 Mar 2024": None,
    }
    assert one(dates.normalize_date, list(cases)) == list(cases.values())
    assert one(lambda c: dates.normalize_date(c, more=True), ["5 Mar 2024", "March 5 2024", "2024-03-05T10:00:00"]) == ["2024-03-05"] * 3


def test_fuzzy_dates_are_only_asked_for_the_residue(spark):
    df = spark.createDataFrame([("01/15/2026",), ("the 7th of May 2021",), ("nothing here",), (None,)], "d string")
    got = [r.n for r in dates.with_normalized_date(df, "d", "n", dt.date(2020, 1, 1)).collect()]
    assert got == ["2026-01-15", "2021-05-07", None, None]


def test_date_in_text(one):
    assert one(dates.extract_date, ["due 2024-01-25 net", "on March 3rd, 2024 we", "3 March 2024", "none", None]) == ["2024-01-25", "2024-03-03", "2024-03-03", None, None]


def test_amounts(one):
    cases = {"$1,234.56": "1234.56", "€ 1.234,56": "1234.56", "1,234.56 USD": "1234.56", "1,5": "1.50", "1.234": "1.23", "1,234,56": "123456.00", "-100": "-100.00", "(100)": "100.00", "Rs. 500": "0.50", "1-2": None, "1.234.567": None, "": None, None: None, "-0": "-0.00", "12": "12.00", ".": None}
    assert one(amounts.normalize_amount, list(cases)) == list(cases.values())
    assert one(amounts.extract_amount, ["pay $0 or $12.50 now", "none", None]) == ["12.50", None, None]
    assert one(amounts.strict_amount, ["1.005", "2.675", "0.125", None]) == ["1.00", "2.67", "0.12", None]
    assert one(amounts.is_valid_amount, ["5", "-5", "x"]) == [True, False, False]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(0, 99), st.sampled_from(["us", "eu", "plain"])), min_size=1, max_size=20))
def test_amounts_round_trip(one, values):
    forms = {"us": lambda a, b: f"${a:,}.{b:02}", "eu": lambda a, b: f"{a:,}".replace(",", ".") + f",{b:02} EUR", "plain": lambda a, b: f"{a}.{b:02}"}
    assert one(amounts.normalize_amount, [forms[f](a, b) for a, b, f in values]) == [f"{a}.{b:02}" for a, b, _ in values]


def test_names_and_text(one):
    assert one(text.clean_name, ["Vendor:  ACME  CORP LTD", "IBM", "O'BRIEN-SMITH", "to: from: x", None, ""]) == ["Acme Corp Ltd", "IBM", "O'Brien-Smith", "from: x", None, ""]
    assert one(text.clean_text, [" .;a  b:, ", " x y "]) == ["a b", "x y"]
    assert one(text.clean_answer, [" : - x, y .", "--", None]) == ["x, y", "", None]
    assert one(text.is_scanned, [None, " " * 90, "x" * 50]) == [True, True, False]


def test_verdicts(one):
    assert [(v.ok, v.msg) for v in one(validate.date_verdict, ["2026-01-15", "1999-01-01", "2101-01-01", "", None, "15/01/2024"])] == [
        (True, "Valid date"),
        (False, "Year 1999 is too old"),
        (False, "Year 2101 is too far in future"),
        (False, "Date is empty"),
        (False, "Date is empty"),
        (False, "Invalid date format: 15/01/2024"),
    ]
    assert [(v.ok, v.msg) for v in one(validate.amount_verdict, ["1234.56", "-100", "2e9", "x"])] == [(True, "Valid amount"), (False, "Amount cannot be negative"), (False, "Amount 2.0E9 exceeds maximum"), (False, "Could not parse amount: x")]
    assert [v.ok for v in one(validate.number_verdict, ["A1", "-", "--", None])] == [True, False, False, False]


def test_similarity(one, spark):
    df = spark.createDataFrame([("1.234.56", "1234.56"), ("", "x"), ("a", "a")], "a string, b string")
    assert [r[0] for r in df.select(compare.similarity("a", "b")).collect()] == [0.875, 0.0, 1.0]
    assert one(lambda c: compare.comparable("total_amount", c), ["$12345678.90", "10", "0.50", ".5", "1.2.3"]) == ["12345678.9", "10.0", "0.5", "0.5", "1.2.3"]


def test_files(one):
    assert one(files.safe_filename, ["invoice:123/test.pdf", "...", None]) == ["invoice_123_test.pdf", "unnamed", "unnamed"]
    assert one(files.extension, ["document.PDF", "noextension", ".hidden", "a.b/c", "a..b"]) == [".pdf", "", "", "", ".b"]
    assert one(files.format_size, [1536, 1048576, 0, 1280, None], "long") == ["1.5 KB", "1.0 MB", "0.0 B", "1.2 KB", None]


@pytest.mark.parametrize("value", ["2024-01-01", "1/2/2024"])
def test_past_and_future(one, value):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert one(lambda c: dates.is_past(c, now), [value]) == [value.startswith("2024")]
    assert one(lambda c: dates.is_future(c, now), [value]) == [False]


def test_merged_maps(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4}), (None, {"a": 1}), ({"a": 1}, None), (None, None)], "x map<string,int>, y map<string,int>")
    assert [r[0] for r in df.select(maps.merge_maps("x", "y")).collect()] == [{"a": 1, "b": 3, "c": 4}, {"a": 1}, {"a": 1}, None]
