"""Validation of fields and records; a verdict is a struct of ok and msg."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.config import FIELDS
from quillstone.functions.dates import strict_iso
from quillstone.functions.text import bind, col, is_empty, strip

#: Years and amounts that are plausible.
YEARS = (2000, 2100)
AMOUNTS = (0.0, 1_000_000_000.0)
REASONABLE = (10, 1_000_000)
#: What Python's float() reads, without infinities and NaN.
FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


#: The messages of the verdicts, by what is judged; a value or field name stands where the braces are.
MESSAGES = {
    "date": {"empty": "Date is empty", "format": "Invalid date format: ", "old": "Year %d is too old", "late": "Year %d is too far in future", "good": "Valid date"},
    "amount": {"empty": "Amount is empty", "format": "Could not parse amount: ", "negative": "Amount cannot be negative", "large": ("Amount ", " exceeds maximum"), "good": "Valid amount"},
    "number": {"empty": "Invoice number is empty", "short": "Invoice number too short", "signs": "Invoice number must contain alphanumeric characters", "good": "Valid invoice number"},
    "name": {"empty": "{} is empty", "short": "{} too short", "good": "Valid {}"},
    "other": {"empty": "Field is empty", "good": "Field has value"},
}


def verdict(*tests: tuple[Column, str | Column], good: str) -> Column:
    """The message of the first test that fails the value, else ``good``."""
    msg = ok = None
    for bad, text in tests:
        text = F.lit(text) if isinstance(text, str) else text
        msg = F.when(bad, text) if msg is None else msg.when(bad, text)
        ok = bad if ok is None else ok | bad
    return F.struct((~F.coalesce(ok, F.lit(True))).alias("ok"), msg.otherwise(F.lit(good)).alias("msg"))


def date_verdict(c: str | Column) -> Column:
    c, say = col(c), MESSAGES["date"]

    def of(year: Column) -> Column:
        return verdict(
            (is_empty(c), say["empty"]),
            (year.isNull(), F.concat(F.lit(say["format"]), c)),
            (year < YEARS[0], F.format_string(say["old"], year)),
            (year > YEARS[1], F.format_string(say["late"], year)),
            good=say["good"],
        )

    return bind(F.year(strict_iso(c)), of)


def amount_verdict(c: str | Column) -> Column:
    c, say = col(c), MESSAGES["amount"]

    def of(value: Column) -> Column:
        before, after = say["large"]
        return verdict(
            (is_empty(c), say["empty"]),
            (value.isNull(), F.concat(F.lit(say["format"]), c)),
            (value < AMOUNTS[0], say["negative"]),
            (value > AMOUNTS[1], F.concat(F.lit(before), value.cast("string"), F.lit(after))),
            good=say["good"],
        )

    return bind(F.when(c.rlike(FLOAT), strip(c).try_cast("double")), of)


def number_verdict(c: str | Column) -> Column:
    c, say = col(c), MESSAGES["number"]
    return verdict((is_empty(c), say["empty"]), (F.length(strip(c)) < 2, say["short"]), (~c.rlike("[A-Za-z0-9]"), say["signs"]), good=say["good"])


def _name_verdict(c: str | Column, what: str) -> Column:
    c, say = col(c), MESSAGES["name"]
    return verdict((is_empty(c), say["empty"].format(what)), (F.length(strip(c)) < 2, say["short"].format(what)), good=say["good"].format(f"{what[0].lower()}{what[1:]}"))


def vendor_verdict(c: str | Column) -> Column:
    return _name_verdict(c, "Vendor name")


def customer_verdict(c: str | Column) -> Column:
    return _name_verdict(c, "Customer name")


def default_verdict(c: str | Column) -> Column:
    return verdict((is_empty(c), MESSAGES["other"]["empty"]), good=MESSAGES["other"]["good"])


VERDICTS: dict[str, Callable[[str | Column], Column]] = {
    "invoice_number": number_verdict,
    "invoice_date": date_verdict,
    "vendor_name": vendor_verdict,
    "customer_name": customer_verdict,
    "total_amount": amount_verdict,
    "payment_due_date": date_verdict,
}


def field_verdict(name: str, c: str | Column | None = None) -> Column:
    return VERDICTS.get(name, default_verdict)(name if c is None else c)


def reasonable_total(c: str | Column) -> Column:
    return col(c).between(*REASONABLE)


def due_after_invoice(invoice: str | Column, due: str | Column) -> Column:
    def of(later: Column) -> Column:
        msg = F.when(~later, "Due date is before invoice date").when(later, "Valid date relationship").otherwise("Could not validate date relationship")
        return F.struct(F.coalesce(later, F.lit(True)).alias("ok"), msg.alias("msg"))

    return bind(strict_iso(due) >= strict_iso(invoice), of)


def missing_fields(required: tuple[str, ...] | list[str]) -> Column:
    """Names of the required fields that are null or blank."""
    names = [F.when(F.coalesce(strip(f), F.lit("")) == "", F.lit(f)) for f in required]
    return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")


def low_confidence(scores: str | Column, threshold: float) -> Column:
    """``field (0.42)`` of every scored field under the threshold."""
    low = F.filter(F.map_entries(col(scores)), lambda e: e.value < threshold)
    return F.coalesce(F.transform(low, lambda e: F.concat(e.key, F.lit(" ("), F.bround(e.value.cast("decimal(20,10)"), 2).cast("decimal(20,2)").cast("string"), F.lit(")"))), F.array().cast("array<string>"))


def validation(required: tuple[str, ...] | list[str] = ("invoice_number", "total_amount"), threshold: float = 0.5, scores: str | None = "confidence_scores") -> Column:
    """The struct of :data:`quillstone.schema.VALIDATION` for a row with the six fields."""
    verdicts = [F.struct(F.lit(f).alias("key"), field_verdict(f).alias("value")) for f in FIELDS]
    given = F.filter(F.array(*[F.when(~is_empty(f), v) for f, v in zip(FIELDS, verdicts, strict=True)]), lambda x: x.isNotNull())
    return bind(given, lambda g: _record(g, required, threshold, scores))


def _record(given: Column, required: tuple[str, ...] | list[str], threshold: float, scores: str | None) -> Column:
    """The struct from the verdicts of the fields that are given."""
    bad = F.transform(F.filter(given, lambda e: ~e.value.ok), lambda e: F.concat(e.key, F.lit(": "), e.value.msg))
    missing = F.transform(missing_fields(required), lambda f: F.concat(F.lit("Required field missing: "), f))
    none = F.array().cast("array<string>")
    both = ~is_empty("invoice_date") & ~is_empty("payment_due_date")
    late = F.when(both, bind(due_after_invoice("invoice_date", "payment_due_date"), lambda due: F.when(~due.ok, F.array(due.msg)))).otherwise(none)
    low = F.transform(low_confidence(scores, threshold), lambda x: F.concat(F.lit("Low confidence: "), x)) if scores else F.array().cast("array<string>")
    rest = F.struct(F.concat(low, F.coalesce(late, none)).alias("warnings"), F.map_from_entries(given).alias("field_results"))
    return bind(F.concat(bad, missing), lambda errors: F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), rest.warnings.alias("warnings"), rest.field_results.alias("field_results")))
