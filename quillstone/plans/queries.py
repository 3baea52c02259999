"""The registered queries, each beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.config import FIELDS
from quillstone.functions import amounts, compare, dates, files, maps, text, validate
from quillstone.operators import evaluate, extract, layout, postprocess, store
from quillstone.plans import fixtures as fx
from quillstone.plans import reports
from quillstone.plans.fixtures import ARRIVAL_ORDER, table
from quillstone.session import shared_path
from quillstone.sources import ground_truth, workbook
from quillstone.streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- values of the SQL twins ----------------------------------------------------------------------------------------

# Fixed values, written out again here, so that a wrong one in the functions does not agree with itself.
_LEADS = ("date:", "dated:", "invoice date:", "due date:", "on")
_DATE_FORMATS = ("%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%Y")
_DATES_IN_TEXT = (
    r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b",
    r"\b(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})\b",
    r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{2,4})\b",
    r"\b(\d{1,2})(?:st|nd|rd|th)?\s+((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*)\s+(\d{2,4})\b",
)
_AMOUNTS_IN_TEXT = (r"(?i)[\$€£¥₹]?\s*[\d,]+\.?\d*", r"(?i)[\d,]+\.?\d*\s*(?:USD|EUR|GBP|INR)?")
_NAME_LEADS = ("vendor:", "customer:", "bill to:", "ship to:", "from:", "to:")
_SIZES = ("B", "KB", "MB", "GB", "TB")
_FALLBACK = {
    "invoice_number": (r"Invoice\s*(?:#|No\.?|Number)?\s*[:\s]?\s*([A-Z0-9-]+)", r"INV[:\s-]?\s*([A-Z0-9-]+)", r"Bill\s*(?:#|No\.?)?\s*[:\s]?\s*([A-Z0-9-]+)"),
    "total_amount": (r"Total\s*(?:Amount|Due)?\s*[:\s]?\s*\$?\s*([\d,]+\.?\d*)", r"Grand\s*Total\s*[:\s]?\s*\$?\s*([\d,]+\.?\d*)", r"Amount\s*Due\s*[:\s]?\s*\$?\s*([\d,]+\.?\d*)"),
    "invoice_date": (r"(?:Invoice\s*)?Date\s*[:\s]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"Dated?\s*[:\s]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})"),
    "payment_due_date": (r"Due\s*Date\s*[:\s]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"Pay(?:ment)?\s*(?:Due\s*)?By\s*[:\s]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
}

# --- SQL of the scalar functions -----------------------------------------------------------------------------------

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_WS}+|{_WS}+\z', '', 'g')"


def _clean_date(c: str) -> str:
    s = _squeeze(c)
    for p in _LEADS:
        s = f"(CASE WHEN starts_with(lower({s}), '{p}') THEN trim(substr({s}, {len(p) + 1})) ELSE {s} END)"
    return rf"regexp_replace({s}, '(?i)(\d+)(st|nd|rd|th)', '\1', 'g')"


def _iso(c: str) -> str:
    formats = ", ".join(f"'{f}'" for f in _DATE_FORMATS)
    return f"strftime(try_strptime({c}, [{formats}]), '%Y-%m-%d')"


def _plain(c: str) -> str:
    s = rf"regexp_replace({c}, '[^\d,.\-]', '', 'g')"
    return rf"(CASE WHEN regexp_matches({s}, '^[^,]*,\d{{1,2}}$') THEN replace(replace({s}, '.', ''), ',', '.') ELSE replace({s}, ',', '') END)"


def _amount(c: str) -> str:
    return f"CASE WHEN regexp_matches({_plain(c)}, '^-?(\\d+\\.?\\d*|\\.\\d+)$') THEN format('{{:.2f}}', TRY_CAST({_plain(c)} AS DOUBLE)) END"


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes)


_RAW = _with(fx.RAW_HEADERS)
_HEADERS = _with(fx.RAW_HEADERS, fx.HEADERS)
#: Cleaned dates are computed once, as the nested prefixes would make the text long.
_DATED = fx.RAW_HEADERS + f", squeezed AS (SELECT *, {_squeeze('invoice_date')} AS d0 FROM raw_headers)" + "".join(f", p{i} AS (SELECT *, CASE WHEN starts_with(lower(d{i}), '{p}') THEN trim(substr(d{i}, {len(p) + 1})) ELSE d{i} END AS d{i + 1} FROM {'squeezed' if i == 0 else f'p{i - 1}'})" for i, p in enumerate(_LEADS)) + rf", dated AS (SELECT *, {_iso(rf'''regexp_replace(d{len(_LEADS)}, '(?i)(\d+)(st|nd|rd|th)', '\1', 'g')''')} AS iso FROM p{len(_LEADS) - 1})"


# --- normalisation -------------------------------------------------------------------------------------------------


@_query(
    f"WITH {_DATED} SELECT k, iso AS invoice_date, {_amount('total_amount')} AS total_amount, "
    f"iso IS NOT NULL AND CAST(iso[1:4] AS INTEGER) BETWEEN 2000 AND 2100 AS date_ok, "
    f"coalesce(CAST({_amount('total_amount')} AS DOUBLE) BETWEEN 0 AND 1e9, FALSE) AS amount_ok FROM dated"
)
def header_normalize(spark, sf_dir):
    df = fx.raw_headers(spark, sf_dir).select("k", dates.normalize_date("invoice_date").alias("invoice_date"), amounts.normalize_amount("total_amount").alias("total_amount"))
    return df.select("*", validate.date_verdict("invoice_date").ok.alias("date_ok"), validate.amount_verdict("total_amount").ok.alias("amount_ok"))


_FORMS = ("MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "dd.MM.yyyy")
_DUCK_FORMS = ("%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%B %-d, %Y", "%b %-d, %Y", "%-d %B %Y", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%Y")


@_query(f"SELECT o_orderkey AS k, raw, {_iso('raw')} AS iso FROM (SELECT o_orderkey, CASE o_orderkey % 9 {' '.join(f'''WHEN {i} THEN strftime(o_orderdate, '{f}')''' for i, f in enumerate(_DUCK_FORMS))} END AS raw FROM orders)")
def date_normalize_formats(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.coalesce(*[F.when(k % 9 == i, F.date_format("o_orderdate", p)) for i, p in enumerate(_FORMS)])
    return table(spark, sf_dir, "orders").select(k.alias("k"), raw.alias("raw")).select("k", "raw", dates.normalize_date("raw").alias("iso"))


def _found_in_text(c: str) -> str:
    return "coalesce(" + ", ".join(_iso(f"nullif(regexp_extract({c}, '(?i){p}', 0), '')") for p in _DATES_IN_TEXT) + f", {_iso(c)})"


@_query(f"SELECT k, {_found_in_text('body')} AS iso FROM (SELECT o_orderkey AS k, 'issued ' || CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE strftime(o_orderdate, '%-d %B %Y') END || ' by post' AS body FROM orders)")
def date_extract_text(spark, sf_dir):
    k = F.col("o_orderkey")
    forms = ("MM/dd/yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy")
    date = F.coalesce(*[F.when(k % 4 == i, F.date_format("o_orderdate", p)) for i, p in enumerate(forms)])
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("issued "), date, F.lit(" by post")).alias("body")).select("k", dates.extract_date("body").alias("iso"))


@_query(f"{_RAW} SELECT k, {_amount('total_amount')} AS amount FROM raw_headers WHERE k % 5 <> 1")
def amount_normalize_us(spark, sf_dir):
    return fx.raw_headers(spark, sf_dir).where("k % 5 <> 1").select("k", amounts.normalize_amount("total_amount").alias("amount"))


@_query(f"{_RAW} SELECT k, {_amount('total_amount')} AS amount, CAST({_amount('total_amount')} AS DOUBLE) AS value FROM raw_headers WHERE k % 5 = 1")
def amount_normalize_eu(spark, sf_dir):
    return fx.raw_headers(spark, sf_dir).where("k % 5 = 1").select("k", amounts.normalize_amount("total_amount").alias("amount"), amounts.amount_value("total_amount").alias("value"))


@_query(
    f"SELECT k, coalesce(" + ", ".join(f"list_filter(list_transform(regexp_extract_all(body, '{p}'), lambda x: {_amount('x')}), lambda x: TRY_CAST(x AS DOUBLE) > 0)[1]" for p in _AMOUNTS_IN_TEXT) + f", {_amount('body')}) AS amount"
    " FROM (SELECT o_orderkey AS k, 'pay ' || format('{:,.2f}', o_totalprice) || ' USD within ' || CAST(o_orderkey % 30 AS VARCHAR) || ' days' AS body FROM orders)"
)
def amount_extract_text(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.concat(F.lit("pay "), F.format_number("o_totalprice", 2), F.lit(" USD within "), (k % 30).cast("string"), F.lit(" days"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), body.alias("body")).select("k", amounts.extract_amount("body").alias("amount"))


@_query(f"SELECT p_partkey AS k, trim({_squeeze('t')}, '.,;:') AS cleaned FROM (SELECT p_partkey, ' .;' || p_name || chr(9) || '  ' || p_type || ' ,: ' AS t FROM part)")
def text_clean(spark, sf_dir):
    t = F.concat(F.lit(" .;"), F.col("p_name"), F.lit("\t  "), F.col("p_type"), F.lit(" ,: "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.clean_text(t).alias("cleaned"))


def _clean_name(c: str) -> str:
    s = _squeeze(c)
    cases = " ".join(f"WHEN starts_with(lower({s}), '{p}') THEN {_strip(f'substr({s}, {len(p) + 1})')}" for p in _NAME_LEADS)
    n = f"(CASE {cases} ELSE {s} END)"
    title = f"array_to_string(list_transform(regexp_extract_all({n}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda x: upper(x[1]) || lower(x[2:])), '')"
    return f"CASE WHEN {n} = upper({n}) AND {n} <> lower({n}) AND length({n}) > 5 THEN {title} ELSE {n} END"


@_query(f"{_RAW} SELECT k, {_clean_name('vendor_name')} AS vendor_name, {_clean_name('customer_name')} AS customer_name FROM raw_headers")
def name_clean(spark, sf_dir):
    return fx.raw_headers(spark, sf_dir).select("k", text.clean_name("vendor_name").alias("vendor_name"), text.clean_name("customer_name").alias("customer_name"))


_EDGE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}:\-.,]"


@_query(rf"SELECT doc_id, regexp_replace(text, '^{_EDGE}+|{_EDGE}+\z', '', 'g') AS answer FROM documents")
def answer_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_answer("text").alias("answer"))


@_query(rf"SELECT doc_id, coalesce(length({_strip('text')}), 0) < 50 AS scanned FROM documents")
def scanned_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_scanned("text").alias("scanned"))


_POST = f"WITH {_DATED}, post AS (SELECT k, trim({_squeeze('invoice_number')}, '.,;:') AS invoice_number, coalesce(iso, invoice_date) AS invoice_date, {_clean_name('vendor_name')} AS vendor_name, {_clean_name('customer_name')} AS customer_name, coalesce({_amount('total_amount')}, total_amount) AS total_amount, payment_due_date, invoice_date IS NOT NULL AND iso IS NULL AS date_kept, total_amount IS NOT NULL AND {_amount('total_amount')} IS NULL AS amount_kept FROM dated)"
_MISSING = "list_filter([CASE WHEN coalesce(trim(invoice_number), '') = '' THEN 'invoice_number' END, CASE WHEN coalesce(trim(total_amount), '') = '' THEN 'total_amount' END], lambda x: x IS NOT NULL)"


@_query(f"{_POST} SELECT k, {', '.join(FIELDS)}, CAST(CAST(date_kept AS INTEGER) + CAST(amount_kept AS INTEGER) + len({_MISSING}) AS INTEGER) AS n_warnings FROM post")
def postprocess_headers(spark, sf_dir):
    return postprocess.postprocess(fx.raw_headers(spark, sf_dir)).select("k", *FIELDS, F.size("warnings").alias("n_warnings"))


@_query(f"WITH {_DATED} SELECT k, iso IS NOT NULL AS date_ok, coalesce(CAST({_amount('total_amount')} AS DOUBLE) >= 0, FALSE) AS amount_ok, CAST({_amount('total_amount')} AS DOUBLE) AS value, payment_due_date > '1996-06-01' AS future, payment_due_date < '1996-06-01' AS past FROM dated")
def predicates(spark, sf_dir):
    then = F.lit("1996-06-01").cast("timestamp")
    return fx.raw_headers(spark, sf_dir).select("k", dates.is_valid_date("invoice_date").alias("date_ok"), amounts.is_valid_amount("total_amount").alias("amount_ok"), amounts.amount_value("total_amount").alias("value"), dates.is_future("payment_due_date", then).alias("future"), dates.is_past("payment_due_date", then).alias("past"))


@_query("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_fuzzy(spark, sf_dir):
    """Dates among words that no format and no pattern fits, as the fuzzy parser reads them."""
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, F.concat(F.date_format("o_orderdate", "d. MMMM"), F.lit(" of "), F.date_format("o_orderdate", "yyyy"))).when(k % 3 == 1, F.concat(F.lit("shipped "), F.date_format("o_orderdate", "EEEE, MMMM d, yyyy"))).otherwise(F.date_format("o_orderdate", "yyyy MMMM dd"))
    df = table(spark, sf_dir, "orders").select(k.alias("k"), said.alias("said"))
    return dates.with_normalized_date(df, "said", "iso", dt.date(2000, 1, 1)).select("k", "iso")


@_query(f"{_POST}, both_ AS (SELECT {', '.join(f'CAST(p.{f} IS DISTINCT FROM r.{f} AS INTEGER) AS {f}' for f in FIELDS)} FROM post p JOIN raw_headers r ON p.k = r.k) SELECT {', '.join(f'CAST(sum({f}) AS BIGINT) AS changed_{f}' for f in FIELDS)} FROM both_")
def change_summary(spark, sf_dir):
    raw = fx.raw_headers(spark, sf_dir)
    return postprocess.summary(raw, postprocess.postprocess(raw), "k")


# --- extraction ----------------------------------------------------------------------------------------------------

_BODY = "'Invoice Number: ' || invoice_number || chr(10) || 'Dated: ' || coalesce(strftime(CAST(payment_due_date AS DATE), '%m/%d/%Y'), '') || chr(10) || 'Bill To: ' || coalesce(customer_name, '') || chr(10) || 'Due Date: ' || strftime(CAST(payment_due_date AS DATE), '%d-%m-%Y') || chr(10) || 'Total: ' || coalesce(total_amount, '')"


def _fallback(field: str) -> str:
    found = ", ".join(f"nullif(trim(regexp_extract(body, '(?i){p}', 1)), '')" for p in _FALLBACK[field])
    return f"coalesce({found}) AS {field}"


@_query(f"{_HEADERS}, bodies AS (SELECT id AS k, {_BODY} AS body FROM headers) SELECT k, {', '.join(_fallback(f) for f in _FALLBACK)} FROM bodies")
def regex_fallback_fields(spark, sf_dir):
    return _bodies(spark, sf_dir).select("k", *[extract.regex_field(f, "body").alias(f) for f in extract.FALLBACK])


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.headers(spark, sf_dir)
    due = lambda p: F.date_format(F.col("payment_due_date").cast("date"), p)
    body = F.concat(F.lit("Invoice Number: "), F.col("invoice_number"), F.lit("\nDated: "), due("MM/dd/yyyy"), F.lit("\nBill To: "), F.col("customer_name"), F.lit("\nDue Date: "), due("dd-MM-yyyy"), F.lit("\nTotal: "), F.col("total_amount"))
    return h.select(F.col("id").alias("k"), body.alias("body"), *FIELDS)


def _filled(f: str) -> str:
    return f"CAST(coalesce({f}, '') <> '' AS INTEGER)"


_N_FILLED = " + ".join(_filled(f) for f in FIELDS)


@_query(f"{_HEADERS} SELECT id, round(({_N_FILLED}) / 6.0 * 100, 6) AS rate, list_filter([{', '.join(f'''CASE WHEN {f} = '' THEN '{f}' END''' for f in FIELDS)}], lambda x: x IS NOT NULL) AS missing FROM headers")
def extraction_rate(spark, sf_dir):
    return fx.headers(spark, sf_dir).select("id", F.round(extract.extraction_rate(), 6).alias("rate"), extract.missing().alias("missing"))


def _scores() -> F.Column:
    pairs = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f"{f}_confidence"))])
    return extract.positive_scores(pairs)


_SCORED = " + ".join(f"(CASE WHEN {f} <> '' AND {f}_confidence > 0 THEN 1 ELSE 0 END)" for f in FIELDS)
_SCORE_SUM = " + ".join(f"(CASE WHEN {f} <> '' AND {f}_confidence > 0 THEN {f}_confidence ELSE 0 END)" for f in FIELDS)


@_query(f"{_HEADERS} SELECT id, round(CASE WHEN ({_SCORED}) = 0 THEN 0.0 ELSE ({_SCORE_SUM}) / ({_SCORED}) END, 6) AS confidence FROM headers")
def avg_confidence(spark, sf_dir):
    return fx.headers(spark, sf_dir).withColumn("confidence_scores", _scores()).select("id", F.round(extract.average_confidence(), 6).alias("confidence"))


@_query(f"{_HEADERS} SELECT {', '.join(f'''coalesce({f}, '') AS {f}''' for f in FIELDS)}, round(({_N_FILLED}) / 6.0 * 100, 6) AS extraction_rate, {', '.join(f'{f}_confidence' for f in FIELDS)} FROM headers")
def flat_records(spark, sf_dir):
    df = extract.flat(fx.headers(spark, sf_dir).withColumn("confidence_scores", _scores()))
    return df.select(*FIELDS, F.round("extraction_rate", 6).alias("extraction_rate"), *[f"{f}_confidence" for f in FIELDS])


@_query(f"{_HEADERS} SELECT id, {', '.join(FIELDS)}, 'f.pdf' AS source_file, len(list_filter([{', '.join(f'{f}_confidence' for f in FIELDS)}], lambda x: x > 0)) AS n_scores, invoice_number_confidence AS score, TRUE AS success, 0 AS n_errors, '' AS model_name FROM headers")
def header_json(spark, sf_dir):
    """The extraction as JSON and back; what is not in it gets its default."""
    df = fx.headers(spark, sf_dir).withColumn("confidence_scores", _scores()).withColumn("source_file", F.lit("f.pdf"))
    back = df.select("id", extract.to_json().alias("json")).select("id", extract.from_json("json").alias("x"))
    return back.select("id", *[f"x.{f}" for f in FIELDS], "x.source_file", F.size("x.confidence_scores").cast("long").alias("n_scores"), F.coalesce(F.col("x.confidence_scores")["invoice_number"], F.lit(0.0)).alias("score"), "x.success", F.size("x.errors").alias("n_errors"), "x.model_name")


@_query(
    f"{_HEADERS}, bodies AS (SELECT id AS k, {_BODY} AS body, CASE WHEN id % 2 = 0 THEN invoice_number END AS n, CASE WHEN id % 3 = 0 THEN total_amount ELSE '' END AS a FROM headers), found AS (SELECT k, n, a, {', '.join(_fallback(f) for f in _FALLBACK)} FROM bodies) "
    "SELECT k, CASE WHEN coalesce(n, '') = '' THEN coalesce(invoice_number, n) ELSE n END AS invoice_number, CASE WHEN a = '' THEN coalesce(total_amount, a) ELSE a END AS total_amount, invoice_date, payment_due_date, "
    "CAST((coalesce(n, '') = '' AND invoice_number IS NOT NULL)::INTEGER + (a = '' AND total_amount IS NOT NULL)::INTEGER + (invoice_date IS NOT NULL)::INTEGER + (payment_due_date IS NOT NULL)::INTEGER AS INTEGER) AS n_warnings, "
    "CASE WHEN coalesce(n, '') = '' AND invoice_number IS NOT NULL THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END AS score FROM found"
)
def fallback_rows(spark, sf_dir):
    """Patterns fill what the model left empty, with their own confidence and a warning."""
    none = F.lit(None).cast("string")
    k = F.col("k")
    bodies = _bodies(spark, sf_dir).select("k", "body", F.when(k % 2 == 0, F.col("invoice_number")).alias("invoice_number"), none.alias("invoice_date"), F.when(k % 3 == 0, F.col("total_amount")).otherwise("").alias("total_amount"), none.alias("payment_due_date"), F.create_map(F.lit("invoice_number"), F.lit(0.9)).alias("confidence_scores"), F.lit(None).cast("array<string>").alias("warnings"))
    return extract.with_fallback(bodies, "body").select("k", "invoice_number", "total_amount", "invoice_date", "payment_due_date", F.size("warnings").alias("n_warnings"), F.col("confidence_scores")["invoice_number"].alias("score"))


@_query(f"{_HEADERS} SELECT id, nullif(vendor_name, '') AS vendor_name, nullif(customer_name, '') AS customer_name, CASE WHEN vendor_name_confidence > 0 THEN vendor_name_confidence ELSE 0.0 END AS vendor_score, CAST(4 + (customer_name = '')::INTEGER AS INTEGER) AS n_warnings FROM headers")
def answers_to_fields(spark, sf_dir):
    """Answers of a model, cleaned, with positive scores and a warning for each that is missing."""
    asked = lambda f: F.struct(F.lit("?").alias("question"), F.concat(F.lit(" :- "), F.col(f), F.lit(" .,")).alias("answer"), F.col(f"{f}_confidence").alias("confidence"))
    df = fx.headers(spark, sf_dir).select("id", F.create_map(F.lit("vendor_name"), asked("vendor_name"), F.lit("customer_name"), asked("customer_name")).alias("answers"))
    out = extract.from_answers(df)
    return out.select("id", "vendor_name", "customer_name", extract.confidence_of("vendor_name").alias("vendor_score"), F.size("warnings").alias("n_warnings"))


# --- validation ----------------------------------------------------------------------------------------------------


def _odd_dates() -> F.Column:
    k = F.col("o_orderkey")
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    return F.when(k % 6 == 0, F.lit("")).when(k % 6 == 1, F.lit("2024-02-30")).when(k % 6 == 2, F.concat(F.lit("2"), F.substring(d, 2, 10))).when(k % 6 == 3, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k % 6 == 4, F.concat(F.lit("2101"), F.substring(d, 5, 6))).otherwise(d)


_ODD_DATES = "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '2024-02-30' WHEN 2 THEN '2' || substr(strftime(o_orderdate, '%Y-%m-%d'), 2) WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 4 THEN '2101' || strftime(o_orderdate, '-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END"
_DATE_MSG = "CASE WHEN d = '' THEN 'Date is empty' WHEN t IS NULL THEN 'Invalid date format: ' || d WHEN year(t) < 2000 THEN 'Year ' || CAST(year(t) AS VARCHAR) || ' is too old' WHEN year(t) > 2100 THEN 'Year ' || CAST(year(t) AS VARCHAR) || ' is too far in future' ELSE 'Valid date' END"


@_query(f"SELECT k, {_DATE_MSG} = 'Valid date' AS ok, {_DATE_MSG} AS msg FROM (SELECT k, d, try_strptime(d, '%Y-%m-%d') AS t FROM (SELECT o_orderkey AS k, {_ODD_DATES} AS d FROM orders))")
def validate_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _odd_dates().alias("d")).select("k", validate.date_verdict("d").alias("v")).select("k", "v.ok", "v.msg")


_ODD_AMOUNTS = "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-' || format('{:.2f}', o_totalprice) WHEN 2 THEN 'about 5' WHEN 3 THEN '2000000000' ELSE format('{:.2f}', o_totalprice) END"
_AMOUNT_MSG = "CASE WHEN a = '' THEN 'Amount is empty' WHEN v IS NULL THEN 'Could not parse amount: ' || a WHEN v < 0 THEN 'Amount cannot be negative' WHEN v > 1e9 THEN 'Amount 2.0E9 exceeds maximum' ELSE 'Valid amount' END"


@_query(f"SELECT k, {_AMOUNT_MSG} = 'Valid amount' AS ok, {_AMOUNT_MSG} AS msg, coalesce(v BETWEEN 10 AND 1000000, FALSE) AS reasonable FROM (SELECT k, a, TRY_CAST(nullif(a, '') AS DOUBLE) AS v FROM (SELECT o_orderkey AS k, {_ODD_AMOUNTS} AS a FROM orders))")
def validate_amounts(spark, sf_dir):
    k = F.col("o_orderkey")
    plain = F.translate(F.format_number("o_totalprice", 2), ",", "")
    a = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("-"), plain)).when(k % 5 == 2, "about 5").when(k % 5 == 3, "2000000000").otherwise(plain)
    df = table(spark, sf_dir, "orders").select(k.alias("k"), a.alias("a"))
    return df.select("k", validate.amount_verdict("a").alias("v"), F.coalesce(validate.reasonable_total(F.col("a").try_cast("double")), F.lit(False)).alias("reasonable")).select("k", "v.ok", "v.msg", "reasonable")


_ODD_NAMES = "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' x ' WHEN 2 THEN '##' ELSE c_name END"


def _name_msg(what: str) -> str:
    return f"CASE WHEN n = '' THEN '{what} is empty' WHEN length({_strip('n')}) < 2 THEN '{what} too short' ELSE 'Valid {what[0].lower()}{what[1:]}' END"


_NUMBER_MSG = f"CASE WHEN n = '' THEN 'Invoice number is empty' WHEN length({_strip('n')}) < 2 THEN 'Invoice number too short' WHEN NOT regexp_matches(n, '[A-Za-z0-9]') THEN 'Invoice number must contain alphanumeric characters' ELSE 'Valid invoice number' END"


@_query(f"SELECT k, {_NUMBER_MSG} AS number, {_name_msg('Vendor name')} AS vendor, {_name_msg('Customer name')} AS customer, CASE WHEN n = '' THEN 'Field is empty' ELSE 'Field has value' END AS other FROM (SELECT c_custkey AS k, {_ODD_NAMES} AS n FROM customer)")
def validate_names(spark, sf_dir):
    k = F.col("c_custkey")
    n = F.when(k % 4 == 0, "").when(k % 4 == 1, " x ").when(k % 4 == 2, "##").otherwise(F.col("c_name"))
    df = table(spark, sf_dir, "customer").select(k.alias("k"), n.alias("n"))
    return df.select("k", validate.number_verdict("n").msg.alias("number"), validate.vendor_verdict("n").msg.alias("vendor"), validate.customer_verdict("n").msg.alias("customer"), validate.field_verdict("memo", "n").msg.alias("other"))


_LOW = f"list_filter([{', '.join(f'''CASE WHEN {f}_confidence > 0 AND {f}_confidence < 0.5 THEN '{f} (' || format('{{:.2f}}', {f}_confidence) || ')' END''' for f in FIELDS)}], lambda x: x IS NOT NULL)"


@_query(f"{_HEADERS} SELECT id, {_LOW} AS low FROM headers")
def low_confidence(spark, sf_dir):
    return fx.headers(spark, sf_dir).select("id", validate.low_confidence(_scores(), 0.5).alias("low"))


@_query(f"{_HEADERS} SELECT id, {_MISSING} AS missing FROM headers")
def required_missing(spark, sf_dir):
    return fx.headers(spark, sf_dir).select("id", validate.missing_fields(("invoice_number", "total_amount")).alias("missing"))


@_query(
    f"{_HEADERS}, t AS (SELECT *, try_strptime(nullif(invoice_date, ''), '%Y-%m-%d') AS d1, try_strptime(payment_due_date, '%Y-%m-%d') AS d2 FROM headers) "
    f"SELECT id, len({_MISSING}) = 0 AND coalesce(year(d1) BETWEEN 2000 AND 2100, TRUE) AND year(d2) BETWEEN 2000 AND 2100 AS is_valid, "
    f"CAST(len({_MISSING}) + CAST(coalesce(year(d1) NOT BETWEEN 2000 AND 2100, FALSE) AS INTEGER) + CAST(year(d2) NOT BETWEEN 2000 AND 2100 AS INTEGER) AS INTEGER) AS n_errors, "
    f"CAST(len({_LOW}) + CAST(coalesce(d2 < d1, FALSE) AS INTEGER) AS INTEGER) AS n_warnings FROM t"
)
def validate_record(spark, sf_dir):
    df = fx.headers(spark, sf_dir).withColumn("confidence_scores", _scores()).select("id", validate.validation().alias("v"))
    return df.select("id", "v.is_valid", F.size("v.errors").alias("n_errors"), F.size("v.warnings").alias("n_warnings"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) AS ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def due_after_invoice(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select(*ARRIVAL_ORDER, validate.due_after_invoice(day("o_orderdate"), day("l_shipdate")).ok.alias("ok"))


# --- store ---------------------------------------------------------------------------------------------------------

_ORDER = ", ".join(ARRIVAL_ORDER)
_MARKED = f"marked AS (SELECT *, row_number() OVER (PARTITION BY invoice_number, vendor_name ORDER BY {_ORDER}) = 1 AND (vendor_name <> '' OR invoice_number = '' OR row_number() OVER (PARTITION BY invoice_number ORDER BY {_ORDER}) = 1) AS stored FROM arrivals)"


@_query(f"{_with(fx.ARRIVALS, _MARKED)} SELECT {_ORDER}, stored, stored OR invoice_number = '' AS counted FROM marked")
def store_admit(spark, sf_dir):
    return store.admission(fx.arrivals(spark, sf_dir), ARRIVAL_ORDER).select(*ARRIVAL_ORDER, "stored", "counted")


@_query(f"{_with(fx.ARRIVALS, _MARKED)} SELECT count(*) AS rows, count(*) FILTER (stored) AS stored, count(*) FILTER (stored OR invoice_number = '') AS inserted, count(*) FILTER (NOT (stored OR invoice_number = '')) AS skipped FROM marked")
def store_admit_counts(spark, sf_dir):
    return store.admission_counts(fx.arrivals(spark, sf_dir), ARRIVAL_ORDER)


_ORDER2 = f"l_linenumber > 3, {_ORDER}"


@_query(
    f"{_with(fx.ARRIVALS)}, first AS (SELECT *, row_number() OVER (PARTITION BY invoice_number, vendor_name ORDER BY {_ORDER2}) = 1 AND (vendor_name <> '' OR invoice_number = '' OR row_number() OVER (PARTITION BY invoice_number ORDER BY {_ORDER2}) = 1) AS stored FROM arrivals) "
    f"SELECT {_ORDER}, invoice_number, vendor_name FROM first WHERE stored AND l_linenumber > 3"
)
def store_incremental_admit(spark, sf_dir):
    rows = fx.arrivals(spark, sf_dir)
    stored = store.admit(rows.where("l_linenumber <= 3"), ARRIVAL_ORDER)
    return store.admit(rows.where("l_linenumber > 3"), ARRIVAL_ORDER, stored)


@_query(f"{_with(fx.ARRIVALS)}, old AS (SELECT * FROM arrivals WHERE l_linenumber <= 3) SELECT {_ORDER} FROM arrivals a WHERE l_linenumber > 3 AND EXISTS (SELECT 1 FROM old o WHERE o.invoice_number = a.invoice_number AND (a.vendor_name = '' OR o.vendor_name = a.vendor_name))")
def store_exists(spark, sf_dir):
    rows = fx.arrivals(spark, sf_dir)
    return store.exists(rows.where("l_linenumber <= 3"), rows.where("l_linenumber > 3")).select(*ARRIVAL_ORDER)


def _search(where: str) -> str:
    return f"{_HEADERS} SELECT id, vendor_name, invoice_date, total_amount FROM headers WHERE {where}"


def _found(df: DataFrame) -> DataFrame:
    return df.select("id", "vendor_name", "invoice_date", "total_amount")


_REAL = "coalesce(TRY_CAST(nullif(total_amount, '') AS DOUBLE), 0)"


@_query(_search("vendor_name ILIKE '%dor 1%'"))
def store_search_vendor(spark, sf_dir):
    return _found(store.search(fx.headers(spark, sf_dir), vendor_name="DOR 1"))


@_query(_search("invoice_date >= '1996-01-01' AND invoice_date <= '1997-06-30'"))
def store_search_dates(spark, sf_dir):
    return _found(store.search(fx.headers(spark, sf_dir), date_from="1996-01-01", date_to="1997-06-30"))


@_query(_search(f"{_REAL} >= 1000 AND {_REAL} <= 200000"))
def store_search_amounts(spark, sf_dir):
    return _found(store.search(fx.headers(spark, sf_dir), min_amount=1000, max_amount=200000))


@_query(_search(f"vendor_name ILIKE '%vendor%' AND invoice_date >= '1995-01-01' AND {_REAL} <= 150000"))
def store_search_all(spark, sf_dir):
    return _found(store.search(fx.headers(spark, sf_dir), "vendor", "1995-01-01", None, None, 150000))


@_query(f"{_HEADERS} SELECT id, vendor_name, invoice_date, total_amount FROM headers WHERE invoice_number = 'INV-00000007' ORDER BY id LIMIT 1")
def store_lookup(spark, sf_dir):
    return _found(store.find(fx.headers(spark, sf_dir), "INV-00000007", "ignored"))


@_query(f"{_HEADERS} SELECT id, invoice_number FROM headers ORDER BY id DESC LIMIT 100")
def store_recent(spark, sf_dir):
    return store.recent(fx.headers(spark, sf_dir), 100).select("id", "invoice_number")


@_query(f"{_HEADERS} SELECT count(*) AS total_records, avg(success) AS success_rate, round(avg(average_confidence) FILTER (success = 1), 9) AS avg_confidence, count(DISTINCT vendor_name) AS unique_vendors FROM headers")
def store_stats(spark, sf_dir):
    return store.statistics(fx.headers(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 9))


@_query(f"{_HEADERS} SELECT id, invoice_number FROM headers WHERE NOT invoice_number = 'INV-00000007'")
def store_delete(spark, sf_dir):
    return store.delete(fx.headers(spark, sf_dir), "INV-00000007").select("id", "invoice_number")


@_query(f"{_with(fx.ARRIVALS)} SELECT {_ORDER}, row_number() OVER (ORDER BY {_ORDER}) AS id FROM arrivals")
def store_ids(spark, sf_dir):
    return store.with_ids(fx.arrivals(spark, sf_dir).select(*ARRIVAL_ORDER), ARRIVAL_ORDER).select(*ARRIVAL_ORDER, "id")


@_query(f"{_with(fx.ARRIVALS, _MARKED)} SELECT {_ORDER}, CAST(id - 1 AS BIGINT) AS id, padded FROM (SELECT {_ORDER}, row_number() OVER (ORDER BY {_ORDER}) AS id, repeat(invoice_number || '/' || vendor_name, 20) AS padded FROM arrivals)")
def store_ids_wide(spark, sf_dir):
    rows = fx.arrivals(spark, sf_dir).withColumn("padded", F.repeat(F.concat("invoice_number", F.lit("/"), "vendor_name"), 20))
    return store.with_ids(rows.select(*ARRIVAL_ORDER, "padded"), ARRIVAL_ORDER, start=-1)


@_query(f"{_with(fx.ARRIVALS, _MARKED)} SELECT {_ORDER}, invoice_number, vendor_name FROM marked WHERE stored")
def store_stream_admit(spark, sf_dir):
    """Arrivals as a stream of files, admitted batch by batch into a table of the shared folder."""
    at = shared_path(spark, "stream")
    # a pattern, as a stream takes no single file
    lines = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).parquet(f"{sf_dir}/lineitem.parque[t]")
    ingest.start(fx.as_arrivals(lines), f"{at}/table", f"{at}/state", ARRIVAL_ORDER).awaitTermination()
    return spark.read.parquet(f"{at}/table").drop("batch")


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS until, event_type, count(*) AS n FROM events GROUP BY ALL")
def arrival_counts(spark, sf_dir):
    return ingest.arrival_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour").withColumnRenamed("end", "until").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "until")})


@_query(f"{_HEADERS} SELECT " + ", ".join(f"coalesce({f}, '') AS {f}" for f in FIELDS) + f", id AS k, {', '.join(f"format('{{:.2f}}', CASE WHEN {f}_confidence > 0 THEN {f}_confidence ELSE 0.0 END) AS {f}_conf" for f in FIELDS)}, format('{{:.1f}}', ({_N_FILLED}) / 6.0 * 100) AS rate, CASE WHEN success = 1 THEN 'TRUE' ELSE '' END AS success FROM headers")
def workbook_sheets(spark, sf_dir):
    """The cells of the three sheets, side by side."""
    df = fx.headers(spark, sf_dir).withColumns({"confidence_scores": _scores(), "source_file": F.col("id").cast("string"), "success": F.col("success") == 1, "processing_time": F.lit(0.0), "extraction_timestamp": F.lit(""), "model_name": F.lit("")})
    number = F.col("Source File").cast("long").alias("k")
    data = workbook.data_sheet(df.withColumn("invoice_number", F.concat_ws("|", "invoice_number", "source_file")))
    data = data.select(F.substring_index("Invoice Number", "|", -1).cast("long").alias("k"), F.substring_index("Invoice Number", "|", 1).alias("invoice_number"), *[F.col(h).alias(f) for h, f in workbook.COLUMNS[1:]])
    conf = workbook.confidence_sheet(df).select(number, *[F.col(f"`{h} Conf.`").alias(f"{f}_conf") for h, f in workbook.COLUMNS])
    meta = workbook.metadata_sheet(df).select(number, F.col("Extraction Rate (%)").alias("rate"), F.col("Success").alias("success"))
    return data.join(conf, "k").join(meta, "k")


@_query(f"{_HEADERS} SELECT {', '.join(f"least(greatest(max(length({f})), {len(h)}) + 2, 50) AS {f}" for h, f in (('Invoice Number', 'invoice_number'), ('Invoice Date', 'invoice_date'), ('Vendor Name', 'vendor_name'), ('Customer Name', 'customer_name'), ('Total Amount', 'total_amount'), ('Payment Due Date', 'payment_due_date')))} FROM headers")
def workbook_widths(spark, sf_dir):
    made = workbook.widths(workbook.data_sheet(fx.headers(spark, sf_dir)))
    return made.select(*[F.col(h).cast("long").alias(f) for h, f in workbook.COLUMNS])


# --- evaluation ----------------------------------------------------------------------------------------------------

_BASE = r"regexp_extract(source_file, '[^/]*$', 0)"
_LOOKUP = (
    _with(fx.RAW_HEADERS, fx.HEADERS, fx.PREDICTIONS, fx.TRUTH)
    + f", keyed AS (SELECT DISTINCT key, idx FROM (SELECT source_file AS key, idx FROM truth UNION ALL SELECT {_BASE}, idx FROM truth)), best AS (SELECT key, max(idx) AS idx FROM keyed GROUP BY key)"
    + ", pairs AS (SELECT p.*, " + ", ".join(f"coalesce(t.{f}, '') AS gt_{f}" for f in FIELDS) + f", t.idx IS NOT NULL AS gt_found FROM predictions p LEFT JOIN best a ON a.key = p.source_file LEFT JOIN best b ON b.key = regexp_extract(p.source_file, '[^/]*$', 0) LEFT JOIN truth t ON t.idx = coalesce(a.idx, b.idx))"
)


@_query(f"{_LOOKUP} SELECT idx, gt_vendor_name, gt_total_amount, gt_found FROM pairs")
def gt_lookup(spark, sf_dir):
    return _pairs(spark, sf_dir).select("idx", "gt_vendor_name", "gt_total_amount", "gt_found")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.lookup(fx.predictions(spark, sf_dir), fx.truth(spark, sf_dir))


@_query(f"{_with(fx.RAW_HEADERS, fx.HEADERS, fx.TRUTH)} SELECT count(*) AS total_records, count(*) FILTER ({' AND '.join(f'''{f} <> \'\'''' for f in FIELDS)}) AS valid_records, count(*) FILTER (NOT ({' AND '.join(f'''{f} <> \'\'''' for f in FIELDS)})) AS invalid_records, {', '.join(f'''count(*) FILTER ({f} = \'\') AS missing_{f}''' for f in FIELDS)} FROM truth")
def gt_validate(spark, sf_dir):
    return evaluate.completeness(fx.truth(spark, sf_dir))


def _norm(c: str, field: str) -> str:
    s = _squeeze(f"lower(coalesce({c}, ''))")
    if "amount" in field:
        s = f"replace(regexp_replace({s}, '[^\\d.,]', '', 'g'), ',', '.')"
        return f"CASE WHEN regexp_matches({s}, '^(\\d+\\.?\\d*|\\.\\d+)$') THEN CAST(CAST({s} AS DOUBLE) AS VARCHAR) ELSE {s} END"
    return f"regexp_replace({s}, '[^\\d]', '', 'g')" if "date" in field else s


_COMPARED = (
    _LOOKUP
    + ", flat AS ("
    + " UNION ALL ".join(f"SELECT idx, '{f}' AS field, coalesce({f}, '') AS predicted, gt_{f} AS truth, {f}_confidence AS confidence, {_norm(f, f)} AS p, {_norm(f'gt_{f}', f)} AS t FROM pairs" for f in FIELDS)
    + "), sims AS (SELECT *, CASE WHEN p = '' OR t = '' THEN 0.0 ELSE 1 - levenshtein(p, t) / greatest(length(p), length(t)) END AS similarity FROM flat)"
    + ", compared AS (SELECT idx, field, predicted, truth, confidence, predicted <> '' AS extracted, similarity, truth <> '' AND p = t AS exact, truth <> '' AND (p = t OR similarity >= 0.8) AS partial FROM sims)"
)


@_query(f"{_COMPARED} SELECT idx, field, predicted, truth, confidence, extracted, exact, partial FROM compared")
def eval_compare(spark, sf_dir):
    return evaluate.compared(_pairs(spark, sf_dir), ["idx"])


@_query(f"{_with(fx.RAW_HEADERS, fx.HEADERS, fx.TRUTH)} SELECT source_file, {', '.join(FIELDS)} FROM truth")
def gt_json_layouts(spark, sf_dir):
    """Records from JSON of four layouts."""
    t = fx.truth(spark, sf_dir)
    fields = F.struct(*FIELDS)
    whole = F.struct("source_file", *FIELDS)
    forms = [F.to_json(F.array(whole)), F.to_json(F.struct(F.array(whole).alias("records"))), F.to_json(F.struct(F.array(F.struct(F.col("source_file").alias("filename"), fields.alias("fields"))).alias("invoices"))), F.to_json(F.create_map("source_file", fields))]
    text = F.coalesce(*[F.when(F.col("idx") % 4 == i, f) for i, f in enumerate(forms)])
    return ground_truth.parse_json(t.select(text.alias("value"))).drop("idx")


@_query(f"{_with(fx.RAW_HEADERS, fx.HEADERS, fx.TRUTH)} SELECT row_number() OVER (ORDER BY source_file, idx) - 1 AS idx, source_file, {', '.join(f"{f} || CASE WHEN idx % 5 = 0 THEN ' {chr(34)}x, y{chr(34)}' ELSE '' END AS {f}" if f == 'customer_name' else f for f in FIELDS)} FROM truth")
def gt_csv(spark, sf_dir):
    """Ground truth written as one CSV file, with quotes and commas in values, and read back in its order."""
    t = fx.truth(spark, sf_dir).withColumn("customer_name", F.concat("customer_name", F.when(F.col("idx") % 5 == 0, ' "x, y"').otherwise("")))
    at = shared_path(spark, "truth")
    t.orderBy("source_file", "idx").select("source_file", *FIELDS).coalesce(1).write.csv(f"{at}/truth.csv", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return ground_truth.read(spark, f"{at}/truth.csv").na.fill("")


@_query("SELECT * FROM (VALUES (0::BIGINT, 'sample_invoice_001.pdf', '2024-01-10', '1000.00'), (1, 'sample_invoice_002.pdf', '2024-01-11', '1050.00'), (2, 'sample_invoice_003.pdf', '2024-01-12', '1100.00')) t(idx, source_file, invoice_date, total_amount)")
def gt_sample(spark, sf_dir):
    return ground_truth.sample(spark).select("idx", "source_file", "invoice_date", "total_amount")


@_query(f"{_with(fx.RAW_HEADERS, fx.HEADERS, fx.TRUTH)} SELECT idx, source_file, vendor_name FROM truth WHERE idx = 7")
def gt_by_index(spark, sf_dir):
    return evaluate.by_index(fx.truth(spark, sf_dir), 7).select("idx", "source_file", "vendor_name")


@_query(f"{_HEADERS} SELECT p.id AS idx, p.vendor_name, t.customer_name AS gt_customer_name FROM headers p JOIN headers t ON p.id = t.id")
def eval_zipped(spark, sf_dir):
    h = fx.headers(spark, sf_dir).withColumnRenamed("id", "idx")
    return evaluate.zipped(h, h).select("idx", "vendor_name", "gt_customer_name")


@_query(f"{_COMPARED} SELECT idx AS sample_index, field, predicted, truth AS ground_truth, exact AS exact_match, partial AS partial_match, confidence, extracted FROM compared")
def eval_detailed(spark, sf_dir):
    """The detailed results, one row a field again."""
    found = reports.detailed(_pairs(spark, sf_dir))
    return found.select("sample_index", F.explode("comparison").alias("field", "c")).select("sample_index", "field", "c.*")


@_query(f"{_COMPARED} SELECT idx, round(similarity, 9) AS similarity FROM compared WHERE field = 'vendor_name'")
def eval_similarity(spark, sf_dir):
    p, t = (compare.comparable("vendor_name", c) for c in ("vendor_name", "gt_vendor_name"))
    return _pairs(spark, sf_dir).select("idx", F.round(compare.similarity(p, t), 9).alias("similarity"))


_RUNNING = "round(list_reduce(list({'i': idx, 'c': confidence} ORDER BY idx), lambda a, x: {'i': x.i, 'c': CASE WHEN x.c > 0 THEN (a.c * x.i + x.c) / (x.i + 1) ELSE a.c END}, {'i': 0::BIGINT, 'c': 0::DOUBLE}).c, 6)"
_COUNTS = "count(*) AS total_samples, count(*) FILTER (extracted) AS extracted_count, count(*) FILTER (NOT extracted) AS missing_count, count(*) FILTER (extracted AND exact) AS correct_count, count(*) FILTER (extracted AND partial) AS partial_match_count"
_RATES = "round(extracted_count / total_samples, 9) AS extraction_rate, round(missing_count / total_samples, 9) AS missing_rate, round(correct_count / total_samples, 9) AS accuracy, round(partial_match_count / total_samples, 9) AS partial_accuracy"
_METRICS = f"{_COMPARED}, counted AS (SELECT field, {_COUNTS}, {_RUNNING} AS avg_confidence FROM compared GROUP BY field), metrics AS (SELECT *, {_RATES} FROM counted)"
_RATE_NAMES = ("extraction_rate", "missing_rate", "accuracy", "partial_accuracy")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.field_metrics(evaluate.compared(_pairs(spark, sf_dir), ["idx"]), scores=evaluate.confidences(fx.predictions(spark, sf_dir)))
    return m.withColumns({c: F.round(c, 9) for c in _RATE_NAMES}).withColumn("avg_confidence", F.round("avg_confidence", 6))


@_query(f"{_METRICS} SELECT * FROM metrics")
def eval_field_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@_query(f"{_METRICS} SELECT round(avg(accuracy), 6) AS overall_accuracy, round(avg(extraction_rate), 6) AS overall_extraction_rate, round(avg(avg_confidence), 5) AS avg_confidence, max(total_samples) AS total_samples FROM metrics")
def eval_overall(spark, sf_dir):
    o = evaluate.overall(_metrics(spark, sf_dir))
    return o.select(F.round("overall_accuracy", 6).alias("overall_accuracy"), F.round("overall_extraction_rate", 6).alias("overall_extraction_rate"), F.round("avg_confidence", 5).alias("avg_confidence"), "total_samples")


@_query(f"{_COMPARED} SELECT field, {_RUNNING} AS avg_confidence FROM compared GROUP BY field")
def eval_running_confidence(spark, sf_dir):
    rows = evaluate.running_confidence(evaluate.confidences(fx.predictions(spark, sf_dir)))
    return rows.withColumn("avg_confidence", F.round("avg_confidence", 6))


@_query(f"{_METRICS} SELECT field, CASE WHEN accuracy >= 0.9 THEN 'good' WHEN accuracy >= 0.7 THEN 'medium' ELSE 'poor' END AS band FROM metrics")
def report_bands(spark, sf_dir):
    return _metrics(spark, sf_dir).select("field", evaluate.band("accuracy").alias("band"))


# --- layout --------------------------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.words(spark, sf_dir)
    names = ["text", "left", "top", "width", "height", "conf", "line_num"]
    pages = w.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_num", "place", *[n for n in names if n != "line_num"]))).alias("w"))
    return layout.words_from_engine(pages.select("page_id", *[F.col("w")[n].alias(n) for n in names]))


@_query(f"{_with(fx.WORDS)} SELECT * FROM words")
def ocr_words(spark, sf_dir):
    return _words(spark, sf_dir)


@_query(f"{_with(fx.WORDS)} SELECT page_id, line_index, string_agg(text, ' ' ORDER BY x1, word_index) AS text, round(avg(confidence), 6) AS average_confidence, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS word_count FROM words GROUP BY page_id, line_index")
def ocr_lines(spark, sf_dir):
    return layout.lines(_words(spark, sf_dir)).withColumn("average_confidence", F.round("average_confidence", 6))


@_query(f"{_with(fx.WORDS)}, l AS (SELECT page_id, line_index, string_agg(text, ' ' ORDER BY x1, word_index) AS line, sum(confidence) AS c, count(*) AS n FROM words GROUP BY ALL) SELECT page_id, string_agg(line, chr(10) ORDER BY line_index) AS text, CAST(sum(n) AS BIGINT) AS word_count, count(*) AS line_count, round(sum(c) / sum(n), 6) AS average_confidence FROM l GROUP BY page_id")
def ocr_page_text(spark, sf_dir):
    return layout.page_text(_words(spark, sf_dir)).withColumn("average_confidence", F.round("average_confidence", 6))


@_query(f"{_with(fx.WORDS)} SELECT page_id, string_agg(text, '|' ORDER BY word_index) AS words, count(*) AS n_words, count(DISTINCT line_index) AS n_lines, min(x1) AS x1, max(y2) AS y2 FROM words GROUP BY page_id")
def page_json(spark, sf_dir):
    """Pages as JSON and back."""
    box = "struct<x1:int,y1:int,x2:int,y2:int>"
    kind = f"struct<text:string,word_count:bigint,line_count:bigint,words:array<struct<word_index:int,text:string,bbox:{box}>>,lines:array<struct<line_index:int,text:string,bbox:{box}>>>"
    back = layout.serialised(_words(spark, sf_dir)).select("page_id", F.from_json("json", kind).alias("p"))
    return back.select("page_id", F.array_join("p.words.text", "|").alias("words"), F.col("p.word_count").alias("n_words"), F.size("p.lines").cast("long").alias("n_lines"), F.array_min("p.words.bbox.x1").alias("x1"), F.array_max("p.lines.bbox.y2").alias("y2"))


@_query(f"{_with(fx.WORDS)}, n AS (SELECT page_id, count(*) AS n FROM words WHERE page_id % 7 <> 0 GROUP BY page_id) SELECT doc_id AS page_id, CAST(coalesce(n, 0) AS INTEGER) AS n_words, n IS NULL AS is_empty FROM documents LEFT JOIN n ON page_id = doc_id")
def page_nested(spark, sf_dir):
    """Words by page, with the pages that have none."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"))
    return layout.nested(_words(spark, sf_dir).where("page_id % 7 <> 0"), pages=pages).select("page_id", F.size("words").alias("n_words"), "is_empty")


def _norm_box(c: str, size: int) -> str:
    return f"CAST(greatest(0, least(1000, trunc({c} * 1000 / {size}))) AS INTEGER) AS n{c}"


@_query(f"{_with(fx.WORDS)} SELECT page_id, word_index, {', '.join(_norm_box(c, n) for c, n in (('x1', 2480), ('y1', 3508), ('x2', 2480), ('y2', 3508)))} FROM words")
def bbox_normalize(spark, sf_dir):
    w = _words(spark, sf_dir).withColumns({"image_width": F.lit(2480), "image_height": F.lit(3508)})
    return layout.normalize_boxes(w).select("page_id", "word_index", "nx1", "ny1", "nx2", "ny2")


@_query(f"{_with(fx.WORDS)} SELECT page_id, word_index, x2 - x1 AS width, y2 - y1 AS height, (x1 + x2) // 2 AS center_x, (y1 + y2) // 2 AS center_y FROM words")
def bbox_geometry(spark, sf_dir):
    return _words(spark, sf_dir).select("page_id", "word_index", layout.width().alias("width"), layout.height().alias("height"), layout.center().x.alias("center_x"), layout.center().y.alias("center_y"))


@_query("SELECT p_partkey AS k, least(a, b, c) AS x1, least(10, p_size) AS y1, greatest(a, b, c) AS x2, greatest(10, p_size) AS y2 FROM (SELECT p_partkey, p_size, CAST(p_partkey % 50 AS INTEGER) AS a, CAST(p_partkey % 70 + 5 AS INTEGER) AS b, CAST(p_partkey % 30 + 9 AS INTEGER) AS c FROM part)")
def bbox_quad(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    point = lambda x, y: F.array(x.cast("double"), y)
    quad = F.array(point(k % 50, F.lit(10.0)), point(k % 70 + 5, F.lit(10.0)), point(k % 30 + 9, size), point(k % 50, size))
    return table(spark, sf_dir, "part").select(k.alias("k"), layout.quad_box(quad).alias("b")).select("k", "b.*")


@_query(f"{_with(fx.WORDS)} SELECT page_id, word_index, confidence FROM words WHERE confidence >= 60")
def words_confident(spark, sf_dir):
    return layout.confident(_words(spark, sf_dir), 60).select("page_id", "word_index", "confidence")


@_query(f"{_with(fx.WORDS)} SELECT page_id, list(text ORDER BY word_index) AS words, list([CAST(greatest(0, least(1000, trunc(x1 * 1000 / 2480))) AS INTEGER), CAST(greatest(0, least(1000, trunc(y1 * 1000 / 3508))) AS INTEGER), CAST(greatest(0, least(1000, trunc(x2 * 1000 / 2480))) AS INTEGER), CAST(greatest(0, least(1000, trunc(y2 * 1000 / 3508))) AS INTEGER)] ORDER BY word_index) AS boxes FROM words GROUP BY page_id")
def layout_format(spark, sf_dir):
    w = _words(spark, sf_dir).withColumns({"image_width": F.lit(2480), "image_height": F.lit(3508)})
    return layout.model_input(layout.normalize_boxes(w))


@_query("SELECT k, CASE WHEN w <= 2480 AND h <= 3508 THEN w ELSE CAST(floor(w * r) AS INTEGER) END AS width, CASE WHEN w <= 2480 AND h <= 3508 THEN h ELSE CAST(floor(h * r) AS INTEGER) END AS height, w < 500 OR h < 500 AS too_small FROM (SELECT *, least(2480.0::DOUBLE / w, 3508.0::DOUBLE / h) AS r FROM (SELECT p_partkey AS k, CAST(200 + p_partkey * 37 % 5000 AS INTEGER) AS w, CAST(300 + p_partkey * 53 % 6000 AS INTEGER) AS h FROM part))")
def image_resize_dims(spark, sf_dir):
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select(k.alias("k"), (200 + k * 37 % 5000).cast("int").alias("w"), (300 + k * 53 % 6000).cast("int").alias("h"))
    return df.select("k", layout.resized("w", "h").alias("s"), layout.too_small("w", "h").alias("too_small")).select("k", "s.*", "too_small")


# --- files ---------------------------------------------------------------------------------------------------------

_NAMES = "CASE page_id % 6 WHEN 0 THEN 'in/scan ' || page_id || '.PDF' WHEN 1 THEN url WHEN 2 THEN '.hidden' WHEN 3 THEN 'a/b.c/photo.JpG' WHEN 4 THEN 'note.tar.gz' ELSE ' ..' END"


def _names() -> F.Column:
    k = F.col("page_id")
    return F.when(k % 6 == 0, F.concat(F.lit("in/scan "), k.cast("string"), F.lit(".PDF"))).when(k % 6 == 1, F.col("url")).when(k % 6 == 2, ".hidden").when(k % 6 == 3, "a/b.c/photo.JpG").when(k % 6 == 4, "note.tar.gz").otherwise(" ..")


_EXT = r"lower(CASE WHEN regexp_matches(b, '^..*\.[^.]+$') THEN regexp_extract(b, '(\.[^.]+)$', 1) ELSE '' END)"


@_query(rf"SELECT page_id, {_EXT} AS extension, CASE WHEN {_EXT} = '.pdf' THEN 'pdf' WHEN {_EXT} IN ('.jpg', '.jpeg', '.png', '.tiff', '.tif', '.bmp') THEN 'image' END AS file_type FROM (SELECT page_id, regexp_extract(regexp_replace(n, '/+$', ''), '[^/]*$', 0) AS b FROM (SELECT page_id, {_NAMES} AS n FROM pages))")
def file_type_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", _names().alias("n")).select("page_id", files.extension("n").alias("extension"), files.file_type("n").alias("file_type"))


@_query(rf"SELECT page_id, coalesce(nullif(trim(regexp_replace(n, '[<>:\"/\\|?*\x00-\x1f]', '_', 'g'), '. '), ''), 'unnamed') AS name FROM (SELECT page_id, {_NAMES} AS n FROM pages)")
def filename_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.safe_filename(_names()).alias("name"))


_LADDER = " ".join(f"WHEN n < {1024 ** (i + 1)} THEN format('{{:.1f}} {u}', n / {1024.0 ** i})" for i, u in enumerate(_SIZES))


@_query(f"SELECT k, CASE {_LADDER} ELSE format('{{:.1f}} PB', n / {1024.0 ** 5}) END AS size FROM (SELECT p_partkey AS k, CAST((p_partkey * 1024 + 256) * CAST(pow(1024, p_partkey % 5) AS BIGINT) AS DOUBLE) AS n FROM part)")
def file_size_format(spark, sf_dir):
    k = F.col("p_partkey")
    # as doubles, which hold these products exactly where a long overflows
    n = (k.cast("double") * 1024 + 256) * F.pow(F.lit(1024), k % 5).cast("long")
    return table(spark, sf_dir, "part").select(k.alias("k"), files.format_size(n).alias("size"))


@_query("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM orders")
def timestamp_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), files.timestamp_text(F.col("o_orderdate").cast("timestamp")).alias("stamp"))


@_query("SELECT c_custkey AS k, 'a' AS a, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'b' END AS b, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS c FROM customer")
def settings_merge(spark, sf_dir):
    k = F.col("c_custkey")
    base = F.create_map(F.lit("a"), F.lit("a"), F.lit("b"), F.lit("b"))
    merged = maps.merge_maps(base, F.create_map(F.when(k % 2 == 0, "b").otherwise("c"), F.col("c_name")))
    return table(spark, sf_dir, "customer").select(k.alias("k"), merged.alias("m")).select("k", *[F.try_element_at("m", F.lit(x)).alias(x) for x in "abc"])
