"""Inputs derived from the star schema: raw headers, arrivals, words, predictions and truth.

Each has a DuckDB twin of the same name, so queries and oracles start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.config import FIELDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and the six fields as an engine might read them: five amount and six date forms, some missing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = F.col("o_orderkey")
    d = lambda p: F.date_format("o_orderdate", p)
    date = F.when(k % 6 == 0, d("MM/dd/yyyy")).when(k % 6 == 1, d("yyyy-MM-dd")).when(k % 6 == 2, d("MMMM d, yyyy")).when(k % 6 == 3, d("dd-MM-yyyy")).when(k % 6 == 4, d("dd.MM.yyyy")).otherwise(F.concat(F.lit("Invoice Date: "), d("MM/dd/yyyy")))
    us = F.format_number("o_totalprice", 2)
    plain = F.translate(us, ",", "")
    amount = F.when(k % 5 == 0, F.concat(F.lit("$"), us)).when(k % 5 == 1, F.concat(F.lit("€ "), F.translate(us, ",.", ".,"))).when(k % 5 == 2, F.concat(plain, F.lit(" USD"))).when(k % 5 == 3, plain).otherwise(F.lit("n/a"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(s, k % 10 + 1 == F.col("s_suppkey"), "left")
    return joined.select(
        k.alias("k"),
        F.concat(F.lit("INV-"), F.lpad(k.cast("string"), 8, "0"), F.when(k % 4 == 0, ";").otherwise("")).alias("invoice_number"),
        F.when(k % 11 != 0, date).alias("invoice_date"),
        F.when(k % 3 == 0, F.upper("s_name")).otherwise(F.concat(F.lit("  Vendor:  "), F.col("s_name"))).alias("vendor_name"),
        F.when(k % 13 != 0, F.concat(F.lit("Bill To: "), F.col("c_name"))).alias("customer_name"),
        F.when(k % 17 != 0, amount).alias("total_amount"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (k * 7 % 61 - 10).cast("int")), "yyyy-MM-dd").alias("payment_due_date"),
    )


RAW_HEADERS = """raw_headers AS (
  SELECT o_orderkey AS k,
    'INV-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || CASE WHEN o_orderkey % 4 = 0 THEN ';' ELSE '' END AS invoice_number,
    CASE WHEN o_orderkey % 11 <> 0 THEN CASE o_orderkey % 6
      WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y')
      WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 4 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE 'Invoice Date: ' || strftime(o_orderdate, '%m/%d/%Y') END END AS invoice_date,
    CASE WHEN o_orderkey % 3 = 0 THEN upper(s_name) ELSE '  Vendor:  ' || s_name END AS vendor_name,
    CASE WHEN o_orderkey % 13 <> 0 THEN 'Bill To: ' || c_name END AS customer_name,
    CASE WHEN o_orderkey % 17 <> 0 THEN CASE o_orderkey % 5
      WHEN 0 THEN '$' || format('{:,.2f}', o_totalprice) WHEN 1 THEN '€ ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,')
      WHEN 2 THEN format('{:.2f}', o_totalprice) || ' USD' WHEN 3 THEN format('{:.2f}', o_totalprice) ELSE 'n/a' END END AS total_amount,
    strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7 % 61 - 10 AS INTEGER), '%Y-%m-%d') AS payment_due_date
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON o_orderkey % 10 + 1 = s_suppkey
)"""


def scores(k: str = "k") -> list:
    """Confidence of each field by key: hundredths, some of them 0."""
    return [((F.col(k) * 37 + i * 11) % 101 / 100.0).alias(f"{f}_confidence") for i, f in enumerate(FIELDS)]


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean headers: id, the six fields with ISO dates and plain amounts, confidences, success and mean confidence."""
    raw = raw_headers(spark, sf_dir).alias("r")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    k = F.col("k")
    rows = raw.join(o, k == F.col("o_orderkey"))
    made = {
        "invoice_number": F.concat(F.lit("INV-"), F.lpad(k.cast("string"), 8, "0")),
        "invoice_date": F.when(k % 11 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        "vendor_name": F.concat(F.lit("Vendor "), (k % 97).cast("string")),
        "customer_name": F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("Customer "), (k % 1009).cast("string"))),
        "total_amount": F.when(k % 17 == 0, "").otherwise(F.translate(F.format_number("o_totalprice", 2), ",", "")),
    }
    out = rows.select(k.alias("id"), *[made.get(f, F.col(f)).alias(f) for f in FIELDS], *scores(), (k % 10 != 3).cast("int").alias("success"))
    return out.withColumn("average_confidence", F.col("id") % 100 / 100.0)


HEADERS = f"""headers AS (
  SELECT k AS id, 'INV-' || lpad(CAST(k AS VARCHAR), 8, '0') AS invoice_number,
    CASE WHEN k % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date,
    'Vendor ' || CAST(k % 97 AS VARCHAR) AS vendor_name,
    CASE WHEN k % 13 = 0 THEN '' ELSE 'Customer ' || CAST(k % 1009 AS VARCHAR) END AS customer_name,
    CASE WHEN k % 17 = 0 THEN '' ELSE format('{{:.2f}}', o_totalprice) END AS total_amount, payment_due_date,
    {', '.join(f"(k * 37 + {i * 11}) % 101 / 100.0 AS {f}_confidence" for i, f in enumerate(FIELDS))},
    CAST(k % 10 <> 3 AS INTEGER) AS success, k % 100 / 100.0 AS average_confidence
  FROM raw_headers JOIN orders ON k = o_orderkey
)"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as (invoice, vendor) rows in the order of four keys, some without number or vendor."""
    return as_arrivals(table(spark, sf_dir, "lineitem"))


def as_arrivals(lines: DataFrame) -> DataFrame:
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_partkey") % 13 == 0, "").otherwise(F.col("l_orderkey").cast("string")).alias("invoice_number"),
        F.when(F.col("l_partkey") % 17 == 0, "").otherwise(F.col("l_suppkey").cast("string")).alias("vendor_name"),
    )


ARRIVAL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ARRIVALS = """arrivals AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_partkey % 13 = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS invoice_number,
    CASE WHEN l_partkey % 17 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS vendor_name
  FROM lineitem
)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recognised words: a box and a confidence for each, some negative."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_num", "line"))
    w = d.select("page_id", "line_num", F.posexplode(F.split("line", " ")).alias("place", "text"))
    return w.select(
        "page_id",
        "line_num",
        "place",
        "text",
        (F.col("place") * 60).alias("left"),
        (F.col("line_num") * 40).alias("top"),
        (F.length("text") * 10).alias("width"),
        F.lit(30).alias("height"),
        ((F.col("page_id") * 31 + F.col("place") * 7) % 103 - 2).cast("double").alias("conf"),
    )


WORDS = """engine_words AS (
  SELECT page_id, CAST(line_num AS INTEGER) AS line_num, CAST(place AS INTEGER) AS place, t AS text, CAST(place * 60 AS INTEGER) AS "left", CAST(line_num * 40 AS INTEGER) AS top, CAST(length(t) * 10 AS INTEGER) AS width, 30 AS height,
    CAST((page_id * 31 + place * 7) % 103 - 2 AS DOUBLE) AS conf
  FROM (SELECT page_id, line_num, unnest(ws) AS t, unnest(range(len(ws))) AS place
        FROM (SELECT page_id, line_num, string_split(line, ' ') AS ws
              FROM (SELECT doc_id AS page_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_num FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))
), words AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line_num, place) - 1 AS INTEGER) AS word_index, text,
    "left" AS x1, top AS y1, "left" + width AS x2, top + height AS y2, greatest(conf, 0.0) AS confidence, line_num AS line_index
  FROM engine_words WHERE trim(text, ' ' || chr(9) || chr(13)) <> '' AND width > 0
)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, source_file, fields and confidences: truth with lost characters, other amount forms and gaps."""
    h = headers(spark, sf_dir)
    k = F.col("id")
    clipped = F.when(k % 7 == 0, F.substring("vendor_name", 1, 7)).otherwise(F.upper("vendor_name"))
    amount = F.when((k % 5 == 0) & (F.col("total_amount") != ""), F.concat(F.lit("$"), F.col("total_amount"))).otherwise(F.col("total_amount"))
    return h.select(
        k.alias("idx"),
        F.when(k % 2 == 0, F.concat(F.lit("in/batch/"), F.col("invoice_number"), F.lit(".pdf"))).otherwise(F.concat(F.col("invoice_number"), F.lit(".pdf"))).alias("source_file"),
        F.when(k % 19 == 0, F.lit(None)).otherwise(F.col("invoice_number")).alias("invoice_number"),
        F.when(k % 23 == 0, F.lit("")).otherwise(F.col("invoice_date")).alias("invoice_date"),
        clipped.alias("vendor_name"),
        F.concat(F.lit(" "), F.col("customer_name")).alias("customer_name"),
        amount.alias("total_amount"),
        F.col("payment_due_date"),
        *[f"{f}_confidence" for f in FIELDS],
    )


PREDICTIONS = f"""predictions AS (
  SELECT id AS idx, CASE WHEN id % 2 = 0 THEN 'in/batch/' || invoice_number || '.pdf' ELSE invoice_number || '.pdf' END AS source_file,
    CASE WHEN id % 19 = 0 THEN NULL ELSE invoice_number END AS invoice_number,
    CASE WHEN id % 23 = 0 THEN '' ELSE invoice_date END AS invoice_date,
    CASE WHEN id % 7 = 0 THEN substr(vendor_name, 1, 7) ELSE upper(vendor_name) END AS vendor_name,
    ' ' || customer_name AS customer_name,
    CASE WHEN id % 5 = 0 AND total_amount <> '' THEN '$' || total_amount ELSE total_amount END AS total_amount,
    payment_due_date, {', '.join(f'{f}_confidence' for f in FIELDS)}
  FROM headers
)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth: a record a header, every third by full path, with later corrections of some."""
    h = headers(spark, sf_dir)
    k = F.col("id")
    name = F.concat(F.when(k % 3 == 0, "in/batch/").otherwise(""), F.col("invoice_number"), F.lit(".pdf"))
    first = h.where(k % 29 != 0).select(k.alias("idx"), name.alias("source_file"), *FIELDS)
    again = h.where((k % 31 == 0) & (k % 29 != 0)).select((k + 100_000_000).alias("idx"), F.concat(F.col("invoice_number"), F.lit(".pdf")).alias("source_file"), *[F.lit("CORRECTED").alias(f) if f == "vendor_name" else F.col(f) for f in FIELDS])
    return first.unionByName(again)


TRUTH = f"""truth AS (
  SELECT id AS idx, CASE WHEN id % 3 = 0 THEN 'in/batch/' ELSE '' END || invoice_number || '.pdf' AS source_file, {', '.join(FIELDS)} FROM headers WHERE id % 29 <> 0
  UNION ALL
  SELECT id + 100000000, invoice_number || '.pdf', {', '.join("'CORRECTED'" if f == 'vendor_name' else f for f in FIELDS)} FROM headers WHERE id % 31 = 0 AND id % 29 <> 0
)"""
