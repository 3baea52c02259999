import random

from pyspark.sql import functions as F

from quillstone.operators import store
from quillstone.streaming import ingest


def replay(rows):
    """What one-by-one inserts do: the existence check, then the uniqueness of (number, vendor)."""
    table, out = set(), []
    for number, vendor in rows:
        if number and any(n == number and (not vendor or v == vendor) for n, v in table):
            out.append((False, False))
            continue
        fresh = (number, vendor) not in table
        table.add((number, vendor))
        out.append((fresh, True))
    return out


def test_admission_replays_inserts(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice(["", "1", "2", "3"]), rng.choice(["", "A", "B"])) for g in range(300) for i in range(rng.randint(1, 8))]
    # groups are kept apart by the vendor's and number's prefix, which the empty texts do not have
    want, got = {}, {}
    for g in range(300):
        part = [(n, v) for gg, _, n, v in rows if gg == g]
        want[g] = replay(part)
    df = spark.createDataFrame(rows, "g int, i int, n string, v string")
    for g in (0, 1, 2, 3, 4, 5, 6, 7):
        marked = store.admission(df.where(F.col("g") == g), ["i"], "n", "v").orderBy("i").collect()
        got[g] = [(r.stored, r.counted) for r in marked]
        assert got[g] == want[g]


def test_golden_sequence(spark):
    rows = [(i, n, v) for i, (n, v) in enumerate([("1", "A"), ("1", "A"), ("1", ""), ("1", "B"), ("", "A"), ("", "A")])]
    marked = store.admission(spark.createDataFrame(rows, "i int, invoice_number string, vendor_name string"), ["i"]).orderBy("i").collect()
    assert [int(r.stored) for r in marked] == [1, 0, 0, 1, 1, 0]
    assert [int(r.counted) for r in marked] == [1, 0, 0, 1, 1, 1]
    assert store.admission_counts(spark.createDataFrame(rows, "i int, invoice_number string, vendor_name string"), ["i"]).first().asDict() == {"rows": 6, "stored": 3, "inserted": 4, "skipped": 2}


def test_search_and_statistics(spark):
    rows = [(1, "a", "2024-01-01", "Acme", "12.5abc", 1, 0.5), (2, "b", "", "ACME 2", "", 0, 0.9), (3, "c", "2024-02-01", "Other", "-3", 1, 1.0)]
    df = spark.createDataFrame(rows, "id long, invoice_number string, invoice_date string, vendor_name string, total_amount string, success int, average_confidence double")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(store.search(df, vendor_name="acme")) == [1, 2]
    assert ids(store.search(df, min_amount=0)) == [1, 2]
    assert ids(store.search(df, max_amount=12)) == [3, 2]
    assert ids(store.search(df, date_from="2024-01-15")) == [3]
    assert ids(store.recent(df, 0)) == [3, 2, 1] and ids(store.recent(df, 1)) == [3]
    assert ids(store.delete(df, "b")) == [1, 3]
    assert store.statistics(df).first().asDict() == {"total_records": 3, "success_rate": 2 / 3, "avg_confidence": 0.75, "unique_vendors": 3}
    assert store.statistics(df.limit(0)).first().asDict() == {"total_records": 0, "success_rate": 0.0, "avg_confidence": 0.0, "unique_vendors": 0}


def test_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    got = store.with_ids(df, ["x"], start=5).orderBy("id").collect()
    assert [r.id for r in got] == list(range(6, 1006))
    assert [r.x for r in got] == sorted(r.x for r in got)


def test_ids_of_wide_rows(spark):
    """Adaptive execution joins small partitions differently with and without a wide column."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("65536", "-1", "64"), strict=True):
            spark.conf.set(k, v)
        df = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("x"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("wide"))
        got = [(r.id, r.x) for r in store.with_ids(df, ["x"]).select("id", "x", F.length("wide")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(i for i, _ in got) == list(range(1, 20001)) and [x for _, x in sorted(got)] == sorted(x for _, x in got)


def test_patterns_of_names(spark):
    df = spark.createDataFrame([("ÄRGER 50%",), ("a\\b",), ("A_B",), (None,)], "vendor_name string")
    found = lambda p: {r.vendor_name for r in store.search(df, vendor_name=p, ordered=False).collect()}
    assert found("ärger") == set() and found("Ärger") == {"ÄRGER 50%"}
    assert found("rger") == {"ÄRGER 50%"} and found("\\B") == {"a\\b"} and found("a_b") == {"a\\b", "A_B"}


def test_admission_of_equal_rows_and_hot_keys(spark):
    rows = [("", "")] * 500 + [("7", "")] * 300 + [("7", "A")] * 300 + [(None, None)] * 50
    df = spark.createDataFrame([(1, n, v) for n, v in rows], "i int, invoice_number string, vendor_name string").repartition(5)
    marked = store.admission(df, ["i"])
    kept = sorted((r.invoice_number or "", r.vendor_name or "") for r in marked.where("stored").collect())
    assert marked.count() == len(rows) and kept.count(("", "")) == 1 and kept.count(("7", "A")) == 1 and kept.count(("7", "")) <= 1


def test_batches_of_a_stream_match_one_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", "1", "2", "3", "4"]), rng.choice(["", "A", "B"])) for i in range(60)]
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for b in range(3):
        spark.createDataFrame(rows[20 * b : 20 * b + 20], "i int, invoice_number string, vendor_name string").coalesce(1).write.mode("append").parquet(source)
    run = ingest.admit_batch(table, ["i"])
    for b in range(3):
        run(spark.createDataFrame(rows[20 * b : 20 * b + 20], "i int, invoice_number string, vendor_name string"), b)
    run(spark.createDataFrame(rows[40:], "i int, invoice_number string, vendor_name string"), 2)
    whole = store.admission(spark.createDataFrame(rows, "i int, invoice_number string, vendor_name string"), ["i"]).where("stored")
    assert sorted(r.i for r in spark.read.parquet(table).collect()) == sorted(r.i for r in whole.collect())
    streamed = str(tmp_path / "streamed")
    ingest.start(spark.readStream.schema("i int, invoice_number string, vendor_name string").parquet(source), streamed, str(tmp_path / "cp"), ["i"]).awaitTermination()
    assert sorted(r.i for r in spark.read.parquet(streamed).collect()) == sorted(r.i for r in whole.collect())
