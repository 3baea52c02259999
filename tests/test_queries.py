"""Every core query against its SQL twin, at the smallest size."""

import math

import pytest

from quillstone.plans import queries as q

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canon(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return tuple(map(canon, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = q.queries()[name](spark, DATA)
    sql = q.oracle_sql()[name]
    cols = sorted(df.columns)
    assert cols == sorted(duck.sql(sql).columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    key = lambda rows: sorted((tuple(map(canon, r)) for r in rows), key=repr)
    assert key(tuple(r[c] for c in cols) for r in df.collect()) == key(want)


def test_sizes_beyond_a_long(spark, tmp_path):
    """Keys of larger tables, against the same SQL over keys of 128 bits."""
    keys = [*range(8185, 8200), *range(19_995, 20_000), 1_199_999, 4_000_000_004, None]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT CAST(p_partkey AS HUGEINT) AS p_partkey FROM '{tmp_path}/part.parquet/*.parquet'")
    got = {r.k: r["size"] for r in q.queries()["file_size_format"](spark, str(tmp_path)).collect()}
    assert got == dict(c.sql(q.oracle_sql()["file_size_format"]).fetchall())
    assert got[8194] == "8194.2 PB" and got[4_000_000_004] == "4000000004.2 PB"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1500
    assert set(e.oracle_sql()) <= set(e.queries())
