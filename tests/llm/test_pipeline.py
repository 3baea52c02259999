import corpus_pipeline
from brute import components, contamination
from pyspark.sql import functions as F

from quillstone.llm import langid, queries, secrets


def test_stages(spark, tmp_path, documents, benchmark):
    sf = "/root/testdata/sf0.001"
    docs, frames = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixture":
            assert out.columns == documents.columns and out.dtypes == documents.dtypes
        out.write.parquet(str(tmp_path / name))
        frames[name] = docs = spark.read.parquet(str(tmp_path / name))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    rejected = {r.doc_id for r in langid.predict(documents).where("rejected").collect()}
    assert ids(frames["language"]) == ids(documents) - rejected
    rows = [(r.doc_id, r.text) for r in frames["language"].collect()]
    assert ids(frames["near_dedup"]) == {d for d, (_, c) in components(rows, 5).items() if c == d}
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert ids(frames["decontamination"]) == {r.doc_id for r in frames["near_dedup"].collect() if contamination(r.text, items)[1] == 0}
    texts = {r.doc_id: r.text for r in frames["decontamination"].collect()}
    scanned = secrets.scan(frames["decontamination"], queries.secret_model(spark)).collect()
    found = {r.doc_id: [f.token for f in r.findings if f.p >= 0.5] for r in scanned}
    for r in frames["secret_scan"].collect():
        want = texts[r.doc_id]
        for t in sorted(found[r.doc_id], key=len, reverse=True):
            want = want.replace(t, secrets.MASK)
        assert r.text == want
    assert ids(frames["mixture"]) == ids(frames["secret_scan"])
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, frames["mixture"].collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark, tmp_path, odd):
    sf = "/root/testdata/sf0.001"
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_stages_judge_rows(spark, tmp_path, benchmark):
    """Rows that share an id or have none, and repeated rows."""
    sf = "/root/testdata/sf0.001"
    passage = max((r.text for r in benchmark.collect()), key=len)
    clean, other = "the plain words of a clean text that nothing else resembles at all", "quite another text about some other matter with words of its own"
    rows = [(5, clean), (5, f"before {passage} after"), (None, f"begin {passage} end of it"), (6, other), (6, other), (None, other), (7, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "kept") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string").repartition(3)
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    got = corpus_pipeline.decontamination(spark, docs, sf)
    assert key(got) == sorted([(5, clean), (6, other), (6, other), (None, other), (7, None), (8, ""), (8, "")], key=str)
    assert got.columns == docs.columns
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert key(got) == sorted([r for r in rows if r[1] != other and (r[0] or not r[1])] + [(6, other)], key=str)
    got = corpus_pipeline.language(spark, docs, sf)
    assert all(r.text for r in got.collect()) and got.where("text = '" + other + "'").count() == 3


def test_numbers_of_rows(spark, tmp_path, documents):
    """They differ, and are the same from files whatever the number of partitions."""
    path = str(tmp_path / "docs with a space")
    documents.repartition(7).write.parquet(path)
    docs = spark.read.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in (old, "20000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = corpus_pipeline.numbered(docs)
        found.append({r[corpus_pipeline.ROW]: r.doc_id for r in rows.select(corpus_pipeline.ROW, "doc_id").collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1] and len(found[0]) == documents.count()
    made = corpus_pipeline.numbered(docs.withColumn("_metadata", F.lit(1)))
    assert made.columns == [*docs.columns, "_metadata", corpus_pipeline.ROW] and made.select(corpus_pipeline.ROW).distinct().count() == len(found[0])
