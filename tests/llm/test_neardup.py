import random

import pytest
from brute import components, shingle_set

from quillstone.llm import common, neardup
from quillstone.llm.components import components as connected


def found(df, size):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, size).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_real_documents(spark, documents, size):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert found(documents, size) == components(rows, size)


@pytest.mark.parametrize("size", [2, 5])
def test_large_groups_and_chains(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):  # one group around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i * 3 % 401, " ".join(w)))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(40):  # each resembles its neighbours only
        chain = chain[5:] + [rng.choice(vocabulary) for _ in range(5)]
        rows.append((1000 - i, " ".join(chain)))
    rows += [(2000 + i, " ".join(base)) for i in range(60)] + [(3000 + i, f"only {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(df, size) == components(rows, size)


def test_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd, 2).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and all(by[i].kept for i in (1, 2, 3))
    assert by[4].n_shingles == 1 and sum(r.doc_id == 4 for r in got) == 2
    assert by[None].component_id is None and by[None].kept and by[None].n_shingles == 2
    assert by[7].n_shingles == 1
    assert neardup.near_duplicates(odd.limit(0), 2).count() == 0


def test_an_id_with_two_texts_joins_both(spark):
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u"), (9, "z")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {2: 2, 3: 2, 5: 2, 9: 9}
    rows += [(5, ""), (9, None), (None, "z"), (None, "z")]
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()]
    assert len(got) == len(rows) and {(d, c) for d, c, _ in got} == {(2, 2), (3, 2), (5, 2), (9, 9), (None, None)}
    assert {d for d, _, k in got if k} == {2, 9, None}


def test_texts_of_any_length(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(32_708)]
    more = [f"v{i}" for i in range(200)]
    half = words[:20_000]
    # near copies of 32,708 and 32,908 words, a text and the same text twice
    rows = [(1, " ".join(words)), (2, " ".join(words + more)), (3, " ".join(half[::-1])), (4, " ".join(half[::-1] * 2))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert got == components(rows, 2)
    assert [got[i][1] for i in (1, 2, 3, 4)] == [1, 1, 3, 3]


@pytest.mark.parametrize("size", [2, 5])
def test_recall_at_the_threshold(spark, size):
    """Pairs of a similarity between 0.8 and 0.85, apart from each other and among texts that resemble them less."""
    rng = random.Random(20 + size)
    rows, true = [], 0
    for i in range(400):
        base = [f"{i}w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 400))]
        other = list(base)
        while True:
            at = rng.randrange(len(other))
            other[at] = f"{i}x{rng.randrange(10**6)}"
            x, y = shingle_set(" ".join(base), size), shingle_set(" ".join(other), size)
            if 100 * len(x & y) < 85 * len(x | y):
                break
        true += 100 * len(x & y) >= 80 * len(x | y)
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(other)), (3 * i + 2, " ".join(base[: len(base) * 7 // 10]))]
    want = components(rows, size)
    assert true > 250 and found(spark.createDataFrame(rows, "doc_id long, text string"), size) == want


def test_short_and_empty_partitions_at_an_edge():
    assert neardup._joined_edges({0: 22, 1: 22, 2: 22}) == []
    assert neardup._joined_edges({0: 22, 1: 3, 2: 22}) == [(1, 0)]
    assert neardup._joined_edges({0: 22, 2: 5, 3: 22, 4: 1, 5: 22}) == [(1, 0), (2, 0), (4, 3)]
    assert neardup._joined_edges({}) == [(0, -1)]


def test_few_rows_in_many_partitions(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert found(spark.createDataFrame(rows, "doc_id long, text string"), 2) == components(rows, 2)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_heavy_keys(spark, monkeypatch):
    """Copies, hubs and regions of most rows, joined by broadcast and by shuffle."""
    monkeypatch.setattr(common, "LIGHT_ROWS", 10)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words)) for i in range(200)]
    for i in range(200, 330):
        w = list(words)
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(60)] = f"y{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 2) == components(rows, 2)
    big = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(500)], "k long, v long")
    small = big.groupBy("k").count().withColumnRenamed("count", "rows").where("k < 5")
    got = common.join_heavy(big, small, ["k"], "rows", 500).orderBy("v").collect()
    assert [(r.k, r.v) for r in got] == [(r.k, r.v) for r in big.where("k < 5").orderBy("v").collect()] and "rows" in got[0]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)]
    root = {x: x for e in links for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_few_jobs(spark, monkeypatch):
    """Both ways give the smallest node of each component; few links, whatever their shape, don't cost the driver a plan a step."""
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1500)]
    hub = [(9000, 2000 + i) for i in range(1500)]
    pairs = [(rng.randrange(10_000, 12_000), rng.randrange(10_000, 12_000)) for _ in range(1200)]
    ends = [(-7, 1 << 62), (1 << 62, -(1 << 62)), (5, 5), (None, 3)]
    links = chain + hub + pairs + ends + [(b, a) for a, b in chain[::3]]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            one, two = top(a), top(b)
            root[max(one, two)] = min(one, two)
    want = {x: top(x) for x in root if top(x) != x}
    context = spark.sparkContext
    context.setJobGroup("few links", "")
    got = dict(map(tuple, connected(df).collect()))
    jobs = len(context.statusTracker().getJobIdsForGroup("few links"))
    context.setJobGroup("other", "")
    assert got == want and jobs <= 10, jobs
    monkeypatch.setattr("quillstone.llm.components.ALONE", -1)
    assert dict(map(tuple, connected(df).collect())) == want
    assert connected(df.limit(0)).count() == 0
    monkeypatch.undo()
    assert connected(df.limit(0)).count() == 0
